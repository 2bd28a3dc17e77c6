"""Streaming forms: page views by idle gap, counters by day, debounce, and nodes that vanish soon after they appear."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from suasion.operators.outcomes import MAX_EXPOSED

VIEW = "view_id long, origin string, started_ms long, funnel_stage string, added boolean, exposed string"
_STATE = "started_ms long, last_ms long, funnel_stage string, exposed string"


def page_views(messages: DataFrame, idle_ms: int, delay: str = "1 hour") -> DataFrame:
    """Views as they close: after an add at once, or once the viewer has been idle for longer than ``idle_ms``.

    Needs view_id, origin, ts (timestamp), seq, funnel_stage, pattern_id, added. State is one row per open view; event
    time closes idle ones, and a view keeps MAX_EXPOSED patterns, so it stays bounded.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = list(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append((*key, now[0], now[2], False, now[3]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts_ms", "seq"])
            for ts, stage, pattern, added in zip(rows["ts_ms"], rows["funnel_stage"], rows["pattern_id"], rows["added"], strict=True):
                if now is not None and ts - now[1] > idle_ms:
                    out.append((*key, now[0], now[2], False, now[3]))
                    now = None
                if now is None:
                    now = [int(ts), int(ts), stage, pattern]
                elif pattern not in (seen := now[3].split(",")) and len(seen) < MAX_EXPOSED:
                    now[3] += "," + pattern
                now[1] = int(ts)
                if added:
                    out.append((*key, now[0], now[2], True, now[3]))
                    now = None
            if now is None:
                state.exists and state.remove()
            else:
                state.update(tuple(now))
                state.setTimeoutTimestamp(max(now[1] + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["view_id", "origin", "started_ms", "funnel_stage", "added", "exposed"])

    timed = messages.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return timed.groupBy("view_id", "origin").applyInPandasWithState(fold, VIEW, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(detections: DataFrame, delay: str = "1 day") -> DataFrame:
    """Detections by day and pattern, emitted when the day can get no more."""
    days = detections.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "pattern_id").agg(F.count("*").alias("n"))
    return days.select(F.floor(F.unix_seconds("w.start") / 86_400).cast("long").alias("day_bucket"), "pattern_id", "n")


def debounce(triggers: DataFrame, keys: tuple[str, ...], delay: str = "40 days") -> DataFrame:
    """The first trigger of each key within the delay."""
    return triggers.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stage_triggers(stages: DataFrame, into: tuple[str, ...] = ("checkout", "payment")) -> DataFrame:
    """To get to the till is a trigger of its own: a checkout_intent for each message of such a stage. Needs page_load, stage, ts."""
    return stages.filter(F.col("stage").isin(*into)).withColumn("kind", F.lit("checkout_intent")).withColumn("label", F.concat(F.lit("stage:"), F.col("stage")))


def ephemeral(inserted: DataFrame, removed: DataFrame, within: str = "15 seconds") -> DataFrame:
    """Nodes removed soon after they appeared: a stream-stream interval join with bounded state."""
    a = inserted.select("node", F.col("ts").alias("inserted_at")).withWatermark("inserted_at", "1 hour")
    b = removed.select(F.col("node").alias("gone"), F.col("ts").alias("removed_at")).withWatermark("removed_at", "1 hour")
    soon = (F.col("node") == F.col("gone")) & (F.col("removed_at") >= F.col("inserted_at")) & (F.col("removed_at") < F.col("inserted_at") + F.expr(f"interval {within}"))
    return a.join(b, soon).select("node", "inserted_at", "removed_at")
