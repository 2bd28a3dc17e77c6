"""From detections to what is shown: eligibility, one per family, the best few, capacity, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suasion.operators.dims import EPHEMERAL_GATE_MS, GATE_MS, SURFACE_THRESHOLD, taxonomy

MAX_ITEMS = 4


#: How long the findings that no page shows are taken to have been visible.
UNSEEN_VISIBLE_MS = 2_000


def union_pools(page: DataFrame, *others: DataFrame) -> DataFrame:
    """Page candidates and those of charges, baskets and repeat visits as one pool, each with its source.

    What is not on a page was not watched: it counts as visible for UNSEEN_VISIBLE_MS, not ephemeral and prominent. Columns
    that a pool lacks are null.
    """
    out = page.withColumn("pool", F.lit("page"))
    for pool in others:
        out = out.unionByName(pool.withColumns({"visible_ms": F.lit(UNSEEN_VISIBLE_MS), "ephemeral": F.lit(False), "prominent": F.lit(True)}), allowMissingColumns=True)
    return out


def decide(inputs: DataFrame, disabled: tuple[str, ...] = (), max_items: int = MAX_ITEMS, threshold: float = SURFACE_THRESHOLD, digest: str = "digest_id", index: str = "input_index") -> DataFrame:
    """rank, surfaced and reason of every input, decided within its digest.

    One shuffle by digest serves both windows. The reasons, first that holds: unknown pattern, disabled, below the
    threshold, not on screen long enough, another of the family ranks higher (the earlier on ties), no room.
    """
    known = inputs.join(F.broadcast(taxonomy(inputs.sparkSession)), "pattern_id", "left")
    rank = F.when(F.col("severity").isNull(), F.lit(0.0)).otherwise(F.col("raw_score") * F.log(1 + F.col("visible_ms") / 1000) * F.col("severity"))
    gate = F.col("visible_ms") >= F.when(F.col("ephemeral"), EPHEMERAL_GATE_MS).otherwise(GATE_MS)
    bad = (
        F.when(F.col("family").isNull(), "below_threshold")
        .when(F.col("detector_id").isin(*disabled) | F.col("pattern_id").isin(*disabled) if disabled else F.lit(False), "user_disabled")
        .when(F.col("raw_score") < threshold, "below_threshold")
        .when(~gate, "below_salience_gate")
    )
    judged = known.withColumn("rank", rank).withColumn("bad", bad)
    family = Window.partitionBy(digest, "family", F.col("bad").isNull())
    best = judged.withColumn("nth", F.row_number().over(family.orderBy(F.desc("rank"), index))).withColumn("slot", F.min(index).over(family))
    lead = F.col("bad").isNull() & (F.col("nth") == 1)
    place = F.row_number().over(Window.partitionBy(digest, lead).orderBy(F.desc("rank"), "slot"))
    placed = best.withColumn("place", F.when(lead, place))
    reason = F.coalesce(F.col("bad"), F.when(F.col("nth") > 1, "dedup_family"), F.when(F.col("place") > max_items, "digest_full"), F.lit("none"))
    return placed.withColumn("reason", reason).withColumn("surfaced", F.col("reason") == "none").drop("bad", "nth", "slot", "family", "severity")


def with_capacity(decisions: DataFrame, capacity: int) -> DataFrame:
    """Surfaced rows beyond the room on the page become placement_suppressed; mode is card, pill or suppressed."""
    shown = F.col("surfaced") & (F.col("place") <= capacity)
    mode = F.when(shown, "card").when(F.col("surfaced"), "pill").otherwise("suppressed")
    return decisions.withColumn("mode", mode).withColumn("reason", F.when(F.col("surfaced") & ~shown, "placement_suppressed").otherwise(F.col("reason")))


def debounce(digests: DataFrame, once_per_site: bool = False) -> DataFrame:
    """Keep a session's first digest for each origin, stage and page (or for each origin)."""
    key = ("session_id", "origin") if once_per_site else ("session_id", "origin", "stage", "page")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ts_ms", "seq"))
    return digests.withColumn("show", nth == 1).withColumn("reason", F.when(F.col("show"), "none").otherwise("debounced"))


def gate(digests: DataFrame, frequency: Column) -> DataFrame:
    """``show`` and ``reason`` of each digest under its shopper's setting, which may change within a session.

    ``off`` and ``never_interrupt`` show nothing; ``once_per_site`` shows one only where the session saw none of the origin
    yet; any other setting shows the first of each origin, stage and page. Needs session_id, origin, stage, page, ts_ms, seq.

    The first digest of an origin that is not switched off is shown in any case, and is the only one that once_per_site
    can show; so a digest is shown if it is that one, or, under the last setting, if it is the first of its page under that
    setting and that one was not of the page.
    """
    order = lambda *key: Window.partitionBy(*key).orderBy("ts_ms", "seq")
    off, once = F.coalesce(frequency.isin("off", "never_interrupt"), F.lit(False)), F.coalesce(frequency == "once_per_site", F.lit(False))
    page = ("session_id", "origin", "stage", "page")
    kind = digests.withColumn("_kind", F.when(off, "off").when(once, "once").otherwise("page")).withColumn("_on", ~off)
    opened = kind.withColumn("_first", F.col("_on") & (F.row_number().over(order("session_id", "origin", "_on")) == 1))
    met = F.max("_first").over(order(*page).rowsBetween(Window.unboundedPreceding, -1))
    turned = opened.withColumn("_met", F.coalesce(met, F.lit(False))).withColumn("_nth", F.row_number().over(order(*page, "_kind")))
    show = F.col("_first") | ((F.col("_kind") == "page") & (F.col("_nth") == 1) & ~F.col("_met"))
    reason = F.when(off, "user_disabled").when(F.col("show"), "none").otherwise("debounced")
    return turned.withColumn("show", show).withColumn("reason", reason).drop("_kind", "_on", "_first", "_met", "_nth")


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each (page, pattern, text): the first by detector order and node."""
    nth = F.row_number().over(Window.partitionBy("page_id", "pattern_id", "text_hash").orderBy("detector_order", "idx"))
    return candidates.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
