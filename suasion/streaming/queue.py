"""Two small keyed streams: reporters' queues that are sent in batches, and cards that wait for a shop's next page.

Both take the messages of one batch in the order of (ts, seq).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from suasion.functions.url import DEFAULT_RULES, SuffixRules
from suasion.operators.telemetry import site_of
from suasion.streaming.run import in_order

# fixed values: rows that make a batch, how long fewer may wait, how many a queue keeps, how long a card waits
MIN_BATCH, MAX_AGE_MS, QUEUE_CAP, CARD_MS = 25, 86_400_000, 5_000, 60_000

SENT = "reporter long, sent_ms long, n int, seqs array<bigint>"
HANDED = "site string, card string, asked_seq long, waited_ms long"


class _Queue(StatefulProcessor):
    """State of a reporter: consent and the age of its oldest row, and the rows that wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "consent boolean, timer_ms long")
        self.rows = handle.getListState("rows", "ts_ms long, seq long")

    def _save(self, consent: bool, rows: list[tuple[int, int]], timer: int, watermark: int, before: list[tuple[int, int]]) -> None:
        """Each call to the store is a round trip, so only what has changed is written."""
        due = max(rows[0][0] + MAX_AGE_MS, watermark) + 1 if rows else 0
        if timer != due:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.head.update((consent, due))
        if rows and rows != before:
            self.rows.put(rows)
        elif before and not rows:
            self.rows.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head = self.head.get()
        consent, timer = head or (True, 0)
        # rows wait just where a timer is set
        held = before = [tuple(x) for x in self.rows.get()] if timer else []
        sent = []
        for r in in_order(rows):
            if held and r.ts_ms - held[0][0] > MAX_AGE_MS:
                sent.append((*key, held[0][0] + MAX_AGE_MS, len(held), [s for _, s in held]))
                held = []
            if r.kind == "consent":
                consent = bool(r.given)
                held = held if consent else []
            elif consent and r.sound:
                held = [*held, (int(r.ts_ms), int(r.seq))][-QUEUE_CAP:]
                if len(held) >= MIN_BATCH:
                    sent.append((*key, int(r.ts_ms), len(held), [s for _, s in held]))
                    held = []
        self._save(consent, held, timer, timerValues.getCurrentWatermarkInMs() if held else 0, before)
        if sent:
            yield pd.DataFrame(sent, columns=["reporter", "sent_ms", "n", "seqs"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        consent, _ = self.head.get()
        held = [tuple(x) for x in self.rows.get()]
        self.head.update((consent, 0))
        self.rows.clear()
        yield pd.DataFrame([(*key, held[0][0] + MAX_AGE_MS, len(held), [s for _, s in held])] if held else [], columns=["reporter", "sent_ms", "n", "seqs"])

    def close(self) -> None:
        pass


def sent_batches(queued: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Batches as they are sent: 25 rows, or what has waited for 24 hours. Run it with the settings of ``streaming.run.STORE``.

    Needs reporter, ts, seq, kind (``row`` or ``consent``), given (of a consent) and sound (of a row: it can be parsed; others
    are dropped). Withdrawn consent clears the queue, and nothing is queued until it is given again.
    """
    rows = queued.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.groupBy("reporter").transformWithStateInPandas(_Queue(), SENT, "append", "eventTime")


class _Waiting(StatefulProcessor):
    """State of a shop: the card that waits, read once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", "card string, ts_ms long, timer_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, timer = None, 0
        if self.card.exists():
            card, ts_ms, timer = self.card.get()
            waiting = (card, ts_ms)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_ms", "seq"]).itertuples(index=False):
            if r.kind == "card":
                waiting = (r.card, int(r.ts_ms))
                continue
            if r.kind == "ask" and waiting and r.ts_ms - waiting[1] <= CARD_MS:
                out.append((*key, waiting[0], int(r.seq), int(r.ts_ms) - waiting[1]))
            waiting = None
        due = max(waiting[1] + CARD_MS, timerValues.getCurrentWatermarkInMs()) + 1 if waiting else 0
        if timer != due:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        if waiting:
            self.card.update((*waiting, due))
        else:
            self.card.clear()
        yield pd.DataFrame(out, columns=["site", "card", "asked_seq", "waited_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.card.clear()
        yield pd.DataFrame([], columns=["site", "card", "asked_seq", "waited_ms"])

    def close(self) -> None:
        pass


def handed_over(messages: DataFrame, rules: SuffixRules = DEFAULT_RULES, delay: str = "1 minute") -> DataFrame:
    """Cards that the next page of their shop asked for within 60 s, whatever its subdomain. Run it with ``streaming.run.STORE``.

    Needs origin, ts, seq, kind (``card``, ``ask``, ``seen``) and card. A newer card replaces the one that waits; asking takes
    it away in time or not, and so does its being seen.
    """
    rows = messages.withColumn("site", site_of(F.col("origin"), rules)).filter("site is not null").withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.select("site", "ts", "ts_ms", "seq", "kind", "card").groupBy("site").transformWithStateInPandas(_Waiting(), HANDED, "append", "eventTime")
