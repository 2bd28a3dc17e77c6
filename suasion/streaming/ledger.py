"""Session ledgers as a stream: what a shopper's session on a site has gone through, kept as state.

One ledger is held for each (client, origin), so all its messages have one writer. A message of another session id than
the ledger's closes it and opens a fresh one; so does a day of event time without messages. What a ledger holds is
bounded: one record a stage, the newest 50 adds, 64 choices and 500 events, and the digests shown.

Messages: client_id, origin, session_id, ts (timestamp), seq (unique in a client's messages), kind, stage, snapshot (price
in minor units), ref, selected. Kinds: ``stage`` (entry, with or without a snapshot), ``add``, ``choice`` (ref is the
add-on family), ``event`` (ref is the detection), ``digest`` (ref is what was shown). Repeated messages count once;
messages that come after the watermark has passed them are dropped; those of one batch are taken in order of (ts, seq).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE_MS = 86_400_000
# fixed values: how many of each a ledger keeps
CAPS = {"add": 50, "choice": 64, "event": 500}

_CHOICE = "addon_key string, selected boolean, ts_ms long"
LEDGER = (
    "client_id long, origin string, session_id string, opened_ms long, version long, closed boolean, stages array<struct<stage: string, entered_ms: bigint, snapshot: bigint>>, adds array<string>, "
    "choices array<struct<addon_key: string, selected: boolean, ts_ms: bigint>>, events array<string>, digests array<string>"
)


class _Ledger:
    """One ledger in a task's memory while a batch of its messages is folded."""

    def __init__(self, session: str, opened_ms: int):
        self.session, self.opened_ms, self.version, self.last_ms = session, opened_ms, 0, opened_ms
        self.stages: dict[str, tuple[int, int | None]] = {}
        self.lists: dict[str, list] = {"add": [], "choice": [], "event": [], "digest": []}

    def take(self, row: tuple) -> None:
        self.last_ms = max(self.last_ms, row.ts_ms)
        if row.kind == "stage":
            entered, snapshot = self.stages.get(row.stage, (row.ts_ms, None))
            given = None if pd.isna(row.snapshot) else int(row.snapshot)
            self.stages[row.stage] = (entered, given if snapshot is None else snapshot)
        elif row.kind == "choice":
            self.lists["choice"].append((row.ref, bool(row.selected), row.ts_ms))
        elif row.kind in self.lists:
            self.lists[row.kind].append((row.ref,))

    def trim(self) -> None:
        for kind, cap in CAPS.items():
            self.lists[kind] = self.lists[kind][-cap:]

    def row(self, key: tuple, closed: bool) -> tuple:
        stages = [{"stage": s, "entered_ms": e, "snapshot": p} for s, (e, p) in sorted(self.stages.items(), key=lambda x: (x[1][0], x[0]))]
        choices = [{"addon_key": k, "selected": on, "ts_ms": t} for k, on, t in self.lists["choice"]]
        plain = {kind: [x for (x,) in self.lists[kind]] for kind in ("add", "event", "digest")}
        return (*key, self.session, self.opened_ms, self.version, closed, stages, plain["add"], choices, plain["event"], plain["digest"])


class LedgerProcessor(StatefulProcessor):
    """State of one (client, origin): a head, a map of stages and four lists."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "session_id string, opened_ms long, version long, last_ms long, timer_ms long")
        self.stages = handle.getMapState("stages", "stage string", "entered_ms long, snapshot long")
        self.lists = {kind: handle.getListState(kind, _CHOICE if kind == "choice" else "ref string") for kind in ("add", "choice", "event", "digest")}

    def _load(self) -> tuple[_Ledger | None, int]:
        if not self.head.exists():
            return None, 0
        session, opened_ms, version, last_ms, timer = self.head.get()
        ledger = _Ledger(session, opened_ms)
        ledger.version, ledger.last_ms = version, last_ms
        ledger.stages = {k[0]: (v[0], v[1]) for k, v in self.stages.iterator()}
        ledger.lists = {kind: [tuple(x) for x in state.get()] for kind, state in self.lists.items()}
        return ledger, timer

    def _clear(self) -> None:
        for state in (self.head, self.stages, *self.lists.values()):
            state.clear()

    def _save(self, ledger: _Ledger, timer: int) -> None:
        self._clear()
        self.head.update((ledger.session, ledger.opened_ms, ledger.version, ledger.last_ms, timer))
        for stage, record in ledger.stages.items():
            self.stages.updateValue((stage,), record)
        for kind, state in self.lists.items():
            if ledger.lists[kind]:
                state.put(ledger.lists[kind])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        ledger, timer = self._load()
        for row in pd.concat(list(rows)).sort_values(["ts_ms", "seq"]).itertuples(index=False):
            stale = ledger is not None and row.ts_ms - ledger.last_ms > IDLE_MS
            if ledger is not None and (ledger.session != row.session_id or stale):
                ledger.trim()
                out.append(ledger.row(key, True))
                ledger = None
            ledger = ledger or _Ledger(row.session_id, row.ts_ms)
            ledger.take(row)
        ledger.trim()
        ledger.version += 1
        out.append(ledger.row(key, False))
        due = max(ledger.last_ms + IDLE_MS, timerValues.getCurrentWatermarkInMs()) + 1
        if timer != due:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self._save(ledger, due)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger, _ = self._load()
        self._clear()
        yield pd.DataFrame([ledger.row(key, True)] if ledger else [], columns=_COLUMNS)

    def close(self) -> None:
        pass


_COLUMNS = ["client_id", "origin", "session_id", "opened_ms", "version", "closed", "stages", "adds", "choices", "events", "digests"]


def ledgers(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each ledger as it stands after every batch that touched it (``closed`` false), and once more when it is closed.

    The newest version of an open ledger replaces the earlier ones. Run it with the settings of ``streaming.run.STORE``.
    """
    timed = messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["client_id", "origin", "seq"])
    rows = timed.select("client_id", "origin", "session_id", F.unix_millis("ts").alias("ts_ms"), "seq", "kind", "stage", "snapshot", "ref", "selected", "ts")
    return rows.groupBy("client_id", "origin").transformWithStateInPandas(LedgerProcessor(), LEDGER, "append", "eventTime")
