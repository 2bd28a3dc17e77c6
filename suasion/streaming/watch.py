"""What a page's mutation records tell, as one stateful stream: text histories, short-lived elements, interruptions.

Rows out, by ``what``:

* ``text``: an element's text changed to one with a digit (the newest twelve of each element are its history);
* ``ephemeral``: an element was removed within 15 s of its insertion (``since_ms``);
* ``modal``: an interruption nobody asked for, and ``exit_modal`` beside it if it answered a leaving shopper.

A wrapper and what is in it are one interruption, told of the outermost; a backdrop is none; one that comes back counts
again after it was away for 1.5 s; one that follows a gesture within 0.75 s was asked for, unless the shopper was leaving.
State is bounded: 2,000 elements with texts, 2,000 insertions, 24 modals a page, and a page is forgotten after a day of
event time without records. Records of one batch are taken in order of (ts, seq); records that the watermark has passed
are taken as they come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from suasion.operators.history import EXIT_MS, GESTURE_MS, HIDDEN_MS, TEXT_MOST
from suasion.streaming.run import in_order

EPHEMERAL_MS, IDLE_MS = 15_000, 86_400_000
MAX_ELEMENTS, MAX_MODALS, NEST = 2_000, 24, 6
SEEN = "page_id long, what string, path string, ts_ms long, seq long, text string, since_ms long"
_COLUMNS = ["page_id", "what", "path", "ts_ms", "seq", "text", "since_ms"]
_SPACE = re.compile(r"\s+")


def ancestors(path: str, most: int = NEST) -> list[str]:
    """The nearest ``most`` ancestors of a path, nearest first, without body."""
    steps = path.split(">")
    return [">".join(steps[:n]) for n in range(len(steps) - 1, 1, -1)][:most]


def within(inner: str, outer: str) -> bool:
    return inner.startswith(outer + ">")


class Page:
    """One page's memory while a batch of its records is folded."""

    def __init__(self) -> None:
        self.recording, self.gesture, self.leaving, self.last_ms = False, None, None, 0
        self.texts: dict[str, str] = {}
        self.born: dict[str, int] = {}
        self.modals: dict[str, tuple[bool, int | None]] = {}  # shown before, hidden since
        self.looks: dict[str, bool] = {}  # paths that look like modals now: whether empty

    def take(self, r) -> list[tuple]:
        self.last_ms = max(self.last_ms, r.ts_ms)
        if r.kind in ("insert", "show", "text") and not r.empty:
            for path in ancestors(r.path):  # what holds something is no backdrop any more
                if path in self.looks:
                    self.looks[path] = False
        if r.kind == "gesture":
            self.gesture = r.ts_ms
        elif r.kind == "exit":
            self.leaving = r.ts_ms
        elif r.kind == "recording":
            self.recording = True
        elif r.kind == "remove":
            return self._removed(r)
        elif r.kind == "text":
            return self._text(r)
        else:
            out = []
            if r.kind == "insert":
                if self.recording:
                    self.born.pop(r.path, None)
                    self.born[r.path] = r.ts_ms
                    _oldest_out(self.born, MAX_ELEMENTS)
                out = self._text(r)
            return out + self._modal(r)
        return []

    def _text(self, r) -> list[tuple]:
        text = _SPACE.sub(" ", r.text or "").strip()[:TEXT_MOST] if isinstance(r.text, str) else ""
        if not self.recording or not re.search(r"[0-9]", text) or self.texts.get(r.path) == text:
            return []
        self.texts.pop(r.path, None)
        self.texts[r.path] = text
        _oldest_out(self.texts, MAX_ELEMENTS)
        return [("text", r.path, r.ts_ms, r.seq, text, None)]

    def _removed(self, r) -> list[tuple]:
        self.looks.pop(r.path, None)
        shown, hidden = self.modals.get(r.path, (None, None))
        if shown is not None and hidden is None:
            self.modals[r.path] = (shown, r.ts_ms)
        at = self.born.pop(r.path, None)
        return [("ephemeral", r.path, r.ts_ms, r.seq, None, at)] if at is not None and r.ts_ms - at < EPHEMERAL_MS else []

    def _modal(self, r) -> list[tuple]:
        watch = self.modals.get(r.path)
        if not r.modal:
            self.looks.pop(r.path, None)
            if watch is not None:
                self.modals[r.path] = (watch[0], r.ts_ms if watch[1] is None else watch[1])
            elif r.dialog:
                self._watch(r.path, False, r.ts_ms)
            return []
        self.looks[r.path] = r.empty
        _oldest_out(self.looks, MAX_MODALS)
        if watch is not None and watch[0]:
            self.modals[r.path] = (True, None)
            return self._told(r, r.path) if watch[1] is not None and r.ts_ms - watch[1] >= HIDDEN_MS else []
        if r.empty or any(shown and p != r.path and (within(r.path, p) or within(p, r.path)) for p, (shown, _) in self.modals.items()):
            return []
        around = [p for p in ancestors(r.path) if self.looks.get(p) is False]
        self._watch(r.path, True, None)
        if around:
            self._watch(around[-1], True, None)
        return self._told(r, around[-1] if around else r.path)

    def _watch(self, path: str, shown: bool, hidden: int | None) -> None:
        self.modals[path] = (shown, hidden)
        _oldest_out(self.modals, MAX_MODALS)

    def _told(self, r, path: str) -> list[tuple]:
        leaving = self.leaving is not None and r.ts_ms - self.leaving <= EXIT_MS
        if not leaving and self.gesture is not None and r.ts_ms - self.gesture < GESTURE_MS:
            return []
        row = (path, r.ts_ms, r.seq, None, None)
        return [("modal", *row)] + ([("exit_modal", *row)] if leaving else [])


def _oldest_out(kept: dict, most: int) -> None:
    while len(kept) > most:
        del kept[next(iter(kept))]


class Watcher(StatefulProcessor):
    """State of one page: a head, and maps of texts, insertions and modals that are written where they changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "recording boolean, gesture long, leaving long, last_ms long, timer_ms long")
        self.texts = handle.getMapState("texts", "path string", "text string, at long")
        self.born = handle.getMapState("born", "path string", "ms long, at long")
        self.modals = handle.getMapState("modals", "path string", "shown boolean, hidden long, at long")
        self.looks = handle.getMapState("looks", "path string", "empty boolean, at long")

    def _maps(self) -> dict:
        return {"texts": self.texts, "born": self.born, "modals": self.modals, "looks": self.looks}

    def _load(self) -> tuple[Page, int, dict[str, dict[str, tuple]]]:
        """The page, its timer, and what each map holds in the store."""
        page, timer, stored = Page(), 0, {name: {} for name in self._maps()}
        head = self.head.get()
        if head is not None:
            page.recording, page.gesture, page.leaving, page.last_ms, timer = head
            for name, state in self._maps().items():
                stored[name] = {k[0]: tuple(v) for k, v in state.iterator()}
                rows = sorted(stored[name].items(), key=lambda x: x[1][-1])
                setattr(page, name, {k: v[0] if len(v) == 2 else v[:-1] for k, v in rows})
        return page, timer, stored

    def _save(self, page: Page, due: int, stored: dict[str, dict[str, tuple]]) -> None:
        """Each call to the store is a round trip, so only entries that have changed are written or removed."""
        self.head.update((page.recording, page.gesture, page.leaving, page.last_ms, due))
        for name, state in self._maps().items():
            now = {path: (*(value if isinstance(value, tuple) else (value,)), at) for at, (path, value) in enumerate(getattr(page, name).items())}
            for path in stored[name].keys() - now.keys():
                state.removeKey((path,))
            for path, value in now.items():
                if stored[name].get(path) != value:
                    state.updateValue((path,), value)

    def _clear(self) -> None:
        self.head.clear()
        for state in self._maps().values():
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        page, timer, stored = self._load()
        out = []
        for r in in_order(rows):
            if page.last_ms and r.ts_ms - page.last_ms > IDLE_MS:
                page = Page()
            out += [(*key, *x) for x in page.take(r)]
        due = max(page.last_ms + IDLE_MS, timerValues.getCurrentWatermarkInMs()) + 1
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        self._save(page, due, stored)
        if out:
            frame = pd.DataFrame(out, columns=_COLUMNS)
            frame["since_ms"] = frame["since_ms"].astype("Int64")
            yield frame

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._clear()
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def watch(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream of what the mutation records of ``sources.changes`` tell. Run it with the settings of ``streaming.run.STORE``."""
    rows = changes.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.groupBy("page_id").transformWithStateInPandas(Watcher(), SEEN, "append", "eventTime")
