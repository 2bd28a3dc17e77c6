"""Benchmark decontamination: pigeonhole edit matching.

A test item of m characters may occur with up to ``k = floor(m * error_rate)`` edits. Split into k + 1 pieces, at least
one piece must occur unchanged, so exact hits of pieces (hashes of all windows of the whole text, looked up in the sorted
hashes of the pieces) find every occurrence. Around the hits, a count of the q-grams that so many edits must leave drops
most regions, and Myers' bit-parallel algorithm gives the edit distance in the others. The test items go to the tasks in
blocks of at most ``BLOCK_CHARS`` characters, each a broadcast of bounded size and a pass of its own: a benchmark of up to
64 million characters is one pass over the documents, which are never shuffled.

Defined results: letters A-Z match in either case; a null or empty text holds nothing; a null, empty or blank item is
found nowhere; an item shorter than 1 / error_rate is sought exactly; repeated items and rows give rows of their own;
an occurrence is given by code points, end exclusive; bytes that are not UTF-8 match nothing; without items no document
leaks. An item's occurrences in a text do not overlap: from the left, the first end within k edits opens one, of that end
and the 3k ends after it the nearest to the item (in a tie the first) is taken, and the search goes on behind it. Other
columns are not read by ``find_leaks`` and pass, whatever their names, through ``decontaminate``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from suasion.llm import common

ERROR_RATE = 0.08
BLOCK_CHARS = 64_000_000
#: Length of the q-grams that are counted; bits of the table that tells most windows from pieces.
GRAM, FILTER_BITS = 3, 22
_FILTER_SHIFT = np.uint64(64 - FILTER_BITS)
_STEP = np.uint64(0x9E3779B97F4A7C15)
Item = tuple[int, str]


def fold(text: str) -> str:
    """A-Z to lower case; as many characters as before."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def best_substring(item: str, text: str) -> tuple[int, int]:
    """Myers: the smallest edit distance of ``item`` to a substring of ``text``, and the first end where it occurs."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq) & full
        hp = minus | (~(d | plus) & full)
        hm = plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1) & full
        hm = (hm << 1) & full
        plus = hm | (~(x | hp) & full)
        minus = hp & x
        if score < best:
            best, at = score, j + 1
    return best, at


def next_occurrence(item: str, masks: dict[str, int], k: int, text: str, low: int, high: int) -> tuple[int, int] | None:
    """Myers, within text[low:high]: distance and end of the next occurrence with at most k edits.

    The first end within k edits opens it; of that end and the 3k ends after it the nearest to the item, the first of
    such, is taken.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at, stop = k + 1, 0, high
    for j in range(low, high):
        if j >= stop:
            break
        eq = masks.get(text[j], 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq) & full
        hp = minus | (~(d | plus) & full)
        hm = plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1) & full
        hm = (hm << 1) & full
        plus = hm | (~(x | hp) & full)
        minus = hp & x
        if score < best:
            if best > k:
                stop = min(high, j + 1 + 3 * k)
            best, at = score, j + 1
            if not best:
                break
    return (best, at) if best <= k else None


def _points(text: str) -> np.ndarray:
    """Code points, A-Z folded."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points + np.uint32(32) * ((points >= 65) & (points <= 90))


def _windows(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of each window of q code points: their polynomial, spread."""
    n = len(points) - q + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(q if n > 0 else 0):
        out = out * _STEP + points[j : j + n]
    return common.mix(out)


class Matcher:
    """All occurrences of a block of items in texts.

    Pieces are known by the hashes of their first q characters, q being the length of the item's shortest piece: sorted
    arrays of hash, item and offset for each q, about a byte of them for each character of the items.
    """

    def __init__(self, items: list[Item], error_rate: float = ERROR_RATE) -> None:
        self.items = [(i, fold(t)) for i, t in items]
        self.k = np.array([int(len(t) * error_rate) for _, t in self.items], np.int64)
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for n, (_, t) in enumerate(self.items):
            parts = int(self.k[n]) + 1
            q = len(t) // parts
            at = len(t) * np.arange(parts) // parts
            found[q].append((_windows(_points(t), q)[at], np.full(parts, n), at))
        self.anchors = {}
        for q, rows in found.items():
            h, n, at = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(h, kind="stable")
            h = h[order]
            known = np.zeros(1 << FILTER_BITS, bool)
            known[h >> _FILTER_SHIFT] = True
            self.anchors[q] = (h, n[order].astype(np.int32), at[order].astype(np.int32), known)
        self.masks: dict[int, dict[str, int]] = {}
        self.grams: dict[int, np.ndarray] = {}

    def _hits(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(row, item, diagonal), sorted and distinct: where pieces occur unchanged. starts: of the rows, and the end."""
        out = []
        for q, (h, items, offsets, known) in self.anchors.items():
            w = _windows(points, q)
            at = np.flatnonzero(known[w >> _FILTER_SHIFT])
            low, high = np.searchsorted(h, w[at], "left"), np.searchsorted(h, w[at], "right")
            row = np.searchsorted(starts, at, "right") - 1
            some = (high > low) & (at + q <= starts[row + 1])
            at, low, high, row = at[some], low[some], high[some], row[some]
            n = high - low
            which = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out.append(np.column_stack([np.repeat(row, n), items[which], np.repeat(at - starts[row], n) - offsets[which]]))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def _shares_grams(self, n: int, grams: np.ndarray) -> bool:
        """k edits leave at least so many of an item's q-grams as they were: a region with fewer holds no occurrence."""
        mine = self.grams.get(n)
        if mine is None:
            mine = self.grams[n] = _windows(_points(self.items[n][1]), GRAM)
        return np.isin(mine, grams).sum() >= len(mine) - GRAM * self.k[n]

    def _in_region(self, n: int, text: str, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        item, k = self.items[n][1], int(self.k[n])
        masks = self.masks.get(n)
        if masks is None:
            masks = self.masks[n] = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
        while (found := next_occurrence(item, masks, k, text, low, high)) is not None:
            distance, end = found
            back = best_substring(item[::-1], text[max(low, end - len(item) - k) : end][::-1])[1]
            yield distance, end - back, end
            low = end

    def occurrences(self, texts: list[str], first_only: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, distance, start, end); with ``first_only`` one for each text that has any.

        Occurrences of an item in a text do not overlap: they are taken from the left, each as ``next_occurrence`` says,
        and the search goes on where one ends.
        """
        coded = [_points(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        points = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
        hits = self._hits(points, starts)
        if not len(hits):
            return
        grams = _windows(points, GRAM)
        new = (hits[1:, :2] != hits[:-1, :2]).any(1)
        apart = new | (np.diff(hits[:, 2]) > self.k[hits[1:, 1]])
        begins = np.concatenate([[0], np.flatnonzero(apart) + 1])
        ends = np.append(begins[1:], len(hits)) - 1
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            row, n = int(hits[a, 0]), int(hits[a, 1])
            k, m, size = int(self.k[n]), len(self.items[n][1]), int(starts[row + 1] - starts[row])
            low, high = max(0, int(hits[a, 2]) - k), min(size, int(hits[b, 2]) + m + 4 * k)
            if high - low < m - k or not self._shares_grams(n, grams[starts[row] + low : starts[row] + high - GRAM + 1]):
                continue
            mine = regions.setdefault((row, n), [])
            if mine and low <= mine[-1][1]:  # an occurrence may reach from one into the other
                mine[-1][1] = max(high, mine[-1][1])
            else:
                mine.append([low, high])
        text, of, done = "", -1, -1
        for (row, n), mine in regions.items():
            if row == done:
                continue
            if of != row:
                text, of = fold(texts[row]), row
            for found in (x for low, high in mine for x in self._in_region(n, text, low, high)):
                yield row, n, *found
                if first_only:
                    done = row
                    break


_built: dict[tuple[int, float], tuple[list[Item], Matcher]] = {}


def _matcher(shared: Broadcast, error_rate: float) -> Matcher:
    """The matcher of a block: a Python worker that runs several tasks builds it once."""
    key = (id(shared.value), error_rate)
    if key not in _built:
        _built.clear()
        _built[key] = (shared.value, Matcher(shared.value, error_rate))  # the items are held, so their id stays theirs
    return _built[key][1]


def _item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    block: list[Item] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if row["text"] is None or not row["text"].strip():
            continue
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end of every occurrence of a test item."""
    id_kind = documents.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, distance int, start long, end long"
    found: list[DataFrame] = []
    for block in _item_blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, error_rate)
            for batch in batches:
                for low, high, _, _ in common.blocks(batch.column(1)):
                    rows = list(matcher.occurrences(common.texts(batch.column(1).slice(low, high - low))))
                    ids = batch.column(0).take(pa.array([low + r[0] for r in rows], pa.int64()))
                    items = pa.array([matcher.items[r[1]][0] for r in rows], None if rows else pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, items, pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["doc_id", "item_id", "distance", "start", "end"])

        found.append(documents.select("doc_id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else documents.sparkSession.createDataFrame([], schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents, whole and with all their columns, in which no test item occurs."""
    out = documents
    at = documents.columns.index("text")
    for block in _item_blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, error_rate)
            for batch in batches:
                for low, high, _, _ in common.blocks(batch.column(at)):
                    part = batch.slice(low, high - low)
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in matcher.occurrences(common.texts(part.column(at)), first_only=True)]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
    return out
