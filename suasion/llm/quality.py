"""Quality: a linear-chain conditional random field labels each line good or bad.

A line's features are binned surface statistics of the line and of its two neighbours; two transition weights tie the
labels of consecutive lines. Lines take the label of their document for learning (documents are labelled, lines are
not). Forward-backward gives each line's probability of being good, and the mean of these, weighted by line length,
is the document's quality. Learning uses a bounded sample of labelled rows (``max_train_rows``); hash shards of it are
fitted in tasks of their own and averaged. The model is ``N_FEATURES`` + 2 numbers, whatever the corpus.

Defined results: a null or empty text is one empty line; a text of any length is read whole, its lines one after
another in one pass; repeated rows are scored one by one; without labelled rows every score is 0.5; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from suasion.llm import common

MAX_TRAIN_ROWS = 8_000
SHARD_ROWS = 4_000
EDGES = np.array([0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75])
LENGTH_EDGES = np.array([1.0, 10, 30, 80, 200, 500, 2000])
#: upper, digit, mark, symbol, blank, short-word, distinct-word, repeated-word shares, longest-word share, line length.
N_STATS = 10
BINS = len(EDGES) + 1
#: Own line, line before, line after, each with a bin that says there is no such line.
N_FEATURES = 3 * N_STATS * (BINS + 1) + 1
EPOCHS, RATE, RIDGE, BATCH = 12, 0.15, 1e-3, 32


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = (_table(bytes(range(65, 91))), _table(bytes(range(97, 123)) + bytes(range(128, 256))), _table(b"0123456789"), _table(b".,;:!?'\"()-"), _table(b"#$%&*|@^~<>{}[]\\/_+="), _table(common.BLANKS.encode()))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of a block: its row, its length in bytes and its ``3 * N_STATS`` feature indices."""
    breaks = np.flatnonzero(data == 10)
    breaks = np.column_stack([breaks, breaks + 1])
    starts = np.sort(np.concatenate([offsets[:-1], breaks[:, 1]]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks[:, 0]]), kind="stable")
    rows = np.searchsorted(offsets, starts, "right") - 1
    # an empty row starts where the next one does: give each of the equal offsets its own row
    first = np.searchsorted(starts, offsets[:-1], "left")
    empty = offsets[:-1] == offsets[1:]
    same = np.arange(len(offsets) - 1) - np.searchsorted(offsets[:-1], offsets[:-1], "left")
    rows[(first + same)[empty]] = np.flatnonzero(empty)
    length = (ends - starts).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[ends] - sums[starts]).astype(float)

    upper, lower, digit, mark, symbol, blank = (count(c[data]) for c in _CLASSES)
    t0, t1, _ = common.token_spans(data, offsets)
    of = np.searchsorted(starts, t0, "right") - 1
    words = np.bincount(of, minlength=len(starts)).astype(float)
    hashes = common.span_hashes(data, t0, t1)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=len(starts))
    again = np.zeros(len(of), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    repeated = np.bincount(of[again], minlength=len(starts))
    short = np.bincount(of[t1 - t0 <= 2], minlength=len(starts))
    longest = np.zeros(len(starts))
    np.maximum.at(longest, of, t1 - t0)
    n, w = np.maximum(length, 1), np.maximum(words, 1)
    shares = [upper / np.maximum(upper + lower, 1), digit / n, mark / n, symbol / n, blank / n, short / w, 1 - distinct / w, repeated / w, np.minimum(longest / 100, 1)]
    bins = np.column_stack([*(np.searchsorted(EDGES, s, "right") for s in shares), np.searchsorted(LENGTH_EDGES, length, "right")])
    none = np.full((1, N_STATS), BINS)
    before, after = np.vstack([none, bins[:-1]]), np.vstack([bins[1:], none])
    edge = rows[1:] != rows[:-1]
    before[1:][edge] = BINS
    after[:-1][edge] = BINS
    own = np.arange(3 * N_STATS) * (BINS + 1)
    return rows, n, (np.hstack([bins, before, after]) + own).astype(np.int32)


def marginals(gain: np.ndarray, stay: float, swap: float) -> np.ndarray:
    """P(good) of each line of one document. gain: a line's score of good less that of bad; stay and swap: of a pair of lines with equal and with unequal labels."""
    a, b = np.exp(stay), np.exp(swap)
    n = len(gain)
    forward, backward = np.empty(n), np.empty(n)
    f = np.exp(np.clip(gain, -30, 30)).tolist()
    x = 1.0
    for k in range(n):  # odds of good from what lies before, then with the line itself
        x = (x * a + b) / (x * b + a) if k else 1.0
        forward[k] = x
        x = min(max(x * f[k], 1e-30), 1e30)
    x = 1.0
    for k in range(n - 1, -1, -1):
        x = (x * a + b) / (x * b + a) if k < n - 1 else 1.0
        backward[k] = x
        x = min(max(x * f[k], 1e-30), 1e30)
    odds = forward * backward * np.asarray(f)
    return odds / (1 + odds)


def gradients(gains: np.ndarray, lengths: np.ndarray, y: np.ndarray, stay: float, swap: float) -> tuple[np.ndarray, float]:
    """For padded rows of line gains with one label a row: d(log likelihood)/d(gain) of each line, and the summed d/d(stay) (that of swap is its negative, as lines of a document never change label)."""
    n, most = gains.shape
    live = np.arange(most)[None, :] < lengths[:, None]
    t = np.array([[stay, swap], [swap, stay]])
    e = np.stack([np.zeros_like(gains), np.where(live, gains, 0.0)], 2)
    alpha = np.empty((n, most, 2))
    alpha[:, 0] = e[:, 0]
    for k in range(1, most):
        alpha[:, k] = np.where(live[:, k, None], np.logaddexp(alpha[:, k - 1, :1] + t[0], alpha[:, k - 1, 1:] + t[1]) + e[:, k], alpha[:, k - 1])
    beta = np.zeros((n, most, 2))
    for k in range(most - 2, -1, -1):
        x = beta[:, k + 1] + e[:, k + 1]
        beta[:, k] = np.where(live[:, k + 1, None], np.logaddexp(x[:, :1] + t[:, 0], x[:, 1:] + t[:, 1]), 0.0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
    kept = 0.0
    for s in (0, 1):
        pair = np.exp(alpha[:, :-1, s] + stay + e[:, 1:, s] + beta[:, 1:, s] - z[:, None])
        kept += float((pair * live[:, 1:]).sum())
    return np.where(live, y[:, None] - p, 0.0), float(live[:, 1:].sum()) - kept


def train(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> np.ndarray:
    """AdaGrad over minibatches of documents of similar length: line weights, then stay and swap."""
    w, seen = np.zeros(N_FEATURES + 2), np.full(N_FEATURES + 2, 1e-6)
    rng = np.random.default_rng(seed)
    by_length = np.argsort([len(d) for d in docs], kind="stable")
    groups = np.array_split(by_length, max(1, len(docs) // BATCH))
    for _ in range(EPOCHS):
        for g in rng.permutation(len(groups)):
            members = groups[g]
            lengths = np.array([len(docs[i]) for i in members])
            x = np.concatenate([docs[i] for i in members])
            flat = w[x].sum(1) + w[N_FEATURES - 1]
            live = np.arange(lengths.max())[None, :] < lengths[:, None]
            gains = np.zeros(live.shape)
            gains[live] = flat
            d, stay = gradients(gains, lengths, y[members], w[-2], w[-1])
            share = (1 / lengths)[:, None] * np.ones_like(gains)  # a document counts once, however many lines it has
            each = (d * share)[live]
            grad = -RIDGE * w
            grad[: N_FEATURES - 1] += np.bincount(x.ravel(), np.repeat(each, x.shape[1]), N_FEATURES - 1) / len(members)
            grad[N_FEATURES - 1] += each.sum() / len(members)
            grad[-2] += stay / lengths.sum()
            grad[-1] -= stay / lengths.sum()
            seen += grad * grad
            w += RATE * grad / np.sqrt(seen)
    w[-2:] = np.clip(w[-2:], -2, 2)
    return w


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """Weights averaged over the shards of the training sample."""
    sample, _ = common.training_sample(documents, labels, target, max_train_rows, SHARD_ROWS)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_key", "text"])
        docs = []
        for low, high, data, offsets in common.blocks(pa.array(pdf["text"], pa.large_binary())):
            rows, _, x = line_features(data, offsets)
            docs += np.split(x, np.searchsorted(rows, np.arange(1, high - low)))
        return pd.DataFrame({"w": [train(docs, pdf["label"].to_numpy(float)).tolist()]})

    found = [np.array(r["w"]) for r in common.as_bytes(sample).groupBy("shard").applyInPandas(learn, "w array<double>").collect()]
    return np.mean(sorted(found, key=lambda w: w.tolist()), axis=0) if found else np.zeros(N_FEATURES + 2)


def _scores(column: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality, lines and good lines of each text of a batch."""
    n = len(column)
    out, lines, good = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for low, high, data, offsets in common.blocks(column):
        rows, size, x = line_features(data, offsets)
        gain = w[x].sum(1) + w[N_FEATURES - 1]
        cuts = np.append(np.searchsorted(rows, np.arange(high - low)), len(rows))
        for k in range(high - low):
            a, b = cuts[k], cuts[k + 1]
            p = marginals(gain[a:b], w[-2], w[-1])
            out[low + k] = min(1.0, float(p @ size[a:b] / size[a:b].sum()))
            lines[low + k], good[low + k] = b - a, (p >= 0.5).sum()
    return out, lines, good


def score(documents: DataFrame, weights: np.ndarray, id_column: str = "doc_id") -> DataFrame:
    """(id, score, n_lines, n_good_lines) of every row; whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, 1):
            out, lines, good = _scores(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(lines), pa.array(good)], [id_column, "score", "n_lines", "n_good_lines"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, score double, n_lines long, n_good_lines long")


def quality(documents: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id and quality score of every document, by a model learnt from ``labels.quality``."""
    return score(documents, fit(documents, labels, "quality", max_train_rows))


def keep_good(documents: DataFrame, labels: DataFrame, min_quality: float = 0.3, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The documents that score ``min_quality`` or more, with all their columns; rows are scored as they stream by."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, "quality", max_train_rows))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, at):
            yield batch.filter(pa.array(_scores(batch.column(at), shared.value)[0] >= min_quality))

    return documents.mapInArrow(run, documents.schema)
