"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning runs on a bounded sample of labelled rows (``max_train_rows``, a parameter): hash shards of it go to tasks,
each task runs FTRL-proximal with per-coordinate rates and an L1 term over its shard, and the shards' sparse weights
are averaged. What comes back to the driver is the non-zero weights alone, at most ``2**HASH_BITS`` of them and in
practice a few thousand, so what is shipped to the scoring tasks does not grow with the corpus. Scoring streams over
whole texts, one Arrow batch at a time.

Defined results: a null or empty text has no features and gets the bias alone; a text may be of any length; repeated
rows are scored one by one; without any labelled row every score is the prior 0.5 (predicted 1 by the >= 0.5 rule is
avoided: the bias is then slightly negative); other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm import common

HASH_BITS = 20
#: Word distances of the two-word features: 1 is the bigram, 2 and 3 are skip-grams.
GAPS = (1, 2, 3)
MAX_TRAIN_ROWS = 24_000
SHARD_ROWS = 12_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
_SALT = [np.uint64(x) for x in (0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]
_SHIFT = np.uint64(64 - HASH_BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and row of every unigram, bigram and skip-gram of a block."""
    starts, ends, rows = common.token_spans(data, offsets, "alnum")
    words = common.span_hashes(data, starts, ends)
    index, row = [(words >> _SHIFT).astype(np.int32)], [rows]
    for gap in GAPS:
        if len(words) > gap:
            same = rows[gap:] == rows[:-gap]
            pair = common.mix(words[:-gap] * _SALT[gap] + words[gap:])
            index.append((pair[same] >> _SHIFT).astype(np.int32))
            row.append(rows[gap:][same])
    return np.concatenate(index), np.concatenate(row)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over sets of feature indices, in the order given: non-zero indices, their weights and the bias.

    The bias is one more coordinate (the last), without L1.
    """
    size = 1 << HASH_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, L1)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(examples, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = np.arange(size + 1)
    w = weights(every)
    kept = np.flatnonzero(w[:size])
    return kept, w[kept], float(w[size])


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic", max_train_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights and bias, averaged over the shards of the training sample."""
    sample, shards = common.training_sample(documents, labels, target, max_train_rows, SHARD_ROWS)
    size = 1 << HASH_BITS

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_key", "text"])
        examples = []
        for low, high, data, offsets in common.blocks(pa.array(pdf["text"], pa.large_binary())):
            index, row = features(data, offsets)
            order = np.argsort(row, kind="stable")
            for part in np.split(index[order], np.searchsorted(row[order], np.arange(1, high - low))):
                examples.append(np.append(np.unique(part), size))
        kept, w, bias = ftrl(examples, pdf["label"].to_numpy(float))
        return pd.DataFrame({"i": np.append(kept, size), "w": np.append(w, bias)})

    found = common.as_bytes(sample).groupBy("shard").applyInPandas(learn, "i long, w double").groupBy("i").agg((F.sum("w") / shards).alias("w")).toPandas()
    found = found.sort_values("i")
    at, w = found["i"].to_numpy(np.int64), found["w"].to_numpy()
    bias = float(w[at == size].sum()) if len(at) else -1e-6
    return at[at < size].astype(np.int32), w[at < size].astype(np.float32), bias


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row; whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        table = np.zeros(1 << HASH_BITS, np.float32)
        table[at] = w
        for batch in common.text_slices(batches, 1):
            totals = np.full(batch.num_rows, bias)
            for low, high, data, offsets in common.blocks(batch.column(1)):
                index, row = features(data, offsets)
                hit = np.flatnonzero(table[index])
                once = np.unique((row[hit].astype(np.int64) << HASH_BITS) | index[hit])
                totals[low:high] += np.bincount(once >> HASH_BITS, table[once & ((1 << HASH_BITS) - 1)], high - low)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(totals, -35, 35))))], [id_column, "score"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, score double")


def toxicity(documents: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id and toxicity score of every document, by a model learnt from ``labels.toxic``."""
    return score(documents, fit(documents, labels, "toxic", max_train_rows))
