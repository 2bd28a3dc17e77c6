"""Hashed character n-grams and a logistic model for short texts: one model per pattern, learnt where its rows meet.

What is learnt from is labelled copy, ``max_rows`` of a pattern at most (chosen by hash), so a pattern's group is bounded
and a model is ``DIM`` numbers. Scoring streams over the texts with the models broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: size of the vector, lengths of the n-grams, reserved slots, how a model is learnt
DIM, SHORTEST, LONGEST, RESERVED = 4_096, 3, 5, 8
EPOCHS, RATE, RIDGE, SEED = 60, 0.5, 1e-4, 42
MAX_ROWS = 5_000
_PRIME, _BASIS = 16_777_619, 2_166_136_261


def features(text: str, structure: tuple[bool, bool, float | None] = (False, False, None)) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: signed counts of hashed n-grams at length one, then the slots of (decline control, in a modal, relative font size)."""
    padded = " " + " ".join(text.lower().split()) + " "
    codes = np.frombuffer(padded.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    found = []
    for n in range(SHORTEST, LONGEST + 1):
        h = np.full(max(0, len(codes) - n + 1), _BASIS, np.uint64)
        for j in range(n):
            h = ((h ^ codes[j : j + len(h)]) * np.uint64(_PRIME)) & np.uint64(0xFFFFFFFF)
        found.append(h)
    h = np.concatenate(found)
    dense = np.bincount((h & np.uint64(DIM - 1)).astype(np.int64), np.where(h >> np.uint64(31), -1.0, 1.0), DIM)
    touched = np.unique((h & np.uint64(DIM - 1)).astype(np.int64))
    values = dense[touched] / (np.sqrt((dense * dense).sum()) or 1.0)
    out = dict(zip(touched.tolist(), values.tolist(), strict=True))
    slot = DIM - RESERVED
    for k, on in enumerate(structure[:2]):
        if on:
            out[slot + k] = 1.0
    if structure[2] is not None:
        out[slot + 2] = float(np.clip(structure[2], -2, 2))
    return np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), float, len(out))


def _shuffled(n: int, state: int) -> tuple[list[int], int]:
    """A Fisher-Yates order from a 32-bit congruential generator, and its next state."""
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        state = (state * 1_664_525 + 1_013_904_223) % (1 << 32)
        j = state * (i + 1) >> 32
        order[i], order[j] = order[j], order[i]
    return order, state


def learn(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights and, last, the bias: stochastic gradient steps in a fixed order; a weight shrinks when it is touched."""
    rows = [features(t) for t in texts]
    w, bias, state = np.zeros(DIM), 0.0, SEED
    for _ in range(epochs):
        order, state = _shuffled(len(rows), state)
        for k in order:
            at, v = rows[k]
            miss = 1 / (1 + np.exp(-(w[at] @ v + bias))) - labels[k]
            w[at] -= RATE * (miss * v + RIDGE * w[at])
            bias -= RATE * miss
    return np.append(w, bias)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(pattern_id, trained_on, weights) from (pattern_id, text, label); each pattern in a task of its own."""
    h = F.xxhash64("text", "label")
    rows = labelled.select("pattern_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    copies = rows.groupBy("pattern_id", "text", "label").agg(F.count("*").alias("_times"))
    sizes = copies.groupBy("pattern_id").agg(F.count("*").alias("_of"))
    # by hash first, with a margin, so that the window sorts some 2 * max_rows texts of a large pattern and not all of them
    likely = copies.join(sizes, "pattern_id").filter(h.cast("double") / 2.0**63 <= 4.0 * max_rows / F.col("_of") - 1)
    earlier = F.coalesce(F.sum("_times").over(Window.partitionBy("pattern_id").orderBy(h, "text", "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = likely.withColumn("_earlier", earlier).withColumn("_room", F.least("_times", max_rows - F.col("_earlier"))).filter("_room > 0")
    bounded = room.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_room")))).select("pattern_id", "text", "label", (F.col("_earlier") + F.col("_k")).alias("_nth"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_nth")
        w = learn(pdf["text"].tolist(), pdf["label"].tolist())
        return pd.DataFrame({"pattern_id": [pdf["pattern_id"].iloc[0]], "trained_on": [len(pdf)], "weights": [w.tolist()]})

    return bounded.groupBy("pattern_id").applyInPandas(run, "pattern_id string, trained_on long, weights array<double>")


def score(rows: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """(key, pattern_id, score) of every text by every model; one model for each pattern of the taxonomy at most."""
    known = [(r["pattern_id"], np.array(r["weights"])) for r in models.orderBy("pattern_id").collect()]
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = [n for n, _ in shared.value], np.array([v for _, v in shared.value]).reshape(-1, DIM + 1)
        for batch in batches:
            scores = np.empty((batch.num_rows, len(names)))
            for k, t in enumerate(batch.column(1)):
                at, v = features(t.as_py() or "")
                scores[k] = 1 / (1 + np.exp(-np.clip(w[:, at] @ v + w[:, DIM], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(names)))), pa.array(names * batch.num_rows, pa.string()), pa.array(scores.ravel())], [key, "pattern_id", "score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, pattern_id string, score double")
