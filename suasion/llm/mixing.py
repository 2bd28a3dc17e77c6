"""Mixing to target weights with soft membership.

A classifier learnt from a labelled table gives every document a posterior over the target domains. Each document has
a rate r >= min_rate; the expected tokens of domain j are the sum of r * tokens * posterior_j. The rates are fitted to
the targets by least squares (errors weighed by the domains' wanted totals), and of the rates that fit equally well those
nearest to 1 are taken. Such rates are one gradient step from 1, projected on r >= min_rate: max(min_rate, 1 - posterior .
step). So the whole state of the fit is one short vector, which Newton's method with a line search finds: a pass is one
distributed sum over the stored (tokens, posterior) rows, which returns about k * k / 2 numbers for k domains. Nothing
per document comes to the driver, and no pass shuffles documents. The passes end when every domain is within TOLERANCE of
its wanted total (``met``), or when the projected gradient is 0, as the targets cannot be met by any rates (a warning
gives wanted and reached shares); a fit that comes to neither within MAX_PASSES is an error.

The token budget is the smallest at which no domain must shrink: targets are met by repeating, not by dropping. With
``min_rate`` 1 every document is kept at least once. ``copies`` realises a rate: its whole part, and one more with the
probability of the rest, by a hash of doc_id.

Defined results: a null or empty text has 0 tokens, the posterior of the classifier's biases and its rate; texts are
read whole; repeated rows are mixed one by one, and drawn alike; a target domain without labelled rows gets no membership and its weight
is shared among the others; an empty table gives no rows; other columns, whatever their names, pass through ``mix``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from suasion.llm import common

HASH_BITS = 15
MAX_TRAIN_ROWS = 3_000
EPOCHS, RATE, RIDGE = 6, 0.5, 1e-5
#: TOLERANCE: of each wanted total. NEAR: the weight of the rates' distance from 1 beside the errors.
MAX_PASSES, TOLERANCE, NEAR, STATIONARY = 200, 1e-3, 1e-7, 1e-8
#: Shares of tokens by domain of the registered query and the pipeline.
TARGETS = {"de": 0.175, "en": 0.5, "es": 0.15, "fr": 0.175}
_SHIFT = np.uint64(64 - HASH_BITS)


def _word_index(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = common.token_spans(data, offsets, "alnum")
    return (common.span_hashes(data, starts, ends) >> _SHIFT).astype(np.int32), rows


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_classifier(documents: DataFrame, labelled: DataFrame, n_domains: int, max_train_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """Softmax regression on shares of hashed words: (2**HASH_BITS + 1) x n_domains weights, the biases last.

    ``labelled`` has doc_id and domain (an index); about ``max_train_rows`` of its rows are used, in one task.
    """
    sample, _ = common.training_sample(documents, labelled, "domain", max_train_rows, max_train_rows)
    size = 1 << HASH_BITS

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_key", "text"])
        examples = []
        for low, high, data, offsets in common.blocks(pa.array(pdf["text"], pa.large_binary())):
            index, rows = _word_index(data, offsets)
            for part in np.split(index, np.searchsorted(rows, np.arange(1, high - low))):
                examples.append(np.unique(part, return_counts=True))
        y = pdf["label"].to_numpy(int)
        w, seen = np.zeros((size + 1, n_domains)), np.full((size + 1, n_domains), 1e-4)
        for _ in range(EPOCHS):
            for (at, n), label in zip(examples, y, strict=True):
                x = n / max(1, n.sum()) * 8
                p = _softmax(x @ w[at] + w[size])
                p[label] -= 1
                g = x[:, None] * p + RIDGE * w[at]
                seen[at] += g * g
                w[at] -= RATE * g / np.sqrt(seen[at])
                seen[size] += p * p
                w[size] -= RATE * 0.1 * p / np.sqrt(seen[size])
        w[:, np.setdiff1d(np.arange(n_domains), y)] = 0
        w[size, np.setdiff1d(np.arange(n_domains), y)] = -50
        kept = np.flatnonzero(np.abs(w).sum(1))
        return pd.DataFrame({"i": kept, "w": list(w[kept])})

    found = common.as_bytes(sample).groupBy("shard").applyInPandas(learn, "i long, w array<double>").toPandas()
    out = np.zeros((size + 1, n_domains))
    for i, w in zip(found["i"], found["w"], strict=True):
        out[i] += w
    return out


def _posteriors(column: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blank-separated words and posterior of each text of a batch."""
    size, k = w.shape[0] - 1, w.shape[1]
    tokens, p = np.zeros(len(column), np.int64), np.zeros((len(column), k))
    for low, high, data, offsets in common.blocks(column):
        tokens[low:high] = np.bincount(common.token_spans(data, offsets)[2], minlength=high - low)
        index, rows = _word_index(data, offsets)
        n = np.maximum(np.bincount(rows, minlength=high - low), 1)
        z = np.column_stack([np.bincount(rows, w[index, j], high - low) for j in range(k)]) * 8 / n[:, None] + w[size]
        p[low:high] = _softmax(z)
    return tokens, p


def _rate(posterior: Column, steps: list[list[float]], min_rate: float) -> Column:
    """Replay the steps: rate <- max(min_rate, rate - posterior . step), from 1."""
    if not steps:
        return F.lit(1.0)
    rows = F.from_json(F.lit(str(steps)), "array<array<double>>")
    dot = lambda step: F.aggregate(F.zip_with(posterior, step, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(rows, F.lit(1.0), lambda r, step: F.greatest(F.lit(float(min_rate)), r - dot(step)))


class Fit(NamedTuple):
    """The steps of the rates, the domain totals wanted and those reached, and whether these are within TOLERANCE."""

    steps: list[list[float]]
    wanted: np.ndarray
    reached: np.ndarray
    met: bool


def fit_rates(members: DataFrame, targets: list[float], min_rate: float = 0.0) -> Fit:
    """Fit the rates of (tokens, posterior) rows to the targets, as the module says."""
    k, least = len(targets), float(min_rate)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum, over rows, of the integral of the rate; domain totals; their slopes over the rows free to move."""
        p, t = [F.col("posterior")[j] for j in range(k)], F.col("tokens")
        moved = sum((p[j] * F.lit(float(-step[j])) for j in range(k)), F.lit(1.0))
        rows = members.select(t, *(p[j].alias(f"p{j}") for j in range(k)), moved.alias("x"))
        x, rate = F.col("x"), F.greatest(F.lit(least), F.col("x"))
        free = F.when(x >= least, t).otherwise(0)
        row = rows.agg(
            F.sum(t * F.when(x >= least, x * x / 2).otherwise(least * x - least * least / 2)).alias("v"),
            *(F.sum(t * rate * F.col(f"p{j}")).alias(f"m{j}") for j in range(k)),
            *(F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"h{i}_{j}") for i, j in pairs),
        ).first()
        slopes = np.zeros((k, k))
        for i, j in pairs:
            slopes[i, j] = slopes[j, i] = row[f"h{i}_{j}"] or 0.0
        return row["v"] or 0.0, np.array([row[f"m{j}"] or 0.0 for j in range(k)]), slopes

    step = np.zeros(k)
    value, now, slopes = measure(step)
    share = np.where(now > 1e-9 * max(1.0, now.sum()), targets, 0.0)
    if not share.sum():
        return Fit([], np.zeros(k), now, True)
    share = share / share.sum()
    live = share > 0
    wanted = share * (now[live] / share[live]).max()
    near = NEAR * wanted
    # a convex function of the step, whose slope is wanted - now + near * step: 0 where the fit is done
    value += (wanted @ step) + near @ step**2 / 2
    for _ in range(MAX_PASSES):
        error = now - wanted
        met = bool((np.abs(error) <= TOLERANCE * wanted)[live].all())
        slope = np.where(live, near * step - error, 0.0)
        if met or (np.abs(slope) <= STATIONARY * wanted)[live].all():
            return Fit([step.tolist()] if step.any() else [], wanted, now, met)
        move = np.zeros(k)
        move[live] = np.linalg.solve(slopes[np.ix_(live, live)] + np.diag(near[live]), -slope[live])
        downhill, length = float(slope @ move), 1.0
        while True:
            tried = step + length * move
            found, totals, free = measure(tried)
            found += wanted @ tried + near @ tried**2 / 2
            if found <= value + 1e-4 * length * downhill + 1e-12 * abs(value) or length < 1e-9:
                break
            length /= 4
        step, value, now, slopes = tried, found, totals, free
    raise RuntimeError(f"the rates did not settle in {MAX_PASSES} passes: wanted {wanted.tolist()}, reached {now.tolist()}")


def shares(totals: np.ndarray, names: list[str]) -> dict[str, float]:
    """Share of each domain in the sum of the totals (0 where there are none)."""
    return {n: float(x) for n, x in zip(names, totals / (totals.sum() or 1.0), strict=True)}


def _replay(p: np.ndarray, steps: list[list[float]], min_rate: float) -> np.ndarray:
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(min_rate, r - p @ np.array(step))
    return r


def _rated(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], min_rate: float, kept: list[str]) -> tuple[DataFrame, list[str], np.ndarray, Fit]:
    """The ``kept`` columns, tokens, posterior, rate and copies of every row, the names of these four, the classifier and the fit.

    Texts are scored once, and the scored rows stored; the fit's passes read tokens and posterior alone.
    """
    names, spark = list(targets), documents.sparkSession
    index = F.coalesce(*(F.when(F.col("domain") == name, F.lit(j)) for j, name in enumerate(names)))
    w = fit_classifier(documents, labelled.select("doc_id", index.alias("domain")), len(names))
    shared = spark.sparkContext.broadcast(w)
    added = common.fresh(kept, "tokens", "posterior", "rate", "copies")
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, n):
            tokens, p = _posteriors(batch.column(n), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(tokens), lists], [*kept, *added[:2]])

    (text,) = common.fresh(kept, "scored_text")
    whole = documents.select(*(F.col(f"`{c}`") for c in kept), F.col("text").alias(text))
    schema = StructType([*(documents.schema[c] for c in kept), StructField(added[0], LongType()), StructField(added[1], ArrayType(DoubleType()))])
    members = common.materialize(whole.mapInArrow(run, schema))
    fit = fit_rates(members.select(F.col(added[0]).alias("tokens"), F.col(added[1]).alias("posterior")), [targets[n] for n in names], min_rate)
    if not fit.met:
        warnings.warn(f"no rates meet the targets; nearest shares by domain: wanted {shares(fit.wanted, names)}, reached {shares(fit.reached, names)}", stacklevel=3)
    whole_part = F.floor(added[2])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(common.HASH_RANGE)) / F.lit(float(common.HASH_RANGE))
    rated = members.withColumn(added[2], _rate(F.col(added[1]), fit.steps, min_rate))
    return rated.withColumn(added[3], (whole_part + (drawn < F.col(added[2]) - whole_part).cast("long")).cast("long")), added, w, fit


def soft_rates(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], min_rate: float = 0.0) -> tuple[DataFrame, np.ndarray, Fit]:
    """doc_id, tokens, posterior (in the order of ``targets``), rate and copies of every row; the classifier; the fit.

    ``labelled``: doc_id, domain (a key of ``targets``; other rows are not used).
    """
    rated, _, w, fit = _rated(documents, labelled, targets, min_rate, ["doc_id"])
    return rated, w, fit


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], min_rate: float = 1.0) -> DataFrame:
    """The documents, each as often as its rate says, with their own columns."""
    rated, added, _, _ = _rated(documents, labelled, targets, min_rate, documents.columns)
    return rated.filter(F.col(added[3]) > 0).withColumn(added[0], F.explode(F.sequence(F.lit(1), F.col(added[3]).cast("int")))).drop(*added)


def language_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the registered query: the languages of the documents that ``labels`` lists."""
    listed = labels.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return documents.select("doc_id", F.col("lang").alias("domain")).join(listed, "doc_id")
