"""Exact top-k inner-product search: a Voronoi kNN join.

Vectors are grouped by a near one of the pivots: real vectors, chosen by hash, about half the square root of their number
(MAX_PIVOTS at most, which bounds what is broadcast). Pivots are found by way of the nearest of some coarse ones; any
assignment gives right results, as bounds use the groups as they are. Groups of one coarse pivot are numbered next to each
other, so blocks of queries are of one neighbourhood. Group summaries
(pivot, radius, largest norm, count) bound every score: for a query q and a group with pivot p and radius r, no member
scores more than min(q.p + |q| r, |q| R). The k-th best score of q among the pivots is a lower bound of its k-th best
score overall. Queries are packed into blocks of neighbouring groups, and data of a group go to a query block only if
some query of the block could find a better or equal score there. Each (query block, data block) cell is solved by one
matrix product over at most QUERY_ROWS x DATA_ROWS vectors, whatever the size of a group (large groups are cut by
hash), and the cells' k best per query are merged by rank. Scores are exact integers.

Defined results: null vectors and vectors with null or non-finite components neither ask nor answer; a shorter vector
counts as padded with zeros; rows with the query's own id are its own rows and never answer it; rows that repeat
another id answer once each; ties go to the smaller id; with fewer than k other rows all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suasion.llm import common

K = 20
SCALE = 64
MAX_PIVOTS = 16_384
QUERY_ROWS, DATA_ROWS = 2048, 8192
#: Queries that are held against all groups at once.
NEEDS_ROWS = 256


def quantise(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the usable vectors."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of the nearest centre of each row."""
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1) if len(x) else np.zeros(0, np.int64)


def top_k(vectors: DataFrame, is_query: str, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that meets ``is_query`` (SQL on vec_id)."""
    spark = vectors.sparkSession
    points = quantise(vectors, id_column, vector_column, scale)
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda e: F.abs(e)))).alias("top")).first()
    n, width, top = shape["n"], shape["width"] or 0, shape["top"] or 0
    result = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    kind = "<i1" if top < 2**7 else "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    exact = np.float32 if top * top * width < 2**24 else np.float64 if top * top * width < 2**53 else np.int64
    n_pivots = int(min(MAX_PIVOTS, max(1, 2 * k, n**0.5 / 2), n))
    chosen = points.select("vec_id", "v", F.xxhash64("vec_id", F.lit("pivot")).alias("h")).orderBy("h", "vec_id").limit(n_pivots).collect()
    pivots = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        pivots[i, : len(row["v"])] = row["v"]
    coarse = pivots[: max(1, round(len(pivots) ** 0.5))].copy()
    near = _nearest(pivots, coarse)
    order = np.argsort(near, kind="stable")
    pivots, near = pivots[order], near[order]
    pivot_ids = np.array([row["vec_id"] for row in chosen])[order]
    shared = spark.sparkContext.broadcast((pivots, pivot_ids, coarse, np.searchsorted(near, np.arange(len(coarse) + 1))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, _, coarse, cuts = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            f = x.astype(float)
            parent = _nearest(f, coarse)
            group = np.zeros(len(x), np.int64)
            for c in np.unique(parent):
                mine = parent == c
                low, high = cuts[c], cuts[c + 1]
                group[mine] = low + _nearest(f[mine], p[low:high])
            away = np.sqrt(((f - p[group]) ** 2).sum(1))
            packed = x.astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group.astype(np.int32)), pa.array(away), pa.array(np.sqrt((f * f).sum(1))), pa.array([r.tobytes() for r in packed], pa.binary())], ["vec_id", "g", "away", "norm", "v"])

    cells = common.materialize(points.mapInArrow(assign, "vec_id long, g int, away double, norm double, v binary"))
    # at most MAX_PIVOTS rows
    summary = cells.groupBy("g").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.max("norm").alias("norm"), F.sum(F.expr(f"cast(({is_query}) as int)")).alias("asked")).orderBy("g").toPandas()
    groups, radius, norms = summary["g"].to_numpy(), summary["r"].to_numpy(), summary["norm"].to_numpy()

    def blocks(counts: np.ndarray, most: int) -> tuple[list[int], list[int]]:
        """For each group its first block and how many blocks it is cut into; small groups share a block."""
        first, parts, block, filled = [], [], 0, 0
        for c in counts.tolist():
            if filled and filled + c > most:
                block, filled = block + 1, 0
            need = max(1, -(-c // most))
            first.append(block)
            parts.append(need)
            if need > 1:
                block, filled = block + need, 0
            else:
                filled += c
        return first, parts

    q_first, q_parts = blocks(summary["asked"].to_numpy(), QUERY_ROWS)
    d_first, d_parts = blocks(summary["n"].to_numpy(), DATA_ROWS)

    def placed(df: DataFrame, first: list[int], parts: list[int], name: str) -> DataFrame:
        rows = list(zip(groups.tolist(), first, parts, strict=True))
        plan = spark.createDataFrame(rows, "g int, first int, parts int")
        return df.join(F.broadcast(plan), "g").withColumn(name, (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("parts"))).cast("int")).drop("first", "parts")

    asked = placed(cells.filter(is_query), q_first, q_parts, "qb")

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The data groups that each query must see, and its lower bound."""
        p, ids, *_ = shared.value
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).reshape(batch.num_rows, width)
            own, blocks_of = batch.column("vec_id").to_numpy(), batch.column("qb").to_numpy()
            wanted: dict[int, np.ndarray] = {}
            # so many queries at a time, so that what is held grows with the pivots alone
            for at in range(0, len(q), NEEDS_ROWS):
                some = q[at : at + NEEDS_ROWS].astype(float)
                scores = some @ p.T
                norm = np.sqrt((some * some).sum(1))
                known = np.where(ids[None, :] == own[at : at + NEEDS_ROWS, None], -np.inf, scores)
                floor = np.partition(known, -k, 1)[:, -k] if known.shape[1] >= k else np.full(len(some), -np.inf)
                best = np.minimum(scores[:, groups] + norm[:, None] * radius, norm[:, None] * norms)
                ok = best + 1e-6 * (1 + np.abs(best)) >= floor[:, None]
                here = blocks_of[at : at + NEEDS_ROWS]
                for block in np.unique(here).tolist():
                    wanted[block] = wanted.get(block, False) | ok[here == block].any(0)
            pairs = [np.column_stack([np.full(m.sum(), block), groups[m]]) for block, m in wanted.items()]
            pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))], ["qb", "g"])

    pairs = asked.select("vec_id", "v", "qb").mapInArrow(needs, "qb int, g int").distinct()
    data = placed(cells.select("vec_id", "g", "v"), d_first, d_parts, "db")
    # a group goes to the query blocks that need it; the list of them rides along with the group's rows
    wanted_by = pairs.groupBy("g").agg(F.sort_array(F.collect_set("qb")).alias("qbs"))
    sent = data.join(wanted_by, "g").select("vec_id", "v", "db", F.explode("qbs").alias("qb"))
    places = sent.select("qb", "db").distinct()
    asking = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "qb").join(places, "qb").select("query_id", "q", F.col("qb").alias("ask_qb"), F.col("db").alias("ask_db"))
    told = sent.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.col("qb").alias("tell_qb"), F.col("db").alias("tell_db"))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        right = right.sort_values("vec_id")
        ids = right["vec_id"].to_numpy()
        d = np.frombuffer(b"".join(map(bytes, right["v"])), kind).reshape(len(ids), width).astype(exact)
        out = []
        for at in range(0, len(left), 256):
            part = left.iloc[at : at + 256]
            own = part["query_id"].to_numpy()
            q = np.frombuffer(b"".join(map(bytes, part["q"])), kind).reshape(len(part), width).astype(exact)
            s = q @ d.T
            for row, query in enumerate(own):
                line = s[row]
                if len(line) > 4 * k:
                    cut = np.partition(line, -2 * k)[-2 * k] if (ids == query).sum() <= k else line.min()
                    keep = np.flatnonzero(line >= cut)
                else:
                    keep = np.arange(len(line))
                keep = keep[ids[keep] != query]
                keep = keep[np.lexsort((ids[keep], -line[keep]))][:k]
                out.append((np.full(len(keep), query), ids[keep], line[keep].astype(np.int64)))
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    best = asking.groupBy("ask_qb", "ask_db").cogroup(told.groupBy("tell_qb", "tell_db")).applyInPandas(solve, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH p AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM p q JOIN p c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
