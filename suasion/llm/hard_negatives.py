"""Hard-negative mining: best-first descent of cover trees over norm-augmented candidates.

Every vector gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of all; an anchor's is zero. Inner
products stay as they were, and all candidates lie on one sphere. Vectors are dealt by the nearest of some pivots (real
vectors, chosen by hash, ``MAX_PIVOTS`` at most: the top level of the tree, which is broadcast), packed into blocks of
neighbouring groups, and each block is a cover tree of its own: a node has a centre and the largest distance of its
members from it, its children are centres further than the next level's radius apart, and what a node's ``FAN_OUT``
children leave uncovered stays in the node's own bucket.

A member of a node with centre c and radius r scores within q.c +- |q| r. A block's nodes wait in a heap by the best that
any anchor may still find there, clipped to its window's upper end, so that bounds grow tight early; a node is skipped by
every anchor whose window lies outside those bounds or whose k-th best is above them, and buckets are verified exactly by
one matrix product. The same bounds keep whole groups from being sent to anchors that can't use them. Positives are found
first (k best of the anchor's label), then, for each of them, the k best of other labels inside its score window.

Scores are exact integers as long as they fit a long. Blocks are cut by hash, so a label, group or vector that holds any
share of the rows is dealt to many tasks.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part; a shorter
vector counts as padded with zeros; rows with the anchor's own id are its own and never answer it, and the least of them
by label and vector asks; rows that repeat another id answer once each; ties go to the smaller id; with fewer than k rows
all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suasion.llm import common

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, as hundredths of the positive's.
LEAST_PART, MOST_PART = 50, 95
MAX_PIVOTS = 4_096
#: Anchors of a cell; data of a cell, which are a MIN_BLOCKS-th of all rows but not more than MAX_DATA_ROWS.
ANCHOR_ROWS, MIN_BLOCKS, MAX_DATA_ROWS = 8_192, 16, 65_536
LEAF, FAN_OUT, SHRINK = 64, 64, 1.3
#: Anchors and bucket rows of one matrix product.
SLICE, BUCKET = 256, 16_384
_NONE = -(1 << 62)


@dataclass
class Node:
    """A node of a cover tree: members beyond the children's are in ``bucket`` (row numbers)."""

    centre: int
    radius: float
    bucket: np.ndarray
    children: list[Node] = field(default_factory=list)


def _away(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """One more column that brings every row's norm to ``top``."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top * top - np.einsum("ij,ij->i", x, x)))])


def cover_tree(x: np.ndarray) -> Node | None:
    """A cover tree over the rows: children's centres are apart by more than the node's radius over ``SHRINK``."""
    if not len(x):
        return None
    root = Node(0, 0.0, np.zeros(0, np.int64))
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, members = todo.pop()
        away = _away(x[members], x[node.centre])
        node.radius = float(away.max())
        if len(members) <= LEAF or node.radius == 0:
            node.bucket = members
            continue
        reach, alone = node.radius / SHRINK, []
        left = members[np.argsort(away, kind="stable")]
        for _ in range(FAN_OUT):
            inside = _away(x[left], x[left[0]]) <= reach
            if inside.sum() < LEAF // 8:
                alone.append(left[inside])
            else:
                child = Node(int(left[0]), 0.0, np.zeros(0, np.int64))
                node.children.append(child)
                todo.append((child, left[inside]))
            left = left[~inside]
            if not len(left):
                break
        node.bucket = np.concatenate([*alone, left])
    return root


@dataclass
class Found:
    """The best so far of each window of each anchor: window, score, candidate row; and the score to beat."""

    window: np.ndarray
    score: np.ndarray
    row: np.ndarray
    floor: np.ndarray

    @classmethod
    def none(cls, windows: int) -> Found:
        empty = np.zeros(0, np.int64)
        return cls(empty, empty, empty, np.full(windows, _NONE, np.int64))

    def add(self, window: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int) -> None:
        window, score, row = np.concatenate([self.window, window]), np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort((row, ids[row], -score, window))
        window, score, row = window[order], score[order], row[order]
        first = np.searchsorted(window, window, "left")
        rank = np.arange(len(window)) - first
        keep = rank < k
        last = np.flatnonzero(rank == k - 1)
        self.floor[window[last]] = score[last]
        self.window, self.score, self.row = window[keep], score[keep], row[keep]


def search(tree: Node | None, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray, own_labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, kind: type) -> Found:
    """The k best rows of each (anchor, window): of the anchor's label or of others, scores within low and high (anchor x window)."""
    n, w = low.shape
    found = Found.none(n * w)
    if tree is None or not n:
        return found
    rows, norms = x.astype(kind), np.sqrt(np.einsum("ij,ij->i", q.astype(float), q.astype(float)))
    asks = q.astype(kind)
    slack = 1e-6 * (1 + norms * max(1.0, float(np.abs(x).max())) * x.shape[1] ** 0.5)

    def useful(live: np.ndarray, centre: np.ndarray, radius: float) -> tuple[np.ndarray, float]:
        """The anchors that may find something within ``radius`` of scores ``centre``, and the best promise."""
        reach = norms[live] * radius + slack[live]
        best = np.minimum((centre + reach)[:, None], high[live])
        floor = found.floor.reshape(n, w)[live]
        ok = (best >= low[live]) & ((centre - reach)[:, None] <= high[live]) & (best >= floor)
        promise = np.where(ok, best, -np.inf).max() if len(live) else -np.inf
        return ok.any(1), float(promise)

    def verify(live: np.ndarray, bucket: np.ndarray) -> None:
        for at in range(0, len(bucket), BUCKET):
            part = bucket[at : at + BUCKET]
            s = asks[live] @ rows[part].T
            fit = (own_labels[live][:, None] == labels[part][None, :]) == same
            fit &= own[live][:, None] != ids[part][None, :]
            for j in range(w):
                floor = np.maximum(found.floor.reshape(n, w)[live, j], low[live, j])
                ok = fit & (s >= floor[:, None]) & (s <= high[live, j][:, None])
                many = np.flatnonzero(ok.sum(1) > 4 * k)
                if len(many):  # raise the floor first, so that few rows are sorted
                    cut = np.partition(np.where(ok[many], s[many], -np.inf if s.dtype.kind == "f" else _NONE), -k, 1)[:, -k]
                    ok[many] &= s[many] >= cut[:, None]
                a, b = np.nonzero(ok)
                if len(a):
                    found.add(live[a] * w + j, s[a, b].astype(np.int64), part[b], ids, k)

    heap: list[tuple[float, int, Node, np.ndarray, np.ndarray]] = []
    every = np.arange(n)
    centre = (asks @ rows[tree.centre]).astype(float)
    ok, promise = useful(every, centre, tree.radius)
    heapq.heappush(heap, (-promise, 0, tree, every[ok], centre[ok]))
    made = 1
    while heap:
        _, _, node, live, centre = heapq.heappop(heap)
        ok, _ = useful(live, centre, node.radius)
        live = live[ok]
        if not len(live):
            continue
        if len(node.bucket):
            verify(live, node.bucket)
        if node.children:
            scores = (asks[live] @ rows[[c.centre for c in node.children]].T).astype(float)
            for c, child in enumerate(node.children):
                ok, promise = useful(live, scores[:, c], child.radius)
                if ok.any():
                    heapq.heappush(heap, (-promise, made, child, live[ok], scores[ok, c]))
                    made += 1
    return found


def usable(vectors: DataFrame, id_column: str, label_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, label, v array<long>): floor(scale * x) of the rows that take part."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.filter(whole).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))


@dataclass
class Cells:
    """Where candidates and anchors are, and what bounds their groups."""

    rows: DataFrame
    groups: np.ndarray
    radius: np.ndarray
    centres: np.ndarray
    anchors: DataFrame
    data: DataFrame
    width: int
    kind: str
    exact: type
    top: float


def _unpack(column: pa.Array | pd.Series, kind: str, width: int) -> np.ndarray:
    packed = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else map(bytes, column)
    return np.frombuffer(b"".join(packed), kind).reshape(len(column), width)


def _blocks(counts: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """For each group its first block and how many blocks it is cut into; small groups share a block."""
    first, parts, block, filled = [], [], 0, 0
    for count in counts.tolist():
        if filled and filled + count > most:
            block, filled = block + 1, 0
        need = max(1, -(-count // most))
        first.append(block)
        parts.append(need)
        block, filled = (block + need, 0) if need > 1 else (block, filled + count)
    return first, parts


def deal(points: DataFrame, is_anchor: str) -> Cells | None:
    """Group the usable vectors by pivots and pack the groups into blocks; nothing if there are none."""
    spark = points.sparkSession
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda e: F.abs(e)))).alias("top"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))).alias("square")).first()
    n, width, most = shape["n"], shape["width"] or 0, shape["top"] or 0
    if not n:
        return None
    kind = "<i1" if most < 2**7 else "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    exact = np.float32 if most * most * width < 2**24 else np.float64 if most * most * width < 2**53 else np.int64
    top = float(shape["square"]) ** 0.5
    n_pivots = int(min(MAX_PIVOTS, max(1, n**0.5 / 2)))
    chosen = points.select("v", F.xxhash64("vec_id", F.lit("pivot")).alias("h"), "vec_id").orderBy("h", "vec_id", "v").limit(n_pivots).collect()
    pivots = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        pivots[i, : len(row["v"])] = row["v"]
    # neighbours get neighbouring numbers: pivots in the order of their nearest coarse one
    coarse = pivots[: max(1, round(len(pivots) ** 0.5))]
    near = ((coarse * coarse).sum(1) - 2 * (pivots @ coarse.T)).argmin(1)
    pivots = pivots[np.argsort(near, kind="stable")]
    shared = spark.sparkContext.broadcast(augmented(pivots, top))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        squares = (p * p).sum(1)
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.zeros((len(lists), width), np.int64)
            x[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            y = augmented(x.astype(float), top)
            group = np.concatenate([(squares - 2 * (y[at : at + SLICE] @ p.T)).argmin(1) for at in range(0, len(y), SLICE)]) if len(y) else np.zeros(0, np.int64)
            away = np.sqrt(((y - p[group]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(group.astype(np.int32)), pa.array(away), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], ["vec_id", "label", "g", "away", "v"])

    rows = common.materialize(points.select("vec_id", "label", "v").mapInArrow(assign, "vec_id long, label long, g int, away double, v binary"))
    # at most MAX_PIVOTS rows
    summary = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.count_if(F.expr(is_anchor)).alias("asked")).orderBy("g").toPandas()
    groups = summary["g"].to_numpy()

    def placed(df: DataFrame, counts: np.ndarray, most: int, name: str) -> DataFrame:
        plan = spark.createDataFrame(list(zip(groups.tolist(), *_blocks(counts, most), strict=True)), "g int, first int, parts int")
        return df.join(F.broadcast(plan), "g").withColumn(name, (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("parts"))).cast("int")).drop("first", "parts")

    asking = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "g")).alias("a")).select("vec_id", "a.*")
    anchors = placed(asking, summary["asked"].to_numpy(), ANCHOR_ROWS, "qb")
    data = placed(rows.drop("away"), summary["n"].to_numpy(), min(MAX_DATA_ROWS, max(SLICE, -(-n // MIN_BLOCKS))), "db")
    return Cells(rows, groups, summary["r"].to_numpy(), pivots[groups], anchors, data, width, kind, exact, top)


def _mined(cells: Cells, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, score, vec_id, rank): the k best of each window of ``windows`` (vec_id, windows array<struct<window, low, high>>)."""
    width, kind, exact, top = cells.width, cells.kind, cells.exact, cells.top
    asked = cells.anchors.join(windows, "vec_id")
    shared = asked.sparkSession.sparkContext.broadcast((cells.groups, cells.centres, cells.radius))

    def spans(column: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window names, low and high of each anchor; missing windows are empty (low above high)."""
        w = max((len(x) for x in column), default=0)
        name, low, high = np.zeros((len(column), w), np.int64), np.full((len(column), w), 1 << 62), np.full((len(column), w), _NONE)
        for i, row in enumerate(column):
            for j, one in enumerate(row):
                name[i, j], low[i, j], high[i, j] = one["window"], one["low"], one["high"]
        return name, low, high

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The data groups that each block of anchors must see."""
        groups, centres, radius = shared.value
        for batch in batches:
            q = _unpack(batch.column("v"), kind, width).astype(float)
            _, low, high = spans(batch.column("windows").to_pylist())
            block = batch.column("qb").to_numpy()
            wanted: dict[int, np.ndarray] = {}
            for at in range(0, len(q), SLICE):
                part = q[at : at + SLICE]
                s = part @ centres.T
                reach = np.sqrt((part * part).sum(1))[:, None] * (radius * (1 + 1e-9) + 1e-6)
                ok = (s + reach >= low[at : at + SLICE].min(1, initial=1 << 62)[:, None]) & (s - reach <= high[at : at + SLICE].max(1, initial=_NONE)[:, None])
                for b in np.unique(block[at : at + SLICE]):
                    wanted[b] = wanted.get(b, False) | ok[block[at : at + SLICE] == b].any(0)
            pairs = [(b, g) for b, m in wanted.items() for g in groups[m]]
            yield pa.RecordBatch.from_arrays([pa.array([int(b) for b, _ in pairs], pa.int32()), pa.array([int(g) for _, g in pairs], pa.int32())], ["qb", "g"])

    pairs = asked.select("v", "qb", "windows").mapInArrow(needs, "qb int, g int").distinct()
    wanted_by = pairs.groupBy("g").agg(F.sort_array(F.collect_set("qb")).alias("qbs"))
    sent = cells.data.join(wanted_by, "g").select("vec_id", "label", "v", "db", F.explode("qbs").alias("qb"))
    places = sent.select("qb", "db").distinct()
    asking = asked.join(places, "qb").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("v").alias("q"), "windows", F.col("qb").alias("ask_qb"), F.col("db").alias("ask_db"))
    told = sent.select("vec_id", "label", "v", F.col("qb").alias("tell_qb"), F.col("db").alias("tell_db"))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
        x = _unpack(right["v"], kind, width).astype(float if exact is not np.int64 else np.int64)
        tree = cover_tree(augmented(x.astype(float), top))
        for at in range(0, len(left), SLICE):
            part = left.iloc[at : at + SLICE]
            own = part["anchor_id"].to_numpy()
            name, low, high = spans(list(part["windows"]))
            found = search(tree, x, ids, labels, _unpack(part["q"], kind, width), own, part["own"].to_numpy(), low, high, same, k, exact)
            anchor, window = np.divmod(found.window, max(1, name.shape[1]))
            out.append(pd.DataFrame({"anchor_id": own[anchor], "window": name[anchor, window], "score": found.score, "vec_id": ids[found.row]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "window": [], "score": [], "vec_id": []}, dtype="int64")

    best = asking.groupBy("ask_qb", "ask_db").cogroup(told.groupBy("tell_qb", "tell_db")).applyInPandas(solve, "anchor_id long, window long, score long, vec_id long")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _window(name: Column, low: Column, high: Column) -> Column:
    return F.struct(name.cast("long").alias("window"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def mine(vectors: DataFrame, is_anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PART, most: int = MOST_PART, scale: int = SCALE, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors meet ``is_anchor`` (SQL on vec_id); negatives score between ``least`` and ``most`` hundredths of the positive.
    """
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    cells = deal(usable(vectors, id_column, label_column, vector_column, scale), is_anchor)
    if cells is None:
        return vectors.sparkSession.createDataFrame([], result)
    anywhere = cells.anchors.select("vec_id", F.array(_window(F.lit(0), F.lit(-(1 << 61)), F.lit(1 << 61))).alias("windows"))
    close = common.materialize(_mined(cells, anywhere, True, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
    # a positive's window goes by its place, as rows that repeat its id are positives of their own; products fit a decimal
    part = F.col("positive_score").cast("decimal(20,0)")
    low, high = -F.floor(-part * least / 100), F.floor(part * most / 100)
    windows = close.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(_window(F.col("place"), low, high)).alias("windows"))
    hard = _mined(cells, windows, False, negatives).select(F.col("anchor_id").alias("a_id"), F.col("window").alias("a_place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = hard.join(close, (F.col("a_id") == F.col("anchor_id")) & (F.col("a_place") == F.col("place")))
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH p AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM p a JOIN p c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT pos.anchor_id, pos.vec_id AS positive_id, row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, pos.score AS positive_score, s.score AS negative_score
FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT s.same AND {LEAST_PART} * pos.score <= 100 * s.score AND 100 * s.score <= {MOST_PART} * pos.score
QUALIFY rank <= {NEGATIVES}
"""


def shifted(label: str = "label", vec_id: str = "vec_id") -> Column:
    """The contract's labels: one further, of ten, where the id is divisible by seven."""
    return F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))

