"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, by count vectors in R-trees.

A set's shingles are hashed to groups; the counts by group are its point. The sum of coordinate minima of two points
bounds the overlap of the sets from above, and the same sum over the upper corners of two boxes bounds every pair
between them, which is what prunes an R-tree join.

* Equal sets are one class (128-bit sums of their hashes) and go on as one node, the smallest doc_id.
* Count vectors alone cannot deal out documents (boxes in 64 dimensions overlap), so the trees are dealt by shingle:
  two linked sets share a shingle among the first ``n - ceil(t * n) + 1`` of each, in any common order. The order puts
  shingles that a bounded sample shows as frequent last; that choice affects the cost alone.
* In each bucket the tree finds the pairs that the bound allows. Only a spanning forest of them is kept: it holds
  together all that can be linked. Buckets of more than ``BUCKET_ROWS`` go in pairs of hash tiles.
* The connected parts of these forests are small worlds outside which no link exists. Within each, sets are rebuilt
  from the texts and pairs verified exactly; a part with too many shingles for a task goes in pairs of tiles.
* The components of verified links are the result.

Defined results: a null, empty or blank text has an empty set, linked with nothing; a text with fewer words than a
shingle is one shingle; rows with equal doc_id are one document, linked by any of its texts; rows without a doc_id get
a null component; an empty table gives no rows; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm import common
from suasion.llm.components import components

WORDS, THRESHOLD = 5, (80, 100)
SAMPLE_ROWS, SAMPLE_SHARED, SAMPLE_KEPT = 3_000, 3, 50_000
COARSE = 64
#: Groups of the count vector by set size: enough for the bound to tell strangers apart.
GROUPS = ((1024, 64), (4096, 256), (None, 1024))
LEAF = 32
BUCKET_ROWS = 4_096
PART_SHINGLES = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC6A4A7935BD1E995)
_SHORT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    starts, ends, rows = common.token_spans(data, offsets)
    h = common.span_hashes(data, starts, ends)
    n = len(offsets) - 1
    cuts = np.searchsorted(rows, np.arange(n + 1))
    rolled = h[: max(0, len(h) - words + 1)].copy()
    for j in range(1, words):
        rolled = rolled * _STEP + h[j : j + len(rolled)]
    rolled = common.mix(rolled)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64) * _SHORT
            for k in range(a, b):
                whole = whole * _STEP + h[k : k + 1]
            out.append(common.mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    num, den = threshold
    return n + (-num * n) // den + 1 if n else 0


def count_vector(shingles: np.ndarray) -> bytes:
    """Counts by group as bytes; what goes over 255 in a group is kept as one number at the end (four bytes)."""
    groups = next(g for most, g in GROUPS if most is None or len(shingles) <= most)
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.uint32(np.maximum(counts - 255, 0).sum()).tobytes()


def _unpack(vector: bytes, groups: int) -> tuple[np.ndarray, int]:
    counts = np.frombuffer(vector, np.uint8, len(vector) - 4).astype(np.int32)
    return counts.reshape(-1, groups).sum(0), int(np.frombuffer(vector, np.uint32, 1, len(vector) - 4)[0])


def _allowed(bound: np.ndarray, total: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether an overlap of ``bound`` could make a link of sets of ``total`` shingles together."""
    num, den = threshold
    return bound * (num + den) >= num * total


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class CountTree:
    """An R-tree over count vectors, packed sort-tile-recursively: by set size, then by the coordinate of most spread."""

    def __init__(self, counts: np.ndarray, over: np.ndarray, sizes: np.ndarray) -> None:
        by_size = np.argsort(sizes, kind="stable")
        slabs = np.array_split(by_size, max(1, int((len(sizes) / LEAF) ** 0.5)))
        axis = int(counts.astype(float).var(0).argmax())
        order = np.concatenate([s[np.argsort(counts[s, axis], kind="stable")] for s in slabs])
        self.leaves = np.array_split(order, max(1, -(-len(order) // LEAF)))
        self.corner = np.stack([counts[x].max(0) for x in self.leaves])
        self.over = np.array([over[x].max() for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        fan = range(0, len(self.leaves), 16)
        self.top_corner = np.stack([self.corner[i : i + 16].max(0) for i in fan])
        self.top_over = np.array([self.over[i : i + 16].max() for i in fan])
        self.top_least = np.array([self.least[i : i + 16].min() for i in fan])

    def leaf_pairs(self, threshold: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """Pairs of leaves between which the bound allows a link."""
        n = len(self.leaves)
        for i in range(len(self.top_least)):
            bound = np.minimum(self.top_corner[i], self.top_corner[i:]).sum(1) + np.minimum(self.top_over[i], self.top_over[i:])
            for j in i + np.flatnonzero(_allowed(bound, self.top_least[i] + self.top_least[i:], threshold)):
                for a in range(16 * i, min(n, 16 * i + 16)):
                    low, high = max(a, 16 * int(j)), min(n, 16 * int(j) + 16)
                    if low < high:
                        inner = np.minimum(self.corner[a], self.corner[low:high]).sum(1) + np.minimum(self.over[a], self.over[low:high])
                        for b in low + np.flatnonzero(_allowed(inner, self.least[a] + self.least[low:high], threshold)):
                            yield a, int(b)


def _fine(vectors: list[bytes], i: int, j: int, total: int, threshold: tuple[int, int]) -> bool:
    """The bound in as many groups as both vectors have."""
    groups = min(len(vectors[i]), len(vectors[j])) - 4
    if groups <= COARSE:
        return True
    (a, x), (b, y) = _unpack(vectors[i], groups), _unpack(vectors[j], groups)
    return bool(_allowed(np.minimum(a, b).sum() + min(x, y), total, threshold))


def allowed_forest(nodes: np.ndarray, sizes: np.ndarray, vectors: list[bytes], cuts: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Pairs of nodes that hold together, bucket by bucket, whatever the bound allows. cuts: where buckets begin, and the end."""
    unpacked = [_unpack(v, COARSE) for v in vectors]
    counts = np.array([c for c, _ in unpacked], np.int32).reshape(-1, COARSE)
    over = np.array([o for _, o in unpacked], np.int64)
    width = np.diff(cuts)
    found: list[np.ndarray] = []
    for size in range(2, LEAF + 1):
        first = cuts[:-1][width == size]
        ti, tj = np.triu_indices(size, 1)
        for at in range(0, len(first), max(1, 100_000 // len(ti))):
            base = first[at : at + max(1, 100_000 // len(ti)), None]
            i, j = (base + ti).ravel(), (base + tj).ravel()
            keep = nodes[i] != nodes[j]
            i, j = i[keep], j[keep]
            bound = np.minimum(counts[i], counts[j]).sum(1) + np.minimum(over[i], over[j])
            keep = _allowed(bound, sizes[i] + sizes[j], threshold)
            i, j = i[keep], j[keep]
            keep = np.array([_fine(vectors, x, y, sizes[x] + sizes[y], threshold) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            found.append(np.column_stack([nodes[i[keep]], nodes[j[keep]]]))
    for k in np.flatnonzero(width > LEAF):
        a, b = cuts[k], cuts[k + 1]
        tree = CountTree(counts[a:b], over[a:b], sizes[a:b])
        forest = Forest(b - a)
        edges = []
        for p, q in tree.leaf_pairs(threshold):
            left, right = tree.leaves[p], tree.leaves[q]
            bound = np.minimum(counts[a + left][:, None], counts[a + right][None]).sum(2) + np.minimum(over[a + left][:, None], over[a + right][None])
            ok = _allowed(bound, sizes[a + left][:, None] + sizes[a + right][None], threshold) & (left[:, None] != right[None])
            for x, y in zip(*np.nonzero(ok), strict=True):
                u, v = int(left[x]), int(right[y])
                if forest.find(u) != forest.find(v) and _fine(vectors, a + u, a + v, sizes[a + u] + sizes[a + v], threshold):
                    forest.join(u, v)
                    edges.append((nodes[a + u], nodes[a + v]))
        if edges:
            found.append(np.array(edges))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return np.unique(np.sort(pairs, 1), axis=0)


def verified_links(nodes: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Verified links that hold together all that is linked among some sets: rarest shingles first, then the exact overlap."""
    num, den = threshold
    sizes = np.array([len(s) for s in sets])
    every, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(every))
    ranked = [np.sort(rank[x]) for x in np.split(inverse, np.cumsum(sizes)[:-1])]
    forest = Forest(len(sets))
    postings: dict[int, list[int]] = {}
    out = []
    for k in np.argsort(sizes, kind="stable").tolist():
        s = ranked[k]
        asked: set[int] = set()
        for token in s[: prefix_length(len(s), threshold)].tolist():
            met = postings.setdefault(token, [])
            asked.update(met)
            met.append(k)
        for other in asked:
            if sizes[other] * den < num * sizes[k] or forest.find(other) == forest.find(k):
                continue
            common_size = len(np.intersect1d(s, ranked[other], assume_unique=True))
            if den * common_size >= num * (sizes[k] + sizes[other] - common_size):
                forest.join(other, k)
                if nodes[other] != nodes[k]:
                    out.append((int(nodes[other]), int(nodes[k])))
    return out


def _frequent(documents: DataFrame, words: int) -> np.ndarray:
    """Shingles that several documents of a bounded sample share, the most frequent SAMPLE_KEPT at most."""
    share = SAMPLE_ROWS / max(1, documents.count())
    sample = documents.filter(common.in_sample(share, "doc_id", F.lit("sample")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in common.blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(data, offsets, words)).view(np.int64))], ["s"])

    counted = sample.select("text").mapInArrow(run, "s long").groupBy("s").count().filter(F.col("count") >= SAMPLE_SHARED)
    return np.sort(np.array([r["s"] for r in counted.orderBy(F.desc("count"), "s").limit(SAMPLE_KEPT).collect()], np.int64).view(np.uint64))


def fingerprints(documents: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, n, s1, s2 (sums that name the set), counts and prefix of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(_frequent(documents, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in common.text_slices(batches, 1):
            n, s1, s2, counts, prefix = [], [], [], [], []
            for _, _, data, offsets in common.blocks(batch.column(1)):
                for s in shingle_sets(data, offsets, words):
                    n.append(len(s))
                    s1.append(s.sum(dtype=np.uint64))
                    s2.append(common.mix(s ^ _SECOND).sum(dtype=np.uint64))
                    counts.append(count_vector(s))
                    at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
                    late = frequent[at] == s if len(frequent) else np.zeros(len(s), bool)
                    prefix.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s), threshold)].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(counts, pa.binary()), lists], ["doc_id", "n", "s1", "s2", "counts", "prefix"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, counts binary, prefix array<long>")


def _allowed_edges(nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between nodes that the count-vector bound lets be linked."""
    routes = nodes.select(F.col("doc_id").alias("node"), F.explode("prefix").alias("key"))
    counted = routes.groupBy(F.col("key").alias("met_key")).agg(F.count("*").alias("met")).filter("met > 1")
    met = routes.join(counted, F.col("key") == F.col("met_key")).select("node", "key", "met")
    vectors = nodes.select(F.col("doc_id").alias("owner"), "n", "counts")
    tiles = F.ceil(F.col("met") / BUCKET_ROWS).cast("int")
    tile = F.pmod(F.xxhash64("node", F.lit("tile")), tiles).cast("int")
    dealt = (
        met.join(vectors, F.col("node") == F.col("owner"))
        .select("key", "node", "n", "counts", tile.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        .select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "n", "counts")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            pairs = allowed_forest(table["node"].to_numpy(), table["n"].to_numpy(), table["counts"].to_pylist(), begins, threshold)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def begins(table: pa.Table) -> np.ndarray:
            key, low, high = (table[c].to_numpy() for c in ("key", "low", "high"))
            new = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            return np.concatenate([[0], np.flatnonzero(new) + 1])

        for batch in batches:  # a bucket may go on in the next batch: its rows wait for it
            held.append(batch)
            table = pa.Table.from_batches(held)
            first = begins(table)
            if len(first) > 1:
                yield solve(table.slice(0, first[-1]), first)
                held = table.slice(first[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                yield solve(table, np.append(begins(table), len(table)))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _links(documents: DataFrame, nodes: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Verified edges (a, b) that connect exactly what links connect."""
    parts = components(_allowed_edges(nodes, threshold))
    sized = parts.join(nodes.select(F.col("doc_id").alias("owner"), "n"), F.col("node") == F.col("owner")).select("node", "component", "n")
    totals = sized.groupBy("component").agg(F.sum("n").alias("weight"))
    tiles = F.ceil(F.col("weight") / PART_SHINGLES).cast("int")
    placed = parts.join(totals.withColumnRenamed("component", "part"), F.col("component") == F.col("part")).select("node", "component", tiles.alias("tiles"))
    texts = documents.select("doc_id", "text").join(placed, F.col("doc_id") == F.col("node")).select("node", "component", "tiles", "text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in common.blocks(batch.column(3)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in range(3)), pa.array([s.tobytes() for s in shingle_sets(data, offsets, words)], pa.binary())], ["node", "component", "tiles", "s"])

    sets = texts.mapInArrow(rebuild, "node long, component long, tiles int, s binary")
    tile = F.pmod(F.xxhash64("node", F.lit("part")), F.col("tiles")).cast("int")
    dealt = sets.select("node", "component", "s", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select("component", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "s")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        found = verified_links(pdf["node"].to_numpy(), [np.frombuffer(bytes(s), np.uint64) for s in pdf["s"]], threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("component", "low", "high").applyInPandas(verify, "a long, b long")


def jaccard_components(documents: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id of every row."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = common.materialize(fingerprints(documents, words, threshold))
    whole = prints.filter("doc_id is not null and n > 0")
    classes = common.materialize(whole.groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id")))
    keys = classes.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "class_id")
    first = whole.join(keys, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & (F.col("doc_id") == F.col("class_id"))).dropDuplicates(["doc_id", "s1", "s2"])
    nodes = common.materialize(first.select("doc_id", "n", "counts", "prefix"))
    # a document is of the class of each of its texts, so these hang together by it
    same = whole.select("doc_id", "s1", "s2").join(keys, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2"))).filter("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    joined = components(_links(documents, nodes, words, threshold).unionByName(same)).withColumnRenamed("component", "joined")
    members = prints.select("doc_id", "n", "s1", "s2").join(keys, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & (F.col("n") > 0), "left")
    own = F.coalesce("class_id", "doc_id")
    labelled = members.join(joined, own == F.col("node"), "left")
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("joined", own)).alias("component_id"))


def drop_near_duplicates(documents: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each group, that with the smallest doc_id, and every document that is alone, with all columns."""
    groups = jaccard_components(documents, words, threshold)
    (name,) = common.fresh(documents.columns, "gone")
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, F.col("doc_id") == F.col(name), "left_anti")
