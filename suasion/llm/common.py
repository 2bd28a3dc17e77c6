"""Shared pieces: byte-level text views for Arrow batches, hashing, sampling, free names, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18
#: Text bytes of a slice of an Arrow batch (Spark bounds the batch itself by bytes); one longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: Hash samples are taken out of so many values: fine enough for a few thousand rows out of any table.
HASH_RANGE = 1 << 62
#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = " \t\n\x0b\x0c\r"

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED_CODE = _BYTE_CODE[_FOLD]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NOT_SPACE = ~_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_powers: dict[str, np.ndarray] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder does for one local JVM; on a cluster that is an error, as
    executors do not see each other's disks.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="suasion-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores added as keep it from meeting one of ``columns`` (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices (not copied) of about SLICE_BYTES of text in column ``at``, so what a task holds for them is bounded."""
    for batch in batches:
        for low, high, _, _ in blocks(batch.column(at), SLICE_BYTES):
            yield batch.slice(low, high - low)


def texts(column: pa.Array) -> list[str]:
    """The texts (null as empty); each run of bytes that is not UTF-8 is read as U+FFFD."""
    return [(x.as_py() or b"").decode("utf-8", "replace") for x in column.cast(pa.binary())]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back.

    The files survive lost executors, are columnar (later passes read what they need), and go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/suasion-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def held_out() -> Column:
    """The rows no classifier may learn from: crc32 of the id's text divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def in_sample(share: float, *key: Column | str) -> Column:
    """Whether a row falls in a sample of about ``share`` of all, by the hash of ``key``: the same rows in any layout."""
    return F.pmod(F.xxhash64(*key), F.lit(HASH_RANGE)) < F.lit(int(min(1.0, share) * HASH_RANGE))


def shards_of(rows: int, max_rows: int, shard_rows: int) -> int:
    """Into how many shards a sample of at most ``max_rows`` out of ``rows`` rows is cut."""
    return max(1, round(min(rows, max_rows) / shard_rows))


def training_sample(documents: DataFrame, labels: DataFrame, target: str, max_rows: int, shard_rows: int) -> tuple[DataFrame, int]:
    """Labelled texts to learn from: (shard int, order_key long, label int, text string) and the number of shards.

    About ``max_rows`` rows at most, chosen by a hash of doc_id (the same rows in any layout). A document labelled
    more than once counts with its largest label; null ids and labels are left out. The chosen ids are at most
    ``max_rows`` or so rows, which bounds the broadcast.
    """
    named = labels.select("doc_id", F.col(target).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = named.count()
    chosen = named.filter(in_sample(max_rows / max(1, rows), "doc_id", F.lit(target)))
    shards = shards_of(rows, max_rows, shard_rows)
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    key = F.xxhash64("doc_id", F.lit("order"))
    return found.select(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), key.alias("order_key"), "label", "text"), shards


def as_bytes(sample: DataFrame) -> DataFrame:
    """The sample with its texts as bytes: pandas then takes those that are not UTF-8 as well."""
    return sample.withColumn("text", F.col("text").cast("binary"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column (null as empty), without copying."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes (one long row is a block of its own): first row, end row, bytes, offsets."""
    data, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES * 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED_CODE if fold else _BYTE_CODE)[data] * _power("up", _BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def token_spans(data: np.ndarray, offsets: np.ndarray, words: str = "blank") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each token. ``blank``: maximal runs without blanks; ``alnum``: of letters, digits and non-ASCII."""
    inside = (_NOT_SPACE if words == "blank" else _ALNUM)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(offsets, first, "right") - 1
