"""Sharding: contiguous shards of near-equal byte size, by global prefix sums. DataFrame functions throughout.

Rows with their size and checksum are range-partitioned by id, sorted and stored, each with a mark that holds its
partition and its place there, so that both are facts, not something a retry might decide anew. The partitions' totals
(one row each) give every partition its offset; running sums over (mark, size) inside partitions give the place where a
shard begins; a row goes to the shard in which the middle of its bytes falls. These places, at most one for each shard
and one for each partition, are broadcast, and the stored rows get shard and slot as they are read: texts go through one
range shuffle when whole documents are sharded, and through none when only the assignment is asked for. Shards are
contiguous in id order and differ from the equal target by less than the two rows at their ends. No step needs more than
one range partition in a task.

Defined results: a null text has no bytes and the checksum of no bytes (0), an empty one likewise; a text longer than
a whole shard leaves the shards that it covers empty; rows with equal ids are ordered by checksum and size and may lie
in neighbouring shards, and each row, repeated or not, has a slot of its own; null ids come first; an empty table gives
no rows; ``law`` is always ``bytes``, and ``grown_shard`` null, as a further shard moves rows under this law. Where
whole documents are sharded, a column of theirs with the name of a result column is kept with an underscore added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suasion.llm.common import fresh, materialize

N_SHARDS = 40
ROW_OVERHEAD = 16
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Bits of a mark below the partition number.
PLACE_BITS = 33


def _measured(documents: DataFrame, kept: dict[str, str]) -> DataFrame:
    """The kept columns under their new names, size and text_crc32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(*(F.col(f"`{c}`").alias(name) for c, name in kept.items()), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def _placed(rows: DataFrame, order_by: list[str], n_shards: int) -> DataFrame:
    """The rows with law, shard, slot and grown_shard."""
    mark, cuts, part = fresh([*rows.columns, *RESULT], "mark", "cuts", "part")
    order = [F.col(f"`{c}`") for c in order_by]
    stored = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()))
    narrow = stored.select(F.col(mark).alias("mark"), "size", F.shiftright(mark, PLACE_BITS).alias("part"))
    totals = narrow.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("all_bytes"))
    running = Window.partitionBy("part").orderBy("mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    home = (
        narrow.withColumn("upto", F.sum("size").over(running))
        .join(F.broadcast(offsets), "part")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(middle * {n_shards}L) div (2 * all_bytes)")).cast("int"))
    )
    place = F.col("mark").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    begins = home.groupBy("part", "shard").agg(F.min("mark").alias("mark"), F.min(F.col("rows_before") + place).alias("position"), F.first("rows_before").alias("rows_before"))
    firsts = begins.groupBy(F.col("shard").alias("of")).agg(F.min("position").alias("first"))  # at most n_shards rows
    listed = begins.join(F.broadcast(firsts), F.col("shard") == F.col("of")).groupBy(F.col("part").alias(part)).agg(F.sort_array(F.collect_list(F.struct("mark", "shard", (F.col("rows_before") - F.col("first")).alias("shift")))).alias(cuts))
    found = F.element_at(F.filter(F.col(cuts), lambda c: c["mark"] <= F.col(mark)), -1)
    joined = stored.join(F.broadcast(listed), F.shiftright(mark, PLACE_BITS) == F.col(part)).withColumn(cuts, found)
    slot = (F.col(mark).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.col(f"{cuts}.shift")).cast("long")
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.lit("bytes").alias("law"), F.col(f"{cuts}.shard").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def assign_shards(documents: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = materialize(_measured(documents, {"doc_id": "doc_id"}))
    return _placed(rows, ["doc_id", "text_crc32", "size"], n_shards).select("doc_id", *RESULT)


def shard_documents(documents: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The documents with all their columns, and size, text_crc32, law, shard, slot, grown_shard."""
    clashing = [c for c in documents.columns if c.lower() in RESULT]
    renamed = dict(zip(clashing, fresh([*documents.columns, *RESULT], *clashing), strict=True))
    (tie,) = fresh([*documents.columns, *renamed.values(), *RESULT], "tie")
    hashed = [f"`{f.name}`" for f in documents.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    rows = _measured(documents.withColumn(tie, F.xxhash64(*hashed)), {c: renamed.get(c, c) for c in [*documents.columns, tie]})
    return _placed(rows, ["doc_id", "text_crc32", "size", tie], n_shards).drop(tie)


def write_shards(documents: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Write the documents as one folder for each shard, in slot order inside its files; rows are not shuffled again."""
    shard_documents(documents, n_shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + {ROW_OVERHEAD} AS size FROM documents
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM d
), s AS (
  SELECT doc_id, size, least({N_SHARDS - 1}, ((2 * upto - size) * {N_SHARDS}) // (2 * total))::INTEGER AS shard FROM p
)
SELECT doc_id, size::BIGINT AS size, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot FROM s
"""
