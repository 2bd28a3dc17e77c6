"""A training-corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage reads all that its predecessor kept; all but the last return the columns of documents, and the last adds size,
checksum, law, shard and slot to them, texts included.

Defined results: a null or empty text is judged by the quality model as one empty line and, if kept, is nobody's copy, no
leak and has no tokens; texts of any length are read whole; rows with equal doc_id are one document to the near-duplicate
stage (all stay or all go) and rows of their own to the others, and mixing repeats rows, each with a slot of its own in
the shards; of a group of near-duplicates the smallest doc_id stays; an empty table gives no rows; other columns pass
through, under their own names (the last stage adds an underscore to one that has the name of a column it adds).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suasion.llm import common, decontaminate, mixing, ngram_join, quality, sharding
from suasion.sources.tables import table

#: Documents that score less are rejected.
MIN_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the line model finds poor."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), MIN_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates: five words, similarity 0.8 or more."""
    return ngram_join.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that languages reach their target shares; none is dropped."""
    return mixing.mix(docs, mixing.language_labels(docs, table(spark, sf_dir, "labels")), mixing.TARGETS, min_rate=1.0)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents, whole, into contiguous shards of equal bytes."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: Classifiers and group links can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
