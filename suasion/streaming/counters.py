"""Stored events and counters, fed by streams: idempotent by batch, pruned by whole days.

A table is a folder of increments, ``day_bucket=D/batch=B``. A micro-batch overwrites the partitions of its own number
and no others, so a batch that is run again after a failure leaves what it left before. Counters are the sums of their
increments; ``compact`` writes the sums of all batches up to one as a new version beside the increments, which counts only
once it is complete, so that a reader or a crash in between sees every batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from suasion.operators import ingest
from suasion.operators.telemetry import COHORT, OUTCOME_COHORT

DAY = "day_bucket"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder: a table's days or versions, never its files."""
    target, fs = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def append(rows: DataFrame, batch: int, path: str) -> None:
    """Add a batch's rows to a table by day; the same batch again replaces itself."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "batch").parquet(path)


def prune(spark: SparkSession, path: str, before_day: int) -> list[int]:
    """Delete the days before ``before_day``, whole; which ones."""
    gone = []
    for name in _names(spark, path):
        if name.startswith(f"{DAY}=") and name.split("=")[1].lstrip("-").isdigit() and int(name.split("=")[1]) < before_day:
            target, fs = _files(spark, f"{path}/{name}")
            fs.delete(target, True)
            gone.append(int(name.split("=")[1]))
    return sorted(gone)


class Counters:
    """Counters of one cohort: n grows by rows, reporters by one for each client batch."""

    def __init__(self, spark: SparkSession, root: str, cohort: tuple[str, ...] = COHORT):
        self.spark, self.root, self.cohort = spark, root.rstrip("/"), cohort

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take up a micro-batch's rows (the cohort and batch_id); counted first, so a row a cohort is written."""
        append(rows.groupBy(*self.cohort).agg(F.count("*").alias("n"), F.countDistinct("batch_id").alias("reporters")), batch, f"{self.root}/increments")

    def _version(self) -> int:
        done = [int(n.split("=")[1]) for n in _names(self.spark, f"{self.root}/sums") if n.startswith("upto=") and "_SUCCESS" in _names(self.spark, f"{self.root}/sums/{n}")]
        return max(done, default=-1)

    def _schema(self) -> str:
        kinds = {DAY: "long", "quartile": "int", "added_to_cart": "int"}
        return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in self.cohort) + ", n long, reporters long"

    def _increments(self) -> DataFrame | None:
        if not _names(self.spark, f"{self.root}/increments"):
            return None
        return self.spark.read.schema(f"{self._schema()}, batch long").parquet(f"{self.root}/increments")

    def read(self) -> DataFrame:
        """cohort, n, reporters."""
        version, new = self._version(), self._increments()
        parts = []
        if version >= 0:
            parts.append(self.spark.read.parquet(f"{self.root}/sums/upto={version}"))
        if new is not None:
            parts.append(new.filter(F.col("batch") > version).select(*self.cohort, "n", "reporters"))
        if not parts:
            return self.spark.createDataFrame([], self._schema())
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return every.groupBy(*self.cohort).agg(F.sum("n").alias("n"), F.sum("reporters").alias("reporters"))

    def compact(self, upto: int) -> None:
        """Sum the batches up to ``upto`` into a new version; increments stay until ``sweep``."""
        version, new = self._version(), self._increments()
        if upto <= version or new is None:
            return
        fresh = new.filter((F.col("batch") > version) & (F.col("batch") <= upto)).select(*self.cohort, "n", "reporters")
        both = fresh if version < 0 else fresh.unionByName(self.spark.read.parquet(f"{self.root}/sums/upto={version}"))
        both.groupBy(*self.cohort).agg(F.sum("n").alias("n"), F.sum("reporters").alias("reporters")).write.mode("overwrite").parquet(f"{self.root}/sums/upto={upto}")

    def sweep(self) -> None:
        """Delete increments and versions that the newest version holds."""
        version = self._version()
        for day in _names(self.spark, f"{self.root}/increments"):
            for name in _names(self.spark, f"{self.root}/increments/{day}") if day.startswith(f"{DAY}=") else ():
                if name.startswith("batch=") and int(name.split("=")[1]) <= version:
                    target, fs = _files(self.spark, f"{self.root}/increments/{day}/{name}")
                    fs.delete(target, True)
        for name in _names(self.spark, f"{self.root}/sums"):
            if name.startswith("upto=") and int(name.split("=")[1]) < version:
                target, fs = _files(self.spark, f"{self.root}/sums/{name}")
                fs.delete(target, True)


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``take(rows, batch number)`` for everything that is there now; a restart goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_counters(bodies: DataFrame, root: str, categories: tuple[str, ...], as_of_day: int) -> StreamingQuery:
    """Judge a stream of requests (batch_id, method, content_type, body) and count the rows of those admitted."""
    spark = bodies.sparkSession
    records, outcomes = Counters(spark, f"{root}/records"), Counters(spark, f"{root}/outcomes", OUTCOME_COHORT)

    def take(rows: DataFrame, batch: int) -> None:
        judged = ingest.judge(rows, categories, as_of_day).persist()
        try:
            for store, part in zip((records, outcomes), ingest.admitted(judged), strict=True):
                store.add(part, batch)
        finally:
            judged.unpersist()

    return each_batch(bodies, take, f"{root}/offsets")


def store_events(events: DataFrame, root: str) -> StreamingQuery:
    """Append a stream of events (with ts) to a table by day."""
    dated = events.withColumn(DAY, F.floor(F.unix_seconds("ts") / 86_400).cast("int"))
    return each_batch(dated, lambda rows, batch: append(rows, batch, f"{root}/events"), f"{root}/offsets")


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/events")
