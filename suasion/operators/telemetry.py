"""Detections to counters: coarsening, validation, cohort counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suasion.functions.url import DEFAULT_RULES, SuffixRules, registrable_domain
from suasion.operators.dims import RULEPACK_VERSION, STAGES

COHORT = ("pattern_id", "detector_id", "funnel_stage", "site", "origin_category", "rulepack_version", "day_bucket", "quartile")
OUTCOME_COHORT = ("pattern_id", "funnel_stage", "site", "origin_category", "rulepack_version", "day_bucket", "added_to_cart")
MAX_BATCH = 500
DAY_MS = 86_400_000
SITE = r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$"


def quartile(score: Column) -> Column:
    return F.when(score < 0.25, 1).when(score < 0.5, 2).when(score < 0.75, 3).otherwise(4)


def day_bucket(ms: Column) -> Column:
    return F.floor(ms / F.lit(DAY_MS)).cast("long")


def site_of(origin: Column, rules: SuffixRules = DEFAULT_RULES) -> Column:
    """The registrable domain of an https origin, so that a shop's subdomains are one site; null for other schemes."""
    host = F.regexp_extract(F.lower(origin), r"^https://([^/?#:]+)", 1)
    return F.when(origin.startswith("https://"), registrable_domain(host, rules))


def to_records(detections: DataFrame, allowlist: DataFrame, rules: SuffixRules = DEFAULT_RULES) -> DataFrame:
    """Detections coarsened to what may leave the device: site, category, day, quartile."""
    coarse = detections.withColumn("site", site_of(F.col("origin"), rules)).filter("site is not null")
    joined = coarse.join(allowlist, "site", "left")
    return joined.select(
        "batch_id", "pattern_id", "detector_id", "funnel_stage", "site", F.coalesce("category", F.lit("other")).alias("origin_category"), F.lit(RULEPACK_VERSION).alias("rulepack_version"),
        day_bucket(F.col("ts_ms")).alias("day_bucket"), quartile(F.col("confidence")).alias("quartile"),
    )


def cohort_counts(records: DataFrame, cohort: tuple[str, ...] = COHORT) -> DataFrame:
    """Counters by cohort: n rows, and reporters = batches that touched it."""
    return records.groupBy(*cohort).agg(F.count("*").alias("n"), F.countDistinct("batch_id").alias("reporters"))


def valid_record(as_of_day: int) -> Column:
    """Shape of one record: site, stage, quartile, and a day within 90 of ``as_of_day``."""
    ok = F.col("site").rlike(SITE) & (F.length("site") <= 253) & F.col("funnel_stage").isin(*STAGES) & F.col("quartile").between(1, 4) & F.col("day_bucket").between(as_of_day - 90, as_of_day + 90) & F.col("pattern_id").rlike(r"^[a-z_]+\.[a-z_]+$")
    return F.coalesce(ok, F.lit(False))


def admit_batches(records: DataFrame, as_of_day: int, max_batch: int = MAX_BATCH) -> DataFrame:
    """batch_id, size, status: a batch is taken whole (204) or not at all (413 too large, 422 a bad record)."""
    judged = records.groupBy("batch_id").agg(F.count("*").alias("size"), F.min(valid_record(as_of_day).cast("int")).alias("ok"))
    return judged.select("batch_id", "size", F.when(F.col("size") > max_batch, 413).when(F.col("ok") == 0, 422).otherwise(204).alias("status"))


def batches_of(queue: DataFrame, cap: int = 5_000, size: int = MAX_BATCH) -> DataFrame:
    """Each reporter's newest ``cap`` queued rows, oldest first, in batches of ``size``."""
    newest = queue.withColumn("age", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts_ms"), F.desc("event_id")))).filter(F.col("age") <= cap)
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id"))
    return newest.withColumn("batch_seq", F.floor((nth - 1) / size).cast("int")).drop("age")
