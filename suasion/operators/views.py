"""The published aggregate views over the two counter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 20


def site_prevalence(counts: DataFrame) -> DataFrame:
    return counts.groupBy("site", "origin_category", "pattern_id").agg(
        F.sum("n").alias("detections"), F.sum("reporters").alias("batches"), F.countDistinct("day_bucket").alias("days_seen"), F.min("day_bucket").alias("first_day"), F.max("day_bucket").alias("last_day")
    )


def pattern_reach(counts: DataFrame) -> DataFrame:
    return counts.groupBy("pattern_id").agg(F.countDistinct("site").alias("sites"), F.sum("n").alias("detections"))


def pattern_by_stage(counts: DataFrame) -> DataFrame:
    return counts.groupBy("pattern_id", "funnel_stage").agg(F.countDistinct("site").alias("sites"), F.sum("n").alias("detections"))


def public(view: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Rows that enough batches stand behind."""
    return view.filter(F.col("batches") >= floor)


def _rate(part: str, whole: str):
    return F.col(part).cast("double") / F.col(whole)


def pattern_add_rate(outcomes: DataFrame) -> DataFrame:
    added = F.sum(F.when(F.col("added_to_cart") == 1, F.col("n")).otherwise(0))
    by = outcomes.groupBy("pattern_id").agg(F.sum("n").alias("views"), added.alias("added"), F.countDistinct("site").alias("sites"))
    return by.withColumn("add_rate", F.round(_rate("added", "views"), 4))


def site_pattern_add_rate(outcomes: DataFrame) -> DataFrame:
    """Add rate of each technique in each shop beside the shop's own baseline, and their ratio."""
    added = F.sum(F.when(F.col("added_to_cart") == 1, F.col("n")).otherwise(0))
    per = outcomes.groupBy("site", "pattern_id").agg(F.sum("n").alias("views"), added.alias("added"), F.sum("reporters").alias("batches"))
    base = per.filter("pattern_id = '_page'").select("site", F.col("views").alias("base_views"), F.col("added").alias("base_added"))
    lift = F.when(F.col("base_added") != 0, F.round(_rate("added", "views") / _rate("base_added", "base_views"), 3))
    return per.filter("pattern_id <> '_page'").join(base, "site").select(
        "site", "pattern_id", "views", "added", F.round(_rate("added", "views"), 4).alias("add_rate"), "base_views", F.round(_rate("base_added", "base_views"), 4).alias("base_add_rate"), lift.alias("lift"), "batches"
    )


def daily_summary(detections: DataFrame, since_ms: int) -> DataFrame:
    """By pattern and stage since a time: detected, surfaced, below the salience gate, distinct origins."""
    return detections.filter(F.col("ts_ms") >= since_ms).groupBy("pattern_id", "funnel_stage").agg(
        F.count("*").alias("detected"), F.count_if(F.col("confidence") >= 0.75).alias("surfaced"), F.count_if(F.col("visible_ms") < F.when(F.col("ephemeral"), 400).otherwise(800)).alias("below_salience"), F.countDistinct("origin").alias("origins")
    )


def top_patterns(detections: DataFrame, k: int = 5) -> DataFrame:
    return detections.groupBy("pattern_id").agg(F.count("*").alias("detected")).orderBy(F.desc("detected"), "pattern_id").limit(k)
