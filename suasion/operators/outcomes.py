"""Page views to outcome rows: idle-gap sessions that an add ends at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suasion.operators.telemetry import RULEPACK_VERSION, day_bucket, site_of

IDLE_MS = 30 * 60_000
MAX_EXPOSED = 32


def page_views(messages: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Views cut where a viewer was idle for more than ``idle_ms`` or had just added to the cart.

    Stage, site and day are those of a view's first message; exposed patterns are collected, MAX_EXPOSED at most, in
    order of first appearance.
    """
    by = Window.partitionBy("view_id", "origin").orderBy("ts_ms", "seq")
    starts = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(by) > idle_ms) | F.lag("added").over(by), F.lit(True))
    cut = messages.withColumn("starts", starts.cast("int")).withColumn("view_no", F.sum("starts").over(by))
    first_seen = cut.groupBy("view_id", "origin", "view_no", "pattern_id").agg(F.min(F.struct("ts_ms", "seq")).alias("seen"), F.min_by("funnel_stage", F.struct("ts_ms", "seq")).alias("stage"), F.max("added").alias("added"))
    return first_seen.groupBy("view_id", "origin", "view_no").agg(
        F.min("seen.ts_ms").alias("started_ms"), F.min_by("stage", "seen").alias("funnel_stage"), F.max("added").alias("added"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seen", "pattern_id"))), lambda x: x["pattern_id"]), 1, MAX_EXPOSED).alias("exposed")
    )


def outcome_rows(views: DataFrame) -> DataFrame:
    """The page baseline and one row for each technique, for views of https pages."""
    rows = views.withColumn("site", site_of(F.col("origin"))).filter("site is not null").withColumn("pattern_id", F.explode(F.concat(F.array(F.lit("_page")), "exposed")))
    return rows.select("view_id", "view_no", "pattern_id", "funnel_stage", "site", F.lit(RULEPACK_VERSION).alias("rulepack_version"), day_bucket(F.col("started_ms")).alias("day_bucket"), F.col("added").cast("int").alias("added_to_cart"))
