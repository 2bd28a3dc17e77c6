"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (partial sums on the map side) joined back to the edges, so a node with a third of all
edges is one row per map task in the aggregate and a skewed side that Spark splits in the join. Each step's edges are
stored in the shared folder. The steps end when the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm.common import materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    moved = both.join(least.withColumnRenamed("u", "lu"), F.col("u") == F.col("lu")).filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least.withColumnRenamed("u", "lu"), F.col("u") == F.col("lu")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its smallest node."""
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = materialize(_small_star(_large_star(now)))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
