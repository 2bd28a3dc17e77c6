"""What a page's JSON-LD says of selling, read in the JVM as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: kinds that mean a sale, keys that mean one whatever their value, and how deep they are looked for
SELLING_TYPES = ("Offer", "AggregateOffer", "Order", "ShoppingCart", "CheckoutPage")
SELLING_KEYS = ("offers", "priceCurrency")
DEPTH = 6

BLOCK = r"(?is)<script\b[^>]*?\stype\s*=\s*[\"']?application/ld\+json[\"']?(?:\s[^>]*)?>(.*?)</script>"


def blocks(html: Column) -> Column:
    """The texts of a page's JSON-LD scripts, in order."""
    return F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))


def _sells(node: Column) -> Column:
    kind = F.array_append(F.coalesce(F.try_variant_get(node, "$['@type']", "array<string>"), F.array().cast("array<string>")), F.try_variant_get(node, "$['@type']", "string"))
    named = F.arrays_overlap(kind, F.array(*map(F.lit, SELLING_TYPES)))
    keyed = [F.try_variant_get(node, f"$.{key}", "variant").isNotNull() for key in SELLING_KEYS]
    return F.coalesce(named, F.lit(False)) | keyed[0] | keyed[1]


def selling(pages: DataFrame, key: str = "page_id", texts: str = "json_ld") -> DataFrame:
    """(key, sells_ld) of pages with JSON-LD (an array of texts): does an object at most DEPTH levels down mean a sale?

    A block that is no JSON (or repeats a key within an object) says nothing, nor does a null. Pages without blocks are
    left out. Each level is one explode of the level above, so a page is read once and in the JVM; an object that sells
    is not taken apart any more.
    """
    level = pages.select(key, F.explode(texts).alias("_text")).select(key, F.try_parse_json("_text").alias("_node")).withColumn("_sells", _sells(F.col("_node")))
    tvf = pages.sparkSession.tvf
    for _ in range(DEPTH):
        inside = F.when(~F.col("_sells"), F.col("_node"))
        level = level.lateralJoin(tvf.variant_explode_outer(inside.outer())).select(key, "_sells", F.col("value").alias("_node"))
        level = level.withColumn("_sells", F.col("_sells") | _sells(F.col("_node")))
    return level.groupBy(key).agg(F.max("_sells").alias("sells_ld"))
