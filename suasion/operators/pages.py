"""Page-level classifiers over a page_meta table of counted signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suasion.operators.dims import STAGES

# fixed values: path patterns in order; one vote of this weight
PATH_SIGNALS = (
    (r"(?i)/payment|/billing", "payment"),
    (r"(?i)/checkout|/place-?order", "checkout"),
    (r"(?i)/(cart|basket|bag)(/|$|\?)", "cart"),
    (r"(?i)/(products?|item|itm|dp|pd)/", "pdp"),
    (r"(?i)/p/[^/]+", "pdp"),
    (r"(?i)/(collections?|category|c|search|s)(/|\?|$)", "browse"),
)
URL_WEIGHT = 0.2
BOOLEANS = ("has_cc_field", "has_address", "has_contact", "has_postal", "has_steps", "has_quantity", "has_remove", "has_total", "has_product_ld", "og_product")
COUNTS = ("place_order", "cart_rows", "summary_rows", "checkout_cta", "add_to_cart", "booking_cta", "per_unit_rows", "priced_texts")


def _sum(*terms: tuple[Column, Column | float]) -> Column:
    total = F.lit(0.0)
    for on, amount in terms:
        total = total + F.when(on, amount if isinstance(amount, Column) else F.lit(amount)).otherwise(F.lit(0.0))
    return total


def funnel_stage(meta: DataFrame) -> DataFrame:
    """stage and its score: additive evidence for each stage, the first of the best."""
    c = F.col
    placing, editable = c("place_order") > 0, (c("cart_rows") >= 1) & c("has_remove")
    vote = F.lit(None).cast("string")
    for pattern, stage in reversed(PATH_SIGNALS):
        vote = F.when(F.coalesce(c("path"), F.lit("/")).rlike(pattern), stage).otherwise(vote)
    url = lambda stage: (F.coalesce(vote == stage, F.lit(False)), URL_WEIGHT)
    scores = {
        "browse": 0.15 + _sum((c("add_to_cart") >= 4, 0.35), (editable, -0.3), (c("has_cc_field"), -0.4), url("browse")),
        "pdp": _sum((c("has_product_ld"), 0.4), (c("og_product"), 0.35), (c("add_to_cart") == 1, 0.4), (editable, -0.5), (c("has_cc_field"), -0.4), url("pdp")),
        "cart": _sum((c("cart_rows") >= 1, F.least(F.lit(0.6), 0.35 + 0.12 * c("cart_rows"))), (c("has_quantity") & c("has_remove"), 0.35), (c("summary_rows") >= 2, 0.3), (c("has_total"), 0.2), ((c("checkout_cta") > 0) & (c("add_to_cart") == 0), 0.25), url("cart")),
        "checkout": _sum((c("has_address"), 0.5), (c("has_contact") & ((c("summary_rows") >= 1) | c("has_total")), 0.45), (c("has_postal"), 0.2), (c("has_steps"), 0.4), (placing, 0.25), (c("summary_rows") >= 2, 0.2), url("checkout")),
        "payment": _sum((c("has_cc_field"), 0.9), (placing, 0.35), url("payment")),
    }
    rated = meta.withColumn("_s", F.array(*(F.round(scores[s], 6) for s in STAGES)))
    best = F.array_max("_s")
    return rated.withColumn("stage", F.element_at(F.array(*map(F.lit, STAGES)), F.array_position("_s", best).cast("int"))).withColumn("stage_score", best).drop("_s")


def commerce(meta: DataFrame) -> DataFrame:
    """is_commerce, its score and the reasons: each signal adds a point or half of one; one point makes a shop.

    ``sells_ld`` (json_ld.selling) is asked where no product is named in JSON-LD; without that column nothing sells there.
    """
    c = F.col
    sells = ~c("has_product_ld") & c("sells_ld") if "sells_ld" in meta.columns else F.lit(False)
    signals = (
        (c("has_product_ld"), 1.0, "product"), (sells, 1.0, "offer"), (c("og_product"), 1.0, "og_product"), ((c("cart_rows") > 0) & (c("has_quantity") | c("has_remove")), 1.0, "cart_rows"), (c("has_total") & (c("summary_rows") >= 2), 1.0, "total"), (c("place_order") > 0, 1.0, "place_order"),
        (c("has_steps") & (c("checkout_cta") > 0), 1.0, "steps"), (c("per_unit_rows") > 0, 1.0, "per_unit"), (c("priced_texts") >= 20, 1.0, "many_prices"), (c("priced_texts").between(8, 19), 0.5, "some_prices"), ((c("booking_cta") > 0) & ((c("summary_rows") > 0) | (c("priced_texts") >= 4)), 1.0, "booking"),
        (c("add_to_cart") > 0, 0.5, "add_to_cart"), (c("checkout_cta") > 0, 0.5, "checkout"), (c("summary_rows") > 0, 0.5, "summary"),
    )
    score = _sum(*((on, points) for on, points, _ in signals))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(on, F.lit(why)) for on, _, why in signals))), ",")
    return meta.withColumn("commerce_score", score).withColumn("is_commerce", score >= 1.0).withColumn("reasons", reasons)


def prominence(nodes: DataFrame) -> DataFrame:
    """relative_size and prominent of each node against its page's upper-median font and most common background.

    Needs font_px, weight, background. Both page figures come from counts by value, so a page of any number of nodes is small.
    """
    sizes = nodes.groupBy("page_id", "font_px").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("page_id").orderBy("font_px"))
    total = F.sum("n").over(Window.partitionBy("page_id"))
    median = sizes.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("page_id").agg(F.min("font_px").alias("median_px"))
    grounds = nodes.groupBy("page_id", "background").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    modal = grounds.groupBy("page_id").agg(F.max_by("background", F.struct("n", -F.col("first"))).alias("page_background"))
    joined = nodes.join(median, "page_id").join(modal, "page_id")
    relative = F.round(F.col("font_px") / F.col("median_px"), 2)
    return joined.withColumn("relative_size", relative).withColumn("prominent", ~((F.col("relative_size") < 0.9) & (F.col("weight") < 600) & (F.col("background") == F.col("page_background"))))
