"""Session ledgers: late charges and unrequested add-ons over child tables keyed by session and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suasion.functions.text import addon_keys, line_item_kind
from suasion.operators.dims import STAGES, stage_order

KEY = ("session_id", "origin")


def first_disclosure(fees: DataFrame) -> DataFrame:
    """The earliest stage at which a session met each charge."""
    return fees.groupBy(*KEY, "label").agg(F.min(stage_order(F.col("stage"))).alias("first_stage"))


def _base(snapshots: DataFrame) -> Column:
    return F.coalesce("subtotal", "displayed") if "displayed" in snapshots.columns else F.col("subtotal")


def reconcile(snapshots: DataFrame, fees: DataFrame) -> DataFrame:
    """Per snapshot: base price, charges, mandatory charges, their ratio to the base, and what of a total is unexplained.

    The base is the subtotal or, without one, the displayed price; without either, or where it is zero, ratio and
    unexplained are null. Snapshots need subtotal; displayed, shipping, tax and total may be missing columns.
    """
    kind = line_item_kind(F.col("label"))
    sums = fees.groupBy(*KEY, "stage").agg(
        F.sum(F.when(kind != "discount", F.col("amount")).otherwise(0)).alias("fee_total"), F.sum(F.when(kind == "mandatory_fee", F.col("amount")).otherwise(0)).alias("mandatory_total")
    )
    out = snapshots.join(sums, [*KEY, "stage"], "left").na.fill(0, ["fee_total", "mandatory_total"]).withColumn("base", _base(snapshots))
    part = lambda name: F.coalesce(F.col(name), F.lit(0)) if name in snapshots.columns else F.lit(0)
    accounted = F.col("base") + part("shipping") + part("tax") + F.col("fee_total")
    unexplained = F.coalesce(F.col("total") - accounted, F.lit(0)) if "total" in snapshots.columns else F.lit(0)
    known = F.col("base") != 0
    return out.withColumn("drip_ratio", F.when(known, F.col("mandatory_total") / F.col("base"))).withColumn("unexplained", F.when(known, unexplained).cast("long"))


def drip(snapshots: DataFrame, fees: DataFrame, min_ratio: float = 0.05) -> DataFrame:
    """Sessions whose last snapshot has charges, neither discounts nor add-ons, that the first did not show and that appeared in the cart or later."""
    order = stage_order(F.col("stage"))
    ends = snapshots.groupBy(*KEY).agg(F.min(order).alias("first"), F.max_by(F.struct("stage", _base(snapshots).alias("base")), order).alias("last"), F.max(order).alias("last_order"), F.countDistinct("stage").alias("stages")).filter("stages >= 2")
    known = fees.withColumn("at", order)
    marked = known.join(ends, list(KEY)).withColumn("kind", line_item_kind(F.col("label")))
    by_label = marked.groupBy(*KEY, "label", "kind", "first", "last_order", F.col("last.base").alias("base")).agg(
        F.min("at").alias("disclosed"), F.count_if(F.col("at") == F.col("first")).alias("shown_first"), F.sum(F.when(F.col("at") == F.col("last_order"), F.col("amount"))).alias("amount"), F.count_if(F.col("at") == F.col("last_order")).alias("lines")
    )
    late = by_label.filter((F.col("lines") > 0) & (F.col("shown_first") == 0) & ~F.col("kind").isin("discount", "optional_addon") & (F.col("disclosed") >= STAGES.index("cart")))
    each = late.groupBy(*KEY, "base").agg(F.sum("amount").alias("drip_amount"), F.sum("lines").alias("fee_count"), F.min("disclosed").alias("disclosed"))
    ratio = F.col("drip_amount") / F.col("base")
    found = each.filter(F.col("base") != 0).withColumn("drip_ratio", ratio).filter(F.col("drip_ratio") >= min_ratio)
    score = F.least(F.lit(1.0), 0.5 + 0.25 * (F.col("disclosed") / F.lit(4.0)) + 0.25 * F.least(F.lit(1.0), F.col("drip_ratio") / 0.2))
    return found.select(*KEY, "drip_amount", "fee_count", F.element_at(F.array(*map(F.lit, STAGES)), (F.col("disclosed") + 1).cast("int")).alias("first_disclosure"), "drip_ratio", score.alias("raw_score"))


def latest_choices(choices: DataFrame) -> DataFrame:
    """A session's last word on each add-on family."""
    return choices.groupBy(*KEY, "addon_key").agg(F.max_by("selected", "seq").alias("selected"))


def sneak(snapshots: DataFrame, fees: DataFrame, adds: DataFrame, choices: DataFrame) -> DataFrame:
    """Sessions with add-on lines, at the first of checkout, payment and cart that has a snapshot, that the shopper did not choose."""
    preference = F.coalesce(*(F.when(F.col("stage") == s, F.lit(k)) for k, s in enumerate(("checkout", "payment", "cart"))))
    stage = snapshots.filter(F.col("stage").isin("checkout", "payment", "cart")).groupBy(*KEY).agg(F.min_by("stage", preference).alias("stage"))
    lines = fees.join(stage, [*KEY, "stage"]).filter(line_item_kind(F.col("label")) == "optional_addon").withColumn("line", F.monotonically_increasing_id())
    chosen = latest_choices(choices).filter("selected").select(*KEY, "addon_key")
    taken = lines.select(*KEY, "label", F.explode(addon_keys(F.col("label"))).alias("addon_key")).join(chosen, [*KEY, "addon_key"]).select(*KEY, "label").distinct()
    own = lines.join(taken, [*KEY, "label"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("unattributed"))
    added = adds.groupBy(*KEY).agg(F.count("*").alias("adds_observed"))
    return own.join(added, list(KEY)).withColumn("raw_score", F.least(F.lit(1.0), 0.6 + 0.1 * F.col("unattributed")))


def stage_records(messages: DataFrame, key: tuple[str, ...], ts: str, snapshot: str) -> DataFrame:
    """First entry of each stage, and the first snapshot that came with it."""
    return messages.groupBy(*key, "stage").agg(F.min(ts).alias("entered_at"), F.min_by(snapshot, F.when(F.col(snapshot).isNotNull(), F.col(ts))).alias("snapshot"))


def newest(rows: DataFrame, key: tuple[str, ...], order: tuple[str | Column, ...], cap: int) -> DataFrame:
    """The ``cap`` newest rows of each key."""
    return rows.withColumn("_age", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_age") <= cap).drop("_age")
