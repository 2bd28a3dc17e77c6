"""Claims that only repeat visits can support: four detectors over long tables of sightings per offer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OFFER = ("origin", "offer_key")
DAY_MS = 86_400_000
MIN_SIGHTINGS, LOW_STOCK, MIN_VIEWER_SAMPLES = 2, 10, 20


def evergreen_countdown(timers: DataFrame) -> DataFrame:
    """Offers with a timer whose end moves forward as fast as the clock; the first such timer in order of appearance."""
    by = Window.partitionBy(*OFFER, "container").orderBy("ts_ms", "seq")
    gap, moved = F.col("ts_ms") - F.lag("ts_ms").over(by), F.col("end_ms") - F.lag("end_ms").over(by)
    off = F.col("gap") % DAY_MS
    telling = (F.col("gap") >= 60_000) & (F.least(off, DAY_MS - off) >= 90 * 60_000)
    ratio = F.col("moved") / F.col("gap")
    steps = timers.withColumn("gap", gap).withColumn("moved", moved).withColumn("telling", F.coalesce(telling, F.lit(False)))
    each = steps.groupBy(*OFFER, "container").agg(
        F.count("*").alias("sightings"), F.min("seq").alias("first_seq"), F.count_if("telling").alias("comparisons"), F.count_if(F.col("telling") & (ratio > 0.7) & (ratio < 1.4)).alias("advancing")
    )
    flagged = each.filter((F.col("sightings") >= MIN_SIGHTINGS) & (F.col("advancing") > 0))
    best = flagged.groupBy(*OFFER).agg(F.min_by(F.struct("container", "advancing", "comparisons"), "first_seq").alias("b"))
    return best.select(*OFFER, "b.container", "b.advancing", "b.comparisons", F.least(F.lit(0.95), 0.6 + 0.15 * F.col("b.advancing")).alias("raw_score"))


def stock_nonmonotonic(stock: DataFrame) -> DataFrame:
    """Offers whose low count rises more than once, or never moves for a fortnight."""
    by = Window.partitionBy(*OFFER).orderBy("ts_ms", "seq")
    before = F.lag("n").over(by)
    rose = (F.col("n") > before) & (F.col("n") <= LOW_STOCK) & (before <= LOW_STOCK)
    each = stock.withColumn("rose", F.coalesce(rose, F.lit(False))).groupBy(*OFFER).agg(
        F.count("*").alias("samples"), F.count_if("rose").alias("increases"), F.min("n").alias("low"), F.max("n").alias("high"), (F.max("ts_ms") - F.min("ts_ms")).alias("span_ms")
    )
    frozen = (F.col("low") == F.col("high")) & (F.col("high") <= LOW_STOCK) & (F.col("span_ms") >= 14 * DAY_MS) & (F.col("samples") >= 4)
    found = each.withColumn("frozen", frozen.cast("int")).filter((F.col("samples") >= MIN_SIGHTINGS) & ((F.col("increases") >= 2) | (F.col("frozen") == 1)))
    return found.select(*OFFER, "samples", "increases", "frozen", F.least(F.lit(0.9), 0.55 + 0.12 * (F.col("increases") + 2 * F.col("frozen"))).alias("raw_score"))


def reference_price_ungrounded(prices: DataFrame, references: DataFrame) -> DataFrame:
    """Offers shown beside a higher "was" price on every visit of four weeks or more, and never at that price."""
    visits = prices.groupBy(*OFFER, "ts_ms").agg(F.max("minor").alias("top"))
    shown = references.groupBy(*OFFER, "ts_ms").agg(F.min("minor").alias("ref"), F.count("*").alias("refs"))
    both = visits.join(shown, [*OFFER, "ts_ms"], "full")
    each = both.groupBy(*OFFER).agg(
        F.count("top").alias("visits"), F.count_if(F.col("top").isNotNull() & F.col("ref").isNull()).alias("bare"), F.max("top").alias("highest"), F.min("ref").alias("lowest_ref"), F.sum("refs").alias("ref_samples"),
        (F.max(F.when(F.col("top").isNotNull(), F.col("ts_ms"))) - F.min(F.when(F.col("top").isNotNull(), F.col("ts_ms")))).alias("span_ms"),
    )
    days = F.col("span_ms") / F.lit(float(DAY_MS))
    found = each.filter((F.col("visits") >= 3) & (F.col("bare") == 0) & (days >= 28) & (F.col("highest") < F.col("lowest_ref")))
    return found.select(*OFFER, "visits", "ref_samples", days.alias("span_days"), F.least(F.lit(0.95), 0.6 + F.least(F.lit(0.3), (days - 28) / 60)).alias("raw_score"))


def social_proof_synthetic(viewers: DataFrame) -> DataFrame:
    """Offers whose viewer counts are constant, or too evenly spread (chi-square), or in too narrow a band."""
    spread = viewers.groupBy(*OFFER).agg(F.count("*").alias("samples"), F.min("n").alias("low"), F.max("n").alias("high")).filter(F.col("samples") >= MIN_VIEWER_SAMPLES)
    spread = spread.withColumn("bins", F.least(F.lit(8), F.greatest(F.lit(2), F.ceil(F.sqrt("samples")))).cast("int"))
    slot = F.least(F.col("bins") - 1, F.floor((F.col("n") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("bins"))).cast("int")
    counted = viewers.join(spread, list(OFFER)).withColumn("bin", slot).groupBy(*OFFER, "samples", "low", "high", "bins", "bin").agg(F.count("*").alias("c"))
    # empty bins each add the expected count: (0 - e)^2 / e = e
    expected = F.col("samples") / F.col("bins")
    chi = F.sum((F.col("c") - expected) * (F.col("c") - expected) / expected) + (F.first("bins") - F.count("*")) * F.first(expected)
    each = counted.groupBy(*OFFER, "samples", "low", "high", "bins").agg(chi.alias("chi_square"))
    constant = F.col("low") == F.col("high")
    even = (~constant & (F.col("chi_square") < F.col("bins"))).cast("int")
    narrow = (~constant & (F.col("high") - F.col("low") <= F.greatest(F.lit(3.0), F.col("high") * 0.25))).cast("int")
    found = each.withColumn("constant", constant.cast("int")).withColumn("uniformish", even).withColumn("narrow_band", narrow).filter("constant + uniformish + narrow_band > 0")
    score = F.when(F.col("constant") == 1, F.lit(0.8)).otherwise(F.least(F.lit(0.85), 0.5 + 0.2 * F.col("uniformish") + 0.2 * F.col("narrow_band")))
    return found.select(*OFFER, "samples", "bins", "constant", "uniformish", "narrow_band", score.alias("raw_score"))
