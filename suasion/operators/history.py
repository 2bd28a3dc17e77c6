"""Histories kept as long tables: texts of a node, dwell, interruptions, offers, daily sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suasion.operators.ledger import newest

TEXTS_KEPT, TEXT_MOST = 12, 120
OFFERS_KEPT, OFFER_DAYS, SAMPLES_KEPT = 5_000, 90, 64
#: How many claims of a series an offer keeps.
SERIES_KEPT = {"timers": 64, "stock": 64, "viewers": 128, "prices": 64, "reference_prices": 64}
HIDDEN_MS, GESTURE_MS, EXIT_MS = 1_500, 750, 500
DAY_MS = 86_400_000


def text_history(rows: DataFrame, key: tuple[str, ...], text: str = "text", cap: int = TEXTS_KEPT) -> DataFrame:
    """The newest ``cap`` texts (120 characters of each) of each node, of those with a digit that differ from the one before. Needs ts_ms, seq."""
    shown = rows.withColumn(text, F.substring(text, 1, TEXT_MOST)).filter(F.col(text).rlike("[0-9]"))
    before = F.lag(text).over(Window.partitionBy(*key).orderBy("ts_ms", "seq"))
    changed = shown.withColumn("_before", before).filter(~F.col(text).eqNullSafe(F.col("_before"))).drop("_before")
    return newest(changed, key, (F.desc("ts_ms"), F.desc("seq")), cap)


def dwell(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """visible_ms, viewport_fraction and scroll_depth (at the first view) of each node.

    Needs ts_ms, seq, ratio, tab_visible, scroll: a state holds until the node's next row.
    """
    order = Window.partitionBy(*key).orderBy("ts_ms", "seq")
    seen = (F.col("ratio") >= 0.5) & F.col("tab_visible")
    held = rows.withColumn("_ms", F.when(seen, F.coalesce(F.lead("ts_ms").over(order) - F.col("ts_ms"), F.lit(0))).otherwise(0))
    return held.groupBy(*key).agg(F.sum("_ms").alias("visible_ms"), F.max("ratio").alias("viewport_fraction"), F.min_by("scroll", F.when(seen, F.struct("ts_ms", "seq"))).alias("scroll_depth"))


def interruptions(rows: DataFrame) -> DataFrame:
    """The modals of a page that nobody asked for. Needs page_id, node, ts_ms, seq, kind (shown, hidden, gesture, exit).

    A modal counts when it shows for the first time or after it was away long enough (since it was first hidden), unless a gesture has just called
    it up; what follows an exit at once counts in any case.
    """
    upto = Window.partitionBy("page_id").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("page_id", "node").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind, over: F.max(F.when(F.col("kind") == kind, F.col("ts_ms"))).over(over)
    # a row's spell is the number of times its modal had shown before it; what hid it first in the spell counts
    spells = rows.withColumn("_spell", F.count_if(F.col("kind") == "shown").over(before))
    hidden = F.min(F.when(F.col("kind") == "hidden", F.col("ts_ms"))).over(Window.partitionBy("page_id", "node", "_spell"))
    marked = spells.withColumn("_hidden", hidden).withColumn("_gesture", last("gesture", upto)).withColumn("_exit", last("exit", upto))
    since = lambda c: F.col("ts_ms") - F.col(c)
    fresh = (F.col("_spell") == 0) | (since("_hidden") >= HIDDEN_MS)
    asked = F.coalesce(since("_gesture") < GESTURE_MS, F.lit(False)) & ~F.coalesce(since("_exit") <= EXIT_MS, F.lit(False))
    return marked.filter((F.col("kind") == "shown") & F.coalesce(fresh, F.lit(False)) & ~asked).select("page_id", "node", "ts_ms", "seq")


def merge_offers(sightings: DataFrame, value: str = "n", cap: int = SAMPLES_KEPT) -> DataFrame:
    """One row per offer: sightings, first_seen, last_seen and its newest ``cap`` samples in order."""
    key = ("origin", "offer_key")
    spans = sightings.groupBy(*key).agg(F.countDistinct("ts_ms").alias("sightings"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))
    kept = newest(sightings, key, (F.desc("ts_ms"), F.desc("seq")), cap).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ts_ms", "seq", value))).alias("_s"))
    return spans.join(kept, list(key)).withColumn("samples", F.transform("_s", lambda s: s[value])).drop("_s")


def merge_observations(looks: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per offer: sightings, first_seen, last_seen, and its newest claims of each series, in order.

    ``looks`` (origin, offer_key, ts_ms) has a row for each time that the offer was seen; ``claims`` (origin, offer_key,
    ts_ms, seq, series, n, tag) what was claimed then: n is an end time, a count or an amount, tag a container or a
    currency. A series keeps SERIES_KEPT of its claims; one that SERIES_KEPT does not name is left out. An offer without claims has empty series.
    """
    key = ["origin", "offer_key"]
    spans = looks.groupBy(*key).agg(F.count("*").alias("sightings"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))
    room = F.create_map(*(F.lit(x) for pair in SERIES_KEPT.items() for x in pair))[F.col("series")]
    nth = F.row_number().over(Window.partitionBy(*key, "series").orderBy(F.desc("ts_ms"), F.desc("seq")))
    # by the largest room, a plain number, Spark leaves out most before the shuffle
    kept = claims.withColumn("_nth", nth).filter((F.col("_nth") <= max(SERIES_KEPT.values())) & (F.col("_nth") <= room))
    claim = F.struct(F.col("ts_ms").cast("long").alias("ts_ms"), F.col("seq").cast("long").alias("seq"), F.col("n").cast("long").alias("n"), F.col("tag").cast("string").alias("tag"))
    series = kept.groupBy(*key).agg(*(F.sort_array(F.collect_list(F.when(F.col("series") == s, claim))).alias(s) for s in SERIES_KEPT))
    empty = F.array().cast("array<struct<ts_ms:bigint,seq:bigint,n:bigint,tag:string>>")
    return spans.join(series, key, "left").withColumns({s: F.coalesce(s, empty) for s in SERIES_KEPT})


def evict_offers(offers: DataFrame, as_of_ms: int, cap: int = OFFERS_KEPT, days: int = OFFER_DAYS) -> DataFrame:
    """The ``cap`` offers seen last, of those seen within ``days``."""
    return offers.filter(F.col("last_seen") >= as_of_ms - days * DAY_MS).orderBy(F.desc("last_seen"), "offer_key").limit(cap)


def session_id(user: Column, ts_ms: Column) -> Column:
    """A new id each UTC day, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / F.lit(DAY_MS)).cast("int"))
    return F.concat_ws(":", user.cast("string"), day.cast("string"))
