"""The page pass: from scanned pages to candidates, detections, price snapshots, offer keys and observations.

A scanned page is (page_id, url, meta, nodes). Everything below is a projection of it, or one aggregate by page; nodes of
different pages never meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.functions.bind import bound, once
from suasion.functions.hashing import create_hash
from suasion.functions.money import parse_prices, without_price
from suasion.functions.text import clock_seconds, line_item_kind, normalize_text, normalize_title
from suasion.functions.url import path_template
from suasion.operators import detectors, json_ld
from suasion.operators.pages import commerce, funnel_stage

# fixed values: labels of sums, limits of texts, forms of claims that are compared between visits
SUBTOTAL = r"\bsub-?total\b|\bitems? total\b|\bmerchandise\b|\bbag total\b"
TOTAL = r"\b(?:order )?total\b|\bamount due\b|\byou pay\b|\bgrand total\b|\bto pay\b"
LABEL_TEXT, SCOPE_TEXT, CLAIM_TEXT, PRICE_AREA, TIMERS = 120, 140, 200, 400, 3
STOCK = r"\bonly (\d{1,3}) (?:left|remaining|available)\b|\b(\d{1,3}) (?:left|remaining) in stock\b|\bonly (\d{1,3}) in stock\b"
VIEWERS = r"\b(\d{1,4})\s*(?:other\s+)?(?:people|shoppers|customers|users|others)\s+(?:are\s+)?(?:viewing|looking at|watching)\b|\b(\d{1,4})\s+(?:sold|bought|purchased) in the (?:last|past)\b"
VARIANTS = r"\b\d{1,3} (?:sizes?|colou?rs?|styles?|variants?|options?|shades?) (?:left|remaining|available)\b"
CLOCK = r"\b\d{1,3}:[0-5]\d(?::[0-5]\d)?\b"
OBSERVATION_MS = 60_000
CONTROLS = ("button", "a", "input")
#: What text detectors read of a candidate, and what no detector reads.
TEXT_COLUMNS = ("page_id", "idx", "stage", "selector_path", "text", "raw_text", "text_history", "has_progress", "has_progress_child", "ephemeral", "is_control", "in_dialog", "accessible_name", "container_path", "container_text")
UNREAD = ("summary_rows", "parent_idx", "tag_name", "role", "rendered", "font_px", "attrs")


def staged(scanned: DataFrame) -> DataFrame:
    """The scanned pages with their funnel stage."""
    signals = scanned.select("*", "meta.*", path_template(F.col("url")).alias("path"), F.coalesce(F.col("meta.og_type") == "product", F.lit(False)).alias("og_product"))
    return funnel_stage(signals).select(*scanned.columns, "stage", "stage_score")


def shops(scanned: DataFrame) -> DataFrame:
    """page_id, is_commerce, commerce_score and reasons of each scanned page. Reads them twice: store them first."""
    og = F.coalesce(F.col("meta.og_type").isin("product", "product.item"), F.lit(False))
    sells = json_ld.selling(scanned.select("page_id", F.col("meta.json_ld").alias("json_ld")))
    judged = commerce(scanned.select("page_id", "meta.*", og.alias("og_product")).join(sells, "page_id", "left"))
    return judged.select("page_id", "is_commerce", "commerce_score", "reasons")


def candidates(pages: DataFrame) -> DataFrame:
    """One row for each rendered node of staged pages, as the detectors want it; histories are those of one look: empty."""
    bar = lambda n: (n["role"] == "progressbar") | (n["attrs"]["role"] == "progressbar")
    bars = F.transform(F.filter("nodes", bar), lambda n: n["parent_idx"])
    nodes = pages.select("page_id", "stage", F.col("meta.summary_rows").alias("summary_rows"), bars.alias("_bars"), F.inline("nodes")).withColumn("has_progress_child", F.coalesce(F.array_contains("_bars", F.col("idx")), F.lit(False))).drop("_bars")
    control = F.col("tag_name").isin(*CONTROLS) | F.coalesce(F.col("role").isin("button", "link"), F.lit(False))
    button = F.col("tag_name").isin("button", "a") | F.coalesce(F.col("role") == "button", F.lit(False)) | ((F.col("tag_name") == "input") & F.coalesce(F.col("input_type").isin("button", "submit"), F.lit(False)))
    shown = nodes.filter("rendered").withColumnRenamed("text", "raw_text")
    return shown.select(
        "*", normalize_text(F.col("raw_text")).alias("text"), control.alias("is_control"), F.lit(False).alias("ephemeral"), F.coalesce("attrs.name", F.lit("")).alias("group_name"), F.lit(False).alias("touched"), button.alias("is_button"), F.concat_ws(" ", "accessible_name", F.col("attrs")["aria-label"]).alias("label"), F.array().cast("array<struct<t:double,text:string>>").alias("text_history")
    )


def detect(pages: DataFrame, disabled: tuple[str, ...] = (), log_threshold: float = 0.35, store: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """All text detections of staged pages over the log threshold, without those of disabled patterns. ``store`` keeps the candidates, which are read more than once."""
    found = detectors.run_text_detectors(store(candidates(pages).select(*TEXT_COLUMNS)), log_threshold)
    return found.filter(~F.col("pattern_id").isin(*disabled)) if disabled else found


def detect_all(pages: DataFrame, store: Callable[[DataFrame], DataFrame], log_threshold: float = 0.35) -> DataFrame:
    """All detections that one look at staged pages can answer. ``store`` keeps the candidates, so that pages are taken apart once."""
    return detectors.run_page_detectors(store(candidates(pages).drop(*UNREAD)), log_threshold)


def _single(text: Column, most: int) -> Column:
    """The only price of a text of at most ``most`` characters, else null."""
    return F.when(F.length(text).between(1, most), once(parse_prices(text), lambda prices: F.when(F.size(prices) == 1, F.get(prices, F.lit(0)))))


def price_snapshot(pages: DataFrame) -> DataFrame:
    """page_id, displayed, subtotal, shipping, tax, total (minor units) and fees of each page.

    A node of a short text with one price is a line; a bare price takes its label, and its price, from the row or the
    container around it. Of sums the last in the document counts; the displayed price is the largest that has no label, or
    none that says what it is for outside a summary. Equal fees count once.
    """
    nodes = pages.select("page_id", F.col("meta.summary_rows").alias("summary_rows"), F.inline("nodes"))
    priced = bound(nodes.select("page_id", "idx", "text", "row_text", "container_text", "summary_rows"), "own", _single(F.col("text"), LABEL_TEXT)).filter("own is not null")
    bare = F.col("label") == ""
    named = priced.withColumn("label", without_price(F.col("text"), F.col("own.raw")))
    labelled = bound(bound(named, "by_row", F.when(bare, _single(F.col("row_text"), SCOPE_TEXT))), "by_box", F.when(bare, _single(F.col("container_text"), SCOPE_TEXT)))
    row_label = F.when(bare, F.nullif(without_price(F.col("row_text"), F.col("by_row.raw")), F.lit("")))
    box_label = F.when(bare, F.nullif(without_price(F.col("container_text"), F.col("by_box.raw")), F.lit("")))
    scoped = labelled.select("*", bare.alias("borrowed"), row_label.alias("row_label"), box_label.alias("box_label"))
    lines = scoped.select(
        "page_id", "idx", "borrowed", F.coalesce("row_label", "box_label", "label").alias("label"),
        F.when(F.col("row_label").isNotNull(), F.col("by_row.amount")).when(F.col("box_label").isNotNull(), F.col("by_box.amount")).otherwise(F.col("own.amount")).alias("amount"),
        ((F.col("summary_rows") >= 2) & F.col("container_text").rlike(f"{SUBTOTAL}|{TOTAL}")).alias("in_summary"),
    )
    lower = F.lower("label")
    sub, kind = lower.rlike(SUBTOTAL), line_item_kind(F.col("label"))
    role = F.when(F.col("label") == "", "displayed").when(sub, "subtotal").when(lower.rlike(TOTAL), "total").otherwise(kind)
    named = lines.select("*", role.alias("role"), lower.alias("lower"))
    role = F.when((F.col("role") == "unknown") & ~F.col("in_summary"), F.when(F.col("borrowed"), "displayed").otherwise("none")).otherwise(F.col("role"))
    sorted_out = named.withColumn("role", role)
    last = lambda name: F.max_by(F.when(F.col("role") == name, F.col("amount")), F.when(F.col("role") == name, F.col("idx"))).alias(name)
    fee = F.col("role").isin("mandatory_fee", "optional_addon", "unknown")
    fees = F.array_sort(F.collect_set(F.when(fee, F.struct("lower", "amount", F.col("role").alias("kind")))))
    found = sorted_out.groupBy("page_id").agg(F.max(F.when(F.col("role") == "displayed", F.col("amount"))).alias("displayed"), last("subtotal"), last("shipping"), last("tax"), last("total"), fees.alias("fees"))
    return found.withColumn("fees", F.transform("fees", lambda f: F.struct(create_hash(f["lower"]).alias("label_hash"), f["lower"].alias("label"), f["amount"].alias("amount"), f["kind"].alias("kind"))))


def offers(pages: DataFrame) -> DataFrame:
    """page_id, offer_key, source and title: the product's own number, else its stock number, else its name, else path and title."""
    product, title = F.col("meta.product"), F.col("meta.title")
    by_id = F.concat(F.lit("id:"), F.substring(create_hash(product["id"]), 1, 24))
    basis = F.concat_ws("|", path_template(F.col("url")), normalize_title(title))
    kinds = (
        (product["gtin"].isNotNull(), F.concat(F.lit("gtin:"), product["gtin"]), "gtin"), (product["sku"].isNotNull(), F.concat(F.lit("sku:"), product["sku"]), "sku"), (product["id"].isNotNull(), by_id, "jsonld_id"),
        (F.col("meta.dom_sku").isNotNull(), F.concat(F.lit("sku:"), F.col("meta.dom_sku")), "sku"), (F.length(title) > 0, F.concat(F.lit("h:"), F.substring(create_hash(basis), 1, 24)), "url_title_hash"),
    )
    key, source = F.coalesce(*(F.when(on, k) for on, k, _ in kinds)), F.coalesce(*(F.when(on, F.lit(s)) for on, _, s in kinds))
    from_product = product["gtin"].isNotNull() | product["sku"].isNotNull() | product["id"].isNotNull()
    return pages.select("page_id", key.alias("offer_key"), source.alias("source"), F.when(from_product, F.coalesce(product["title"], title)).otherwise(title).alias("title")).filter("offer_key is not null")


def observations(nodes: DataFrame) -> DataFrame:
    """What a look at a page says that another visit can be held against, from nodes with text_history and now_ms.

    Of each page: up to TIMERS deadlines (of clocks that were seen to change), the first stock count, viewer count, price and
    struck price. Pages that say nothing have no row.
    """
    number = lambda pattern, n: F.coalesce(*(F.nullif(F.regexp_extract("text", pattern, k), F.lit("")) for k in range(1, n + 1))).cast("int")
    near = bound(nodes.filter(F.length("text").between(1, CLAIM_TEXT)), "price", _single(F.col("raw_text"), CLAIM_TEXT))
    seconds = F.when((F.size("text_history") >= 2) & F.col("text").rlike(CLOCK), clock_seconds(F.col("text")))
    live = F.col("price").isNotNull() & ~F.col("struck") & (F.coalesce("area", F.lit(PRICE_AREA + 1.0)) > PRICE_AREA)
    said = near.select(
        "page_id", "idx", "selector_path", F.when(seconds > 0, F.col("now_ms") + seconds.cast("long") * 1000).alias("end_ms"), F.when(~F.col("text").rlike(VARIANTS), number(STOCK, 3)).alias("stock"),
        number(VIEWERS, 2).alias("viewers"), F.when(live, F.col("price.amount")).alias("price"), F.when(F.col("price").isNotNull() & F.col("struck"), F.col("price.amount")).alias("reference"),
    )
    claims = ("stock", "viewers", "price", "reference")
    told = said.filter(F.coalesce("end_ms", *claims).isNotNull())
    # by path first, as a clock counts once a path; the first claim of each kind goes along
    first = lambda name: F.min(F.when(F.col(name).isNotNull(), F.struct("idx", name)))
    paths = told.groupBy("page_id", "selector_path").agg(first("end_ms").alias("clock"), *(first(c).alias(c) for c in claims))
    timer = F.when(F.col("clock").isNotNull(), F.struct("clock.idx", "selector_path", "clock.end_ms"))
    found = paths.groupBy("page_id").agg(*(F.min(c)[c].alias(c) for c in claims), F.slice(F.array_sort(F.collect_list(timer)), 1, TIMERS).alias("clocks"))
    timers = F.transform("clocks", lambda t: F.struct(create_hash(t["selector_path"]).alias("container_hash"), t["end_ms"].alias("end_ms")))
    return found.select("page_id", *claims, F.when(F.size("clocks") > 0, timers).alias("timers"))


def throttle(looks: DataFrame, interval_ms: int = OBSERVATION_MS) -> DataFrame:
    """Of a page view's non-empty looks (view_id, ts_ms) those that are let through: each more than ``interval_ms`` after the last one let through."""
    fold = F.aggregate(
        "times", F.array().cast("array<bigint>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > interval_ms), F.concat(kept, F.array(t))).otherwise(kept)
    )
    return looks.groupBy("view_id").agg(F.array_sort(F.collect_set("ts_ms")).alias("times")).select("view_id", F.explode(fold).alias("ts_ms"))


def passive_log(detections: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Each (pattern, text) of a page view once, when first seen, with the reason passive_scan; disabled patterns not at all."""
    rows = detections.filter(~F.col("pattern_id").isin(*disabled)) if disabled else detections
    return rows.groupBy("view_id", "pattern_id", "text_hash").agg(F.min("ts_ms").alias("ts_ms")).withColumn("suppression_reason", F.lit("passive_scan"))
