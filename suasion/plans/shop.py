"""Queries: the page pass over shop pages, end to end from HTML, and ingest from JSON bodies.

The pages are written from part keys: what is on a page follows from its key by rules that SQL states as well, so the
oracle says what has to come out of the HTML without reading any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.functions import facts, fixtures, hashing, money
from suasion.functions.bind import bound
from suasion.operators import ingest, page_pass
from suasion.operators.telemetry import COHORT
from suasion.plans.bridge import TABLES, dealt, frame, oracle
from suasion.sources import pages
from suasion.sources.tables import table
from suasion.streaming.run import stored

HTML = """
    select k, cast(k as bigint) as page_id, concat('https://www.shop', k % 50, '.com/', case k % 3 when 0 then concat('products/', k) when 1 then 'cart' else 'about' end) as url, concat(
      '<html lang="en"><head><title>', p_name, ' number ', k, ' | Shop</title>',
      case k % 4 when 0 then concat('<script type="application/ld+json">{{"@type":"Product","name":"N', k, '","sku":"S-', k, '"}}</script>')
                 when 1 then concat('<script type="application/ld+json">{{broken</script><script type="application/ld+json">{{"@graph":[{{"@type":["Thing","Offer"],"gtin13":', k + 1000, '}}]}}</script>')
                 when 2 then concat('<script type="application/ld+json">[{{"@type":"Product","@id":"urn:', k, '"}}]</script>') else '' end,
      '</head><body>', case when k % 8 = 3 then concat('<span data-sku="D-', k, '"></span>') else '' end,
      '<p>Was <s>$', k % 500 + 100, '.00</s> <b>$', k % 500 + 50, '.99</b></p>',
      '<p>Only ', k % 9 + 1, ' left in stock</p>', '<p', case when k % 4 = 0 then ' style="display:none"' else '' end, '>Deal ends in 04:12</p>',
      '<div role="dialog">Save 10% now <a href="#">No thanks, I don''t want to save money</a></div>',
      '<ul>', array_join(transform(sequence(0, k % 4), i -> case when i = 0 then '' else '<li>Item $5.00 <button>Remove</button></li>' end), ''), '</ul>',
      '<table><tr><td>Subtotal $20.00</td></tr><tr><td>Shipping $4.00</td></tr><tr><td>Service fee $', k % 7 + 1, '.50</td></tr><tr><td>Order total $', k % 7 + 25, '.50</td></tr></table>',
      '<button style="background:#00aa00">Add to cart</button>', case when k % 5 = 0 then '<a href="/c">Proceed to checkout</a>' else '' end,
      '<div style="background-color:rgb(1, 2, 3)"><p><button>Not now $1</button></p></div>', '<input name="first name"><input type="email">',
      case when k % 2 = 0 then '<input autocomplete="address-line1"><input autocomplete="country">' else '' end, case when k % 7 = 0 then '<input autocomplete="cc-number">' else '' end,
      '<p>You''re $30 away from free shipping <progress></progress></p>', '<p style="font-size:20px">$12<sup style="font-size:', case when k % 2 = 0 then '10' else '18' end, 'px">99</sup></p>',
      '<section><h3>Mug set</h3><div><i>$', k % 90 + 1000, '.25</i></div></section></body></html>') as html
    from (select *, cast(p_partkey as int) as k from {part})"""

TABLES["b_shop"] = """
    select k, cast(k as {BIG}) as page_id, k % 4 as n_rows, (case when k % 4 in (0, 2) then 0.4 else 0.0 end) + 0.4 + (case when k % 4 > 0 then -0.5 else 0.0 end) + (case when k % 7 = 0 then -0.4 else 0.0 end) + (case when k % 3 = 0 then 0.2 else 0.0 end) as pdp,
           0.15 + (case when k % 4 > 0 then -0.3 else 0.0 end) + (case when k % 7 = 0 then -0.4 else 0.0 end) as browse, (case when k % 4 > 0 then least(0.6, 0.35 + 0.12 * (k % 4)) else 0.0 end) + 0.5 + (case when k % 3 = 1 then 0.2 else 0.0 end) as cart,
           (case when k % 2 = 0 then 0.5 else 0.0 end) + 0.65 as checkout, case when k % 7 = 0 then 0.9 else 0.0 end as payment
    from (select cast(p_partkey as int) as k from {part}) p"""
STAGE_SQL = "CASE WHEN round(browse, 6) >= greatest(round(pdp, 6), round(cart, 6), round(checkout, 6), round(payment, 6)) THEN 'browse' WHEN round(pdp, 6) >= greatest(round(cart, 6), round(checkout, 6), round(payment, 6)) THEN 'pdp' WHEN round(cart, 6) >= greatest(round(checkout, 6), round(payment, 6)) THEN 'cart' WHEN round(checkout, 6) >= round(payment, 6) THEN 'checkout' ELSE 'payment' END"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts, dealt: their file is small, and what is made of a row is not."""
    return dealt(table(spark, d, "part").select("p_partkey", "p_name"))


def shop(spark: SparkSession, d: str, *parts: str) -> DataFrame:
    """The scanned shop pages: page_id, url, and of meta and nodes those named (both, if none is). Every page is parsed where it is read: store what is read twice."""
    return pages.scan(spark.sql(HTML.strip(), part=_parts(spark, d)), parts or ("meta", "nodes"), ("url",))


def sc3_signals(spark: SparkSession, d: str) -> DataFrame:
    m = "cart_rows summary_rows has_total has_quantity has_remove has_steps add_to_cart checkout_cta place_order booking_cta per_unit_rows priced_texts has_product_ld has_cc_field has_postal has_address has_contact".split()
    staged = page_pass.staged(shop(spark, d, "meta"))
    return staged.select("page_id", *(F.col(f"meta.{c}").cast("long").alias(c) for c in m), "stage")


SC3 = oracle(
    f"SELECT page_id, n_rows::BIGINT AS cart_rows, 9::BIGINT AS summary_rows, 1::BIGINT AS has_total, 0::BIGINT AS has_quantity, (n_rows > 0)::BIGINT AS has_remove, 0::BIGINT AS has_steps, 1::BIGINT AS add_to_cart, (k % 5 = 0)::BIGINT AS checkout_cta, 0::BIGINT AS place_order, 0::BIGINT AS booking_cta, 1::BIGINT AS per_unit_rows, (10 + n_rows)::BIGINT AS priced_texts, (k % 4 IN (0, 2))::BIGINT AS has_product_ld, (k % 7 = 0)::BIGINT AS has_cc_field, 0::BIGINT AS has_postal, (k % 2 = 0)::BIGINT AS has_address, 1::BIGINT AS has_contact, {STAGE_SQL} AS stage FROM b_shop",
    "b_shop",
)


def sc1_styles(spark: SparkSession, d: str) -> DataFrame:
    """Node columns that come from the page's structure and styles."""
    n = shop(spark, d, "nodes").select("page_id", F.inline("nodes"))
    count = lambda on, name: F.sum(on.cast("long")).alias(name)
    return n.groupBy("page_id").agg(
        count(F.col("struck"), "struck"), count(~F.col("rendered"), "hidden"), count(F.col("in_dialog"), "in_dialog"), count(F.col("has_progress"), "has_progress"), count(F.col("cents_child"), "cents_child"),
        F.max(F.when(F.col("row_text") != "", F.col("row_text"))).alias("row_text"), F.max(F.when(F.col("text") == "Not now $1", F.col("background"))).alias("ground"), F.max("font_px").alias("largest"),
    )


SC1 = oracle("SELECT page_id, 1::BIGINT AS struck, (k % 4 = 0)::BIGINT AS hidden, 2::BIGINT AS in_dialog, 1::BIGINT AS has_progress, (k % 2 = 0)::BIGINT AS cents_child, 'was $' || (k % 500 + 100) || '.00 $' || (k % 500 + 50) || '.99' AS row_text, 'rgb(1, 2, 3)' AS ground, 20.0::DOUBLE AS largest FROM b_shop", "b_shop")


def dt_pages(spark: SparkSession, d: str) -> DataFrame:
    """Detections from HTML: harvest, stage, text detectors, thresholds; one pattern switched off."""
    found = page_pass.detect(page_pass.staged(shop(spark, d)), disabled=("social_proof.live_activity",), store=stored)
    return found.groupBy("page_id", "pattern_id").agg(F.count("*").alias("n"), F.round(F.max("raw_score"), 6).alias("best"))


DT_PAGES = oracle(
    f"""
WITH s AS (SELECT *, {STAGE_SQL} AS stage FROM b_shop)
SELECT page_id, pattern_id, n::BIGINT AS n, best::DOUBLE AS best FROM (
  SELECT page_id, 'scarcity.stock' AS pattern_id, 1 AS n, 0.85 AS best FROM s WHERE stage IN ('pdp', 'cart', 'browse')
  UNION ALL SELECT page_id, 'urgency.countdown', 1, 0.85 FROM s WHERE k % 4 <> 0 AND stage IN ('pdp', 'cart', 'checkout', 'browse')
  UNION ALL SELECT page_id, 'confirmshaming.decline_copy', 2, 1.0 FROM s WHERE stage IN ('browse', 'pdp', 'cart', 'checkout')
  UNION ALL SELECT page_id, 'goal_gradient.threshold', 1, 1.0 FROM s WHERE stage IN ('cart', 'checkout', 'pdp')
) u""",
    "b_shop",
)


def dt_all_pages(spark: SparkSession, d: str) -> DataFrame:
    """Detections from HTML by all the detectors that one look can answer."""
    found = page_pass.detect_all(page_pass.staged(shop(spark, d)), stored)
    return found.groupBy("page_id", "pattern_id").agg(F.count("*").alias("n"), F.round(F.max("raw_score"), 6).alias("best"))


# the struck price of a page is 49.01 above the live one beside it, which ends in 99 and stands in a node that says both
DT_ALL = oracle(
    f"""
WITH s AS (SELECT *, {STAGE_SQL} AS stage FROM b_shop)
SELECT page_id, pattern_id, n::BIGINT AS n, best::DOUBLE AS best FROM (
  SELECT page_id, 'scarcity.stock' AS pattern_id, 1 AS n, 0.85 AS best FROM s WHERE stage IN ('pdp', 'cart', 'browse')
  UNION ALL SELECT page_id, 'urgency.countdown', 1, 0.85 FROM s WHERE k % 4 <> 0 AND stage IN ('pdp', 'cart', 'checkout', 'browse')
  UNION ALL SELECT page_id, 'confirmshaming.decline_copy', 2, 1.0 FROM s WHERE stage IN ('browse', 'pdp', 'cart', 'checkout')
  UNION ALL SELECT page_id, 'goal_gradient.threshold', 1, 1.0 FROM s WHERE stage IN ('cart', 'checkout', 'pdp')
  UNION ALL SELECT page_id, 'anchoring.reference_price', 1, CASE WHEN 4901 * 100 < (k % 500 + 100) * 100 * 15 THEN 0.6 ELSE 1.0 END FROM s WHERE stage IN ('pdp', 'browse', 'cart')
  UNION ALL SELECT page_id, 'pricing.charm', 1, 0.6 FROM s WHERE stage IN ('pdp', 'browse')
) u""",
    "b_shop",
)


def fn27_offers(spark: SparkSession, d: str) -> DataFrame:
    return page_pass.offers(shop(spark, d, "meta"))


def _hash_sql(text: str) -> str:
    """The text hash in DuckDB's wide integers."""
    half = lambda begin, added: f"list_reduce(list_prepend({begin}::HUGEINT, list_transform(string_split(nullif({text}, ''), ''), lambda c: (unicode(c) + {added})::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)"
    digits = lambda h: f"lpad(lower(to_hex(coalesce({h}, 0::HUGEINT)::UBIGINT)), 16, '0')"
    pair = f"({digits(half(0xCBF29CE4, 0))} || {digits(half(0x84222325, 0x9E37))})"
    return f"({pair} || {pair})"


FN27 = f"""
SELECT page_id, CASE k % 4 WHEN 0 THEN 'sku:S-' || k WHEN 1 THEN 'gtin:' || (k + 1000) WHEN 2 THEN 'id:' || substr({_hash_sql("'urn:' || k")}, 1, 24)
         ELSE CASE WHEN k % 8 = 3 THEN 'sku:D-' || k ELSE 'h:' || substr({_hash_sql("basis")}, 1, 24) END END AS offer_key,
       CASE k % 4 WHEN 0 THEN 'sku' WHEN 1 THEN 'gtin' WHEN 2 THEN 'jsonld_id' ELSE CASE WHEN k % 8 = 3 THEN 'sku' ELSE 'url_title_hash' END END AS source,
       CASE k % 4 WHEN 0 THEN 'N' || k ELSE title END AS title
FROM (SELECT k, k::BIGINT AS page_id, p_name || ' number ' || k || ' | Shop' AS title,
        '/' || CASE k % 3 WHEN 0 THEN 'products/:id' WHEN 1 THEN 'cart' ELSE 'about' END || '|' || trim(regexp_replace(lower(p_name || ' number ' || k), '[^a-z0-9]+', ' ', 'g')) AS basis
      FROM (SELECT *, p_partkey::INTEGER AS k FROM part) p) x"""


def cl3_price_snapshot(spark: SparkSession, d: str) -> DataFrame:
    snap = page_pass.price_snapshot(shop(spark, d))
    return snap.select("page_id", "displayed", "subtotal", "shipping", F.coalesce("tax", F.lit(-1)).cast("long").alias("tax"), "total", F.size("fees").cast("long").alias("n_fees"), F.array_join(F.transform("fees", lambda f: F.concat_ws(":", f["label"], f["amount"].cast("string"), f["kind"])), ";").alias("fees"))


CL3 = oracle("SELECT page_id, ((k % 90 + 1000) * 100 + 25)::BIGINT AS displayed, 2000::BIGINT AS subtotal, 3000::BIGINT AS shipping, -1::BIGINT AS tax, ((k % 7 + 25) * 100 + 50)::BIGINT AS total, 2::BIGINT AS n_fees, '99:1200:unknown;service fee:' || ((k % 7 + 1) * 100 + 50) || ':mandatory_fee' AS fees FROM b_shop", "b_shop")


def cl5_observations(spark: SparkSession, d: str) -> DataFrame:
    """A second look at each page: its clock has been seen to change."""
    seen = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(x).alias("text")) for t, x in ((0.0, "04:13"), (1000.0, "04:12"))))
    looked = page_pass.candidates(page_pass.staged(shop(spark, d))).withColumn("text_history", F.when(F.col("text").contains("04:12"), seen).otherwise(F.col("text_history"))).withColumn("now_ms", F.col("page_id") * 1000)
    found = page_pass.observations(looked)
    return found.select("page_id", F.coalesce(F.size("timers"), F.lit(0)).cast("long").alias("n_timers"), F.coalesce(F.col("timers")[0]["end_ms"], F.lit(-1)).alias("end_ms"), F.col("timers")[0]["container_hash"].alias("container"), F.col("stock").cast("long").alias("stock"), F.coalesce(F.col("viewers"), F.lit(-1)).cast("long").alias("viewers"), "price", "reference")


CL5 = oracle(
    f"SELECT page_id, (k % 4 <> 0)::BIGINT AS n_timers, CASE WHEN k % 4 <> 0 THEN k::BIGINT * 1000 + 252000 ELSE -1 END AS end_ms, CASE WHEN k % 4 <> 0 THEN {_hash_sql(chr(39) + 'html>body>p:nth-of-type(3)' + chr(39))} END AS container, (k % 9 + 1)::BIGINT AS stock, -1::BIGINT AS viewers, ((k % 500 + 50) * 100 + 99)::BIGINT AS price, ((k % 500 + 100) * 100)::BIGINT AS reference FROM b_shop",
    "b_shop",
)


def st13_throttle(spark: SparkSession, d: str) -> DataFrame:
    """Of a user's looks those more than four hours after the last one let through."""
    looks = frame(spark, d, "b_views").select("view_id", "ts_ms")
    return page_pass.throttle(looks, 14_400_000).groupBy("view_id").agg(F.count("*").alias("n"), F.sum(F.col("ts_ms") % 1_000_003).alias("checksum"))


ST13 = oracle(
    """
WITH RECURSIVE v AS (SELECT DISTINCT view_id, ts_ms FROM b_views), r AS (
  SELECT view_id, min(ts_ms) AS ts_ms FROM v GROUP BY view_id
  UNION ALL SELECT r.view_id, (SELECT min(v.ts_ms) FROM v WHERE v.view_id = r.view_id AND v.ts_ms > r.ts_ms + 14400000) AS ts_ms FROM r WHERE r.ts_ms IS NOT NULL
)
SELECT view_id, count(*)::BIGINT AS n, sum(ts_ms % 1000003)::BIGINT AS checksum FROM r WHERE ts_ms IS NOT NULL GROUP BY view_id""".replace("WITH RECURSIVE", "WITH"),
    "b_views",
).replace("WITH ", "WITH RECURSIVE ", 1)


def st14_passive_log(spark: SparkSession, d: str) -> DataFrame:
    seen = frame(spark, d, "b_detections").select(F.col("user_id").alias("view_id"), "pattern_id", F.col("funnel_stage").alias("text_hash"), "ts_ms")
    return page_pass.passive_log(seen, disabled=("scarcity.stock",))


ST14 = oracle("SELECT user_id AS view_id, pattern_id, funnel_stage AS text_hash, min(ts_ms) AS ts_ms, 'passive_scan' AS suppression_reason FROM b_detections WHERE pattern_id <> 'scarcity.stock' GROUP BY ALL", "b_detections")

CATEGORIES = ("fashion", "travel", "grocery", "electronics", "other")
# a request for each order: some are well formed, others go wrong in one way each
TABLES["b_requests"] = """
    select k, cast(k as {STR}) as batch_id, case when k % 17 = 3 then 'GET' else 'POST' end as method, case when k % 17 = 4 then 'text/plain' else 'application/json; charset=utf-8' end as content_type,
           case when k % 17 = 5 then '{OPEN}"v": 2, "records": [' when k % 17 = 6 then '[]' else
             '{OPEN}"v": ' || case k % 17 when 7 then '1' when 8 then '2' else '3' end || ', "records": [' || case when k % 17 = 9 then '' else
               '{OPEN}"patternId": "urgency.countdown", "detectorId": "urgency.countdown@1", "funnelStage": "' || case k % 17 when 10 then 'nowhere' else 'pdp' end || '", "site": "shop' || cast(k % 5 as {STR}) || '.com", "originCategory": "fashion", "rulepackVersion": "1.0.1", "dayBucket": ' || case k % 17 when 11 then '1' else '20000' end || ', "confidenceQuartile": ' || cast(k % 4 + 1 as {STR}) || case k % 17 when 12 then ', "extra": 1' else '' end || '{CLOSE}' end
             || '], "outcomes": [' || case when k % 17 = 9 then '' else
               '{OPEN}"patternId": "' || case k % 3 when 0 then '_page' else 'urgency.countdown' end || '", "funnelStage": "' || case k % 17 when 13 then 'cart' else 'pdp' end || '", "site": "shop' || cast(k % 5 as {STR}) || '.com", "originCategory": "fashion", "rulepackVersion": "1.0.1", "dayBucket": 20000, "addedToCart": ' || case k % 17 when 14 then '"yes"' else case k % 2 when 0 then 'true' else 'false' end end || '{CLOSE}' end || ']{CLOSE}' end as body
    from (select o_orderkey as k from {orders}) o"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return ingest.judge(frame(spark, d, "b_requests", orders=dealt(table(spark, d, "orders").select("o_orderkey"))), CATEGORIES, 20_000)


def vl3_requests(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("batch_id", "status")


STATUS = "CASE k % 17 WHEN 3 THEN 405 WHEN 4 THEN 415 WHEN 5 THEN 400 WHEN 6 THEN 400 WHEN 7 THEN 400 WHEN 8 THEN 400 WHEN 9 THEN 400 WHEN 10 THEN 422 WHEN 11 THEN 422 WHEN 12 THEN 422 WHEN 13 THEN 422 WHEN 14 THEN 422 ELSE 204 END"
VL3 = oracle(f"SELECT batch_id, {STATUS}::INTEGER AS status FROM b_requests", "b_requests")


def ag2_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counters of one half of the batches, then the other half taken up."""
    records, _ = ingest.split_union(stored(ingest.admitted_queue(_requests(spark, d))))
    half = F.pmod(F.col("batch_id").cast("long"), F.lit(2)) == 0
    empty = records.limit(0).groupBy(*COHORT).agg(F.count("*").alias("n"), F.count("*").alias("reporters"))
    return ingest.merge_counters(ingest.merge_counters(empty, records.filter(half)), records.filter(~half))


AG2 = oracle(f"SELECT 'urgency.countdown' AS pattern_id, 'urgency.countdown@1' AS detector_id, 'pdp' AS funnel_stage, 'shop' || (k % 5) || '.com' AS site, 'fashion' AS origin_category, '1.0.1' AS rulepack_version, 20000::BIGINT AS day_bucket, (k % 4 + 1)::INTEGER AS quartile, count(*)::BIGINT AS n, count(*)::BIGINT AS reporters FROM b_requests WHERE {STATUS} = 204 GROUP BY ALL", "b_requests")


def so2_union(spark: SparkSession, d: str) -> DataFrame:
    return ingest.admitted_queue(_requests(spark, d)).select("batch_id", "kind", "pattern_id", "site", F.coalesce("added_to_cart", F.lit(-1)).alias("added_to_cart"))


SO2 = oracle(f"SELECT batch_id, 'record' AS kind, 'urgency.countdown' AS pattern_id, 'shop' || (k % 5) || '.com' AS site, -1::INTEGER AS added_to_cart FROM b_requests WHERE {STATUS} = 204 UNION ALL SELECT batch_id, 'outcome', CASE k % 3 WHEN 0 THEN '_page' ELSE 'urgency.countdown' END, 'shop' || (k % 5) || '.com', (k % 2 = 0)::INTEGER FROM b_requests WHERE {STATUS} = 204", "b_requests")

MESSAGES = {"page_view": ("origin", "stage"), "detected": ("candidates",), "trigger": ("kind", "label")}
TABLES["b_messages"] = """
    select event_id, case event_id % 5 when 0 then '{OPEN}"type": "page_view", "origin": "x", "stage": "pdp"{CLOSE}' when 1 then '{OPEN}"type": "page_view", "origin": "x"{CLOSE}' when 2 then '{OPEN}"type": "detected", "candidates": []{CLOSE}' when 3 then '{OPEN}"type": "unheard_of"{CLOSE}' else 'not json' end as body from {events}"""


def vl4_messages(spark: SparkSession, d: str) -> DataFrame:
    return ingest.known_messages(frame(spark, d, "b_messages"), MESSAGES).select("event_id", "valid")


VL4 = oracle("SELECT event_id, event_id % 5 IN (0, 2) AS valid FROM b_messages", "b_messages")

PART_COPY = """
    select k, concat('only ', k % 30, ' left ', case k % 4 when 0 then concat('at polaris ', p_name, ' for pickup today') when 1 then 'nearby' when 2 then 'at this price' else 'in stock' end) as stock,
           concat('Big news about ', p_name, ' this week. ', case k % 2 when 0 then 'Sale ends tonight! ' else 'Sale starts tonight! ' end, 'And then there is a good deal more to be said about everything else in the shop.') as copy,
           case k % 5 when 0 then concat(k % 12 + 1, ' months') when 1 then concat('pack of ', k % 50 + 1) when 2 then 'billed per year' when 3 then 'monthly plan' else 'a mug' end as option,
           case k % 4 when 0 then 'Add to cart' when 1 then 'Section B12 row C $40' when 2 then 'Proceed to payment' else 'Learn more' end as name, case k % 6 when 3 then 'btnAddToCart' else 'catchall' end as attribute,
           concat('Card 4111 1111 1111 1111, ', p_name, ' mail a', k, '.b@example.com or call 415-555-0132; order #AB', k + 10000000, ' at 12 Main Street <p>') as personal,
           concat('<a onclick="go()" href="https://x.example/', k, '">', p_name, '</a><script>var t=1</script><script type="application/ld+json">{{}}</script><i data-end="1700000', lpad(cast(k % 1000000 as string), 6, '0'), '"></i>') as page
    from (select *, cast(p_partkey as int) as k from {part})"""


def _copy(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(PART_COPY.strip(), part=_parts(spark, d))


def fn19_facts(spark: SparkSession, d: str) -> DataFrame:
    """What detections say of their texts: stock facts, quotes, quantities, triggers and evidence."""
    c = F.col
    fact = facts.scarcity_facts(c("stock"))
    return _copy(spark, d).select(
        "k", fact["count"].cast("long").alias("n"), fact["scope"].alias("scope"), fact["place"].alias("place"), facts.quoted_sentence(c("copy"), "ends tonight").alias("quote"), F.coalesce(facts.quantity_of(c("option")), F.lit(-1)).cast("long").alias("quantity"),
        facts.trigger_of(c("name"), F.array("attribute")).alias("trigger"), facts.evidence_text(F.when(c("k") % 2 == 0, F.lit("  ")), c("option")).alias("evidence"), hashing.create_hash(c("option")).alias("hash"),
    )


FN19 = f"""
SELECT k, (k % 30)::BIGINT AS n, CASE k % 4 WHEN 0 THEN 'location' WHEN 1 THEN 'location' WHEN 2 THEN 'price' END AS scope,
       CASE WHEN k % 4 = 0 THEN 'Polaris ' || array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') END AS place, CASE WHEN k % 2 = 0 THEN 'Sale ends tonight!' END AS quote,
       (CASE k % 5 WHEN 0 THEN k % 12 + 1 WHEN 1 THEN k % 50 + 1 WHEN 2 THEN 12 WHEN 3 THEN 1 ELSE -1 END)::BIGINT AS quantity,
       CASE WHEN k % 4 = 0 OR k % 6 = 3 THEN 'add_to_cart' WHEN k % 4 IN (1, 2) THEN 'checkout_intent' END AS trigger, option AS evidence, {_hash_sql("option")} AS hash
FROM (SELECT *, CASE k % 5 WHEN 0 THEN (k % 12 + 1) || ' months' WHEN 1 THEN 'pack of ' || (k % 50 + 1) WHEN 2 THEN 'billed per year' WHEN 3 THEN 'monthly plan' ELSE 'a mug' END AS option FROM (SELECT *, p_partkey::INTEGER AS k FROM part) p) x
"""


def fn31_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Scrubbed and normalised fixtures, and the hits that a scan for personal data would fail on."""
    c = F.col
    scrubbed = bound(_copy(spark, d), "scrubbed", fixtures.scrub_fixture(c("personal")))
    return scrubbed.select("k", "scrubbed", F.aggregate(F.map_values(fixtures.pii_hits(c("personal"))), F.lit(0), lambda a, x: a + x).cast("long").alias("hits"), F.size(fixtures.pii_hits(c("scrubbed"))).cast("long").alias("left"), fixtures.normalise_html(c("page"), 1600000000000).alias("page"))


FN31 = """
SELECT k, 'Card [card redacted], ' || p_name || ' mail [email redacted] or call [phone redacted]; order #[token redacted] at [address redacted] <p>' AS scrubbed, 5::BIGINT AS hits, 0::BIGINT AS "left",
       '<a href="about:blank">' || p_name || '</a><script type="application/ld+json">{}</script><i data-end="1600000000000"></i>' AS page
FROM (SELECT *, p_partkey::INTEGER AS k FROM part) p
"""


def fn35_wire(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "b_money").select("l_orderkey", "l_linenumber", F.struct(F.col("was_minor").alias("amount"), F.lit("USD").alias("currency"), F.lit(0.9).alias("confidence")).alias("m"))
    sent = rows.select("l_orderkey", "l_linenumber", F.to_json(money.encode_money(F.col("m"))).alias("wire"))
    back = money.decode_money(F.from_json("wire", "minor string, currency string, confidence double"))
    return sent.select("l_orderkey", "l_linenumber", "wire", back["amount"].alias("amount"))


FN35 = oracle("""SELECT l_orderkey, l_linenumber, '{"minor":"' || was_minor || '","currency":"USD","confidence":0.9}' AS wire, was_minor AS amount FROM b_money""", "b_money")

QUERIES = {
    "sc1_styles": sc1_styles, "sc3_signals": sc3_signals, "dt_pages": dt_pages, "dt_all_pages": dt_all_pages, "fn27_offers": fn27_offers, "cl3_price_snapshot": cl3_price_snapshot, "cl5_observations": cl5_observations, "st13_throttle": st13_throttle, "st14_passive_log": st14_passive_log,
    "vl3_requests": vl3_requests, "ag2_merge": ag2_merge, "so2_union": so2_union, "vl4_messages": vl4_messages, "fn19_facts": fn19_facts, "fn31_fixtures": fn31_fixtures, "fn35_wire": fn35_wire,
}
ORACLE_SQL = {
    "sc1_styles": SC1, "sc3_signals": SC3, "dt_pages": DT_PAGES, "dt_all_pages": DT_ALL, "fn27_offers": FN27, "cl3_price_snapshot": CL3, "cl5_observations": CL5, "st13_throttle": ST13, "st14_passive_log": ST14,
    "vl3_requests": VL3, "ag2_merge": AG2, "so2_union": SO2, "vl4_messages": VL4, "fn19_facts": FN19, "fn31_fixtures": FN31, "fn35_wire": FN35,
}
