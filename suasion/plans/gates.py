"""Queries: the commerce gate with JSON-LD, the gate on personal data, settings of shoppers, offers with all their series, seeded queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.operators import corpus, digest, history, json_ld, ledger, page_pass, pages
from suasion.plans.bridge import TABLES, frame, oracle
from suasion.plans.measures import KIND
from suasion.plans.shop import shop
from suasion.plans.streams import _events
from suasion.sources import batches, fixtures
from suasion.streaming import views
from suasion.streaming.run import drain, new_folder, stored

# one or two blocks of JSON-LD for each order: kinds and keys at depths from 0 to 8, lists, broken text
TABLES["b_ld"] = """
    select o_orderkey as page_id, core, depth, twice, '<html><head><script type="application/ld+json">' || repeat('{OPEN}"a":', depth) || case core when 0 then '{OPEN}"@type":"Offer"{CLOSE}' when 1 then '{OPEN}"@type":["Thing","Order"]{CLOSE}' when 2 then '{OPEN}"offers":null{CLOSE}'
             when 3 then '{OPEN}"@type":"WebPage","name":"Offer"{CLOSE}' when 4 then '[{OPEN}"priceCurrency":"USD"{CLOSE}]' when 5 then '{OPEN}broken' else '{OPEN}"@type":"Product","@id":7{CLOSE}' end || repeat('{CLOSE}', depth) || '</script>'
             || case when twice then '<script>var offers = 1</script><script id="b" type=''application/ld+json''>[1, {OPEN}"x":{OPEN}"@type":"ShoppingCart"{CLOSE}{CLOSE}]</script>' else '' end || '</head><body></body></html>' as html
    from (select o_orderkey, o_orderkey % 7 as core, cast(o_custkey % 9 as int) as depth, o_custkey % 10 = 0 as twice from {orders}) o"""
TABLES["b_claims"] = """
    select 'https://shop.example' as origin, cast(user_id % 5 as {STR}) as offer_key, {MS} as ts_ms, event_id as seq, case event_id % 8 when 0 then 'timers' when 1 then 'stock' when 2 then 'prices' when 3 then 'reference_prices' when 7 then 'colours' else 'viewers' end as series, cast(floor(value) as {BIG}) as n,
           case when event_id % 8 = 2 then 'USD' else 'c' || cast(event_id % 3 as {STR}) end as tag
    from {events}"""
TABLES["b_totals"] = """
    select o_orderkey as session_id, 'https://shop.example' as origin, s.stage, case when o_orderkey % 3 = 0 then null else minor end as subtotal, case when o_orderkey % 5 = 0 then null else minor + 100 end as displayed, case when o_custkey % 2 = 0 then cast(599 as {BIG}) end as shipping,
           case when o_custkey % 3 = 0 then cast(123 as {BIG}) end as tax, case when o_custkey % 4 > 0 then minor + o_custkey % 1000 end as total
    from (select o_orderkey, o_custkey, case when o_orderkey % 11 = 0 then cast(0 as {BIG}) else cast(round(o_totalprice * 100) as {BIG}) end as minor from {orders}) o cross join (select 'cart' as stage union all select 'checkout' union all select 'payment') s"""


def cl1_json_ld(spark: SparkSession, d: str) -> DataFrame:
    """From HTML: blocks of JSON-LD, and whether they sell something."""
    x = frame(spark, d, "b_ld").select("page_id", json_ld.blocks(F.col("html")).alias("json_ld"))
    return json_ld.selling(x)


# said of the derived rows, not of their JSON: at most six levels above the object, a list being one; the second block sells in any case
CL1_LD = oracle("SELECT page_id, twice OR CASE WHEN core IN (0, 1, 2) THEN depth <= 6 WHEN core = 4 THEN depth <= 5 ELSE false END AS sells_ld FROM b_ld", "b_ld")


def cl1_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over tables of signals, with what their pages' JSON-LD says."""
    x = cl1_json_ld(spark, d)
    judged = pages.commerce(frame(spark, d, "b_meta").join(x, "page_id"))
    return judged.filter("sells_ld").groupBy("is_commerce", "commerce_score", "has_product_ld").agg(F.count("*").alias("n"), F.count_if(F.col("reasons").rlike("(^|,)offer(,|$)")).alias("offers"))


CL1_GATE = oracle(
    """
WITH g AS (
  SELECT has_product_ld, 1 + CASE WHEN og_product THEN 1 ELSE 0 END + CASE WHEN cart_rows > 0 AND (has_quantity OR has_remove) THEN 1 ELSE 0 END + CASE WHEN has_total AND summary_rows >= 2 THEN 1 ELSE 0 END + CASE WHEN place_order > 0 THEN 1 ELSE 0 END
    + CASE WHEN has_steps AND checkout_cta > 0 THEN 1 ELSE 0 END + CASE WHEN per_unit_rows > 0 THEN 1 ELSE 0 END + CASE WHEN priced_texts >= 20 THEN 1 WHEN priced_texts >= 8 THEN 0.5 ELSE 0 END + CASE WHEN booking_cta > 0 AND (summary_rows > 0 OR priced_texts >= 4) THEN 1 ELSE 0 END
    + CASE WHEN add_to_cart > 0 THEN 0.5 ELSE 0 END + CASE WHEN checkout_cta > 0 THEN 0.5 ELSE 0 END + CASE WHEN summary_rows > 0 THEN 0.5 ELSE 0 END AS s
  FROM b_meta JOIN b_ld USING (page_id) WHERE twice OR CASE WHEN core IN (0, 1, 2) THEN depth <= 6 WHEN core = 4 THEN depth <= 5 ELSE false END
)
SELECT true AS is_commerce, s::DOUBLE AS commerce_score, has_product_ld, count(*) AS n, count(*) FILTER (WHERE NOT has_product_ld) AS offers FROM g GROUP BY ALL""",
    "b_meta", "b_ld",
)


def cl1_pages(spark: SparkSession, d: str) -> DataFrame:
    """The gate from HTML to verdict."""
    return page_pass.shops(stored(shop(spark, d, "meta"))).select("page_id", "is_commerce", "commerce_score", "reasons")


CL1_PAGES = oracle(
    """
SELECT page_id, true AS is_commerce, (CASE WHEN k % 4 < 3 THEN 1 ELSE 0 END + CASE WHEN n_rows > 0 THEN 1 ELSE 0 END + 3.5 + CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS commerce_score,
       concat_ws(',', CASE k % 4 WHEN 0 THEN 'product' WHEN 2 THEN 'product' WHEN 1 THEN 'offer' END, CASE WHEN n_rows > 0 THEN 'cart_rows' END, 'total', 'per_unit', 'some_prices', 'add_to_cart', CASE WHEN k % 5 = 0 THEN 'checkout' END, 'summary') AS reasons
FROM b_shop""",
    "b_shop",
)


def vl6_gate(spark: SparkSession, d: str) -> DataFrame:
    """Finds of each rule in fixtures that were refused, and how many fixtures were written."""
    mail = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit(" from a.b@example.com, ssn 123-45-6789 and c@example.org"))).otherwise("")
    x = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_name", mail).alias("html"))
    path = new_folder(spark, "fixtures")
    try:
        found, kept = {}, fixtures.write_clean(x, path)
    except fixtures.PersonalData as refused:
        found, kept = refused.hits, refused.kept
    written = spark.read.parquet(path).agg(F.lit("written").alias("rule"), F.count("*").alias("n"))
    return spark.createDataFrame([*found.items(), ("kept", kept)], "rule string, n long").unionByName(written)


VL6 = "SELECT u.rule, CASE u.rule WHEN 'email' THEN 2 * c WHEN 'ssn' THEN c ELSE a - c END::BIGINT AS n FROM (SELECT count(*) AS a, count(*) FILTER (WHERE p_partkey % 10 = 0) AS c FROM part) p, (VALUES ('email'), ('ssn'), ('kept'), ('written')) u(rule)"

FREQUENCY = "CASE event_id % 4 WHEN 0 THEN 'once_per_site' WHEN 1 THEN 'off' WHEN 2 THEN 'once_per_page' ELSE CASE WHEN user_id % 3 = 0 THEN 'never_interrupt' ELSE 'once_per_page' END END"


def pf17_settings(spark: SparkSession, d: str) -> DataFrame:
    """Digests under settings that change within a session."""
    x = frame(spark, d, "b_detections").select(F.col("user_id").alias("session_id"), "origin", F.col("funnel_stage").alias("stage"), (F.col("k") % 3).alias("page"), "ts_ms", F.col("event_id").alias("seq"), F.expr(FREQUENCY).alias("frequency"))
    return digest.gate(x, F.col("frequency")).select("seq", "show", "reason")


# walked row by row: what was shown before, by page and by origin
PF17 = oracle(
    f"""
WITH x AS (SELECT user_id, origin, funnel_stage || ':' || (k % 3) AS page, event_id, {FREQUENCY} AS f, row_number() OVER (PARTITION BY user_id, origin ORDER BY ts_ms, event_id) AS i FROM b_detections), w AS (
  SELECT user_id, origin, 0::BIGINT AS i, NULL::BIGINT AS seq, []::VARCHAR[] AS seen, false AS shown, '' AS reason FROM (SELECT DISTINCT user_id, origin FROM x) s
  UNION ALL
  SELECT x.user_id, x.origin, x.i, x.event_id, CASE WHEN ok THEN list_append(w.seen, x.page) ELSE w.seen END, ok, CASE WHEN x.f IN ('off', 'never_interrupt') THEN 'user_disabled' WHEN ok THEN 'none' ELSE 'debounced' END
  FROM w JOIN x ON x.user_id = w.user_id AND x.origin = w.origin AND x.i = w.i + 1, LATERAL (SELECT CASE WHEN x.f IN ('off', 'never_interrupt') THEN false WHEN x.f = 'once_per_site' THEN len(w.seen) = 0 ELSE NOT list_contains(w.seen, x.page) END AS ok) o
)
SELECT seq, shown AS "show", reason FROM w WHERE i > 0""",
    "b_detections",
).replace("WITH", "WITH RECURSIVE", 1)


def st3_series(spark: SparkSession, d: str) -> DataFrame:
    """Offers with all five series and the room of each; a series of another name is left out, a look may claim nothing."""
    claims = frame(spark, d, "b_claims")
    offers = history.merge_observations(claims.select("origin", "offer_key", "ts_ms"), claims)
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat(x["n"].cast("string"), x["tag"])), ",").alias(s)
    return offers.select("offer_key", "sightings", "first_seen", "last_seen", *(said(s) for s in history.SERIES_KEPT))


def _series_sql(name: str, room: int) -> str:
    return f"coalesce(string_agg(n || tag, ',' ORDER BY ts_ms, seq) FILTER (WHERE series = '{name}' AND r <= {room}), '') AS {name}"


ST3 = oracle(
    "WITH c AS (SELECT *, row_number() OVER (PARTITION BY offer_key, series ORDER BY ts_ms DESC, seq DESC) AS r FROM b_claims) SELECT offer_key, count(*) AS sightings, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, "
    + ", ".join(_series_sql(s, 128 if s == "viewers" else 64) for s in ("timers", "stock", "viewers", "prices", "reference_prices")) + " FROM c GROUP BY offer_key", "b_claims",
)


def st11_stages(spark: SparkSession, d: str) -> DataFrame:
    """Triggers of a page load, one for each kind and stage, and those that a new stage makes."""
    stage = F.element_at(F.array(*map(F.lit, ("browse", "cart", "checkout", "payment"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = _events(spark, d).select("ts", F.col("user_id").alias("page_load"), stage.alias("stage"), F.col("event_type").alias("kind"))
    given = e.filter("kind <> 'view'").withColumn("label", F.col("kind"))
    both = given.unionByName(views.stage_triggers(e.filter("kind = 'view'")))
    return drain(views.debounce(both, ("page_load", "kind", "stage"))).groupBy("page_load", "kind", "stage").agg(F.count("*").alias("n"))


ST11 = "SELECT DISTINCT user_id AS page_load, CASE event_type WHEN 'view' THEN 'checkout_intent' ELSE event_type END AS kind, ['browse', 'cart', 'checkout', 'payment'][event_id % 4 + 1] AS stage, 1::BIGINT AS n FROM events WHERE event_type <> 'view' OR event_id % 4 >= 2"


def cl4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Reconciled snapshots without a subtotal, a total, or either price."""
    out = ledger.reconcile(frame(spark, d, "b_totals"), frame(spark, d, "b_fees"))
    return out.select("session_id", "stage", "fee_total", "base", "unexplained", F.round("drip_ratio", 9).alias("drip_ratio"))


CL4 = oracle(
    f"""
WITH f AS (SELECT session_id, stage, sum(amount) FILTER (WHERE kind <> 'discount') AS fees, sum(amount) FILTER (WHERE kind = 'mandatory_fee') AS mandatory FROM (SELECT *, {KIND} AS kind FROM b_fees) k GROUP BY ALL),
s AS (SELECT t.*, coalesce(subtotal, displayed) AS base, coalesce(f.fees, 0) AS fee_total, coalesce(f.mandatory, 0) AS mandatory FROM b_totals t LEFT JOIN f ON f.session_id = t.session_id AND f.stage = t.stage)
SELECT session_id, stage, fee_total::BIGINT AS fee_total, base, CASE WHEN base <> 0 THEN CASE WHEN total IS NULL THEN 0 ELSE total - base - coalesce(shipping, 0) - coalesce(tax, 0) - fee_total END END::BIGINT AS unexplained, CASE WHEN base <> 0 THEN round(mandatory::DOUBLE / base, 9) END AS drip_ratio FROM s""",
    "b_fees", "b_totals",
)


def dt14_displayed(spark: SparkSession, d: str) -> DataFrame:
    """Late charges against the displayed price where a page has no subtotal."""
    found = ledger.drip(frame(spark, d, "b_totals"), frame(spark, d, "b_fees"), 0.001)
    return found.select("session_id", "drip_amount", "fee_count", "first_disclosure", F.round("drip_ratio", 9).alias("drip_ratio"))


DT14 = oracle(
    f"""
WITH o AS (SELECT *, CASE stage WHEN 'pdp' THEN 1 WHEN 'cart' THEN 2 WHEN 'checkout' THEN 3 ELSE 4 END AS pos, {KIND} AS kind FROM b_fees),
n AS (SELECT session_id, label, min(pos) AS met, bool_or(pos = 2) AS early FROM o GROUP BY ALL),
l AS (SELECT session_id, sum(amount) AS drip_amount, count(*) AS fee_count, min(met) AS met FROM o JOIN n USING (session_id, label) WHERE pos = 4 AND NOT early AND met >= 2 AND kind NOT IN ('discount', 'optional_addon') GROUP BY session_id),
r AS (SELECT l.*, l.drip_amount::DOUBLE / coalesce(t.subtotal, t.displayed) AS ratio FROM l JOIN b_totals t ON t.session_id = l.session_id AND t.stage = 'payment' WHERE coalesce(t.subtotal, t.displayed) <> 0)
SELECT session_id, drip_amount::BIGINT AS drip_amount, fee_count, CASE met WHEN 2 THEN 'cart' WHEN 3 THEN 'checkout' ELSE 'payment' END AS first_disclosure, round(ratio, 9) AS drip_ratio FROM r WHERE ratio >= 0.001""",
    "b_fees", "b_totals",
)


def wn10_seeded(spark: SparkSession, d: str) -> DataFrame:
    """A queue whose picks look random and are the same each time."""
    rows = frame(spark, d, "b_labels").select("ord", F.when(F.col("label") == 1, "A").when(F.col("pattern_id") == "b.two", "B").otherwise("C").alias("tier"))
    return corpus.build_queue(rows, 60, "round 1").select("ord", "tier")


WN10 = oracle(
    """
WITH t AS (SELECT ord, CASE WHEN label = 1 THEN 'A' WHEN pattern_id = 'b.two' THEN 'B' ELSE 'C' END AS tier FROM b_labels),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sha256('round 1:' || ord), ord) AS nth FROM t),
q AS (SELECT least(count(*) FILTER (WHERE tier = 'A'), 21) AS a, least(count(*) FILTER (WHERE tier = 'B'), 39) AS b, count(*) FILTER (WHERE tier = 'C') AS c FROM t)
SELECT ord, tier FROM r, q WHERE nth <= CASE tier WHEN 'A' THEN a WHEN 'B' THEN b ELSE least(c, a + b, 60 - a - b) END""",
    "b_labels",
)


def sc8_sql(spark: SparkSession, d: str) -> DataFrame:
    """What a query of a user's own says, as JSON lines."""
    path = new_folder(spark, "sql")
    batches.export_sql(spark, "select origin, max(confidence) as best from {detections} where surfaced_ms > 1000 group by origin", path, detections=frame(spark, d, "b_detections").withColumnRenamed("visible_ms", "surfaced_ms"))
    return spark.read.schema("origin string, best double").json(path)


QUERIES = {"cl1_json_ld": cl1_json_ld, "cl1_selling_gate": cl1_gate, "cl1_pages": cl1_pages, "vl6_gate": vl6_gate, "pf17_settings": pf17_settings, "st3_offer_series": st3_series, "st11_stage_triggers": st11_stages, "cl4_totals": cl4_totals, "dt14_displayed_price": dt14_displayed, "wn10_seeded_queue": wn10_seeded, "sc8_sql_export": sc8_sql}
ORACLE_SQL = {
    "cl1_json_ld": CL1_LD, "cl1_selling_gate": CL1_GATE, "cl1_pages": CL1_PAGES, "vl6_gate": VL6, "pf17_settings": PF17, "st3_offer_series": ST3, "st11_stage_triggers": ST11, "cl4_totals": CL4, "dt14_displayed_price": DT14, "wn10_seeded_queue": WN10,
    "sc8_sql_export": oracle("SELECT origin, max(confidence) AS best FROM b_detections WHERE visible_ms > 1000 GROUP BY ALL", "b_detections"),
}
