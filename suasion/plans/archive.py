"""Queries: histories and offers, answers and evaluation, rule packs, small text functions, batches as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.functions import lexicons as lex
from suasion.functions import rules, text
from suasion.operators import classifier, corpus, evaluation, history, telemetry
from suasion.plans.bridge import frame, oracle
from suasion.plans.measures import AS_OF_DAY, DET, RECORDS, _records
from suasion.sources import batches, pages
from suasion.sources.tables import table

AS_OF_MS = 1_712_000_000_000
PATTERNS = ("view", "click", "purchase")


def st7_texts(spark: SparkSession, d: str) -> DataFrame:
    x = frame(spark, d, "b_detections").select("user_id", "ts_ms", F.col("event_id").alias("seq"), F.col("k").cast("string").alias("text"))
    return history.text_history(x, ("user_id",)).select("user_id", "seq", "text")


def st9_interruptions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("k") % 5 < 2, "shown").when(F.col("k") % 5 == 2, "hidden").when(F.col("k") % 5 == 3, "gesture").otherwise("exit")
    x = frame(spark, d, "b_detections").select(F.col("user_id").alias("page_id"), (F.col("k") % 2).alias("node"), F.floor(F.col("ts_ms") / 10_000).alias("ts_ms"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return history.interruptions(x)


MODALS = """
e AS (SELECT user_id AS page_id, k % 2 AS node, ts_ms // 10000 AS ts_ms, event_id AS seq, CASE WHEN k % 5 < 2 THEN 'shown' WHEN k % 5 = 2 THEN 'hidden' WHEN k % 5 = 3 THEN 'gesture' ELSE 'exit' END AS kind FROM b_detections),
c AS (SELECT *, count(*) FILTER (WHERE kind = 'shown') OVER (PARTITION BY page_id, node ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spell FROM e),
m AS (
  SELECT *, min(ts_ms) FILTER (WHERE kind = 'hidden') OVER (PARTITION BY page_id, node, spell) AS h, max(ts_ms) FILTER (WHERE kind = 'gesture') OVER u AS g, max(ts_ms) FILTER (WHERE kind = 'exit') OVER u AS x FROM c
  WINDOW u AS (PARTITION BY page_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT page_id, node, ts_ms, seq FROM m WHERE kind = 'shown' AND (spell = 0 OR coalesce(ts_ms - h >= 1500, false)) AND NOT (coalesce(ts_ms - g < 750, false) AND NOT coalesce(ts_ms - x <= 500, false))
"""


def st10_dwell(spark: SparkSession, d: str) -> DataFrame:
    x = frame(spark, d, "b_detections").select("user_id", "ts_ms", F.col("event_id").alias("seq"), F.col("confidence").alias("ratio"), F.col("prominent").alias("tab_visible"), F.col("k").alias("scroll"))
    return history.dwell(x, ("user_id",))


def st12_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = frame(spark, d, "b_detections").select(history.session_id(F.col("user_id"), F.col("ts_ms")).alias("session_id"))
    return x.groupBy("session_id").agg(F.count("*").alias("n"))


def st3_offers(spark: SparkSession, d: str) -> DataFrame:
    o = history.merge_offers(frame(spark, d, "b_stock"))
    return o.select("offer_key", "sightings", "first_seen", "last_seen", F.array_join(F.transform("samples", lambda n: n.cast("string")), ",").alias("samples"))


OFFERS = """
n AS (SELECT *, row_number() OVER (PARTITION BY offer_key ORDER BY ts_ms DESC, seq DESC) AS r FROM b_stock)
SELECT offer_key, count(DISTINCT ts_ms) AS sightings, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, string_agg(n::VARCHAR, ',' ORDER BY ts_ms, seq) FILTER (WHERE r <= 64) AS samples FROM n GROUP BY offer_key
"""


def st2_evicted(spark: SparkSession, d: str) -> DataFrame:
    seen = frame(spark, d, "b_stock").groupBy("origin", "offer_key").agg(F.max("ts_ms").alias("last_seen"))
    return history.evict_offers(seen, AS_OF_MS, 500).select("offer_key", "last_seen")


def so5_merged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return corpus.first_of_key(docs, F.col("key"), ["source", "doc_id"])


def jn20_labels(spark: SparkSession, d: str) -> DataFrame:
    items = frame(spark, d, "b_labels").select(F.col("ord").alias("i"), "site")
    given = frame(spark, d, "b_label_log").select(F.col("seq").alias("i"), F.col("pattern_id").alias("answer"))
    rows = evaluation.label_every_pattern(evaluation.answered(items, given), PATTERNS)
    return rows.groupBy("site", "pattern_id", "label").agg(F.count("*").alias("n"))


def jn21_scores(spark: SparkSession, d: str) -> DataFrame:
    labels = frame(spark, d, "b_labels")
    fired = frame(spark, d, "b_fired")
    return evaluation.score_or_zero(labels.select("ord", "pattern_id", "label"), fired, ["ord"])


def ag16_thresholds(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.at_two_thresholds(frame(spark, d, "b_labels"))
    rates = (f"{a}_{b}" for a in ("recall", "precision") for b in ("log", "surface"))
    return out.select("pattern_id", "positives", "tp_log", "fp_log", "tp_surface", "fp_surface", *(F.round(c, 9).alias(c) for c in rates))


def _two(name: str, at: float) -> str:
    tp, fp = f"count(*) FILTER (WHERE score >= {at} AND label = 1)", f"count(*) FILTER (WHERE score >= {at} AND label = 0)"
    return f"{tp} AS tp_{name}, {fp} AS fp_{name}, round({tp}::DOUBLE / nullif(count(*) FILTER (WHERE label = 1), 0), 9) AS recall_{name}, round({tp}::DOUBLE / nullif({tp} + {fp}, 0), 9) AS precision_{name}"


def ml4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.holdout_by_site(frame(spark, d, "b_labels"))
    return evaluation.verdicts(rows).select("pattern_id", "positives", "held", "held_positives", "verdict")


VERDICTS = """
s AS (SELECT site, (row_number() OVER (ORDER BY site) - 1) % 4 = 3 AS held_out FROM (SELECT DISTINCT site FROM b_labels)),
c AS (SELECT pattern_id, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE held_out) AS held, count(*) FILTER (WHERE held_out AND label = 1) AS held_positives,
             count(*) FILTER (WHERE held_out AND label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE held_out AND score >= 0.5) AS hits FROM b_labels JOIN s USING (site) GROUP BY ALL)
SELECT pattern_id, positives, held, held_positives, CASE WHEN positives < 40 OR held < 20 OR held_positives < 8 THEN 'SKIPPED' WHEN coalesce(tp::DOUBLE / nullif(hits, 0), 0) < 0.8 OR coalesce(tp::DOUBLE / nullif(held_positives, 0), 0) < 0.5 THEN 'REJECTED' ELSE 'OK' END AS verdict FROM c
"""


def ml6_ratchet(spark: SparkSession, d: str) -> DataFrame:
    """Every label's scores lowered by 0.05, held against the scores as they are."""
    labels = frame(spark, d, "b_labels")
    return evaluation.ratchet(evaluation.recall_baseline(labels.withColumn("score", F.col("score") - F.lit(0.05))), evaluation.recall_baseline(labels))


RATCHET = """
p AS (SELECT pattern_id, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 1 AND score >= 0.35) AS hits, count(*) FILTER (WHERE label = 1 AND score - 0.05::DOUBLE >= 0.35) AS hits_now FROM b_labels GROUP BY pattern_id),
r AS (SELECT pattern_id, positives, round(coalesce(hits::DOUBLE / nullif(positives, 0), 0), 3) AS recall_was, round(coalesce(hits_now::DOUBLE / nullif(positives, 0), 0), 3) AS recall FROM p)
SELECT pattern_id, positives AS positives_was, recall_was, positives, recall, CASE WHEN recall < recall_was - 0.02::DOUBLE THEN 'regressed' ELSE 'held' END AS verdict FROM r
"""


def ml5_novelty(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "b_copy").select(F.col("stage").alias("pattern_id"), "text", F.when(F.col("is_control"), 1).otherwise(0).alias("label"))
    return evaluation.novelty(rows, r"\bleft\b|\bstock\b")


def ag13_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "b_labels").select("pattern_id", "ord")
    return evaluation.with_examples(rows, "pattern_id", "ord", ["ord"]).select("pattern_id", "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


def pf2_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(rules.char_class(F.col("text")).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def _mask_sql() -> str:
    words = "|".join(w.replace("'", "''") for w in lex.TRIGGERS)
    parts = ((r"[0-9]", 1), ("[$£€¥₹]", 2), (":", 4), ("%", 8))
    bits = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {b} ELSE 0 END" for p, b in parts)
    return f"SELECT {bits} + CASE WHEN regexp_matches(lower(text), '{words}') THEN 16 ELSE 0 END AS mask, count(*) AS n FROM documents GROUP BY ALL"


#: A small pack for the registered queries; a full one is read with sources.batches.read_pack.
DENIED = {"schemes": ("about:", "file:"), "suffixes": (".gov", ".mil", ".edu"), "patterns": (r"(^|\.)[a-z0-9-]*bank[a-z0-9-]*\.", r"localhost$", r"^the[a-z]+\.")}
CONVERTED = (r"(^|\.)(alpha|beta)\.com$", r"(^|\.)(gamma|d-elta)\.(com|app|social)$", r"\.local$", r"^(www\.)?(mail|inbox)\.", r"(^|\.)[a-z0-9-]*bank[a-z0-9-]*\.", r"localhost$")


def pf8_denied(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", rules.denied(F.col("url"), **DENIED).alias("denied"), rules.matches_pattern(F.col("url"), "https://*.example.com/*").alias("on_example"))


def fn14_excludes(spark: SparkSession, d: str) -> DataFrame:
    """Patterns written from the brands of parts, two to a pattern, beside the fixed ones."""
    brands = table(spark, d, "part").select(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "").alias("b")).distinct()
    made = brands.select(F.concat(F.lit(r"(^|\.)("), F.col("b"), F.lit("|x-"), F.col("b"), F.lit(r")\.(com|app)$")).alias("pattern"))
    bare = brands.select(F.concat(F.lit(r"\."), F.col("b"), F.lit("$")).alias("pattern"))
    loose = brands.select(F.concat(F.lit(r"^"), F.col("b"), F.lit(r"\.")).alias("pattern"))
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, CONVERTED))).alias("pattern"))
    return rules.exclude_matches(made.unionByName(bare).unionByName(loose).unionByName(fixed))


def fn16_clock(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Ends in "), (F.col("p_size") % 24).cast("string"), F.lit(":"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 2 == 0, ":30").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.clock_seconds(t).alias("seconds"))


def fn42_choices(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("amount") % 4 == 0, "Add ").when(F.col("amount") % 4 == 1, "No thanks, skip ").when(F.col("amount") % 4 == 2, "Remove ").otherwise("")
    x = frame(spark, d, "b_fees").select("label", rules.click_choice(F.concat(lead, F.col("label"))).alias("selected"))
    return x.groupBy("label", "selected").agg(F.count("*").alias("n"))


def sc9_export(spark: SparkSession, d: str) -> DataFrame:
    """Batches written as JSON bodies, read back, checked and counted."""
    bodies = batches.to_bodies(_records(spark, d))
    return telemetry.admit_batches(batches.records_of(bodies), AS_OF_DAY)


def jn14_claims(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.distinct_claims(frame(spark, d, "b_label_log"), ["pattern_id", "key"], "seq")


def sc1_harvest(spark: SparkSession, d: str) -> DataFrame:
    nodes = pages.harvest(table(spark, d, "pages"))
    return nodes.groupBy("tag_name").agg(F.count("*").alias("n"), F.count_if(F.col("accessible_name") != "").alias("named"), F.countDistinct("page_id").alias("pages"))


def sc2_meta(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_meta(table(spark, d, "pages")).select("page_id", "title", "lang", "og_type", "has_cc_field", "n_elements")


def ml2_classifier(spark: SparkSession, d: str) -> DataFrame:
    """A model for each stage's copy, learnt from distinct texts and scored on all of them."""
    copy = frame(spark, d, "b_copy").groupBy("text").agg(F.count("*").alias("n"))
    stock, live = F.col("text").rlike("left|stock|sold out"), F.col("text").rlike("people|bought|sold in")
    labelled = copy.select("text", F.explode(F.array(F.struct(F.lit("scarcity.stock").alias("pattern_id"), stock.cast("int").alias("label")), F.struct(F.lit("social_proof.live_activity").alias("pattern_id"), live.cast("int").alias("label")))).alias("p")).select("p.*", "text")
    return classifier.score(copy, classifier.fit(labelled), "text").select("text", "pattern_id", F.round("score", 6).alias("score"))


QUERIES = {
    "sc1_harvest": sc1_harvest,
    "sc2_page_meta": sc2_meta,
    "ml2_text_classifier": ml2_classifier,
    "st7_text_history": st7_texts,
    "st9_interruptions": st9_interruptions,
    "st10_dwell": st10_dwell,
    "st12_session_ids": st12_sessions,
    "st3_offer_merge": st3_offers,
    "st2_offer_evict": st2_evicted,
    "so5_merge_dedup": so5_merged,
    "jn20_label_fan_out": jn20_labels,
    "jn21_score_or_zero": jn21_scores,
    "ag13_examples": ag13_examples,
    "ag14_distinct_claims": jn14_claims,
    "ag16_two_thresholds": ag16_thresholds,
    "ml4_training_gate": ml4_verdicts,
    "ml5_novelty": ml5_novelty,
    "ml6_recall_ratchet": ml6_ratchet,
    "pf2_prefilter": pf2_prefilter,
    "pf8_denylist": pf8_denied,
    "fn14_exclude_matches": fn14_excludes,
    "fn16_clock_seconds": fn16_clock,
    "fn42_click_choices": fn42_choices,
    "sc10_json_batches": sc9_export,
}
ORACLE_SQL = {
    "st7_text_history": oracle(
        "WITH c AS (SELECT user_id, ts_ms, event_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS p FROM b_detections) SELECT user_id, event_id AS seq, k::VARCHAR AS text FROM c WHERE p IS DISTINCT FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) <= 12", "b_detections"
    ),
    "st9_interruptions": oracle("WITH " + MODALS, "b_detections"),
    "st10_dwell": oracle(
        "WITH t AS (SELECT *, CASE WHEN confidence >= 0.5 AND prominent THEN coalesce(lead(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) - ts_ms, 0) ELSE 0 END AS ms FROM b_detections) SELECT user_id, sum(ms)::BIGINT AS visible_ms, max(confidence) AS viewport_fraction, arg_min(k, ts_ms * 1000000 + event_id) FILTER (WHERE confidence >= 0.5 AND prominent) AS scroll_depth FROM t GROUP BY user_id", "b_detections"
    ),
    "st12_session_ids": oracle("SELECT user_id::VARCHAR || ':' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS session_id, count(*) AS n FROM b_detections GROUP BY ALL", "b_detections"),
    "st3_offer_merge": oracle("WITH " + OFFERS, "b_stock"),
    "st2_offer_evict": oracle(f"SELECT offer_key, max(ts_ms) AS last_seen FROM b_stock GROUP BY ALL HAVING max(ts_ms) >= {AS_OF_MS - 90 * 86_400_000} ORDER BY last_seen DESC, offer_key LIMIT 500", "b_stock"),
    "so5_merge_dedup": "SELECT doc_id, source, sha256(text) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) = 1",
    "jn20_label_fan_out": oracle(
        "SELECT l.site, p.pattern_id, (a.pattern_id = p.pattern_id)::INTEGER AS label, count(*) AS n FROM b_labels l JOIN b_label_log a ON a.seq = l.ord, (VALUES ('view'), ('click'), ('purchase')) p(pattern_id) GROUP BY ALL", "b_labels", "b_label_log"
    ),
    "jn21_score_or_zero": oracle("SELECT ord, pattern_id, label, CASE WHEN score >= 0.35 THEN score ELSE 0 END::DOUBLE AS score FROM b_labels", "b_labels"),
    "ag13_examples": oracle("WITH r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY ord) AS nth FROM b_labels) SELECT pattern_id, count(*) AS n, string_agg(ord::VARCHAR, ',' ORDER BY ord) FILTER (WHERE nth <= 3) AS examples FROM r GROUP BY pattern_id", "b_labels"),
    "ag14_distinct_claims": oracle("SELECT pattern_id, key, count(*) AS logged_times, min(seq) AS first_at FROM b_label_log GROUP BY ALL", "b_label_log"),
    "ag16_two_thresholds": oracle(f"SELECT pattern_id, count(*) FILTER (WHERE label = 1) AS positives, {_two('log', 0.35)}, {_two('surface', 0.75)} FROM b_labels GROUP BY pattern_id", "b_labels"),
    "ml4_training_gate": oracle("WITH " + VERDICTS, "b_labels"),
    "ml6_recall_ratchet": oracle("WITH " + RATCHET, "b_labels"),
    "ml5_novelty": oracle(r"SELECT stage AS pattern_id, count(*) FILTER (WHERE is_control) AS positives, count(*) FILTER (WHERE is_control AND NOT regexp_matches(text, '\bleft\b|\bstock\b')) AS novel FROM b_copy GROUP BY stage", "b_copy"),
    "pf2_prefilter": _mask_sql(),
    "pf8_denylist": r"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://(?:[^@/?#]*@)?([^:/?#]+)', 1)) AS host FROM pages)
SELECT page_id, regexp_matches(url, '^(about|file):') OR regexp_matches(host, '\.(gov|mil|edu)$') OR regexp_matches(host, '(^|\.)[a-z0-9-]*bank[a-z0-9-]*\.') OR regexp_matches(host, 'localhost$') OR regexp_matches(host, '^the[a-z]+\.') AS denied,
       url LIKE 'https://%' AND (host = 'example.com' OR host LIKE '%.example.com') AS on_example FROM h
""",
    "fn14_exclude_matches": rf"""
WITH b AS (SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b FROM part)
SELECT 'https://*.' || l || b || '.' || e || '/*' AS "match", true AS expressible FROM b, (VALUES (''), ('x-')) x(l), (VALUES ('com'), ('app')) y(e)
UNION ALL SELECT 'https://*.' || b || '/*', true FROM b UNION ALL SELECT '^' || b || '\.', false FROM b
UNION ALL SELECT * FROM (VALUES ('https://*.alpha.com/*', true), ('https://*.beta.com/*', true), ('https://*.d-elta.app/*', true), ('https://*.d-elta.com/*', true), ('https://*.d-elta.social/*', true), ('https://*.gamma.app/*', true), ('https://*.gamma.com/*', true), ('https://*.gamma.social/*', true), ('https://*.local/*', true), ('^(www\.)?(mail|inbox)\.', false), ('(^|\.)[a-z0-9-]*bank[a-z0-9-]*\.', false), ('localhost$', false)) t(match, expressible)""",
    "fn16_clock_seconds": "SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN (p_size % 24) * 3600 + (p_partkey % 60) * 60 + 30 ELSE (p_size % 24) * 60 + p_partkey % 60 END)::INTEGER AS seconds FROM part",
    "fn42_click_choices": oracle("SELECT label, CASE amount % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE CASE WHEN label LIKE '%Protection%' THEN NULL END END AS selected, count(*) AS n FROM b_fees GROUP BY ALL", "b_fees"),
    "sc10_json_batches": oracle("WITH " + RECORDS + f" SELECT batch_id, count(*) AS size, CASE WHEN count(*) > 500 THEN 413 WHEN NOT bool_and(day_bucket BETWEEN {AS_OF_DAY - 90} AND {AS_OF_DAY + 90}) THEN 422 ELSE 204 END AS status FROM records GROUP BY batch_id", *DET),
}
