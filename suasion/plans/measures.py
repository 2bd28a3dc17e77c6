"""Queries: counters and views, page views and outcomes, digests, ledgers, repeat visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.operators import digest, ledger, outcomes, telemetry, temporal, views
from suasion.plans.bridge import frame, oracle

AS_OF_DAY = 19_740


def _records(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.to_records(frame(spark, d, "b_detections"), frame(spark, d, "b_allowlist"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.cohort_counts(_records(spark, d))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.cohort_counts(frame(spark, d, "b_outcome_rows"), telemetry.OUTCOME_COHORT)


RECORDS = """
records AS (
  SELECT d.batch_id, d.pattern_id, d.detector_id, d.funnel_stage, regexp_extract(d.origin, '^https://(?:[^/?#:]+\\.)?([^./?#:]+\\.com)', 1) AS site, coalesce(a.category, 'other') AS origin_category, '1.0.1' AS rulepack_version,
         cast(floor(d.ts_ms / 86400000) AS bigint) AS day_bucket, CASE WHEN d.confidence < 0.25 THEN 1 WHEN d.confidence < 0.5 THEN 2 WHEN d.confidence < 0.75 THEN 3 ELSE 4 END AS quartile
  FROM b_detections d LEFT JOIN b_allowlist a ON a.site = regexp_extract(d.origin, '^https://(?:[^/?#:]+\\.)?([^./?#:]+\\.com)', 1) WHERE d.origin LIKE 'https://%'
)"""
COUNTS = RECORDS + """, counts AS (
  SELECT pattern_id, detector_id, funnel_stage, site, origin_category, rulepack_version, day_bucket, quartile, count(*) AS n, count(DISTINCT batch_id) AS reporters FROM records GROUP BY ALL
)"""
OUTCOMES = """
outcomes AS (
  SELECT pattern_id, funnel_stage, site, origin_category, rulepack_version, day_bucket, added_to_cart, count(*) AS n, count(DISTINCT batch_id) AS reporters FROM b_outcome_rows GROUP BY ALL
)"""
PREVALENCE = "SELECT site, origin_category, pattern_id, sum(n)::BIGINT AS detections, sum(reporters)::BIGINT AS batches, count(DISTINCT day_bucket) AS days_seen, min(day_bucket) AS first_day, max(day_bucket) AS last_day FROM counts GROUP BY ALL"
ADD_RATE = """
per AS (SELECT site, pattern_id, sum(n) AS views, sum(CASE WHEN added_to_cart = 1 THEN n ELSE 0 END) AS added, sum(reporters) AS batches FROM outcomes GROUP BY ALL),
rates AS (
  SELECT per.site, per.pattern_id, per.views::BIGINT AS views, per.added::BIGINT AS added, round(per.added::DOUBLE / per.views, 4) AS add_rate, b.views::BIGINT AS base_views, round(b.added::DOUBLE / b.views, 4) AS base_add_rate,
         CASE WHEN b.added = 0 THEN NULL ELSE round((per.added::DOUBLE / per.views) / (b.added::DOUBLE / b.views), 3) END AS lift, per.batches::BIGINT AS batches
  FROM per JOIN per b ON b.site = per.site AND b.pattern_id = '_page' WHERE per.pattern_id <> '_page'
)"""
DET = ("b_detections", "b_allowlist")
SINCE = 1_705_881_600_000


def ag19(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "b_detections").select(F.col("user_id").alias("page_id"), "pattern_id", F.col("k").alias("text_hash"), F.col("funnel_stage").alias("detector_order"), F.col("event_id").alias("idx"))
    return digest.dedup_candidates(c)


def _digest_inputs(spark: SparkSession, d: str) -> DataFrame:
    x = frame(spark, d, "b_detections")
    return x.select(F.floor(F.col("event_id") / 12).alias("digest_id"), F.col("event_id").alias("input_index"), "pattern_id", "detector_id", F.col("confidence").alias("raw_score"), "visible_ms", "ephemeral")


DIGEST = """
tax AS (SELECT * FROM (VALUES ('urgency.countdown', 'urgency', 0.70), ('scarcity.stock', 'scarcity', 0.65), ('pricing.drip', 'pricing', 0.95), ('anchoring.reference_price', 'anchoring', 0.55), ('nagging.repeat_interstitial', 'nagging', 0.50)) t(pattern_id, family, severity)),
j AS (
  SELECT event_id // 12 AS digest_id, event_id AS input_index, d.pattern_id, d.detector_id, confidence AS raw_score, visible_ms, ephemeral, confidence * ln(1 + visible_ms / 1000) * severity AS rank, family,
         CASE WHEN d.pattern_id = 'nagging.repeat_interstitial' THEN 'user_disabled' WHEN confidence < 0.5 THEN 'below_threshold' WHEN visible_ms < CASE WHEN ephemeral THEN 400 ELSE 800 END THEN 'below_salience_gate' END AS bad
  FROM b_detections d JOIN tax USING (pattern_id)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY digest_id, family, bad IS NULL ORDER BY rank DESC, input_index) AS nth, min(input_index) OVER (PARTITION BY digest_id, family, bad IS NULL) AS slot FROM j
), p AS (
  SELECT *, CASE WHEN bad IS NULL AND nth = 1 THEN row_number() OVER (PARTITION BY digest_id, bad IS NULL AND nth = 1 ORDER BY rank DESC, slot) END AS place FROM f
), decided AS (
  SELECT digest_id, input_index, pattern_id, round(rank, 6) AS rank, place::INTEGER AS place, coalesce(bad, CASE WHEN nth > 1 THEN 'dedup_family' WHEN place > 2 THEN 'digest_full' ELSE 'none' END) AS reason FROM p
)"""


def wn2_digest(spark: SparkSession, d: str) -> DataFrame:
    out = digest.decide(_digest_inputs(spark, d), ("nagging.repeat_interstitial",), max_items=2, threshold=0.5)
    return out.select("digest_id", "input_index", "pattern_id", F.round("rank", 6).alias("rank"), "place", "reason")


def wn4_capacity(spark: SparkSession, d: str) -> DataFrame:
    out = digest.with_capacity(digest.decide(_digest_inputs(spark, d), ("nagging.repeat_interstitial",), max_items=2, threshold=0.5), 1)
    return out.groupBy("mode", "reason").agg(F.count("*").alias("n"))


def pf17_debounce(spark: SparkSession, d: str) -> DataFrame:
    x = frame(spark, d, "b_detections").select(F.col("user_id").alias("session_id"), "origin", F.col("funnel_stage").alias("stage"), F.col("k").alias("page"), "ts_ms", F.col("event_id").alias("seq"))
    return digest.debounce(x).select("seq", "show", "reason")


def st5_page_views(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.page_views(frame(spark, d, "b_views"), 6 * 3_600_000).select("view_id", "origin", "view_no", "started_ms", "funnel_stage", "added", F.array_join("exposed", ",").alias("exposed"))


VIEWS = """
s AS (
  SELECT *, CASE WHEN coalesce(ts_ms - lag(ts_ms) OVER w > 21600000 OR lag(added) OVER w, true) THEN 1 ELSE 0 END AS starts FROM b_views WINDOW w AS (PARTITION BY view_id, origin ORDER BY ts_ms, seq)
), c AS (
  SELECT *, sum(starts) OVER (PARTITION BY view_id, origin ORDER BY ts_ms, seq)::BIGINT AS view_no FROM s
), p AS (
  SELECT view_id, origin, view_no, pattern_id, min(seq) AS seq, min(ts_ms) AS ts_ms, bool_or(added) AS added, arg_min(funnel_stage, seq) AS stage FROM c GROUP BY ALL
), v AS (
  SELECT view_id, origin, view_no, min(ts_ms) AS started_ms, arg_min(stage, seq) AS funnel_stage, bool_or(added) AS added, string_agg(pattern_id, ',' ORDER BY ts_ms, seq) AS exposed FROM p GROUP BY ALL
)"""


def st5_outcome_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = outcomes.outcome_rows(outcomes.page_views(frame(spark, d, "b_views"), 6 * 3_600_000))
    return rows.groupBy("site", "pattern_id", "funnel_stage", "day_bucket", "added_to_cart").agg(F.count("*").alias("n"))


def dt14_drip(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.drip(frame(spark, d, "b_snapshots"), frame(spark, d, "b_fees"), 0.001)
    return found.select("session_id", "drip_amount", "fee_count", "first_disclosure", F.round("drip_ratio", 9).alias("drip_ratio"), F.round("raw_score", 9).alias("raw_score"))


KIND = "CASE WHEN label IN ('Estimated tax') THEN 'tax' WHEN label = 'Promo discount' THEN 'discount' WHEN label IN ('Service fee', 'Resort fee') THEN 'mandatory_fee' WHEN label IN ('Accident Protection Plan', 'Gift wrap') THEN 'optional_addon' ELSE 'unknown' END"
DRIP = f"""
o AS (SELECT *, CASE stage WHEN 'pdp' THEN 1 WHEN 'cart' THEN 2 WHEN 'checkout' THEN 3 ELSE 4 END AS pos, {KIND} AS kind FROM b_fees),
first_at AS (SELECT session_id, label, min(pos) AS disclosed, count(*) FILTER (WHERE pos = 1) AS early FROM o GROUP BY ALL),
late AS (
  SELECT o.session_id, sum(o.amount) AS drip_amount, count(*) AS fee_count, min(f.disclosed) AS disclosed FROM o JOIN first_at f USING (session_id, label)
  WHERE o.pos = 4 AND f.early = 0 AND f.disclosed >= 2 AND o.kind NOT IN ('discount', 'optional_addon') GROUP BY o.session_id
), d AS (
  SELECT late.*, late.drip_amount::DOUBLE / s.subtotal AS drip_ratio FROM late JOIN b_snapshots s ON s.session_id = late.session_id AND s.stage = 'payment' WHERE s.subtotal <> 0
)
SELECT session_id, drip_amount::BIGINT AS drip_amount, fee_count, CASE disclosed WHEN 2 THEN 'cart' WHEN 3 THEN 'checkout' ELSE 'payment' END AS first_disclosure, round(drip_ratio, 9) AS drip_ratio,
       round(least(1.0::DOUBLE, 0.5 + 0.25 * (disclosed / 4.0::DOUBLE) + 0.25 * least(1.0::DOUBLE, drip_ratio / 0.2::DOUBLE)), 9) AS raw_score
FROM d WHERE drip_ratio >= 0.001
"""


def dt15_sneak(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.sneak(frame(spark, d, "b_snapshots"), frame(spark, d, "b_fees"), frame(spark, d, "b_adds"), frame(spark, d, "b_choices"))
    return found.select("session_id", "unattributed", "adds_observed", F.round("raw_score", 6).alias("raw_score"))


SNEAK = f"""
chosen AS (SELECT session_id, addon_key, arg_max(selected, seq) AS selected FROM b_choices GROUP BY ALL),
own AS (
  SELECT f.session_id, count(*) AS unattributed FROM b_fees f LEFT JOIN chosen c ON c.session_id = f.session_id AND c.selected AND c.addon_key = CASE WHEN f.label = 'Gift wrap' THEN 'gift_wrap' ELSE 'protection' END
  WHERE f.stage = 'checkout' AND {KIND} = 'optional_addon' AND c.session_id IS NULL GROUP BY f.session_id
)
SELECT session_id, unattributed, 1::BIGINT AS adds_observed, round(least(1.0::DOUBLE, 0.6 + 0.1 * unattributed), 6) AS raw_score FROM own JOIN b_adds USING (session_id)
"""


def jn12_first_disclosure(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_disclosure(frame(spark, d, "b_fees")).groupBy("label", "first_stage").agg(F.count("*").alias("sessions"))


def cl4_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reconcile(frame(spark, d, "b_snapshots"), frame(spark, d, "b_fees")).select("session_id", "stage", "fee_total", "mandatory_total", F.round("drip_ratio", 9).alias("drip_ratio"))


def wn7_latest_choice(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest_choices(frame(spark, d, "b_choices")).select("session_id", "addon_key", "selected")


def wn5_newest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.newest(frame(spark, d, "b_stock"), ("origin", "offer_key"), (F.desc("ts_ms"), F.desc("seq")), 5).select("offer_key", "ts_ms", "seq", "n")


def wn6_stage_records(spark: SparkSession, d: str) -> DataFrame:
    x = frame(spark, d, "b_detections").select(F.col("user_id").alias("session_id"), "origin", F.col("funnel_stage").alias("stage"), "ts_ms", F.when(F.col("k") > 50, F.col("k")).alias("snapshot"))
    return ledger.stage_records(x, ("session_id", "origin"), "ts_ms", "snapshot").select("session_id", "stage", "entered_at", "snapshot")


def dt16(spark: SparkSession, d: str) -> DataFrame:
    return temporal.evergreen_countdown(frame(spark, d, "b_timers")).select("offer_key", "container", "advancing", "comparisons", F.round("raw_score", 6).alias("raw_score"))


EVERGREEN = """
g AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS gap, end_ms - lag(end_ms) OVER w AS moved FROM b_timers WINDOW w AS (PARTITION BY offer_key, container ORDER BY ts_ms, seq)),
t AS (SELECT *, coalesce(gap >= 60000 AND least(gap % 86400000, 86400000 - gap % 86400000) >= 5400000, false) AS telling FROM g),
e AS (
  SELECT offer_key, container, count(*) AS sightings, min(seq) AS first_seq, count(*) FILTER (WHERE telling) AS comparisons, count(*) FILTER (WHERE telling AND moved::DOUBLE / gap > 0.7 AND moved::DOUBLE / gap < 1.4) AS advancing
  FROM t GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY offer_key ORDER BY first_seq) AS nth FROM e WHERE sightings >= 2 AND advancing > 0)
SELECT offer_key, container, advancing, comparisons, round(least(0.95::DOUBLE, 0.6 + 0.15 * advancing), 6) AS raw_score FROM r WHERE nth = 1
"""


def dt17(spark: SparkSession, d: str) -> DataFrame:
    return temporal.stock_nonmonotonic(frame(spark, d, "b_stock")).select("offer_key", "samples", "increases", "frozen", F.round("raw_score", 6).alias("raw_score"))


STOCK = """
g AS (SELECT *, lag(n) OVER (PARTITION BY offer_key ORDER BY ts_ms, seq) AS prev FROM b_stock),
e AS (
  SELECT offer_key, count(*) AS samples, count(*) FILTER (WHERE n > prev AND n <= 10 AND prev <= 10) AS increases,
         CASE WHEN min(n) = max(n) AND max(n) <= 10 AND max(ts_ms) - min(ts_ms) >= 14 * 86400000 AND count(*) >= 4 THEN 1 ELSE 0 END AS frozen FROM g GROUP BY offer_key
)
SELECT offer_key, samples, increases, frozen, round(least(0.9::DOUBLE, 0.55 + 0.12 * (increases + 2 * frozen)), 6) AS raw_score FROM e WHERE samples >= 2 AND (increases >= 2 OR frozen = 1)
"""


def dt18(spark: SparkSession, d: str) -> DataFrame:
    return temporal.reference_price_ungrounded(frame(spark, d, "b_prices"), frame(spark, d, "b_ref_prices")).select("offer_key", "visits", "ref_samples", F.round("span_days", 6).alias("span_days"), F.round("raw_score", 6).alias("raw_score"))


REFERENCE = """
p AS (SELECT offer_key, count(DISTINCT ts_ms) AS visits, max(minor) AS highest, (max(ts_ms) - min(ts_ms)) / 86400000.0::DOUBLE AS span_days FROM b_prices GROUP BY ALL),
r AS (SELECT offer_key, count(*) AS ref_samples, min(minor) AS lowest_ref FROM b_ref_prices GROUP BY ALL),
bare AS (SELECT DISTINCT p.offer_key FROM b_prices p ANTI JOIN b_ref_prices r ON p.offer_key = r.offer_key AND p.ts_ms = r.ts_ms)
SELECT p.offer_key, visits, ref_samples, round(span_days, 6) AS span_days, round(least(0.95::DOUBLE, 0.6 + least(0.3::DOUBLE, (span_days - 28) / 60)), 6) AS raw_score
FROM p JOIN r USING (offer_key) ANTI JOIN bare ON bare.offer_key = p.offer_key WHERE visits >= 3 AND span_days >= 28 AND highest < lowest_ref
"""


def dt19(spark: SparkSession, d: str) -> DataFrame:
    return temporal.social_proof_synthetic(frame(spark, d, "b_viewers")).select("offer_key", "samples", "bins", "constant", "uniformish", "narrow_band", F.round("raw_score", 6).alias("raw_score"))


SOCIAL = """
s AS (SELECT offer_key, count(*) AS samples, min(n) AS low, max(n) AS high, least(8, greatest(2, ceil(sqrt(count(*)))))::INTEGER AS bins FROM b_viewers GROUP BY ALL HAVING count(*) >= 20),
b AS (SELECT v.offer_key, least(bins - 1, floor((n - low)::DOUBLE / (high - low + 1) * bins))::INTEGER AS bin, count(*) AS c FROM b_viewers v JOIN s USING (offer_key) GROUP BY ALL),
every AS (SELECT s.offer_key, samples, low, high, bins, unnest(range(bins)) AS bin FROM s),
x AS (SELECT e.offer_key, samples, low, high, bins, sum(pow(coalesce(c, 0) - samples::DOUBLE / bins, 2) / (samples::DOUBLE / bins)) AS chi FROM every e LEFT JOIN b USING (offer_key, bin) GROUP BY ALL),
m AS (SELECT *, (low = high)::INTEGER AS constant, (low <> high AND chi < bins)::INTEGER AS uniformish, (low <> high AND high - low <= greatest(3, high * 0.25))::INTEGER AS narrow_band FROM x)
SELECT offer_key, samples, bins, constant, uniformish, narrow_band, round(CASE WHEN constant = 1 THEN 0.8::DOUBLE ELSE least(0.85::DOUBLE, 0.5 + 0.2 * uniformish + 0.2 * narrow_band) END, 6) AS raw_score FROM m WHERE constant + uniformish + narrow_band > 0
"""


def vl1_admission(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("site", F.when((F.col("day_bucket") % 9 == 0) & (F.col("quartile") == 4), "not a site").otherwise(F.col("site")))
    return telemetry.admit_batches(r, AS_OF_DAY)


QUERIES = {
    "ag1_cohort_counts": _counts,
    "ag3_outcome_cohorts": _outcomes,
    "ag4_site_prevalence": lambda s, d: views.site_prevalence(_counts(s, d)),
    "ag5_pattern_reach": lambda s, d: views.pattern_reach(_counts(s, d)),
    "ag6_pattern_by_stage": lambda s, d: views.pattern_by_stage(_counts(s, d)),
    "ag7_site_prevalence_public": lambda s, d: views.public(views.site_prevalence(_counts(s, d)), 30),
    "ag8_pattern_add_rate": lambda s, d: views.pattern_add_rate(_outcomes(s, d)),
    "ag9_site_pattern_add_rate": lambda s, d: views.site_pattern_add_rate(_outcomes(s, d)),
    "ag10_site_pattern_add_rate_public": lambda s, d: views.public(views.site_pattern_add_rate(_outcomes(s, d))),
    "ag11_daily_summary": lambda s, d: views.daily_summary(frame(s, d, "b_detections"), SINCE),
    "ag12_top_patterns": lambda s, d: views.top_patterns(frame(s, d, "b_detections")),
    "ag19_candidate_dedup": ag19,
    "fn15_records": lambda s, d: _records(s, d).groupBy("site", "origin_category", "quartile").agg(F.count("*").alias("n")),
    "vl1_batch_admission": vl1_admission,
    "st6_queue_batches": lambda s, d: telemetry.batches_of(frame(s, d, "b_detections"), 60, 25).select("event_id", "user_id", "batch_seq"),
    "wn2_digest_rank": wn2_digest,
    "wn4_capacity": wn4_capacity,
    "pf17_debounce": pf17_debounce,
    "st5_page_views": st5_page_views,
    "st5_outcome_rows": st5_outcome_rows,
    "dt14_drip": dt14_drip,
    "dt15_sneak": dt15_sneak,
    "jn12_first_disclosure": jn12_first_disclosure,
    "cl4_reconcile": cl4_reconcile,
    "wn5_newest_per_key": wn5_newest,
    "wn6_stage_records": wn6_stage_records,
    "wn7_latest_choice": wn7_latest_choice,
    "dt16_evergreen_countdown": dt16,
    "dt17_stock_nonmonotonic": dt17,
    "dt18_reference_price_ungrounded": dt18,
    "dt19_social_proof_synthetic": dt19,
}

ORACLE_SQL = {
    "ag1_cohort_counts": oracle("WITH " + COUNTS + " SELECT * FROM counts", *DET),
    "ag3_outcome_cohorts": oracle("WITH " + OUTCOMES + " SELECT * FROM outcomes", "b_outcome_rows"),
    "ag4_site_prevalence": oracle("WITH " + COUNTS + PREVALENCE, *DET),
    "ag5_pattern_reach": oracle("WITH " + COUNTS + " SELECT pattern_id, count(DISTINCT site) AS sites, sum(n)::BIGINT AS detections FROM counts GROUP BY ALL", *DET),
    "ag6_pattern_by_stage": oracle("WITH " + COUNTS + " SELECT pattern_id, funnel_stage, count(DISTINCT site) AS sites, sum(n)::BIGINT AS detections FROM counts GROUP BY ALL", *DET),
    "ag7_site_prevalence_public": oracle("WITH " + COUNTS + f" SELECT * FROM ({PREVALENCE}) WHERE batches >= 30", *DET),
    "ag8_pattern_add_rate": oracle(
        "WITH " + OUTCOMES + " SELECT pattern_id, sum(n)::BIGINT AS views, sum(CASE WHEN added_to_cart = 1 THEN n ELSE 0 END)::BIGINT AS added, count(DISTINCT site) AS sites, round(sum(CASE WHEN added_to_cart = 1 THEN n ELSE 0 END)::DOUBLE / sum(n), 4) AS add_rate FROM outcomes GROUP BY pattern_id", "b_outcome_rows"
    ),
    "ag9_site_pattern_add_rate": oracle("WITH " + OUTCOMES + "," + ADD_RATE + " SELECT * FROM rates", "b_outcome_rows"),
    "ag10_site_pattern_add_rate_public": oracle("WITH " + OUTCOMES + "," + ADD_RATE + " SELECT * FROM rates WHERE batches >= 20", "b_outcome_rows"),
    "ag11_daily_summary": oracle(
        f"SELECT pattern_id, funnel_stage, count(*) AS detected, count(*) FILTER (WHERE confidence >= 0.75) AS surfaced, count(*) FILTER (WHERE visible_ms < CASE WHEN ephemeral THEN 400 ELSE 800 END) AS below_salience, count(DISTINCT origin) AS origins FROM b_detections WHERE ts_ms >= {SINCE} GROUP BY ALL", "b_detections"
    ),
    "ag12_top_patterns": oracle("SELECT pattern_id, count(*) AS detected FROM b_detections GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5", "b_detections"),
    "ag19_candidate_dedup": oracle("SELECT user_id AS page_id, pattern_id, k AS text_hash, funnel_stage AS detector_order, event_id AS idx FROM b_detections QUALIFY row_number() OVER (PARTITION BY user_id, pattern_id, k ORDER BY funnel_stage, event_id) = 1", "b_detections"),
    "fn15_records": oracle("WITH " + RECORDS + " SELECT site, origin_category, quartile, count(*) AS n FROM records GROUP BY ALL", *DET),
    "vl1_batch_admission": oracle(
        "WITH " + RECORDS + f""" SELECT batch_id, count(*) AS size, CASE WHEN count(*) > 500 THEN 413 WHEN NOT bool_and(NOT (day_bucket % 9 = 0 AND quartile = 4) AND day_bucket BETWEEN {AS_OF_DAY - 90} AND {AS_OF_DAY + 90}) THEN 422 ELSE 204 END AS status FROM records GROUP BY batch_id""", *DET
    ),
    "st6_queue_batches": oracle(
        "WITH q AS (SELECT event_id, user_id, ts_ms FROM b_detections QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) <= 60) SELECT event_id, user_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) - 1) // 25)::INTEGER AS batch_seq FROM q", "b_detections"
    ),
    "wn2_digest_rank": oracle("WITH " + DIGEST + " SELECT * FROM decided", "b_detections"),
    "wn4_capacity": oracle(
        "WITH " + DIGEST + " SELECT CASE WHEN reason = 'none' AND place <= 1 THEN 'card' WHEN reason = 'none' THEN 'pill' ELSE 'suppressed' END AS mode, CASE WHEN reason = 'none' AND place > 1 THEN 'placement_suppressed' ELSE reason END AS reason, count(*) AS n FROM decided GROUP BY ALL", "b_detections"
    ),
    "pf17_debounce": oracle("SELECT event_id AS seq, row_number() OVER w = 1 AS show, CASE WHEN row_number() OVER w = 1 THEN 'none' ELSE 'debounced' END AS reason FROM b_detections WINDOW w AS (PARTITION BY user_id, origin, funnel_stage, k ORDER BY ts_ms, event_id)", "b_detections"),
    "st5_page_views": oracle("WITH " + VIEWS + " SELECT view_id, origin, view_no, started_ms, funnel_stage, added, exposed FROM v", "b_views"),
    "st5_outcome_rows": oracle(
        "WITH " + VIEWS + ", r AS (SELECT 'shop' || (view_id % 60) || '.com' AS site, unnest(list_prepend('_page', string_split(exposed, ','))) AS pattern_id, funnel_stage, cast(floor(started_ms / 86400000) AS BIGINT) AS day_bucket, added::INTEGER AS added_to_cart FROM v) SELECT site, pattern_id, funnel_stage, day_bucket, added_to_cart, count(*) AS n FROM r GROUP BY ALL", "b_views"
    ),
    "dt14_drip": oracle("WITH " + DRIP, "b_fees", "b_snapshots"),
    "dt15_sneak": oracle("WITH " + SNEAK, "b_fees", "b_adds", "b_choices"),
    "jn12_first_disclosure": oracle("WITH f AS (SELECT session_id, label, min(CASE stage WHEN 'pdp' THEN 1 WHEN 'cart' THEN 2 WHEN 'checkout' THEN 3 ELSE 4 END)::INTEGER AS first_stage FROM b_fees GROUP BY ALL) SELECT label, first_stage, count(*) AS sessions FROM f GROUP BY ALL", "b_fees"),
    "cl4_reconcile": oracle(
        f"WITH t AS (SELECT session_id, stage, sum(CASE WHEN {KIND} <> 'discount' THEN amount ELSE 0 END) AS fee_total, sum(CASE WHEN {KIND} = 'mandatory_fee' THEN amount ELSE 0 END) AS mandatory_total FROM b_fees GROUP BY ALL) SELECT s.session_id, s.stage, coalesce(fee_total, 0)::BIGINT AS fee_total, coalesce(mandatory_total, 0)::BIGINT AS mandatory_total, CASE WHEN subtotal <> 0 THEN round(coalesce(mandatory_total, 0)::DOUBLE / subtotal, 9) END AS drip_ratio FROM b_snapshots s LEFT JOIN t ON t.session_id = s.session_id AND t.stage = s.stage", "b_fees", "b_snapshots"
    ),
    "wn5_newest_per_key": oracle("SELECT offer_key, ts_ms, seq, n FROM b_stock QUALIFY row_number() OVER (PARTITION BY offer_key ORDER BY ts_ms DESC, seq DESC) <= 5", "b_stock"),
    "wn6_stage_records": oracle("SELECT user_id AS session_id, funnel_stage AS stage, min(ts_ms) AS entered_at, arg_min(k, ts_ms) FILTER (WHERE k > 50) AS snapshot FROM b_detections GROUP BY ALL", "b_detections"),
    "wn7_latest_choice": oracle("SELECT session_id, addon_key, arg_max(selected, seq) AS selected FROM b_choices GROUP BY ALL", "b_choices"),
    "dt16_evergreen_countdown": oracle("WITH " + EVERGREEN, "b_timers"),
    "dt17_stock_nonmonotonic": oracle("WITH " + STOCK, "b_stock"),
    "dt18_reference_price_ungrounded": oracle("WITH " + REFERENCE, "b_prices", "b_ref_prices"),
    "dt19_social_proof_synthetic": oracle("WITH " + SOCIAL, "b_viewers"),
}
