"""Queries: page detectors over text, prices and groups of nodes, each against the same rule said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.functions import lexicons as lex
from suasion.functions.bind import bound
from suasion.operators import detectors
from suasion.plans.bridge import frame, oracle


def _copy(spark: SparkSession, d: str) -> DataFrame:
    history = F.when(F.col("idx") % 2 == 0, F.array(F.struct(F.lit(0.0).alias("t"), F.lit("00:10").alias("text")), F.struct(F.lit(2000.0).alias("t"), F.lit("00:08").alias("text"))))
    none = F.array().cast("array<struct<t:double,text:string>>")
    return frame(spark, d, "b_copy").withColumn("text_history", F.coalesce(history, none))


def _tidy(found: DataFrame) -> DataFrame:
    return found.select("page_id", "idx", "pattern_id", F.round("raw_score", 6).alias("raw_score"))


def _re(text: str, patterns: tuple[str, ...] | str) -> str:
    joined = patterns if isinstance(patterns, str) else "|".join(f"(?:{p})" for p in patterns)
    return "regexp_matches({}, '{}')".format(text, joined.replace("'", "''"))


def _total(signals: list[tuple[str, float]]) -> str:
    return "round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, " + " + ".join(f"CASE WHEN {on} THEN {w}::DOUBLE ELSE 0 END" for on, w in signals) + ")), 6)"


def _sql(pattern: str, most: int, keep: str, signals: list[tuple[str, float]], extra: str = "") -> str:
    stages = ", ".join(f"'{s}'" for s in lex.DETECTOR_STAGES[pattern])
    return oracle(f"SELECT page_id, idx, '{pattern}' AS pattern_id, {_total(signals)} AS raw_score FROM b_copy WHERE stage IN ({stages}) AND length(text) BETWEEN 1 AND {most} AND ({keep}) {extra}", "b_copy")


NUM, WORDS, BOILER = _re("text", lex.STOCK_NUMERIC), _re("text", lex.STOCK_WORDS), _re("text", lex.STOCK_DISCLAIMER)
STOCK = _sql(
    "scarcity.stock", 160, f"NOT {_re('text', lex.STOCK_VARIANTS)} AND NOT {_re('text', lex.STOCK_NOTICE)} AND ({NUM} OR {WORDS})",
    [(NUM, 0.75), (WORDS, 0.65), ("has_progress", 0.15), (f"length(text) < 60 AND NOT {BOILER}", 0.1), (BOILER, -0.2)],
)
CLOCK, DEADLINE, RUNS = _re("text", r"\b\d{1,3}:[0-5]\d(:[0-5]\d)?\b"), _re("text", lex.DEADLINE), "(idx % 2 = 0)"
LEXEME = "(" + " OR ".join(f"contains(text, '{w}')" for w in lex.DEADLINE_LEXEMES) + ")"
URGENT_KEEP = f"({CLOCK} OR {LEXEME} OR {DEADLINE}) AND ({RUNS} OR {LEXEME} OR {DEADLINE})"
URGENT = _sql(
    "urgency.countdown", 200, URGENT_KEEP,
    [(RUNS, 0.55), (CLOCK, 0.2), (LEXEME, 0.25), (_re("text", r"\b(reserved|held) for\b|\bcart expires\b"), 0.15), (f"{DEADLINE} AND NOT {RUNS}", 0.4), (f"{DEADLINE} AND {_re('text', lex.DEADLINE_SPECIFIC)}", 0.25)],
    f"AND NOT EXISTS (SELECT 1 FROM b_copy o WHERE o.page_id = b_copy.page_id AND starts_with(o.selector_path, b_copy.selector_path || '>') AND o.stage IN ('pdp', 'cart', 'checkout') AND {URGENT_KEEP.replace('text', 'o.text').replace('idx', 'o.idx')})",
)
# a number beside a live badge counts unless it is one of followers; said without looking ahead
BADGE = r"\blive\b\s*[•·|‧∙]\s*\d{2,6}\b"
FOLLOWED = f"(len(regexp_extract_all(text, '{BADGE}')) > len(regexp_extract_all(text, '{BADGE}\\s*(followers?|subscribers?|likes?)')))"
COUNTER = "(" + _re("text", tuple(p for p in lex.LIVE_COUNTERS if "(?!" not in p)) + f" OR {FOLLOWED})"
SAYS = f"({_re('text', lex.TOAST)} AND NOT {_re('text', lex.OWN_PURCHASE)})"
PLACE, JUST = _re("raw_text", lex.PLACE), _re("text", lex.JUST_NOW)
RECENT = _re("text", r"\b(in the (last|past)|right now|today)\b|\b\d{1,5}\s+(other\s+)?(people|shoppers|customers|users|others)\s+(have|has|added)\b[^.!?]{0,24}?\b(carts?|bags?|baskets?)\b")
TOAST = f"({SAYS} AND ephemeral)"
NAMED = f"(NOT {TOAST} AND {SAYS} AND {PLACE} AND length(text) < 80 AND {JUST} AND NOT {_re('text', lex.REVIEW_MARKERS)})"
SOCIAL = _sql("social_proof.live_activity", 180, f"NOT {_re('text', lex.LIVE_EXCLUDED)} AND ({COUNTER} OR {TOAST} OR {NAMED})", [(COUNTER, 0.55), (TOAST, 0.6), (NAMED, 0.5), (PLACE, 0.15), (RECENT, 0.2), ("length(text) < 80", 0.1)])
REMAINDER = _re("text", lex.REMAINDERS)
LISTING = f"(len(regexp_extract_all(text, '{lex.MONEY_ISH}')) >= 2 AND NOT {_re('text', lex.ADDRESSED)})"
POLICY = f"(NOT {REMAINDER} AND NOT {LISTING} AND ({_re('text', lex.THRESHOLD_MET)} OR ({_re('text', lex.MONEY_ISH)} AND {_re('text', lex.REWARD)} AND {_re('text', lex.THRESHOLD_PREP)})))"
BAR = _re("text", lex.THRESHOLD_COPY)
GOAL = _sql("goal_gradient.threshold", 200, f"{REMAINDER} OR {POLICY} OR ({BAR} AND has_progress)", [(REMAINDER, 0.6), ("has_progress", 0.3), (f"{BAR} AND NOT {POLICY}", 0.2), (_re("raw_text", r"[$£€¥₹]\s?\d|\d\s?[$£€¥₹]|\b(USD|GBP|EUR|JPY|INR|CAD|AUD)\s\d"), 0.15), (POLICY, 0.45)])
SAID = "(CASE WHEN accessible_name <> '' THEN lower(accessible_name) ELSE text END)"
SHAMING, ACK = _re(SAID, lex.SHAMING), _re(SAID, lex.COSTLY_ACK)
SHAME = _sql(
    "confirmshaming.decline_copy", 160, f"NOT {_re(SAID, lex.NEUTRAL_DECLINE)} AND ({SHAMING} OR {ACK}) AND (is_control OR {ACK} OR {_re(SAID, lex.DECLINE_HINT)})",
    [("true", 0.6), (_re(SAID, lex.FIRST_PERSON), 0.3), ("is_control", 0.2), ("in_dialog", 0.1)],
)


def fn1_prices(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")  # parsed once
    parsed = bound(frame(spark, d, "b_price_copy"), "p", detectors.parse_prices(F.col("text")))
    places = F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["start"], x["end"], x["fraction"], x["raw"])), ",")
    return parsed.select("page_id", "idx", "l_partkey", p[0]["amount"].alias("was"), p[1]["amount"].alias("now"), p[0]["currency"].alias("currency"), p[1]["confidence"].alias("confidence"), F.size(p).alias("n"), places.alias("places"))


FN1 = """
SELECT page_id, idx, l_partkey, was, now, 'USD' AS currency, 0.9::DOUBLE AS confidence, 2 AS n,
  strpos(text, '$') - 1 || ':' || strpos(text, ' Now') - 1 || ':' || lpad((was % 100)::VARCHAR, 2, '0') || ':' || substr(text, 5, strpos(text, ' Now') - 5) || ',' || strpos(text, 'Now') + 3 || ':' || length(text) || ':' || lpad((now % 100)::VARCHAR, 2, '0') || ':' || substr(text, strpos(text, 'Now') + 4) AS places
FROM b_price_copy"""


def dt1_anchoring(spark: SparkSession, d: str) -> DataFrame:
    return detectors.anchoring(frame(spark, d, "b_nodes")).select("page_id", "idx", "anchor", "current", "ratio", F.round("raw_score", 6).alias("raw_score"))


ANCHORING = r"""
s AS (SELECT *, string_split(selector_path, '>') AS steps FROM b_nodes WHERE struck AND minor <= 100000000), l AS (SELECT * FROM b_nodes WHERE NOT struck AND minor <= 100000000),
lev AS (SELECT s.*, k AS up, array_to_string(steps[1:len(steps) - k], '>') AS scope FROM s, (VALUES (1), (2), (3)) v(k) WHERE len(steps) > k),
p AS (
  SELECT lev.page_id, lev.idx, lev.up, lev.scope, lev.minor AS anchor, lev.text, lev.container_text, min(l.minor) AS current FROM lev JOIN l ON l.page_id = lev.page_id AND (l.selector_path = lev.scope OR starts_with(l.selector_path, lev.scope || '>'))
    AND NOT (lev.selector_path = l.selector_path OR starts_with(lev.selector_path, l.selector_path || '>')) GROUP BY ALL
),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY page_id, idx ORDER BY up) = 1),
c AS (SELECT n.*, coalesce(b.text, n.container_text) || ' ' || n.container_text || ' ' || n.text AS said FROM n LEFT JOIN b_nodes b ON b.page_id = n.page_id AND b.selector_path = n.scope WHERE anchor > current),
r AS (
  SELECT *, least(1.0::DOUBLE, 0.45::DOUBLE + 0.2 + CASE WHEN contains(said, 'was') OR contains(said, 'you save') OR contains(said, 'list price') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(said, '\b\d{1,2}%\s*off\b|\b-\s?\d{1,2}%') THEN 0.15 ELSE 0 END + 0.15) AS score FROM c
)
SELECT page_id, idx, anchor, current, round(anchor::DOUBLE / current, 1) AS ratio, round(CASE WHEN (anchor - current) * 100 < anchor * 15 OR anchor - current < 500 THEN least(score, 0.6) ELSE score END, 6) AS raw_score FROM r
"""


def dt2_charm(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(detectors.charm(frame(spark, d, "b_charm")))


CHARM = """
p AS (SELECT page_id, idx, selector_path, area, cents_child, 0 AS nth, minor AS amount FROM b_charm UNION ALL SELECT page_id, idx, selector_path, area, cents_child, 1, 1295 FROM b_charm WHERE two),
h AS (SELECT * FROM p WHERE amount <= 100000000 AND amount % 100 IN (99, 95, 97, 98)),
f AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.page_id = a.page_id AND b.amount = a.amount AND starts_with(b.selector_path, a.selector_path || '>'))),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, idx, nth) AS place FROM f)
SELECT page_id, idx, 'pricing.charm' AS pattern_id, round(least(1.0::DOUBLE, 0.6::DOUBLE + CASE WHEN cents_child THEN 0.25 ELSE 0 END + CASE WHEN area > 400 THEN 0.2 ELSE 0 END), 6) AS raw_score FROM o WHERE place = 1
"""


def dt3_split(spark: SparkSession, d: str) -> DataFrame:
    """Stock claims of nodes alone and of containers together."""
    return _tidy(detectors.scarcity(frame(spark, d, "b_split")))


SPLIT = """
alone AS (SELECT page_id, idx, selector_path FROM b_split WHERE text = 'low stock'),
-- which node says part of which container's claim
part(container_text, text, score) AS (VALUES ('only 3 left at this price', '3', 0.85), ('only 3 left at this price', 'only', 0.85), ('only 3 left at this price', 'left at', 0.85), ('low stock, order soon', 'stock, order', 0.75)),
l AS (
  SELECT b.page_id, b.idx, b.container_path, score FROM b_split b JOIN part USING (container_text, text) WHERE container_path IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM alone a WHERE a.page_id = b.page_id AND (a.selector_path = b.container_path OR starts_with(a.selector_path, b.container_path || '>') OR starts_with(b.container_path, a.selector_path || '>')))
),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS nth FROM l),
r AS (
  SELECT page_id, 0::BIGINT AS nth, 0::BIGINT AS idx, 0.0::DOUBLE AS score, []::VARCHAR[] AS taken, false AS claims FROM (SELECT DISTINCT page_id FROM o)
  UNION ALL
  SELECT o.page_id, o.nth, o.idx, o.score, CASE WHEN x.met THEN r.taken ELSE list_append(r.taken, o.container_path) END, NOT x.met
  FROM r JOIN o ON o.page_id = r.page_id AND o.nth = r.nth + 1, LATERAL (SELECT len([t FOR t IN r.taken IF t = o.container_path OR starts_with(t, o.container_path || '>') OR starts_with(o.container_path, t || '>')]) > 0 AS met) x
)
SELECT page_id, idx, 'scarcity.stock' AS pattern_id, score::DOUBLE AS raw_score FROM r WHERE claims UNION ALL SELECT page_id, idx, 'scarcity.stock', 0.75 FROM alone
"""


def dt10_decoy(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(detectors.decoy(frame(spark, d, "b_options")))


DECOY = """
g AS (SELECT page_id, container_path FROM b_options GROUP BY ALL HAVING count(*) BETWEEN 2 AND 6),
o AS (SELECT page_id, container_path, idx, minor AS price, quantity, badge, minor::DOUBLE / quantity AS unit FROM b_options JOIN g USING (page_id, container_path) WHERE counted AND single AND minor BETWEEN 1 AND 100000000),
t AS (SELECT page_id, container_path, count(*) AS n, min(unit) AS best, max(unit) AS worst, min(idx) FILTER (WHERE badge) AS badged, arg_min(idx, unit * 1000000 + idx) AS cheapest FROM o GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT t.page_id, t.container_path FROM t JOIN o ON o.page_id = t.page_id AND o.container_path = t.container_path AND o.idx = t.badged WHERE unit > best * 1.02),
x AS (SELECT DISTINCT a.page_id, a.container_path FROM o a JOIN o c USING (page_id, container_path) WHERE a.price >= c.price AND a.quantity <= c.quantity AND (a.price > c.price OR a.quantity < c.quantity))
SELECT t.page_id, coalesce(badged, cheapest) AS idx, 'decoy.asymmetric_dominance' AS pattern_id,
  round(least(1.0::DOUBLE, CASE WHEN b.page_id IS NOT NULL THEN 0.65 ELSE 0 END + CASE WHEN x.page_id IS NOT NULL THEN 0.55 ELSE 0 END + CASE WHEN n >= 3 THEN 0.15 ELSE 0 END + CASE WHEN worst / best > 1.25 THEN 0.15 ELSE 0 END), 6) AS raw_score
FROM t LEFT JOIN b USING (page_id, container_path) LEFT JOIN x USING (page_id, container_path) WHERE b.page_id IS NOT NULL OR x.page_id IS NOT NULL
"""


def dt11_nagging(spark: SparkSession, d: str) -> DataFrame:
    pages = frame(spark, d, "b_detections").groupBy(F.col("user_id").alias("page_id"), F.col("k").alias("visit")).agg(F.array_sort(F.collect_list((F.col("ts_ms") / 60_000.0).cast("double"))).alias("modals")).withColumn("stage", F.lit("pdp"))
    found = detectors.nagging(pages.withColumn("page_id", F.col("page_id") * 1000 + F.col("visit")))
    return _tidy(found)


NAGGING = """
m AS (SELECT user_id * 1000 + k AS page_id, ts_ms / 60000.0::DOUBLE AS t FROM b_detections),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY page_id ORDER BY t) AS gap FROM m)
SELECT page_id, -1 AS idx, 'nagging.repeat_interstitial' AS pattern_id, round(least(1.0::DOUBLE, 0.5 + CASE WHEN count(*) >= 3 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(min(gap) < 10000, false) THEN 0.25 ELSE 0 END), 6) AS raw_score FROM g GROUP BY page_id HAVING count(*) >= 2
"""



def dt9_interference(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(detectors.interference(frame(spark, d, "b_controls")))


INTERFERENCE = """
c AS (SELECT page_id, idx, raw_text, weight, greatest(area, 1.0) AS area, CASE color WHEN 'rgb(0, 0, 0)' THEN 21.0 WHEN 'rgb(118, 118, 118)' THEN 4.54 ELSE 1.61 END AS contrast FROM b_controls),
g AS (SELECT page_id, count(*) AS n FROM c GROUP BY page_id HAVING count(*) BETWEEN 2 AND 6),
a AS (SELECT * FROM c WHERE raw_text IN ('accept all', 'yes, sign me up') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area DESC, idx) = 1),
d AS (SELECT * FROM c WHERE raw_text IN ('no thanks', 'not now') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area, idx) = 1)
SELECT a.page_id, a.idx, 'interference.visual_asymmetry' AS pattern_id, round(least(1.0::DOUBLE, CASE WHEN a.contrast / d.contrast > 3 THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN a.area / d.area > 2 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN a.weight - d.weight >= 200 THEN 0.15::DOUBLE ELSE 0 END + 0.2::DOUBLE), 6) AS raw_score
FROM g JOIN a USING (page_id) JOIN d USING (page_id) WHERE a.contrast / d.contrast > 3 OR a.area / d.area > 2 OR a.weight - d.weight >= 200
"""


def dt13_exit_intent(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "b_controls")
    return _tidy(detectors.exit_intent(c.withColumn("text", F.col("exit_text")), c.select("page_id").distinct().select("page_id", F.lit("body>div1").alias("modal_path"))))


EXIT = """
h AS (SELECT *, exit_text IN ('wait, before you go', 'hold on for free shipping') AS leaving, exit_text IN ('take 10% off today', 'hold on for free shipping') AS offer FROM b_controls WHERE starts_with(selector_path, 'body>div1>') AND exit_text <> 'join the waitlist' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY idx) = 1)
SELECT page_id, idx, 'loss_aversion.exit_intent' AS pattern_id, round(least(1.0::DOUBLE, 0.6::DOUBLE + CASE WHEN leaving THEN 0.3 ELSE 0 END + CASE WHEN offer THEN 0.2 ELSE 0 END), 6) AS raw_score FROM h
"""


def dt12_framing(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(detectors.framing(frame(spark, d, "b_framing")))


FRAMING = """
s AS (SELECT *, (a - b) / 100.0::DOUBLE AS saved, (a - b)::DOUBLE / a * 100 AS share, bool_or(struck) OVER (PARTITION BY page_id) AS marked FROM b_framing),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS nth FROM s WHERE (kind IN (0, 4) AND share > saved * 2) OR (kind = 2 AND saved > share * 2))
SELECT page_id, idx, 'framing.savings_ratio' AS pattern_id, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.25 + CASE WHEN greatest(share, saved) / greatest(1.0, least(share, saved)) > 4 THEN 0.2 ELSE 0 END + CASE WHEN named OR marked THEN 0.15 ELSE 0 END), 6) AS raw_score FROM f WHERE nth = 1
"""


def dt5_preselected(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(detectors.preselected(frame(spark, d, "b_inputs")))


PRESELECTED = """
p AS (SELECT *, CASE WHEN k % 5 = 1 THEN 0 WHEN k % 5 > 2 THEN dollars WHEN k % 6 <> 0 THEN dollars END AS price FROM b_inputs),
r AS (SELECT *, min(price) OVER g AS low, count(*) OVER g AS n FROM p WINDOW g AS (PARTITION BY page_id, input_type)),
k AS (SELECT *, input_type = 'radio' AND group_name <> '' AND n >= 2 AND coalesce(price > low, false) AS dear FROM r WHERE checked AND NOT touched AND words IN ('protection plan', 'leave a tip', 'express shipping'))
SELECT page_id, idx, 'defaults.preselected' AS pattern_id,
  round(least(1.0::DOUBLE, CASE WHEN input_type = 'checkbox' THEN 0.6 ELSE 0.5 END + CASE WHEN k % 12 = 0 THEN 0 ELSE 0.25 END + CASE WHEN stage IN ('checkout', 'payment') THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS raw_score FROM k WHERE input_type = 'checkbox' OR dear
"""

QUERIES = {
    "dt5_preselected": dt5_preselected,
    "dt9_interference": dt9_interference,
    "dt12_framing": dt12_framing,
    "dt13_exit_intent": dt13_exit_intent,
    "dt3_scarcity": lambda s, d: _tidy(detectors.scarcity(_copy(s, d))),
    "dt4_urgency": lambda s, d: _tidy(detectors.urgency(_copy(s, d))),
    "dt6_social_proof": lambda s, d: _tidy(detectors.social_proof(_copy(s, d))),
    "dt7_confirmshaming": lambda s, d: _tidy(detectors.confirmshaming(_copy(s, d))),
    "dt8_goal_gradient": lambda s, d: _tidy(detectors.goal_gradient(_copy(s, d))),
    "dt3_scarcity_split": dt3_split,
    "fn1_parse_prices": fn1_prices,
    "dt1_anchoring": dt1_anchoring,
    "dt2_charm": dt2_charm,
    "dt10_decoy": dt10_decoy,
    "dt11_nagging": dt11_nagging,
}
ORACLE_SQL = {
    "dt5_preselected": oracle("WITH " + PRESELECTED, "b_inputs"),
    "dt9_interference": oracle("WITH " + INTERFERENCE, "b_controls"),
    "dt12_framing": oracle("WITH " + FRAMING, "b_framing"),
    "dt13_exit_intent": oracle("WITH " + EXIT, "b_controls"),
    "dt3_scarcity": STOCK,
    "dt4_urgency": URGENT,
    "dt6_social_proof": SOCIAL,
    "dt7_confirmshaming": SHAME,
    "dt8_goal_gradient": GOAL,
    "dt3_scarcity_split": oracle("WITH " + SPLIT, "b_split").replace("WITH ", "WITH RECURSIVE ", 1),
    "fn1_parse_prices": oracle(FN1, "b_price_copy"),
    "dt1_anchoring": oracle("WITH " + ANCHORING, "b_nodes"),
    "dt2_charm": oracle("WITH " + CHARM, "b_charm"),
    "dt10_decoy": oracle("WITH " + DECOY, "b_options"),
    "dt11_nagging": oracle("WITH " + NAGGING, "b_detections"),
}
