"""Queries: scalar functions over URLs and texts, corpus tooling, evaluation, page classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.functions import color, money, text, url
from suasion.operators import corpus, pages
from suasion.operators.dims import STAGES
from suasion.plans.bridge import frame, oracle
from suasion.sources.tables import table

SPACES = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def fn10_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    host = F.regexp_extract(u, r"^https?://(?:[^@/?#]*@)?([^:/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", url.origin_of(u).alias("origin"), url.path_template(u).alias("path_template"), url.registrable_domain(host).alias("site"))


URLS = r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://(?:[^@/?#]*@)?([^:/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '')[1:6] AS segs, string_split(host, '.') AS labels FROM u)
SELECT page_id, nullif(regexp_extract(url, '^(https?)://', 1) || '://' || host, '://') AS origin,
       '/' || array_to_string(list_transform(segs, lambda x: CASE WHEN regexp_full_match(x, '\d+') THEN ':id' WHEN regexp_matches(x, '\d{4,}') OR length(x) > 24 THEN ':slug' ELSE lower(x) END), '/') AS path_template,
       array_to_string(labels[-2:], '.') AS site
FROM s
"""


def fn4_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalize_text(t), 256).alias("normalized"), F.length(text.normalize_text(t)).alias("n"))


def fn30_scrub(spark: SparkSession, d: str) -> DataFrame:
    clean = F.col("clean")  # worked out once
    return table(spark, d, "documents").withColumn("clean", corpus.scrub(F.col("text"))).select("doc_id", F.sha2(clean, 256).alias("scrubbed"), (clean != F.col("text")).alias("changed"))


def _scrub_sql() -> str:
    out = "text"
    for pattern, mask in corpus.SCRUB:
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return f"SELECT doc_id, sha256({out}) AS scrubbed, {out} <> text AS changed FROM documents"


def fn34_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.lines(table(spark, d, "documents").select("doc_id", "source", "text"))
    return corpus.dedup_lines_by_key(rows, ["doc_id", "line_no"]).select("doc_id", "line_no", F.sha2("line", 256).alias("line_hash"))


LINES = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS line_no FROM l)
SELECT doc_id, line_no, sha256(line) AS line_hash FROM e WHERE trim(line) <> ''
QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '%s', ' ', 'g')) ORDER BY doc_id, line_no) = 1
""" % SPACES


def pf12_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.lines(table(spark, d, "documents").select("doc_id", "text"))
    line = F.col("line")
    kinds = rows.select(corpus.looks_like_a_message(line).alias("message"), corpus.plausible(line).alias("plausible"), line.rlike(corpus.DATE_LIKE).alias("dated"))
    return kinds.groupBy("message", "plausible", "dated").agg(F.count("*").alias("n"))


MESSAGES = r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), e AS (SELECT line, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS w FROM l WHERE trim(line) <> '')
SELECT NOT regexp_matches(line, '{alt}') AND NOT (regexp_matches(line, '^[A-Z][a-z]+:\s') AND length(line) < 32) AND len(w) >= 3 AND NOT (len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]')))::DOUBLE / greatest(len(w), 1) > 0.6 AND NOT regexp_matches(line, '{st}')) AS message,
       length(line) BETWEEN 8 AND 180 AND regexp_matches(line, '\s') AND regexp_matches(line, '{pr}') AS plausible, regexp_matches(line, '{dt}') AS dated, count(*) AS n
FROM e GROUP BY ALL
""".format(alt=corpus.SOCIAL_ALT.replace("'", "''"), st=corpus.STATEMENT, pr=corpus.PROMOTIONAL, dt=corpus.DATE_LIKE)


def wn8_cap_per_site(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "b_labels").select("site", "ord")
    return corpus.cap_per_site(rows, 12).withColumn("chunk", (F.col("ord") % 5 + 1).cast("long"))


def wn10_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "b_labels").select("ord", "site", F.when(F.col("label") == 1, "A").when(F.col("pattern_id") == "b.two", "B").otherwise("C").alias("tier"))
    return corpus.build_queue(rows, 60).select("ord", "tier")


def wn11_holdout(spark: SparkSession, d: str) -> DataFrame:
    return corpus.holdout_by_site(frame(spark, d, "b_labels").select("ord", "site")).select("ord", "site", "held_out")


def wn12_stride(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stride_negatives(frame(spark, d, "b_labels").select("ord", "label"), per_positive=2).select("ord", "label")


STRIDE = """
n AS (SELECT count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM b_labels),
w AS (SELECT greatest(pos * 2, 40) AS want, neg FROM n),
pick AS (SELECT floor(k * (neg::DOUBLE / want))::BIGINT AS pos FROM w, unnest(range((SELECT want FROM w))) t(k)),
r AS (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY ord) - 1 AS nth FROM b_labels)
SELECT ord, label FROM r WHERE label = 1 OR (SELECT want >= neg FROM w) OR nth IN (SELECT pos FROM pick)
"""


def so7_labels(spark: SparkSession, d: str) -> DataFrame:
    return corpus.resolve_labels(frame(spark, d, "b_label_log")).select("pattern_id", "key", "label", "seq")


def so8_fan_out(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.fan_out(frame(spark, d, "b_label_log").filter("label = 0"))
    return rows.groupBy("pattern_id", "label").agg(F.count("*").alias("n"))


def jn18_human_over_auto(spark: SparkSession, d: str) -> DataFrame:
    """Two logs over the same keys: every third entry is a person's, all others are automatic; each is resolved by itself."""
    log = frame(spark, d, "b_label_log")
    human, auto = (corpus.resolve_labels(log.filter(own)).select("pattern_id", "key", "label", "seq") for own in ("seq % 3 = 0", "seq % 3 <> 0"))
    return corpus.human_over_auto(human, auto.withColumn("label", F.lit(1).cast("long")))


def ag15_confusion(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.confusion(frame(spark, d, "b_labels"), 0.5, ("pattern_id",))
    return c.select("pattern_id", "tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in ("accuracy", "precision", "recall", "f1")))


CONFUSION = """
c AS (SELECT pattern_id, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM b_labels GROUP BY ALL),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS re FROM c)
SELECT pattern_id, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1 FROM p
"""


def wn13_threshold(spark: SparkSession, d: str) -> DataFrame:
    return corpus.best_threshold(frame(spark, d, "b_labels")).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


SWEEP = """
t AS (SELECT unnest([{}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM b_labels, t GROUP BY ALL)
SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1
""".format(", ".join(f"{t!r}::DOUBLE" for t in corpus.thresholds()))


def jn17_titles(spark: SparkSession, d: str) -> DataFrame:
    """All titles that are alike: pairs meet on a shared rare trigram, then are measured."""
    titles = frame(spark, d, "b_titles").withColumn("name", text.normalize_title(F.col("title"))).select("p_partkey", "name")
    return corpus.similar_titles(titles, "p_partkey", (), 0.85)


TITLES = r"""
n AS (SELECT p_partkey, trim(regexp_replace(string_split_regex(lower(title), '\s[|\-–—]\s')[1], '[^a-z0-9]+', ' ', 'g')) AS name FROM b_titles),
g AS (SELECT *, list_distinct(list_transform(range(1, length('  ' || name || ' ') - 1), lambda i: substr('  ' || name || ' ', i, 3))) AS t FROM n),
p AS (SELECT a.p_partkey, b.p_partkey AS other, len(list_intersect(a.t, b.t)) AS x, len(a.t) + len(b.t) AS s FROM g a JOIN g b ON a.p_partkey < b.p_partkey AND len(a.t) BETWEEN 0.8 * len(b.t) AND len(b.t) / 0.8)
SELECT p_partkey, other, round(x::DOUBLE / (s - x), 9) AS similarity FROM p WHERE round(x::DOUBLE / (s - x), 9) >= 0.85
"""


def fn23_fnv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("hash"), text.fnv1a(F.substring("p_type", 1, 3)).alias("short_hash"))


FNV = "SELECT p_partkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS hash, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, 4), lambda i: ascii(substr(p_type, i, 1))::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS short_hash FROM part"


def fn32_luhn(spark: SparkSession, d: str) -> DataFrame:
    digits = F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    return table(spark, d, "orders").select("o_orderkey", text.luhn_valid(digits).alias("valid"))


LUHN = """
WITH d AS (SELECT o_orderkey, '4' || lpad(o_orderkey::VARCHAR, 8, '0') || lpad(o_custkey::VARCHAR, 7, '0') AS s FROM orders)
SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * substr(s, i, 1)::INT > 9 THEN 2 * substr(s, i, 1)::INT - 9 ELSE 2 * substr(s, i, 1)::INT END ELSE substr(s, i, 1)::INT END)) % 10 = 0 AS valid FROM d
"""


def fn21_contrast(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    fg = F.format_string("rgb(%d, %d, %d)", p % 256, p * 7 % 256, p * 13 % 256)
    bg = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(p * 37 % 256), 2, "0")), F.lower(F.lpad(F.hex(p * 11 % 256), 2, "0")), F.lower(F.lpad(F.hex(p * 5 % 256), 2, "0")))
    return table(spark, d, "part").select("p_partkey", F.round(color.contrast_ratio(fg, bg), 6).alias("contrast"))


def _lum(*channels: str) -> str:
    one = "CASE WHEN ({0}) / 255.0::DOUBLE <= 0.03928 THEN ({0}) / 255.0::DOUBLE / 12.92 ELSE pow((({0}) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
    return " + ".join(f"{w}::DOUBLE * {one.format(c)}" for w, c in zip((0.2126, 0.7152, 0.0722), channels, strict=True))


CONTRAST = f"WITH l AS (SELECT p_partkey, {_lum('p_partkey % 256', 'p_partkey * 7 % 256', 'p_partkey * 13 % 256')} AS a, {_lum('p_partkey * 37 % 256', 'p_partkey * 11 % 256', 'p_partkey * 5 % 256')} AS b FROM part) SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS contrast FROM l"


def fn3_format(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, d, "orders").select("o_orderkey", money.format_minor(cents, F.lit("USD")).alias("usd"), money.format_minor(cents, F.lit("JPY")).alias("jpy"))


def fn17_kinds(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "b_fees")
    return f.groupBy("label", text.line_item_kind(F.col("label")).alias("kind"), F.array_join(text.addon_keys(F.col("label")), ",").alias("addons")).agg(F.count("*").alias("n"))


def cl2_stage(spark: SparkSession, d: str) -> DataFrame:
    return pages.funnel_stage(frame(spark, d, "b_meta")).select("page_id", "stage", F.round("stage_score", 4).alias("stage_score"))


_EDIT = "(cart_rows >= 1 AND has_remove)"
_W = lambda *t: "round(" + " + ".join(f"CASE WHEN {on} THEN {w} ELSE 0 END" for on, w in t) + ", 6)::DOUBLE"
_SCORES = {
    "browse": _W(("true", 0.15), ("add_to_cart >= 4", 0.35), (_EDIT, -0.3), ("has_cc_field", -0.4), ("path = '/collections/all'", 0.2)),
    "pdp": _W(("has_product_ld", 0.4), ("og_product", 0.35), ("add_to_cart = 1", 0.4), (_EDIT, -0.5), ("has_cc_field", -0.4), ("path IN ('/products/x', '/p/9')", 0.2)),
    "cart": _W(("cart_rows >= 1", "least(0.6, 0.35 + 0.12 * cart_rows)"), ("has_quantity AND has_remove", 0.35), ("summary_rows >= 2", 0.3), ("has_total", 0.2), ("checkout_cta > 0 AND add_to_cart = 0", 0.25), ("path = '/cart'", 0.2)),
    "checkout": _W(("has_address", 0.5), ("has_contact AND (summary_rows >= 1 OR has_total)", 0.45), ("has_postal", 0.2), ("has_steps", 0.4), ("place_order > 0", 0.25), ("summary_rows >= 2", 0.2), ("path = '/checkout/step'", 0.2)),
    "payment": _W(("has_cc_field", 0.9), ("place_order > 0", 0.35), ("path = '/payment'", 0.2)),
}
STAGE_SQL = "s AS (SELECT page_id, [" + ", ".join(_SCORES[s] for s in STAGES) + "] AS v FROM b_meta) SELECT page_id, ['browse', 'pdp', 'cart', 'checkout', 'payment'][list_position(v, list_max(v))] AS stage, round(list_max(v), 4) AS stage_score FROM s"


def cl1_commerce(spark: SparkSession, d: str) -> DataFrame:
    return pages.commerce(frame(spark, d, "b_meta")).groupBy("is_commerce", "commerce_score", "reasons").agg(F.count("*").alias("n"))


_GATE = (
    ("has_product_ld", 1, "product"), ("og_product", 1, "og_product"), ("cart_rows > 0 AND (has_quantity OR has_remove)", 1, "cart_rows"), ("has_total AND summary_rows >= 2", 1, "total"), ("place_order > 0", 1, "place_order"), ("has_steps AND checkout_cta > 0", 1, "steps"), ("per_unit_rows > 0", 1, "per_unit"),
    ("priced_texts >= 20", 1, "many_prices"), ("priced_texts >= 8 AND priced_texts < 20", 0.5, "some_prices"), ("booking_cta > 0 AND (summary_rows > 0 OR priced_texts >= 4)", 1, "booking"), ("add_to_cart > 0", 0.5, "add_to_cart"), ("checkout_cta > 0", 0.5, "checkout"), ("summary_rows > 0", 0.5, "summary"),
)
COMMERCE = "g AS (SELECT (" + " + ".join(f"CASE WHEN {on} THEN {w} ELSE 0 END" for on, w, _ in _GATE) + ")::DOUBLE AS commerce_score, concat_ws(',', " + ", ".join(f"CASE WHEN {on} THEN '{why}' END" for on, _, why in _GATE) + ") AS reasons FROM b_meta) SELECT commerce_score >= 1 AS is_commerce, commerce_score, reasons, count(*) AS n FROM g GROUP BY ALL"


def cl6_prominence(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "b_options").select("page_id", "idx", (F.col("quantity") % 7 + 10).alias("font_px"), F.when(F.col("badge"), 700).otherwise(400).alias("weight"), F.concat(F.lit("bg"), (F.col("quantity") % 3).cast("string")).alias("background"))
    return pages.prominence(n).select("page_id", "idx", "relative_size", "prominent")


PROMINENCE = """
n AS (SELECT page_id, idx, quantity % 7 + 10 AS px, CASE WHEN badge THEN 700 ELSE 400 END AS weight, 'bg' || (quantity % 3) AS bg FROM b_options),
m AS (SELECT page_id, px AS med FROM n QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY px) = count(*) OVER (PARTITION BY page_id) // 2 + 1),
b AS (SELECT page_id, bg AS page_bg FROM (SELECT page_id, bg, count(*) AS c, min(idx) AS f FROM n GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY c DESC, f) = 1)
SELECT page_id, idx, round(px::DOUBLE / med, 2) AS relative_size, NOT (round(px::DOUBLE / med, 2) < 0.9 AND weight < 600 AND bg = page_bg) AS prominent FROM n JOIN m USING (page_id) JOIN b USING (page_id)
"""

QUERIES = {
    "fn10_urls": fn10_urls,
    "fn4_normalize_text": fn4_normalize,
    "fn30_scrub": fn30_scrub,
    "fn34_line_dedup": fn34_line_dedup,
    "pf12_messages": pf12_messages,
    "wn8_cap_per_site": wn8_cap_per_site,
    "wn10_label_queue": wn10_queue,
    "wn11_holdout_by_site": wn11_holdout,
    "wn12_stride_negatives": wn12_stride,
    "wn13_best_threshold": wn13_threshold,
    "so7_resolve_labels": so7_labels,
    "so8_fan_out": so8_fan_out,
    "jn18_human_over_auto": jn18_human_over_auto,
    "ag15_confusion": ag15_confusion,
    "jn17_title_similarity": jn17_titles,
    "fn23_fnv1a": fn23_fnv,
    "fn32_luhn": fn32_luhn,
    "fn21_contrast": fn21_contrast,
    "fn3_format_minor": fn3_format,
    "fn17_line_item_kinds": fn17_kinds,
    "cl1_commerce": cl1_commerce,
    "cl2_funnel_stage": cl2_stage,
    "cl6_prominence": cl6_prominence,
}
NORMALIZED = f"trim(regexp_replace(translate(lower(text), '‘’“”', '''''\"\"'), '{SPACES}', ' ', 'g'))"
ORACLE_SQL = {
    "fn10_urls": URLS,
    "fn4_normalize_text": f"SELECT doc_id, sha256({NORMALIZED}) AS normalized, length({NORMALIZED})::INTEGER AS n FROM documents",
    "fn30_scrub": _scrub_sql(),
    "fn34_line_dedup": LINES,
    "pf12_messages": MESSAGES,
    "wn8_cap_per_site": oracle("SELECT site, ord, ord % 5 + 1 AS chunk FROM b_labels QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) <= 12", "b_labels"),
    "wn10_label_queue": oracle(
        "WITH t AS (SELECT ord, CASE WHEN label = 1 THEN 'A' WHEN pattern_id = 'b.two' THEN 'B' ELSE 'C' END AS tier FROM b_labels), c AS (SELECT least(count(*) FILTER (WHERE tier = 'A'), 21) AS a, least(count(*) FILTER (WHERE tier = 'B'), 39) AS b, count(*) FILTER (WHERE tier = 'C') AS c FROM t), w AS (SELECT a, b, least(c, a + b, 60 - a - b) AS c FROM c), r AS (SELECT ord, tier, row_number() OVER (PARTITION BY tier ORDER BY ord) AS nth FROM t) SELECT ord, tier FROM r, w WHERE nth <= CASE tier WHEN 'A' THEN w.a WHEN 'B' THEN w.b ELSE w.c END", "b_labels"
    ),
    "wn11_holdout_by_site": oracle("WITH s AS (SELECT site, (row_number() OVER (ORDER BY site) - 1) % 4 = 3 AS held_out FROM (SELECT DISTINCT site FROM b_labels)) SELECT ord, b_labels.site, held_out FROM b_labels JOIN s ON s.site = b_labels.site", "b_labels"),
    "wn12_stride_negatives": oracle("WITH " + STRIDE, "b_labels"),
    "wn13_best_threshold": oracle("WITH " + SWEEP, "b_labels"),
    "so7_resolve_labels": oracle("SELECT pattern_id, key, label, seq FROM (SELECT * FROM b_label_log QUALIFY row_number() OVER (PARTITION BY pattern_id, key ORDER BY seq DESC) = 1) WHERE NOT undo", "b_label_log"),
    "so8_fan_out": oracle("WITH f AS (SELECT pattern_id, label::INTEGER AS label FROM b_label_log WHERE label = 0 UNION ALL SELECT also_pattern, 1 FROM b_label_log WHERE label = 0 AND also_pattern <> 'other') SELECT pattern_id, label::BIGINT AS label, count(*) AS n FROM f GROUP BY ALL", "b_label_log"),
    "jn18_human_over_auto": oracle(
        "WITH r AS (SELECT pattern_id, key, label, seq, seq % 3 = 0 AS person FROM (SELECT * FROM b_label_log QUALIFY row_number() OVER (PARTITION BY pattern_id, key, seq % 3 = 0 ORDER BY seq DESC) = 1) WHERE NOT undo), h AS (SELECT * FROM r WHERE person) SELECT pattern_id, key, label, seq FROM h UNION ALL SELECT pattern_id, key, 1::BIGINT, seq FROM r WHERE NOT person AND NOT EXISTS (SELECT 1 FROM h WHERE h.pattern_id = r.pattern_id AND h.key = r.key)", "b_label_log"
    ),
    "ag15_confusion": oracle("WITH " + CONFUSION, "b_labels"),
    "jn17_title_similarity": oracle("WITH " + TITLES, "b_titles"),
    "fn23_fnv1a": FNV,
    "fn32_luhn": LUHN,
    "fn21_contrast": CONTRAST,
    "fn3_format_minor": "SELECT o_orderkey, (round(o_totalprice * 100)::BIGINT // 100)::VARCHAR || '.' || lpad((round(o_totalprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS usd, round(o_totalprice * 100)::BIGINT::VARCHAR AS jpy FROM orders",
    "fn17_line_item_kinds": oracle(
        "SELECT label, CASE label WHEN 'Estimated tax' THEN 'tax' WHEN 'Promo discount' THEN 'discount' WHEN 'Service fee' THEN 'mandatory_fee' WHEN 'Resort fee' THEN 'mandatory_fee' WHEN 'Gift wrap' THEN 'optional_addon' WHEN 'Accident Protection Plan' THEN 'optional_addon' ELSE 'unknown' END AS kind, CASE label WHEN 'Gift wrap' THEN 'gift_wrap' WHEN 'Accident Protection Plan' THEN 'protection' ELSE '' END AS addons, count(*) AS n FROM b_fees GROUP BY ALL", "b_fees"
    ),
    "cl1_commerce": oracle("WITH " + COMMERCE, "b_meta"),
    "cl2_funnel_stage": oracle("WITH " + STAGE_SQL, "b_meta"),
    "cl6_prominence": oracle("WITH " + PROMINENCE, "b_options"),
}
