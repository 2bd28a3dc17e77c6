"""Queries: what is written and read back, candidate pools, tiers and rule packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.functions import rules
from suasion.functions.url import registrable_domain
from suasion.operators import corpus, digest
from suasion.plans.bridge import TABLES, frame, oracle
from suasion.sources import batches
from suasion.sources.tables import table
from suasion.streaming.run import new_folder


def sc5_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A log appended to twice, and its last line cut off."""
    path, rows = new_folder(spark, "log"), frame(spark, d, "b_corpus").select("doc_id", "site", F.length("text").alias("n"))
    batches.append_jsonl(rows.filter("n < 500"), path)
    batches.append_jsonl(rows.filter("n >= 500"), path)
    spark.range(1).select(F.lit('{"doc_id": 7, "si').alias("value")).write.mode("append").text(path)
    return batches.read_jsonl(spark, path, "doc_id long, site string, n int")


def sc7_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "chunks")
    batches.export_chunks(frame(spark, d, "b_labels").select("ord", "site"), path, 7)
    return spark.read.json(path).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("ord").alias("total")).select(F.col("chunk").cast("long").alias("chunk"), "n", "total")


def sc8_view_export(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "view")
    view = frame(spark, d, "b_detections").groupBy("origin", "pattern_id").agg(F.count("*").alias("n"))
    batches.export_view({"site_prevalence": view}, "site_prevalence", path)
    return spark.read.schema("origin string, pattern_id string, n long").json(path)


def sc9_events(spark: SparkSession, d: str) -> DataFrame:
    """Nested events as flat rows; what an event lacks is null."""
    nested = frame(spark, d, "b_detections").select("event_id", "detector_id", "pattern_id", "funnel_stage", "origin", "ts_ms", "confidence", F.struct(F.concat(F.lit("t"), F.col("k")).alias("text_hash")).alias("evidence"), F.struct("visible_ms", "ephemeral").alias("salience"))
    flat = batches.export_events(nested)
    return flat.select("detector_id", "pattern_id", "funnel_stage", "origin", "ts_ms", F.round("confidence", 9).alias("confidence"), "evidence_text_hash", "salience_visible_ms", "salience_ephemeral", F.coalesce("evidence_selector_path", "path_template", F.lit("none")).alias("absent"))


def sc11_packs(spark: SparkSession, d: str) -> DataFrame:
    """A denylist that is read from its JSON file, over the page table."""
    path = new_folder(spark, "pack")
    pack = F.struct(F.array(F.lit("ftp")).alias("schemes"), F.array(F.lit(".example.net")).alias("hostSuffixes"), F.array(F.lit("^casino|^www\\.cheap-")).alias("hostPatterns"))
    spark.range(1).select(pack.alias("p")).select("p.*").coalesce(1).write.json(path)
    return table(spark, d, "pages").select("page_id", rules.denied(F.col("url"), **batches.read_pack(spark, path)).alias("denied"))


SUFFIXES = ("// made for the check", "co.uk", "ck", "*.ck", "!www.ck", "com", "myshopify.com  // private")


def fn12_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Registrable domains under rules that are read from a file: plain, wildcard, exception, private, none, and addresses."""
    path = new_folder(spark, "suffixes")
    spark.createDataFrame([(r,) for r in SUFFIXES], "rule string").coalesce(1).write.text(path)
    k = F.col("p_partkey")
    kinds = (("x.shop", ".co.uk"), ("a.b.city", ".ck"), ("www.ck", None), ("10.0.0.", ""), ("admin.shop", ".myshopify.com"), ("deep.er.name", ".unknown"))
    host = F.coalesce(*(F.when(k % 6 == i, F.lit(head) if tail is None else F.concat(F.lit(head), (k % 250).cast("string"), F.lit(tail))) for i, (head, tail) in enumerate(kinds)))
    return table(spark, d, "part").select("p_partkey", registrable_domain(host, batches.read_suffix_rules(spark, path)).alias("site"))


def pf15_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A table of match patterns (one for each part, and some for the hosts there are) against every page's url."""
    pages = table(spark, d, "pages").select("page_id", "url")
    k = F.col("p_partkey")
    made = table(spark, d, "part").select(F.concat(F.when(k % 3 == 0, "https://").when(k % 3 == 1, "*://").otherwise("http://"), F.when(k % 2 == 0, "*.").otherwise(""), F.element_at(F.split(F.lit("example.com www.example.com example.org net shop.example.net * nowhere.test"), " "), (k % 7 + 1).cast("int")), F.lit("/*")).alias("pattern"))
    return rules.matched_patterns(pages, made.distinct())


def so1_pools(spark: SparkSession, d: str) -> DataFrame:
    page = frame(spark, d, "b_detections").select("user_id", "pattern_id", "visible_ms", "ephemeral", "prominent")
    drip = frame(spark, d, "b_fees").select(F.col("session_id").alias("user_id"), F.lit("pricing.drip").alias("pattern_id"), F.lit("drip").alias("pool"))
    sneak = frame(spark, d, "b_adds").select(F.col("session_id").alias("user_id"), F.lit("basket.sneak").alias("pattern_id"), F.lit("sneak").alias("pool"))
    return digest.union_pools(page, drip, sneak).groupBy("pool", "pattern_id", "ephemeral", "prominent").agg(F.count("*").alias("n"), F.sum("visible_ms").cast("long").alias("visible_ms"), F.sum(F.col("user_id") % 1009).cast("long").alias("checksum"))


TABLES["b_tiers"] = """
    select doc_id, k, case k % 5 when 0 then 'Only ' || cast(k % 9 as {STR}) || ' left, order now' when 1 then 'Save more on every order today' when 2 then 'Mon, Jan 5 only 3 left' when 3 then 'Size: M' else 'Take a look at these 20 new shoes' end as text
    from (select doc_id, doc_id % 1000 as k from {documents}) x"""


def wn10_tiers(spark: SparkSession, d: str) -> DataFrame:
    tier = corpus.tier(F.col("text"), r"(?i)\bonly \d+ left\b", r"(?i)\bsave\b")
    return frame(spark, d, "b_tiers").select("doc_id", F.coalesce(tier, F.lit("none")).alias("tier"))


QUERIES = {"sc5_jsonl": sc5_jsonl, "sc7_chunks": sc7_chunks, "sc8_view_export": sc8_view_export, "sc9_events": sc9_events, "sc11_packs": sc11_packs, "fn12_suffix_rules": fn12_suffixes, "pf15_pattern_table": pf15_patterns, "so1_pools": so1_pools, "wn10_tiers": wn10_tiers}
ORACLE_SQL = {
    "fn12_suffix_rules": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'shop' || p_partkey % 250 || '.co.uk' WHEN 1 THEN 'b.city' || p_partkey % 250 || '.ck' WHEN 2 THEN 'www.ck' WHEN 3 THEN '10.0.0.' || p_partkey % 250 WHEN 4 THEN 'shop' || p_partkey % 250 || '.myshopify.com' ELSE 'name' || p_partkey % 250 || '.unknown' END AS site FROM part",
    "pf15_pattern_table": r"""
WITH p AS (
  SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'https' WHEN 1 THEN '*' ELSE 'http' END AS scheme, p_partkey % 2 = 0 AS below, (['example.com', 'www.example.com', 'example.org', 'net', 'shop.example.net', '*', 'nowhere.test'])[p_partkey % 7 + 1] AS host FROM part
), u AS (SELECT page_id, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)', 1) AS host FROM pages)
SELECT page_id, p.scheme || '://' || CASE WHEN below THEN '*.' ELSE '' END || p.host || '/*' AS pattern FROM u JOIN p ON u.host <> '' AND (p.scheme = '*' OR p.scheme = u.scheme) AND (p.host = '*' OR u.host = p.host OR (below AND ends_with(u.host, '.' || p.host)))
""",
    "sc5_jsonl": oracle("SELECT doc_id, site, length(text)::INTEGER AS n FROM b_corpus", "b_corpus"),
    "sc7_chunks": oracle("SELECT ord % 7 + 1 AS chunk, count(*) AS n, sum(ord)::BIGINT AS total FROM b_labels GROUP BY ALL", "b_labels"),
    "sc8_view_export": oracle("SELECT origin, pattern_id, count(*) AS n FROM b_detections GROUP BY ALL", "b_detections"),
    "sc9_events": oracle("SELECT detector_id, pattern_id, funnel_stage, origin, ts_ms, round(confidence, 9) AS confidence, 't' || k AS evidence_text_hash, visible_ms AS salience_visible_ms, ephemeral AS salience_ephemeral, 'none' AS absent FROM b_detections", "b_detections"),
    "sc11_packs": r"SELECT page_id, starts_with(url, 'ftp:') OR ends_with(host, '.example.net') OR host = 'example.net' OR regexp_matches(host, '^casino|^www\.cheap-') AS denied FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://(?:[^@/?#]*@)?([^:/?#]+)', 1)) AS host FROM pages) h",
    "so1_pools": oracle(
        "SELECT pool, pattern_id, ephemeral, prominent, count(*) AS n, sum(visible_ms)::BIGINT AS visible_ms, sum(user_id % 1009)::BIGINT AS checksum FROM (SELECT 'page' AS pool, pattern_id, ephemeral, prominent, visible_ms, user_id FROM b_detections UNION ALL SELECT 'drip', 'pricing.drip', false, true, 2000, session_id FROM b_fees UNION ALL SELECT 'sneak', 'basket.sneak', false, true, 2000, session_id FROM b_adds) u GROUP BY ALL",
        "b_detections", "b_fees", "b_adds",
    ),
    "wn10_tiers": oracle("SELECT doc_id, CASE k % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 4 THEN 'C' ELSE CASE k % 5 WHEN 2 THEN 'C' ELSE 'none' END END AS tier FROM b_tiers", "b_tiers"),
}
