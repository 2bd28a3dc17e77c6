"""The registered queries of the language-model operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.llm import common, conversation_repair, decontaminate, hard_negatives, license_scan, line_dedup, mixing, ngram_join, quality, secret_scan, sharding, topk, toxicity, url_filter, url_labels
from suasion.sources.tables import table


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, (90, 100)).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = {k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)") for k in ("assign", "access", "hex")}
    base = F.filter("spans", lambda s: s["kind"] != "net")
    return found.select("doc_id", *(v.alias(f"n_{k}") for k, v in kinds.items()), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_labels.labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated, _, fit = mixing.soft_rates(docs, mixing.language_labels(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)
    told = [F.lit(x).alias(f"{kind}_{name}") for kind, totals in (("wanted", fit.wanted), ("reached", fit.reached)) for name, x in mixing.shares(totals, list(mixing.TARGETS)).items()]
    return rated.select("doc_id", "tokens", *(F.col("posterior")[j].alias(f"p_{name}") for j, name in enumerate(mixing.TARGETS)), "rate", "copies", *told, F.lit(fit.met).alias("met"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return _licenses(found).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "freedom", "expressions")


def _licenses(found: DataFrame) -> DataFrame:
    base = F.filter("findings", lambda f: f["base"])
    word = F.transform("base", lambda f: f["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    named = F.concat(F.transform("findings", lambda f: f["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    out = found.withColumn("base", base)
    return out.select("*", F.size("base").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"), joined(F.transform("base", lambda f: f["label"])).alias("base_labels"), joined(named).alias("labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"), conversation_repair.damage)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", hard_negatives.shifted().alias("label"), "embedding"), "vec_id % 50 = 0")


def llm11_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op11: words and base phrases."""
    return op11_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def llm4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: size, shard and slot."""
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "shard", "slot")


def llm5_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: the base findings by kind."""
    kinds = ("assign", "access", "hex")
    found = secret_scan.base_findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in kinds))


def llm9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: host, path and the rules."""
    return url_filter.ruled(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_topk": op3_topk,
    "op4_sharding": op4_sharding,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
    "op11_license_scan": op11_license_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
    "llm4_shards": llm4_shards,
    "llm5_base_counts": llm5_base_counts,
    "llm9_rules": llm9_rules,
    "llm11_base": llm11_base,
}
ORACLE_SQL: dict[str, str] = {"op3_topk": topk.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE, "llm11_base": license_scan.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "llm4_shards": sharding.ORACLE, "llm5_base_counts": secret_scan.ORACLE, "llm9_rules": url_filter.ORACLE}
