"""URL filters: short allow/block rules first, then logistic regression on hashed character n-grams.

The classifier learns from a small labelled URL table (url, label; label 1 to block; ``url_labels`` has the one of the
registered query), which the rules have no part in: n-grams of host and path are
hashed to ``2**HASH_BITS`` slots and weighed by logistic regression, with Spark's own feature hashing and solver.
DataFrame and JVM functions only; scoring is a projection over the scanned url column, without a shuffle.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by the
classifier like any other; host letters A-Z are lower-cased, the path is kept as it is; a url of any length is judged
whole; repeated rows are judged alike; with an empty labelled table every url that no rule decides is allowed.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm import common

HASH_BITS = 14
GRAMS = (3, 4, 5)
#: (verdict, host, path): the policy of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does. For a policy list of up to some hundred rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(host: Column, path: Column) -> Column:
    """All character n-grams, in time linear in the text: it is cut into characters once, and each n-gram is a shorter one and a character more."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))

    def grams(chars: Column) -> Column:
        out, last = [], chars
        for n in range(2, max(GRAMS) + 1):
            last = F.zip_with(last, F.slice(chars, F.lit(n), F.size(chars)), lambda a, b: F.concat(a, b))
            if n in GRAMS:
                out.append(F.array_compact(last))
        return F.concat(*out)

    # the characters are bound once
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))), grams), 1)


def _vectors(urls: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=1 << HASH_BITS, binary=True, inputCol="_grams", outputCol="_vector").transform(urls.withColumn("_grams", _grams(F.col("host"), F.col("path"))))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_column: str = "page_id") -> DataFrame:
    """id, url, host, path, rule, verdict and p_block of every row."""
    parts = pages.select(id_column, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = common.materialize(_vectors(labelled.select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))).select("label", "_vector"))
    kinds = {r["label"] for r in known.select("label").distinct().collect()}  # 0.0, 1.0
    if len(kinds) == 2:
        model = LogisticRegression(featuresCol="_vector", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_side", maxIter=40, regParam=1e-3).fit(known)
        judged = model.transform(_vectors(parts)).withColumn("p_block", vector_to_array("_p")[1])
    else:
        judged = parts.withColumn("p_block", F.lit(1.0 if kinds == {1.0} else 0.0))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("_fit", fit).select(
        id_column, "url", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block"
    )


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_column: str = "page_id") -> DataFrame:
    """id, host, path, rule and the rule's verdict (null where no rule fits) of every row."""
    parts = pages.select(id_column, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    return parts.select(id_column, "host", "path", fit["rule"].alias("rule"), fit["verdict"].alias("verdict"))


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH r(verdict, host, path) AS (VALUES {_RULES_SQL}
), u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.page_id, p.host, p.path
"""
