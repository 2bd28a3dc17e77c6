"""Batches as JSON bodies, JSON-lines corpora, rule packs and view exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.functions.url import MOST_RULES, SuffixRules

RECORD = "pattern_id string, detector_id string, funnel_stage string, site string, origin_category string, rulepack_version string, day_bucket long, quartile int"
PROTOCOLS = (2, 3)
VIEWS = ("site_prevalence", "pattern_reach", "pattern_by_stage", "site_prevalence_public", "pattern_add_rate", "site_pattern_add_rate", "site_pattern_add_rate_public")
EVENT = ("detector_id", "pattern_id", "funnel_stage", "origin", "path_template", "ts_ms", "confidence", "surfaced", "suppression_reason", "evidence.text_hash", "evidence.selector_path", "evidence.text_sample", "salience.visible_ms", "salience.viewport_fraction", "salience.ephemeral")


def to_bodies(records: DataFrame, version: int = 2) -> DataFrame:
    """(batch_id, body): one JSON text for each reporter's batch, as it goes over the wire."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    body = F.to_json(F.struct(F.lit(version).alias("v"), F.collect_list(F.struct(*names)).alias("records")))
    return records.groupBy("batch_id").agg(body.alias("body"))


def records_of(bodies: DataFrame) -> DataFrame:
    """The records of JSON bodies, one row each. A body that cannot be read, or of another version, is one row of nulls, which no check admits."""
    parsed = F.from_json("body", f"v int, records array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>")
    known = bodies.select("batch_id", F.when(parsed["v"].isin(*PROTOCOLS), parsed["records"]).alias("r"))
    return known.select("batch_id", F.explode_outer("r").alias("r")).select("batch_id", "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; a line that was cut off is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_chunks(rows: DataFrame, path: str, chunks: int, order: str = "ord") -> None:
    """Round-robin into ``chunks`` folders of JSON lines."""
    rows.withColumn("chunk", F.pmod(F.col(order), F.lit(chunks)) + 1).write.mode("overwrite").partitionBy("chunk").json(path)


def export_view(views: dict[str, DataFrame], name: str, path: str) -> None:
    """One of the published views as JSON lines; other names are refused."""
    if name not in VIEWS or name not in views:
        raise ValueError(f"no such view: {name}")
    views[name].write.mode("overwrite").json(path)


def export_sql(spark: SparkSession, text: str, path: str, **tables: DataFrame) -> None:
    """What a query says of the named tables ({name} in its text), as JSON lines."""
    spark.sql(text, **tables).write.mode("overwrite").json(path)


def read_pack(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """A rule pack (one JSON object) as the arguments of functions.rules.denied."""
    row = spark.read.option("multiLine", True).json(path).select("schemes", "hostSuffixes", "hostPatterns").first()
    return {"schemes": tuple(row[0]), "suffixes": tuple(row[1]), "patterns": tuple(row[2])}


def read_suffix_rules(spark: SparkSession, path: str) -> SuffixRules:
    """Public suffix rules from a text file, a rule a line; one line more than an expression may hold is an error."""
    return SuffixRules.parse(r[0] for r in spark.read.text(path).limit(2 * MOST_RULES).collect())


def export_events(events: DataFrame) -> DataFrame:
    """Nested events as one flat row each; what an event lacks is null."""
    have = events.schema

    def column(path: str) -> Column:
        head, _, leaf = path.partition(".")
        there = head in have.names and (not leaf or leaf in have[head].dataType.names)
        return (F.col(path) if there else F.lit(None).cast("string")).alias(path.replace(".", "_"))

    return events.select(*map(column, EVENT))
