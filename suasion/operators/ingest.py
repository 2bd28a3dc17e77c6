"""Ingest: JSON bodies to a status each, admitted rows, and counters that take a new batch up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.functions.bind import bound, once
from suasion.operators.dims import STAGES
from suasion.operators.telemetry import COHORT, MAX_BATCH, OUTCOME_COHORT, SITE

# fixed values: keys of a record and of an outcome, what they may hold, versions of the protocol
RECORD_KEYS = ("patternId", "detectorId", "funnelStage", "site", "originCategory", "rulepackVersion", "dayBucket", "confidenceQuartile")
OUTCOME_KEYS = ("patternId", "funnelStage", "site", "originCategory", "rulepackVersion", "dayBucket", "addedToCart")
OUTCOME_PATTERN = r"^(_page|[a-z_]{1,32}\.[a-z_]{1,32})$"
OUTCOME_STAGES, PROTOCOLS, MAX_DAY_SKEW = ("browse", "pdp"), (2, 3), 90
MESSAGES = "map<string,string>"


def _is_text(item: Column, key: str, most: int) -> Column:
    """Whether a key's JSON value is a text of at most ``most`` characters; values are raw JSON."""
    return item[key].startswith('"') & (F.length(_text(item, key)) <= most)


def _text(item: Column, key: str) -> Column:
    return F.regexp_extract(item[key], r'^"(.*)"$', 1)


def _is_day(item: Column, as_of_day: int) -> Column:
    day = F.when(item["dayBucket"].rlike(r"^-?\d{1,9}$"), item["dayBucket"].try_cast("int"))
    return day.between(as_of_day - MAX_DAY_SKEW, as_of_day + MAX_DAY_SKEW)


def _exactly(item: Column, keys: tuple[str, ...]) -> Column:
    return F.array_sort(F.map_keys(item)) == F.array(*map(F.lit, sorted(keys)))


def _common(item: Column, categories: tuple[str, ...], as_of_day: int) -> Column:
    return _is_text(item, "rulepackVersion", 32) & _text(item, "originCategory").isin(*categories) & _is_text(item, "site", 253) & _text(item, "site").rlike(SITE) & _is_day(item, as_of_day)


def valid_record(item: Column, categories: tuple[str, ...], as_of_day: int) -> Column:
    """Whether a record (map of key to raw JSON value) has exactly its keys and holds what they may hold."""
    ok = _exactly(item, RECORD_KEYS) & _is_text(item, "patternId", 64) & _is_text(item, "detectorId", 64) & _text(item, "funnelStage").isin(*STAGES) & item["confidenceQuartile"].isin("1", "2", "3", "4") & _common(item, categories, as_of_day)
    return F.coalesce(ok, F.lit(False))


def valid_outcome(item: Column, categories: tuple[str, ...], as_of_day: int) -> Column:
    """The same of an outcome: a pattern or the page baseline, on a page that can be added from."""
    ok = _exactly(item, OUTCOME_KEYS) & _text(item, "patternId").rlike(OUTCOME_PATTERN) & _text(item, "funnelStage").isin(*OUTCOME_STAGES) & item["addedToCart"].isin("true", "false") & _common(item, categories, as_of_day)
    return F.coalesce(ok, F.lit(False))


def _items(raw: Column) -> Column:
    """The members of a raw JSON array, each a map of key to raw JSON value (null where it is no object)."""
    members = F.from_json(raw, "array<string>")
    return F.transform(members, lambda m: F.when(m.startswith("{"), once(F.json_object_keys(m), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: _raw(m, k))))))


def _raw(whole: Column, key: Column) -> Column:
    """A key's raw JSON value: what follows the key, up to the comma or brace that ends a flat value."""
    behind = r'"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}\s]+)'
    # the keys that rows have are patterns of their own, as a pattern that changes from key to key is compiled anew each time
    known = F.coalesce(*(F.when(key == k, F.regexp_extract(whole, f'"{k}{behind}', 1)) for k in dict.fromkeys((*RECORD_KEYS, *OUTCOME_KEYS))), F.call_function("regexp_extract", whole, F.concat(F.lit('"'), key, F.lit(behind)), F.lit(1)))
    return F.nullif(known, F.lit(""))


def judge(bodies: DataFrame, categories: tuple[str, ...], as_of_day: int, max_batch: int = MAX_BATCH) -> DataFrame:
    """The requests (batch_id, method, content_type, body) with records, outcomes and status.

    405 for another method, 415 for another type, 400 for what is no such batch (no object, another version, members that are
    no lists, outcomes in version 2, none or too many rows), 422 where a row is not valid, else 204. A batch is taken whole
    or not at all.
    """
    top = F.from_json("body", "v string, records string, outcomes string")
    # bound, as a filter on the status would otherwise take the members apart wherever it names them
    read = bound(bodies, "top", top).select("*", F.coalesce("top.outcomes", F.lit("[]")).alias("o"), F.col("top.records").alias("r"))
    lists = bound(bound(read, "records", F.when(F.col("r").startswith("["), _items(F.col("r")))), "outcomes", F.when(F.col("o").startswith("["), _items(F.col("o"))))
    total = F.size("records") + F.size("outcomes")
    shape = F.col("top.v").isin(*map(str, PROTOCOLS)) & F.col("records").isNotNull() & F.col("outcomes").isNotNull() & ((F.col("top.v") == "3") | (F.size("outcomes") == 0)) & total.between(1, max_batch)
    valid = F.forall("records", lambda x: valid_record(x, categories, as_of_day)) & F.forall("outcomes", lambda x: valid_outcome(x, categories, as_of_day))
    status = F.when(F.coalesce(F.col("method") != "POST", F.lit(True)), 405).when(~F.coalesce(F.col("content_type").contains("application/json"), F.lit(False)), 415).when(~F.coalesce(shape, F.lit(False)), 400).when(~F.coalesce(valid, F.lit(False)), 422).otherwise(204)
    return bound(lists, "status", status).select("batch_id", "records", "outcomes", "status")


def admitted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of admitted batches: records by cohort columns, and outcomes by theirs, each with its batch_id."""
    taken = judged.filter("status = 204")
    names = {"patternId": "pattern_id", "detectorId": "detector_id", "funnelStage": "funnel_stage", "site": "site", "originCategory": "origin_category", "rulepackVersion": "rulepack_version"}

    def rows(kind: str, keys: tuple[str, ...], *more: Column) -> DataFrame:
        x = F.col("x")
        return taken.select("batch_id", F.explode(kind).alias("x")).select("batch_id", *(_text(x, k).alias(n) for k, n in names.items() if k in keys), x["dayBucket"].cast("long").alias("day_bucket"), *more)

    return rows("records", RECORD_KEYS, F.col("x")["confidenceQuartile"].cast("int").alias("quartile")), rows("outcomes", OUTCOME_KEYS, (F.col("x")["addedToCart"] == "true").cast("int").alias("added_to_cart"))


def admitted_queue(judged: DataFrame) -> DataFrame:
    """The rows of admitted batches as the one queue that tagged_union makes of them, from one reading of the batches."""
    x, record = F.col("q.x"), F.col("q.kind") == "record"
    tagged = lambda members, kind: F.transform(members, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("x")))
    rows = judged.filter("status = 204").select("batch_id", F.explode(F.concat(tagged("records", "record"), tagged("outcomes", "outcome"))).alias("q"))
    return rows.select(
        "batch_id", _text(x, "patternId").alias("pattern_id"), _text(x, "detectorId").alias("detector_id"), _text(x, "funnelStage").alias("funnel_stage"), _text(x, "site").alias("site"), _text(x, "originCategory").alias("origin_category"), _text(x, "rulepackVersion").alias("rulepack_version"),
        x["dayBucket"].cast("long").alias("day_bucket"), F.when(record, x["confidenceQuartile"].cast("int")).alias("quartile"), F.when(~record, (x["addedToCart"] == "true").cast("int")).alias("added_to_cart"), F.col("q.kind").alias("kind"),
    )


def merge_counters(stored: DataFrame, rows: DataFrame, cohort: tuple[str, ...] = COHORT) -> DataFrame:
    """Stored counters (cohort, n, reporters) with new batches taken up: n grows by rows, reporters by one for each batch.

    The rows are counted first, so what meets the stored counters is one row for each cohort.
    """
    new = rows.groupBy(*cohort).agg(F.count("*").alias("n"), F.countDistinct("batch_id").alias("reporters"))
    return stored.select(*cohort, "n", "reporters").unionByName(new).groupBy(*cohort).agg(F.sum("n").alias("n"), F.sum("reporters").alias("reporters"))


def tagged_union(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Records and outcomes as one queue; ``kind`` tells them apart, by shape: only outcomes have added_to_cart."""
    both = records.unionByName(outcomes, allowMissingColumns=True)
    return both.withColumn("kind", F.when(F.col("added_to_cart").isNull(), "record").otherwise("outcome"))


def split_union(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reverse of tagged_union."""
    return queue.filter("kind = 'record'").select("batch_id", *COHORT), queue.filter("kind = 'outcome'").select("batch_id", *OUTCOME_COHORT)


def known_messages(messages: DataFrame, schemas: dict[str, tuple[str, ...]]) -> DataFrame:
    """Messages (type, body as JSON) with ``valid``: the type is a known one and the body has all the keys that it must have."""
    kind = F.get_json_object("body", "$.type")
    keys = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))
    arms = [F.when(kind == name, F.size(F.array_except(F.array(F.lit("type"), *map(F.lit, need)), keys)) == 0) for name, need in schemas.items()]
    return messages.withColumn("valid", reduce(F.coalesce, [*arms, F.lit(False)]))
