"""Queries that run as streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.plans.bridge import PATTERN, _text, oracle
from suasion.plans.shop import CATEGORIES, STATUS
from suasion.sources import changes
from suasion.sources.tables import table
from suasion.streaming import counters, ledger, queue, views, watch
from suasion.streaming.run import STORE, drain, new_folder

IDLE_MS = 6 * 3_600_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("pattern_id", F.expr(PATTERN))


def st1_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return drain(views.daily_counts(_events(spark, d)))


def st5_views(spark: SparkSession, d: str) -> DataFrame:
    m = _events(spark, d).select(
        F.col("user_id").alias("view_id"), F.concat(F.lit("https://www.shop"), (F.col("user_id") % 60).cast("string"), F.lit(".com")).alias("origin"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "pdp").otherwise("browse").alias("funnel_stage"), "pattern_id", (F.col("event_type") == "purchase").alias("added")
    )
    return drain(views.page_views(m, IDLE_MS)).groupBy("view_id", "funnel_stage", "added").agg(F.count("*").alias("views"))


def st11_debounce(spark: SparkSession, d: str) -> DataFrame:
    return drain(views.debounce(_events(spark, d).select("ts", "user_id", "event_type"), ("user_id", "event_type"))).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def st8_ephemeral(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("node", F.col("user_id"))
    joined = views.ephemeral(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "30 minutes")
    return drain(joined).groupBy("node").agg(F.count("*").alias("n"))


#: A client's messages: what the kind of an event stands for.
KIND = "case event_type when 'view' then 'stage' when 'click' then 'choice' when 'purchase' then 'add' when 'signup' then 'digest' else 'event' end"
SESSION_MS = 10 * 86_400_000


def st4_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every ledger as it stood last, of sessions of ten days of each user's shop."""
    stage = F.when(F.col("event_id") % 3 == 0, "pdp").when(F.col("event_id") % 3 == 1, "cart").otherwise("checkout")
    messages = _events(spark, d).select(
        F.col("user_id").alias("client_id"), F.concat(F.lit("https://shop"), (F.col("user_id") % 60).cast("string"), F.lit(".com")).alias("origin"), F.floor(F.unix_millis("ts") / SESSION_MS).cast("string").alias("session_id"), "ts", F.col("event_id").alias("seq"),
        F.expr(KIND).alias("kind"), stage.alias("stage"), F.when(F.col("value") > 20, F.round(F.col("value") * 100).cast("long")).alias("snapshot"),
        F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 2 == 0, "gift_wrap").otherwise("protection")).otherwise(F.col("event_id").cast("string")).alias("ref"), (F.col("value") > 50).alias("selected"),
    )
    told = drain(ledger.ledgers(messages), conf=STORE)
    last = told.groupBy("client_id", "origin", "session_id", "opened_ms").agg(F.max_by(F.struct("stages", "adds", "choices", "events", "digests"), F.struct("closed", "version")).alias("l"))
    joined = lambda c: F.array_join(F.col(f"l.{c}"), ",").alias(c)
    stages = F.array_join(F.transform("l.stages", lambda x: F.concat_ws(":", x["stage"], x["entered_ms"], F.coalesce(x["snapshot"], F.lit(-1)))), ",")
    choices = F.array_join(F.transform("l.choices", lambda x: F.concat_ws(":", x["addon_key"], x["selected"].cast("string"), x["ts_ms"])), ",")
    return last.select("client_id", "session_id", "opened_ms", stages.alias("stages"), joined("adds"), choices.alias("choices"), joined("events"), joined("digests"))


def sc4_changes(spark: SparkSession, d: str) -> DataFrame:
    """Mutation records put into a folder, and what the page watcher tells of them."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kind = F.when(k % 10 < 2, "insert").when(k % 10 == 2, "hide").when(k % 10 == 3, "gesture").when(k % 10 == 4, "exit").when(k % 10 == 5, "remove").when(k % 10 == 8, "show").otherwise("text")
    e = table(spark, d, "events").withColumn("ms", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 10_000))
    shown = kind.isin("insert", "show")
    rows = e.select(F.col("user_id").alias("page_id"), F.timestamp_millis("ms").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("body>m"), (F.col("event_id") % 2).cast("string")).alias("path"), k.cast("string").alias("text"), shown.alias("modal"), F.lit(False).alias("dialog"), F.lit(False).alias("empty"))
    first = rows.groupBy("page_id").agg(F.min("ts").alias("ts")).select("page_id", "ts", F.lit(-1).cast("long").alias("seq"), F.lit("recording").alias("kind"), F.lit("").alias("path"), F.lit(None).cast("string").alias("text"), *(F.lit(False).alias(c) for c in ("modal", "dialog", "empty")))
    folder = new_folder(spark, "changes")
    rows.unionByName(first).write.parquet(folder)
    seen = drain(watch.watch(changes.page_changes(spark, folder, "parquet")), conf=STORE)
    return seen.select("page_id", "what", "path", "ts_ms", "seq", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("since_ms", F.lit(-1)).alias("since_ms"))


def ag2_counters(spark: SparkSession, d: str) -> DataFrame:
    """A stream of requests judged and counted into a store; the store's records."""
    schema = table(spark, d, "orders").schema
    bodies = spark.sql(_text("b_requests", "spark"), orders=spark.readStream.schema(schema).parquet(f"{d}/order[s].parquet"))
    root = new_folder(spark, "counters")
    counters.ingest_counters(bodies, root, CATEGORIES, 20_000).awaitTermination()
    store = counters.Counters(spark, f"{root}/records")
    store.compact(0)
    return store.read()


def st1_store(spark: SparkSession, d: str) -> DataFrame:
    """Events stored by day as they come, the days of the first ten pruned; what is left by day."""
    root = new_folder(spark, "events")
    counters.store_events(_events(spark, d).select("ts", "event_id", "pattern_id"), root).awaitTermination()
    first = counters.read_events(spark, root).agg(F.min("day_bucket")).first()[0]
    if first is not None:
        counters.prune(spark, f"{root}/events", first + 10)
    return counters.read_events(spark, root).groupBy(F.col("day_bucket").cast("long").alias("day_bucket"), "pattern_id").agg(F.count("*").alias("n"))


def st6_flush(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a queue: one in twenty unsound, errors of k = 0 withdraw consent and of k = 1 give it again."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    consent = (F.col("event_type") == "error") & (k < 2)
    rows = _events(spark, d).select(F.col("user_id").alias("reporter"), "ts", F.col("event_id").alias("seq"), F.when(consent, "consent").otherwise("row").alias("kind"), (k == 1).alias("given"), (F.col("event_id") % 20 != 0).alias("sound"))
    return drain(queue.sent_batches(rows), conf=STORE).select("reporter", "sent_ms", "n", F.array_join("seqs", ",").alias("seqs"))


def st15_handed(spark: SparkSession, d: str) -> DataFrame:
    """Cards and questions of sixty shops; times are shortened, so that many answers fall within, at and beyond a minute."""
    kind = F.when(F.col("event_id") % 7 == 0, "seen").when(F.col("event_id") % 2 == 0, "card").otherwise("ask")
    origin = F.concat(F.lit("https://"), F.when(F.col("event_id") % 3 == 0, "secure.").otherwise("www."), F.lit("shop"), (F.col("user_id") % 60).cast("string"), F.lit(".com"))
    rows = _events(spark, d).select(origin.alias("origin"), F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 300)).alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("c"), F.col("event_id")).alias("card"))
    return drain(queue.handed_over(rows), conf=STORE)


P = PATTERN
QUERIES = {"st1_stream_daily_counts": st1_daily_counts, "st5_stream_page_views": st5_views, "st11_stream_debounce": st11_debounce, "st8_stream_ephemeral": st8_ephemeral, "st4_session_ledger": st4_ledger, "sc4_page_changes": sc4_changes, "ag2_stream_counters": ag2_counters, "st1_event_store": st1_store, "st6_flush": st6_flush, "st15_hand_over": st15_handed}
ORACLE_SQL = {
    # a day is emitted when the watermark, a day behind the latest event, has passed its end
    "st1_stream_daily_counts": f"SELECT cast(epoch_us(ts) // 86400000000 AS BIGINT) AS day_bucket, {P} AS pattern_id, count(*) AS n FROM events WHERE (epoch_us(ts) // 86400000000 + 1) * 86400000 <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 86400000 GROUP BY ALL",
    "st5_stream_page_views": """
WITH m AS (SELECT user_id AS view_id, epoch_us(ts) // 1000 AS t, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'pdp' ELSE 'browse' END AS stage, event_type = 'purchase' AS added FROM events),
s AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 21600000 OR lag(added) OVER w, true) THEN 1 ELSE 0 END AS starts FROM m WINDOW w AS (PARTITION BY view_id ORDER BY t, seq)),
c AS (SELECT *, sum(starts) OVER (PARTITION BY view_id ORDER BY t, seq) AS no FROM s),
v AS (SELECT view_id, no, bool_or(added) AS added, arg_min(stage, seq) AS funnel_stage, max(t) AS last_t FROM c GROUP BY ALL),
-- a view that ends without an add is closed by a later one, or once the watermark, an hour behind the latest event, has passed its idle time
k AS (SELECT *, no < max(no) OVER (PARTITION BY view_id) OR added OR last_t + 21600000 < (SELECT max(t) FROM m) - 3600000 AS closed FROM v)
SELECT view_id, funnel_stage, added, count(*) AS views FROM k WHERE closed GROUP BY ALL
""",
    "st11_stream_debounce": "SELECT DISTINCT user_id, event_type, 1::BIGINT AS n FROM events",
    "st8_stream_ephemeral": "SELECT a.user_id AS node, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 30 MINUTE GROUP BY ALL",
    "st4_session_ledger": f"""
WITH m AS (
  SELECT user_id AS client_id, epoch_us(ts) // 1000 AS t, event_id AS seq, (epoch_us(ts) // 1000 // {SESSION_MS})::VARCHAR AS session_id, {KIND} AS kind, CASE event_id % 3 WHEN 0 THEN 'pdp' WHEN 1 THEN 'cart' ELSE 'checkout' END AS stage,
    CASE WHEN value > 20 THEN round(value * 100)::BIGINT END AS snapshot, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'gift_wrap' ELSE 'protection' END ELSE event_id::VARCHAR END AS ref, value > 50 AS selected FROM events
), s AS (SELECT *, CASE WHEN lag(session_id) OVER w IS DISTINCT FROM session_id OR t - lag(t) OVER w > 86400000 THEN 1 ELSE 0 END AS starts FROM m WINDOW w AS (PARTITION BY client_id ORDER BY t, seq)),
c AS (SELECT *, sum(starts) OVER (PARTITION BY client_id ORDER BY t, seq) AS no FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY client_id, no, kind ORDER BY t DESC, seq DESC) AS age FROM c),
g AS (SELECT client_id, no, stage, min(t) AS entered, first(snapshot ORDER BY t, seq) FILTER (WHERE snapshot IS NOT NULL) AS snapshot FROM c WHERE kind = 'stage' GROUP BY ALL),
h AS (SELECT client_id, no, string_agg(stage || ':' || entered || ':' || coalesce(snapshot, -1), ',' ORDER BY entered, stage) AS stages FROM g GROUP BY ALL)
SELECT r.client_id, any_value(session_id) AS session_id, min(t) AS opened_ms, coalesce(any_value(h.stages), '') AS stages,
  coalesce(string_agg(ref, ',' ORDER BY t, seq) FILTER (WHERE kind = 'add' AND age <= 50), '') AS adds, coalesce(string_agg(ref || ':' || selected || ':' || t, ',' ORDER BY t, seq) FILTER (WHERE kind = 'choice' AND age <= 64), '') AS choices,
  coalesce(string_agg(ref, ',' ORDER BY t, seq) FILTER (WHERE kind = 'event' AND age <= 500), '') AS events, coalesce(string_agg(ref, ',' ORDER BY t, seq) FILTER (WHERE kind = 'digest'), '') AS digests
FROM r LEFT JOIN h USING (client_id, no) GROUP BY r.client_id, no""",
    "sc4_page_changes": """
WITH e AS (
  SELECT user_id AS page_id, 'body>m' || (event_id % 2) AS path, epoch_us(ts) // 10000000 AS ts_ms, event_id AS seq, k,
    CASE WHEN k % 10 < 2 THEN 'insert' WHEN k % 10 = 2 THEN 'hide' WHEN k % 10 = 3 THEN 'gesture' WHEN k % 10 = 4 THEN 'exit' WHEN k % 10 = 5 THEN 'remove' WHEN k % 10 = 8 THEN 'show' ELSE 'text' END AS kind
  FROM (SELECT *, regexp_extract(props, '[0-9]+', 0)::INTEGER AS k FROM events)
),
t AS (SELECT *, lag(k) OVER (PARTITION BY page_id, path ORDER BY ts_ms, seq) AS before FROM e WHERE kind IN ('insert', 'text')),
b AS (SELECT *, lag(kind) OVER w AS was, lag(ts_ms) OVER w AS since FROM e WHERE kind IN ('insert', 'remove') WINDOW w AS (PARTITION BY page_id, path ORDER BY ts_ms, seq)),
s AS (SELECT *, count(*) FILTER (WHERE kind IN ('insert', 'show')) OVER (PARTITION BY page_id, path ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spell FROM e),
m AS (
  SELECT *, min(ts_ms) FILTER (WHERE kind IN ('hide', 'remove')) OVER (PARTITION BY page_id, path, spell) AS h, max(ts_ms) FILTER (WHERE kind = 'gesture') OVER u AS g, max(ts_ms) FILTER (WHERE kind = 'exit') OVER u AS x FROM s
  WINDOW u AS (PARTITION BY page_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
c AS (SELECT *, coalesce(ts_ms - x <= 500, false) AS leaving FROM m WHERE kind IN ('insert', 'show') AND (spell = 0 OR coalesce(ts_ms - h >= 1500, false)) AND NOT (coalesce(ts_ms - g < 750, false) AND NOT coalesce(ts_ms - x <= 500, false)))
SELECT page_id, 'text' AS what, path, ts_ms, seq, k::VARCHAR AS text, -1::BIGINT AS since_ms FROM t WHERE before IS DISTINCT FROM k
UNION ALL SELECT page_id, 'ephemeral', path, ts_ms, seq, '', since FROM b WHERE kind = 'remove' AND was = 'insert' AND ts_ms - since < 15000
UNION ALL SELECT page_id, 'modal', path, ts_ms, seq, '', -1 FROM c UNION ALL SELECT page_id, 'exit_modal', path, ts_ms, seq, '', -1 FROM c WHERE leaving
""",
    "ag2_stream_counters": oracle(f"SELECT 'urgency.countdown' AS pattern_id, 'urgency.countdown@1' AS detector_id, 'pdp' AS funnel_stage, 'shop' || (k % 5) || '.com' AS site, 'fashion' AS origin_category, '1.0.1' AS rulepack_version, 20000::BIGINT AS day_bucket, (k % 4 + 1)::INTEGER AS quartile, count(*)::BIGINT AS n, count(*)::BIGINT AS reporters FROM b_requests WHERE {STATUS} = 204 GROUP BY ALL", "b_requests"),
    "st1_event_store": f"SELECT (epoch_us(ts) // 86400000000)::BIGINT AS day_bucket, {P} AS pattern_id, count(*) AS n FROM events WHERE epoch_us(ts) // 86400000000 >= (SELECT min(epoch_us(ts) // 86400000000) FROM events) + 10 GROUP BY ALL",
    "st6_flush": """
WITH RECURSIVE e AS (
  SELECT user_id AS reporter, epoch_us(ts) // 1000 AS t, event_id AS seq, event_type = 'error' AND k < 2 AS asks, k = 1 AS given, event_id % 20 <> 0 AS sound FROM (SELECT *, regexp_extract(props, '[0-9]+', 0)::INTEGER AS k FROM events)
), o AS (SELECT *, row_number() OVER (PARTITION BY reporter ORDER BY t, seq) AS nth FROM e),
-- what a queue holds after each message: its first time and its rows; what the message has sent before and after itself
r AS (
  SELECT reporter, 0::BIGINT AS nth, true AS consent, []::STRUCT(t BIGINT, seq BIGINT)[] AS held, []::STRUCT(sent_ms BIGINT, rows STRUCT(t BIGINT, seq BIGINT)[])[] AS sent FROM (SELECT DISTINCT reporter FROM o)
  UNION ALL
  SELECT reporter, nth, consent, CASE WHEN len(held) >= 25 THEN [] ELSE held END, CASE WHEN len(held) >= 25 THEN list_append(sent, {'sent_ms': t, 'rows': held}) ELSE sent END
  FROM (
    SELECT x.reporter, x.nth, x.t, CASE WHEN asks THEN given ELSE consent END AS consent, CASE WHEN asks AND NOT given THEN [] WHEN asks OR NOT consent OR NOT sound THEN left_over ELSE list_append(left_over, {'t': x.t, 'seq': x.seq}) END AS held, sent
    FROM (
      SELECT o.*, r.consent, CASE WHEN len(r.held) > 0 AND o.t - r.held[1].t > 86400000 THEN [] ELSE r.held END AS left_over,
        CASE WHEN len(r.held) > 0 AND o.t - r.held[1].t > 86400000 THEN [{'sent_ms': r.held[1].t + 86400000, 'rows': r.held}] ELSE [] END AS sent
      FROM r JOIN o ON o.reporter = r.reporter AND o.nth = r.nth + 1
    ) x
  ) y
), told AS (
  SELECT reporter, unnest(sent) AS s FROM r
  -- the last rows of a queue go by their timer, if the watermark, an hour behind the latest event, has passed it
  UNION ALL SELECT reporter, {'sent_ms': held[1].t + 86400000, 'rows': held} FROM r WHERE len(held) > 0 AND nth = (SELECT max(o.nth) FROM o WHERE o.reporter = r.reporter) AND held[1].t + 86400000 < (SELECT max(t) FROM o) - 3600000
)
SELECT reporter, s.sent_ms AS sent_ms, len(s.rows)::INTEGER AS n, array_to_string([x.seq FOR x IN s.rows], ',') AS seqs FROM told
""",
    "st15_hand_over": """
WITH e AS (SELECT 'shop' || (user_id % 60) || '.com' AS site, (epoch_us(ts) // 1000000 // 300) * 1000 AS t, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'seen' WHEN event_id % 2 = 0 THEN 'card' ELSE 'ask' END AS kind FROM events),
l AS (SELECT *, lag(kind) OVER w AS was, lag(t) OVER w AS since, lag(seq) OVER w AS card FROM e WINDOW w AS (PARTITION BY site ORDER BY t, seq))
SELECT site, 'c' || card AS card, seq AS asked_seq, (t - since)::BIGINT AS waited_ms FROM l WHERE kind = 'ask' AND was = 'card' AND t - since <= 60000
""",
}
