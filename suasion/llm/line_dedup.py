"""Line dedup: lines found in many documents stay in one of them only. DataFrame functions throughout.

Each document's lines are exploded with their positions, once, to (doc_id, text hash, position, 128-bit hash of the
normalised line): narrow rows without text, which are stored. Distinct documents per hash are counted in two aggregation
steps, first by hash and document, then by hash, both with partial sums on the map side, so a line that a third of the
corpus holds costs each task one row. Hashes over the threshold are stored and joined back to the narrow rows; both sides
of that join come fresh out of a shuffle, so Spark splits a hot hash over tasks. What goes back to a document is the
positions that it loses, and its lines are reassembled from the positions that stay (a hash difference of two arrays of
numbers, linear in the lines).

Defined results: a null or empty text is one empty line, never dropped as it is shorter than ``min_chars``; a
document that loses every line keeps an empty text; rows that repeat a doc_id count as one document and are each
filtered alike; rows without a doc_id count for nothing and keep all their lines; texts of any length are read whole; a
line that ties for the largest doc_id is kept in each row of that id; an empty table gives no rows. Every other column
passes through, whatever its name; the input's own n_lines and n_dropped, if any, are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm.common import BLANKS, fresh, materialize


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lost_positions(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, digest, lost): the sorted positions (from 0) of the lines to drop of each doc_id and text that loses any."""
    lines = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), F.posexplode(_lines(F.col("text"))).alias("position", "line"))
    keyed = lines.filter(F.length("line") >= min_chars).select("id", "digest", "position", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    held = materialize(keyed.select("id", "digest", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second half"), "key").alias("h2")))
    counted = held.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("keeper"))
    # stored, so that the join deals both sides out anew and a hot hash can be split
    frequent = materialize(counted.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"))
    lost = held.join(frequent, ["h1", "h2"]).filter(F.col("id") != F.col("keeper"))
    return lost.groupBy("id", "digest").agg(F.sort_array(F.collect_set("position")).alias("lost"))


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with ``text`` rid of repeated lines, and n_lines (before) and n_dropped."""
    names = [c for c in documents.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    taken = [*documents.columns, "text", "n_lines", "n_dropped"]
    owner, digest, owned, lost, lines = fresh(taken, "owner", "digest", "owned", "lost", "lines")
    lists = lost_positions(documents.select("doc_id", "text"), min_chars, min_docs).select(F.col("id").alias(owner), F.col("digest").alias(digest), F.col("lost").alias(lost))
    rows = documents.select(*(F.col(f"`{c}`") for c in names), F.col("text"), F.xxhash64("text").alias(owned))
    joined = rows.join(lists, (F.col("doc_id") == F.col(owner)) & (F.col(owned) == F.col(digest)), "left")
    split = joined.withColumn(lines, _lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    whole = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    return split.select(
        *(F.col(f"`{c}`") for c in names), F.when(F.col(lost).isNull(), F.coalesce("text", F.lit(""))).otherwise(whole).alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped")
    )


ORACLE = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM parts
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.i, k.line, coalesce(hot.keeper <> k.doc_id, false) AS dropped FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
