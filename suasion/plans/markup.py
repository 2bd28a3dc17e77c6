"""Queries: the node table of the given pages, and what pages say of themselves, asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.operators import markup
from suasion.sources.tables import table
from suasion.streaming.run import stored


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return markup.nodes(table(spark, d, "pages").select("page_id", "html"))


def sc1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by page and tag: how many, how deep, how far they reach, and what holds them."""
    found = markup.inside(markup.inside(_nodes(spark, d), F.col("tag") == "nav", "in_nav"), F.col("tag") == "p", "in_p")
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"), total(F.col("depth"), "depths"), total(F.col("end") - F.col("pos"), "reach"), total(F.col("in_nav"), "in_nav"), total(F.col("in_p"), "in_p"))


# end tags by the first place where a name's count falls below that of its tag; everything else by joins of intervals
SC1_NODES = r"""
WITH t AS MATERIALIZED (SELECT page_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[a-z/!][^>]*>|[^<]+|<') AS x FROM pages) p),
k AS MATERIALIZED (
  SELECT page_id, pos, CASE WHEN regexp_matches(raw, '^</?[A-Za-z]') THEN lower(regexp_extract(raw, '^</?([A-Za-z][^\s/>]*)', 1)) ELSE '#text' END AS tag,
    CASE WHEN NOT regexp_matches(raw, '^</?[A-Za-z]') THEN 0 WHEN raw[2] = '/' THEN -1 WHEN tag IN ('br', 'meta', 'img', 'input', 'hr', 'link') OR regexp_matches(raw, '(?is)^<(script|style)\b.*</') THEN 0 ELSE 1 END AS step
  FROM t WHERE raw[1:2] <> '<!' AND NOT regexp_matches(raw, '^</[^A-Za-z]')
), r AS MATERIALIZED (SELECT *, sum(step) OVER (PARTITION BY page_id, tag ORDER BY pos) AS run, max(pos) OVER (PARTITION BY page_id) AS last FROM k),
m AS MATERIALIZED (SELECT o.page_id, o.pos, min(c.pos) AS stop FROM r o JOIN r c ON c.page_id = o.page_id AND c.tag = o.tag AND c.step = -1 AND c.pos > o.pos AND c.run = o.run - 1 WHERE o.step = 1 GROUP BY ALL),
a AS MATERIALIZED (SELECT r.page_id, r.pos, count(m.pos) AS depth, arg_max(m.stop, m.pos) AS up FROM r LEFT JOIN m ON m.page_id = r.page_id AND m.pos < r.pos AND m.stop > r.pos WHERE r.step >= 0 GROUP BY ALL),
n AS MATERIALIZED (SELECT o.page_id, o.pos, min(c.pos) AS next FROM r o JOIN r c ON c.page_id = o.page_id AND c.tag = o.tag AND c.step = 1 AND c.pos > o.pos WHERE o.step = 1 AND o.tag IN ('p', 'li') GROUP BY ALL),
e AS MATERIALIZED (
  SELECT r.page_id, r.pos, r.tag, a.depth, CASE WHEN r.step = 0 THEN r.pos ELSE coalesce(m.stop, least(n.next, coalesce(a.up, r.last + 1))) END AS stop
  FROM r JOIN a ON a.page_id = r.page_id AND a.pos = r.pos LEFT JOIN m ON m.page_id = r.page_id AND m.pos = r.pos LEFT JOIN n ON n.page_id = r.page_id AND n.pos = r.pos
), h AS (SELECT e.page_id, e.pos, bool_or(o.tag = 'nav') AS nav, bool_or(o.tag = 'p') AS p FROM e JOIN e o ON o.page_id = e.page_id AND o.pos < e.pos AND o.stop > e.pos GROUP BY ALL)
SELECT e.page_id, tag, count(*) AS n, sum(depth)::BIGINT AS depths, sum(stop - e.pos)::BIGINT AS reach, count(*) FILTER (WHERE nav) AS in_nav, count(*) FILTER (WHERE p) AS in_p FROM e LEFT JOIN h ON h.page_id = e.page_id AND h.pos = e.pos GROUP BY e.page_id, tag
"""


def sc2_facts(spark: SparkSession, d: str) -> DataFrame:
    """Title, language, character set, links of the navigation, list items with a link, and characters of the article."""
    found = stored(markup.inside(markup.inside(_nodes(spark, d), F.col("tag") == "nav", "in_nav"), F.col("tag") == "article", "in_article"))
    tag, raw = F.col("tag"), F.col("raw")
    one = found.groupBy("page_id").agg(
        F.min(F.when(tag == "html", markup.attribute("lang"))).alias("lang"), F.min(F.when(tag == "meta", markup.attribute("charset"))).alias("charset"), F.count_if((tag == "a") & F.col("in_nav")).alias("nav_links"),
        F.sum(F.when((tag == markup.TEXT) & F.col("in_article"), F.length(raw)).otherwise(0)).cast("long").alias("article_chars"),
    )
    title = markup.own_text(found).join(found.filter("tag = 'title'").select("page_id", "pos"), ["page_id", "pos"]).groupBy("page_id").agg(F.min_by("text", "pos").alias("title"))
    items = markup.with_child(found, tag == "a", "linked").filter("tag = 'li' and linked").groupBy("page_id").agg(F.count("*").alias("linked_items"))
    return one.join(title, "page_id", "left").join(items, "page_id", "left").na.fill(0, ["linked_items"])


SC2_FACTS = r"""
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
       len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')) AS nav_links, len(regexp_extract_all(html, '<li><a ')) AS linked_items,
       length(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g')) AS article_chars
FROM pages
"""

QUERIES = {"sc1_nodes": sc1_nodes, "sc2_page_facts": sc2_facts}
ORACLE_SQL = {"sc1_nodes": SC1_NODES, "sc2_page_facts": SC2_FACTS}
