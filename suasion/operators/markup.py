"""Markup as a node table, made and asked in the JVM: tokens of a page as rows, nesting as intervals of positions.

An element is the interval from its tag to its end tag, so what lies within what is a comparison of positions, found by
windows of a page; nothing is joined all against all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: elements without contents, and those whose end tag may be left out before the next of their kind
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
OPTIONAL = ("dd", "dt", "li", "option", "p", "td", "th", "tr")

#: Comments; scripts and styles whole; tags, quoted values whole; tags with a stray quote; text; a stray bracket.
TOKEN = r"""(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[a-z/!](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[a-z/!][^>]*>|[^<]+|<"""
TEXT = "#text"
#: Bytes of markup that a task takes apart: its windows hold some thirty times as many.
TASK_BYTES = 8 << 20


def dealt(pages: DataFrame, html: str) -> DataFrame:
    """The pages dealt by page_id to as many tasks as their bytes ask for, so that a task's share does not grow with the table."""
    size = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    return pages.repartition(max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "page_id")


def nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, end, depth, parent, tag, raw of each element and text of each page (page_id, html).

    ``pos`` numbers the tokens of a page, ``end`` is the position at which an element ends: that of its end tag, which is
    the first that leaves as many tags of its name open as there were before it. Without one it ends with the element
    around it, or the page, and one of OPTIONAL at the next of its kind, if that comes first. ``depth`` counts the elements
    with an end tag around a node, and ``parent`` is the position of the last that began one level up (null: none): the
    innermost of these, where tags nest; where they cross, it may have ended. Scripts and styles
    are elements without contents, texts are nodes with the tag #text; comments, doctypes and stray end tags are left out,
    as are pages that are null or empty. ``raw`` is the tag or text as written.

    Pages are dealt by page_id once, as text, after their bytes are summed; all the windows below find their rows there.
    """
    token = F.col("raw")
    cut = dealt(pages.select("page_id", html), html).select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
    whole = token.rlike(r"(?is)^<(?:script|style)\b.*</(?:script|style)\s*>$")
    kind = F.when(token.startswith("<!"), "note").when(~token.rlike(r"^</?[A-Za-z]"), F.when(token.rlike(r"^</"), "note").otherwise("text")).when(token.startswith("</"), "close").when(tag.isin(*VOID) | whole, "void").otherwise("open")
    rows = cut.withColumn("kind", kind).filter("kind <> 'note'").withColumn("tag", F.when(F.col("kind") == "text", TEXT).otherwise(tag))

    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    named = Window.partitionBy("page_id", "tag").orderBy("pos")
    rows = rows.withColumn("level", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(named) + F.when(closes, 1).otherwise(0))
    beside = Window.partitionBy("page_id", "tag", "level", opens | closes).orderBy("pos")
    rows = rows.withColumn("_end", F.when(opens & (F.lead("kind").over(beside) == "close"), F.lead("pos").over(beside))).withColumn("_closed", closes & (F.lag("kind").over(beside) == "open"))
    rows = rows.withColumn("_next", F.when(opens & F.col("tag").isin(*OPTIONAL), F.lead("pos").over(Window.partitionBy("page_id", "tag", opens).orderBy("pos"))))

    page = Window.partitionBy("page_id").orderBy("pos")
    around = F.sum(F.when(F.col("_end").isNotNull(), 1).when(F.col("_closed"), -1).otherwise(0)).over(page) - F.when(F.col("_end").isNotNull(), 1).otherwise(0)
    rows = rows.withColumn("depth", around.cast("int")).withColumn("_last", F.max("pos").over(Window.partitionBy("page_id"))).filter(~closes)
    # a frame is an element with an end tag, met by the nodes one level below it
    roles = F.array(F.struct((F.col("depth") - 1).alias("at"), F.lit(False).alias("frame")), F.when(F.col("_end").isNotNull(), F.struct(F.col("depth").alias("at"), F.lit(True).alias("frame"))))
    met = rows.withColumn("_role", F.explode(F.array_compact(roles))).withColumn("_at", F.col("_role.at")).withColumn("_frame", F.col("_role.frame"))
    above = F.last(F.when(F.col("_frame"), F.struct("pos", "_end")), ignorenulls=True).over(Window.partitionBy("page_id", "_at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    found = met.withColumn("_up", F.when(F.col("depth") > 0, above)).filter(~F.col("_frame"))
    end = F.when(opens, F.coalesce("_end", F.greatest("pos", F.least("_next", F.coalesce("_up._end", F.col("_last") + 1))))).otherwise(F.col("pos"))
    return found.select("page_id", "pos", end.cast("int").alias("end"), "depth", F.col("_up.pos").alias("parent"), "tag", "raw")


def attribute(name: str, raw: Column | None = None) -> Column:
    """An attribute of a tag as it is written; null where the tag has none, empty where it has no value."""
    raw = F.col("raw") if raw is None else raw
    quoted = [F.regexp_extract(raw, rf"(?is)\s{name}\s*=\s*{form}", 1) for form in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]
    return F.when(raw.rlike(rf"(?i)\s{name}(?=[\s=>/])"), F.concat(*quoted))


def inside(found: DataFrame, outer: Column, name: str) -> DataFrame:
    """The nodes with a flag ``name``: does an element of kind ``outer`` hold them, at whatever distance?

    Of the elements that began before a node, one reaches beyond it if the farthest does.
    """
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn(name, F.coalesce(F.max(F.when(outer, F.col("end"))).over(before) > F.col("pos"), F.lit(False)))


def with_child(found: DataFrame, inner: Column, name: str) -> DataFrame:
    """The nodes with a flag ``name``: is a node of kind ``inner`` a child of theirs?"""
    up = found.filter(inner).filter("parent is not null").select("page_id", F.col("parent").alias("pos")).distinct().withColumn(name, F.lit(True))
    return found.join(up, ["page_id", "pos"], "left").na.fill(False, [name])


def own_text(found: DataFrame) -> DataFrame:
    """page_id, pos, text: the texts that are an element's own children, in order, blanks collapsed."""
    said = found.filter((F.col("tag") == TEXT) & F.col("parent").isNotNull()).groupBy("page_id", F.col("parent").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "raw"))).alias("_t"))
    return said.select("page_id", "pos", F.trim(F.regexp_replace(F.array_join(F.transform("_t", lambda t: t["raw"]), " "), r"\s+", " ")).alias("text"))
