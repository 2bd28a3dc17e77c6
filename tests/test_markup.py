"""The node table against a walk of the same tokens, on written and on random markup."""

import random
import re

import pytest
from pyspark.sql import functions as F

from suasion.operators import markup


def table(spark, *pages):
    found = markup.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    return sorted((r.page_id, r.pos, r.end, r.depth, r.parent, r.tag) for r in found.collect())


def walk(html):
    """(pos, end, depth, parent, tag) of the nodes, each looked up among all the others."""
    tokens = list(enumerate(re.findall(r"<!--.*?-->|</?[a-z][^>]*>|[^<]+", html)))
    name = lambda t: re.match(r"</?([a-z]+)", t).group(1) if t[0] == "<" else "#text"
    tags = [(i, name(t), t.startswith("</")) for i, t in tokens if not t.startswith("<!")]
    ends, taken = {}, set()
    for i, tag, close in tags:
        if close or tag == "#text" or tag in markup.VOID:
            continue
        open_now = 1
        for j, other, shut in tags:
            if j > i and other == tag:
                open_now += -1 if shut else 1
                if open_now == 0:
                    ends[i] = j
                    taken.add(j)
                    break
    out = []
    for i, tag, close in tags:
        if close:
            continue
        around = [k for k in ends if k < i < ends[k]]
        parent = max(around, default=None)
        if tag == "#text" or tag in markup.VOID:
            end = i
        elif i in ends:
            end = ends[i]
        else:
            options = [ends[parent] if parent is not None else tokens[-1][0] + 1]
            options += [j for j, other, shut in tags if j > i and other == tag and not shut and tag in markup.OPTIONAL][:1]
            end = min(options)
        out.append((i, end, len(around), parent, tag))
    return out


def test_written_markup(spark):
    html = "<div><p>one<p>two<br></p><b>x</b></div><ul><li>a<li>b</ul></i><!-- <p> -->tail"
    assert table(spark, html, "", None) == [(0, *r) for r in walk(html)]


def grown(r, left_open):
    """Pages of random markup whose end tags nest, with tags among it that have none."""

    def grow(depth):
        if depth == 0 or r.random() < 0.25:
            return r.choice(["text", "<br>", "<!-- <div> -->", *left_open])
        tag = r.choice(["div", "p", "b", "ul", "li"])
        return f"<{tag}>" + "".join(grow(depth - 1) for _ in range(r.randrange(4))) + f"</{tag}>"

    return ["".join(grow(4) for _ in range(3)) for _ in range(15)]


@pytest.mark.parametrize("seed", range(3))
def test_nested_markup(spark, seed):
    pages = grown(random.Random(seed), ["<dd>", "<td>open", "<span>"])
    assert table(spark, *pages) == sorted((k, *row) for k, page in enumerate(pages) for row in walk(page))


def test_crossing_markup(spark):
    """Tags left open within others of their name take their end tags: intervals may cross, levels are still counted."""
    pages = grown(random.Random(9), ["<p>open", "<li>", "</b>"])
    got, want = table(spark, *pages), sorted((k, *row) for k, page in enumerate(pages) for row in walk(page))
    assert [(k, pos, depth, tag) for k, pos, _, depth, _, tag in got] == [(k, pos, depth, tag) for k, pos, _, depth, _, tag in want]
    assert all(end >= pos for _, pos, end, *_ in got)


def test_scripts_quotes_and_attributes(spark):
    html = """<DIV data-x="a > b" hidden title='it"s'><script>var t = "</div><p>"</script><style>p > b {}</style><a href=/x>go</a></DIV>1 < 2"""
    found = markup.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    get = lambda n: markup.attribute(n).alias(n)
    rows = [tuple(r) for r in found.filter(F.col("tag") != markup.TEXT).orderBy("pos").select("tag", "depth", get("data-x"), get("hidden"), get("title"), get("href")).collect()]
    assert rows == [("div", 0, "a > b", "", 'it"s', None), ("script", 1, None, None, None, None), ("style", 1, None, None, None, None), ("a", 1, None, None, None, "/x")]
    assert [r.raw for r in found.filter("depth = 0 and tag = '#text'").orderBy("pos").collect()] == ["1 ", "<", " 2"]


def test_inside_children_and_texts(spark):
    html = '<div role="dialog"><p>Save <b>10%</b> now</p></div><p>plain <b>text</b></p><div><i role="progressbar"></i></div>'
    found = markup.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    dialog = markup.inside(found, markup.attribute("role") == "dialog", "in_dialog")
    assert {(r.raw, r.in_dialog) for r in dialog.filter("tag = '#text'").collect()} == {("Save ", True), ("10%", True), (" now", True), ("plain ", False), ("text", False)}
    bars = markup.with_child(found, markup.attribute("role") == "progressbar", "has_bar")
    assert [r.has_bar for r in bars.filter("tag = 'div'").orderBy("pos").collect()] == [False, True]
    assert {r.text for r in markup.own_text(found).collect()} == {"Save now", "10%", "plain", "text"}


def test_one_shuffle_by_page(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")
    plan = markup.nodes(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan


def test_a_very_long_tag_and_page(spark):
    html = "<div " + "a='1' " * 20_000 + ">" + "<b>x</b>" * 20_000 + "</div>"
    found = markup.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [(r.tag, r["n"]) for r in found.groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag").collect()] == [("#text", 20_000), ("b", 20_000), ("div", 1)]


def test_tasks_grow_with_the_bytes_of_the_pages(spark, monkeypatch):
    """A task's share of pages is bounded by their bytes, however many there are; few small tasks are not put together again."""
    monkeypatch.setattr(markup, "TASK_BYTES", 1_000, raising=False)
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 993), F.lit("</p>")).alias("html"))
    found = markup.nodes(pages)
    assert found.rdd.getNumPartitions() == 60
    assert found.count() == 120
    assert markup.nodes(pages.limit(0)).count() == 0
