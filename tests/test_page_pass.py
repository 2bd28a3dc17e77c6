"""Pages from HTML to detections, and requests to counters: the cases that the queries do not reach."""

import pytest

from suasion.operators import corpus, ingest, page_pass
from suasion.sources import pages

PAGE = """<html><head><title>T</title></head><body><div role="dialog">Save 5% <a>x</a></div><p hidden>Only 2 left</p><p style="visibility:hidden">Only 3 left</p>
<p style="opacity:0">Only 4 left</p><p style="font-size:20px">$9<sup style="font-size:8px">99</sup></p><div>Wool mug<div><b>$5.00</b></div></div><img width="0" height="4"><p>Only 6 left <progress></progress></p></body></html>"""


def test_nodes_know_styles_dialogs_rows_and_cents():
    by_text = {n["text"]: n for n in pages.nodes_of(PAGE)}
    assert by_text["x"]["in_dialog"]
    assert [by_text[t]["rendered"] for t in ("Only 2 left", "Only 3 left", "Only 4 left", "Only 6 left")] == [False, False, False, True]
    assert by_text["$9 99"]["cents_child"]
    assert not by_text["99"]["cents_child"]
    assert by_text["$5.00"]["row_text"] == "wool mug $5.00"
    assert by_text["Only 6 left"]["has_progress"]


@pytest.mark.parametrize("html", ["", "</p>", "<", "<p>" * 300, '<script type="application/ld+json">{"a":' + "[" * 5_000 + "</script>", '<script type="application/ld+json">{"@type": 3, "x": [{"@type": ["Product", 4]}]}</script>'])
def test_odd_pages_do_no_harm(html):
    assert isinstance(pages.meta_of(html), dict)
    assert isinstance(pages.nodes_of(html), list)


ODD = ["<p>a<p/>b", '<p a="1"b="2">$1</p>', "<p id=a1 id=b2>Only 2 left</p>", "<a href=/c/>Only 3 left</a>", "<!-- Only 1 left --><p>Only 1 left<!-->", "x < y <p>Only 4 left", "<SCRIPT>Only <p>1</SCRIPT><p>Only 5 left", "<script>Only 6 left", "<p>Only 7 left &amp &#36;5", "<p title='&lt;'>Only 8 left</p >", "<svg><p>$3</p></svg><b hidden/>$4"]


@pytest.mark.parametrize("html", [PAGE, PAGE.upper(), *ODD])
def test_the_plain_reader_makes_the_tree_of_the_html_parser(html, monkeypatch):
    told = pages.meta_of(html), pages.nodes_of(html)
    monkeypatch.setattr(pages, "_plain", lambda html: None)
    assert told == (pages.meta_of(html), pages.nodes_of(html))


def test_plain_pages_do_not_go_through_the_html_parser(monkeypatch):
    monkeypatch.setattr(pages.HTMLParser, "feed", None)
    assert len(pages.nodes_of("<!doctype html>" + PAGE)) == len(pages.nodes_of(PAGE)) > 5


def test_null_pages_have_a_row_and_no_nodes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, PAGE)], "page_id long, html string")
    assert {r["page_id"]: len(r["nodes"]) for r in pages.scan(df).collect()}.keys() == {1, 2, 3}
    staged = page_pass.staged(pages.scan(df).selectExpr("page_id", "cast(null as string) as url", "meta", "nodes"))
    assert staged.count() == 3
    assert {r["page_id"] for r in page_pass.detect(staged).collect()} <= {3}


def test_requests_that_are_no_batches(spark):
    rows = [("a", "POST", "application/json", None), ("b", "POST", None, "{}"), ("c", "POST", "application/json", '{"v": 3, "records": 5}'), ("d", "POST", "application/json", '{"v": 3, "records": [7]}'), ("e", None, "application/json", "{}")]
    judged = ingest.judge(spark.createDataFrame(rows, "batch_id string, method string, content_type string, body string"), ("other",), 20_000)
    assert {r["batch_id"]: r["status"] for r in judged.collect()} == {"a": 400, "b": 415, "c": 400, "d": 422, "e": 405}


def test_numbering_in_ranges_is_the_row_number(spark):
    rows = [(k % 3, (k * k) % 997) for k in range(900)]
    got = sorted((r["k"], r["ord"], r["_nth"]) for r in corpus.numbered(spark.createDataFrame(rows, "k int, ord long"), "k", "ord", 16).collect())
    for key in range(3):
        assert [n for k, _, n in got if k == key] == sorted(n for k, _, n in got if k == key) or len({o for k, o, _ in got if k == key}) < 300
        assert sorted(n for k, _, n in got if k == key) == list(range(300))


def test_the_queue_of_admitted_rows_reads_the_batches_once(spark):
    record = '{"patternId": "a.b", "detectorId": "a.b@1", "funnelStage": "pdp", "site": "shop1.com", "originCategory": "other", "rulepackVersion": "1", "dayBucket": 20000, "confidenceQuartile": 2}'
    outcome = '{"patternId": "_page", "funnelStage": "pdp", "site": "shop1.com", "originCategory": "other", "rulepackVersion": "1", "dayBucket": 20000, "addedToCart": true}'
    rows = [("a", "POST", "application/json", f'{{"v": 3, "records": [{record}, {record}], "outcomes": [{outcome}]}}'), ("b", "POST", "application/json", f'{{"v": 3, "records": [{record}, 7], "outcomes": []}}')]
    judged = ingest.judge(spark.createDataFrame(rows, "batch_id string, method string, content_type string, body string"), ("other",), 20_000)
    queue = ingest.admitted_queue(judged)
    both = ingest.tagged_union(*ingest.admitted(judged))
    assert sorted(map(str, queue.select(both.columns).collect())) == sorted(map(str, both.collect()))
    assert queue.count() == 3
    plan = queue._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_object_keys") <= 2
