"""Pages as tables, JSON sources and sinks, rule packs, the short-text classifier."""

import json
import os

import numpy as np
import pytest

from suasion.functions import rules
from suasion.operators import classifier, evaluation
from suasion.sources import batches, pages

HTML = """<!DOCTYPE html><html lang="en"><head><title>Shop &amp; more</title><meta property="og:type" content="product">
<script type="application/ld+json">{"@type":"Product"}</script><style>p{margin:0}</style></head>
<body><div id="box"><p>Only 3 left<p>nothing here</p><del>$20.00</del> <a href="#" aria-label="Close">x</a><svg><text>50% off</text></svg></div>
<span id="lab">Gift wrap</span><input type="checkbox" aria-labelledby="lab"><ul><li>one<li>save 5%</ul><input autocomplete="cc-number"></body></html>"""


def test_nodes_of_a_page():
    nodes = pages.nodes_of(HTML)
    assert [(n["tag_name"], n["text"]) for n in nodes] == [("p", "Only 3 left"), ("del", "$20.00"), ("a", "x"), ("input", ""), ("li", "save 5%"), ("input", "")]
    assert nodes[0]["selector_path"] == "#box>p:nth-of-type(1)"
    assert nodes[1]["container_path"] == "#box"
    assert [nodes[2]["accessible_name"], nodes[3]["accessible_name"]] == ["Close", "Gift wrap"]
    assert all(n["parent_idx"] == -1 for n in nodes)
    assert pages.nodes_of("") == pages.nodes_of("</p>loose") == []


def test_pages_as_tables(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    assert pages.harvest(df).groupBy("page_id").count().collect()[0]["count"] == 6
    meta = {r["page_id"]: r for r in pages.page_meta(df).collect()}
    assert (meta[1]["title"], meta[1]["lang"], meta[1]["og_type"], meta[1]["has_cc_field"]) == ("Shop & more", "en", "product", True)
    assert json.loads(meta[1]["json_ld"][0]) == {"@type": "Product"}
    assert (meta[2]["title"], meta[2]["n_elements"], meta[3]["json_ld"]) == (None, 0, [])


def test_bodies_that_cannot_be_read_give_no_valid_record(spark):
    bodies = spark.createDataFrame([("a", "not json"), ("b", '{"v": 9, "records": [{"site": "x.com"}]}'), ("c", None), ("d", '{"v": 2, "records": [{"site": "x.com", "quartile": 2}]}')], "batch_id string, body string")
    got = {r["batch_id"]: (r["site"], r["quartile"]) for r in batches.records_of(bodies).collect()}
    assert got == {"a": (None, None), "b": (None, None), "c": (None, None), "d": ("x.com", 2)}


def test_json_lines_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    batches.append_jsonl(spark.createDataFrame([(1, "a")], "ord long, text string"), path)
    batches.append_jsonl(spark.createDataFrame([(2, "b")], "ord long, text string"), path)
    (tmp_path / "log" / "torn.json").write_text('{"ord": 3, "text": "c"}\n{"ord": 4, "te')
    assert sorted(tuple(r) for r in batches.read_jsonl(spark, path, "ord long, text string").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    batches.export_chunks(spark.range(10).withColumnRenamed("id", "ord"), str(tmp_path / "chunks"), 3)
    assert sorted(d for d in os.listdir(tmp_path / "chunks") if d.startswith("chunk=")) == ["chunk=1", "chunk=2", "chunk=3"]


def test_view_export_knows_its_views(spark, tmp_path):
    views = {"pattern_reach": spark.range(3)}
    batches.export_view(views, "pattern_reach", str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == 3
    with pytest.raises(ValueError, match="no such view"):
        batches.export_view(views, "users", str(tmp_path / "w"))


def test_events_are_flattened(spark):
    df = spark.sql("select 'd@1' as detector_id, 'p.q' as pattern_id, 0.5D as confidence, named_struct('text_hash', 'h') as evidence")
    row = batches.export_events(df).first()
    assert (row["detector_id"], row["evidence_text_hash"], row["evidence_text_sample"], row["salience_visible_ms"]) == ("d@1", "h", None, None)


def test_rule_packs_are_read_and_applied(spark, tmp_path):
    (tmp_path / "pack.json").write_text(json.dumps({"schemes": ["about:"], "hostSuffixes": [".gov"], "hostPatterns": [r"(^|\.)[a-z0-9-]*bank[a-z0-9-]*\."]}))
    pack = batches.read_pack(spark, str(tmp_path / "pack.json"))
    df = spark.createDataFrame([("https://irs.gov/x", True), ("about:blank", True), ("https://my-bank.co/", True), ("https://riverbanks.shop.com/", True), ("https://shop.com/bank.", False)], "url string, want boolean")
    assert all(r["d"] == r["want"] for r in df.withColumn("d", rules.denied(df["url"], **pack)).collect())


def test_features_match_a_plain_count():
    text = "Only  3 Left — naïve"
    padded, want = " only 3 left — naïve ", {}
    for n in (3, 4, 5):
        for i in range(len(padded) - n + 1):
            h = 2166136261
            for c in padded[i : i + n]:
                h = (h ^ ord(c)) * 16777619 % 2**32
            want[h % 4096] = want.get(h % 4096, 0) + (-1 if h >> 31 else 1)
    size = sum(v * v for v in want.values()) ** 0.5
    at, v = classifier.features(text)
    assert set(at.tolist()) == set(want)
    assert np.allclose(v, [want[k] / size for k in at.tolist()])
    at, v = classifier.features(text, (True, False, 9.0))
    got = dict(zip(at.tolist(), v.tolist(), strict=True))
    assert got[4088] == 1.0
    assert got[4090] == 2.0


def test_classifier_learns_each_pattern(spark):
    rows = [(p, f"{w} {k}", int(w == p)) for p in ("hurry up", "sold out") for w in ("hurry up", "sold out", "plain words") for k in range(12)] + [("sold out", None, 0)]
    models = classifier.fit(spark.createDataFrame(rows, "pattern_id string, text string, label int"))
    assert {r["pattern_id"]: r["trained_on"] for r in models.collect()} == {"hurry up": 36, "sold out": 37}
    texts = spark.createDataFrame([(1, "hurry up now"), (2, "nearly sold out"), (3, None)], "i long, text string")
    got = {(r["i"], r["pattern_id"]): r["score"] for r in classifier.score(texts, models, "i").collect()}
    assert got[1, "hurry up"] > 0.5 > got[1, "sold out"]
    assert got[2, "sold out"] > 0.5 > got[2, "hurry up"]
    assert classifier.score(texts.limit(0), models, "i").count() == 0


def test_ratchet_tells_a_regression_from_changed_labels(spark):
    shape = "pattern_id string, positives long, recall double"
    before = spark.createDataFrame([("a", 10, 0.8), ("b", 10, 0.8), ("c", 10, 0.8), ("d", 4, 0.5)], shape)
    now = spark.createDataFrame([("a", 10, 0.78), ("b", 10, 0.7), ("c", 9, 0.1), ("e", 3, 1.0)], shape)
    got = {r["pattern_id"]: r["verdict"] for r in evaluation.ratchet(now, before).collect()}
    assert got == {"a": "held", "b": "regressed", "c": "labels_changed", "d": "labels_changed", "e": "new"}
    assert evaluation.ratchet(now.limit(0), before.limit(0)).count() == 0


def test_classifier_learns_from_a_bounded_sample_of_any_rows(spark):
    rows = [("p", f"only {i} left", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, "pattern_id string, text string, label int")
    assert classifier.fit(labelled, max_rows=20).first()["trained_on"] == 20
    assert classifier.fit(labelled, max_rows=1_000).first()["trained_on"] == 400
    repeated = spark.createDataFrame([("p", "last one", 1)] * 300 + [("p", None, 0)] * 2, "pattern_id string, text string, label int")
    assert classifier.fit(repeated, max_rows=50).first()["trained_on"] == 50
