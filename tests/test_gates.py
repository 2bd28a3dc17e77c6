"""Gates: what JSON-LD sells, fixtures with personal data, and which digests a shopper's setting lets through."""

import json
import random

import pytest
from pyspark.sql import functions as F

from suasion.operators import corpus, digest, history, json_ld, ledger, pages
from suasion.sources import fixtures

OFFER = {"@type": "Offer"}


def nest(x, n, wrap=lambda x: {"a": x}):
    for _ in range(n):
        x = wrap(x)
    return x


@pytest.mark.parametrize(
    ("blocks", "sells"),
    [
        ([json.dumps(OFFER)], True),
        ([json.dumps(nest(OFFER, 6))], True),
        ([json.dumps(nest(OFFER, 7))], False),
        ([json.dumps(nest(OFFER, 6, lambda x: [x]))], True),
        ([json.dumps(nest(OFFER, 7, lambda x: [x]))], False),
        (['{"offers": null}'], True),
        (['{"@type": [1, null, "Order"]}'], True),
        (['{"@type": [["Order"]]}'], False),
        (['{"name": "Offer", "@type": {"x": "Offer"}}'], False),
        (["{broken", '{"b": {"priceCurrency": "USD"}}'], True),
        (["{broken", None, "", "null", "[]", '"offers"'], False),
    ],
)
def test_selling(spark, blocks, sells):
    got = json_ld.selling(spark.createDataFrame([(1, blocks, "x")], "page_id long, json_ld array<string>, _node string"))
    assert [tuple(r) for r in got.collect()] == [(1, sells)]


def test_pages_without_blocks_are_left_out(spark):
    assert json_ld.selling(spark.createDataFrame([(1, []), (2, None)], "page_id long, json_ld array<string>")).count() == 0


def test_selling_reads_its_pages_once(spark):
    plan = json_ld.selling(spark.range(9).select(F.col("id").alias("page_id"), F.array(F.lit("{}")).alias("json_ld")))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Range (") == 1 and physical.count("Exchange") <= 1 and "Python" not in physical


def test_blocks_of_html(spark):
    html = """<SCRIPT id=x type='application/ld+json' async>{"a": ">"}</script> <script type=application/ld+json>{2}</script><script
    type="application/ld+json">{3}</script><script>no</script><script type='text/x' data-type="application/ld+json">x</script><script type="application/ld+jsonx">y</script>"""
    assert spark.createDataFrame([(html,)], "h string").select(json_ld.blocks(F.col("h"))).first()[0] == ['{"a": ">"}', "{2}", "{3}"]


def test_an_offer_counts_only_without_a_product(spark):
    names = [*pages.BOOLEANS, "sells_ld"]
    rows = [(k, *([False] * len(pages.BOOLEANS)), sells, *([0] * len(pages.COUNTS))) for k, sells in enumerate([True, False, None, True])]
    rows[3] = (3, *(n == "has_product_ld" for n in pages.BOOLEANS), True, *([0] * len(pages.COUNTS)))
    schema = "page_id long, " + ", ".join(f"{n} boolean" for n in names) + ", " + ", ".join(f"{n} int" for n in pages.COUNTS)
    got = {r.page_id: (r.commerce_score, r.reasons) for r in pages.commerce(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: (1.0, "offer"), 1: (0.0, ""), 2: (0.0, ""), 3: (1.0, "product")}


def test_clean_fixtures_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a plain page"), (2, None), (3, "")], "id long, html string")
    assert fixtures.write_clean(rows, str(tmp_path / "out")) == 3
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["id", "html"]


def test_one_find_fails_the_job_and_is_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a plain page"), (2, "mail a@example.com or b@example.com"), (3, "ssn 123-45-6789")], "id long, html string").repartition(3)
    with pytest.raises(fixtures.PersonalData) as refused:
        fixtures.write_clean(rows, str(tmp_path / "out"))
    assert (refused.value.hits, refused.value.kept) == ({"email": 2, "ssn": 1}, 1)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_no_fixtures(spark, tmp_path):
    assert fixtures.write_clean(spark.createDataFrame([], "id long, html string"), str(tmp_path / "out")) == 0


def walk(rows):
    """Digest after digest, remembering what was shown."""
    out, origins, seen = {}, set(), set()
    for session, origin, stage, page, _, seq, setting in sorted(rows, key=lambda r: (r[4], r[5])):
        site, key = (session, origin), (session, origin, stage, page)
        if setting in ("off", "never_interrupt"):
            out[seq] = (False, "user_disabled")
        elif (setting == "once_per_site" and site in origins) or key in seen:
            out[seq] = (False, "debounced")
        else:
            out[seq] = (True, "none")
            origins.add(site)
            seen.add(key)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_settings_against_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(4), r.choice("ab"), r.choice(["cart", None]), r.choice("xy"), r.randrange(30), i, r.choice(["off", "never_interrupt", "once_per_site", "once_per_page", None])) for i in range(250)]
    got = digest.gate(spark.createDataFrame(rows, "session_id long, origin string, stage string, page string, ts_ms long, seq long, frequency string"), F.col("frequency"))
    assert {x.seq: (x.show, x.reason) for x in got.collect()} == walk(rows)


def test_offers_keep_each_series_apart(spark):
    looks = spark.createDataFrame([("o", "a", t) for t in range(200)] + [("o", "quiet", 5)], "origin string, offer_key string, ts_ms long")
    said = [("o", "a", t, 2 * t + k, s, t, s[0]) for t in range(200) for k, s in enumerate(("viewers", "stock"))] + [("o", "a", 7, 999, "timers", 70, "c"), ("o", "a", 7, 998, "unheard", 70, "c")]
    claims = spark.createDataFrame(said, "origin string, offer_key string, ts_ms long, seq long, series string, n long, tag string")
    got = {x.offer_key: x for x in history.merge_observations(looks, claims).collect()}
    assert [x.n for x in got["a"].viewers] == list(range(72, 200)) and [x.n for x in got["a"].stock] == list(range(136, 200))
    assert [(x.n, x.tag) for x in got["a"].timers] == [(70, "c")] and got["a"].prices == [] and got["a"].sightings == 200
    assert (got["quiet"].sightings, got["quiet"].timers, got["quiet"].first_seen) == (1, [], 5)


def test_a_base_is_the_subtotal_or_the_displayed_price(spark):
    rows = [(1, 100, 500, 5, None, 120), (2, None, 200, None, 7, None), (3, None, None, 1, 1, 9), (4, 0, 300, None, None, 50), (5, 100, None, None, None, 90)]
    snapshots = spark.createDataFrame([(k, "o", "cart", *r) for k, *r in rows], "session_id long, origin string, stage string, subtotal long, displayed long, shipping long, tax long, total long")
    fees = spark.createDataFrame([(1, "o", "cart", "Service fee", 10), (1, "o", "cart", "Promo discount", 3), (2, "o", "cart", "Gift wrap", 4)], "session_id long, origin string, stage string, label string, amount long")
    got = {x.session_id: (x.base, x.fee_total, x.mandatory_total, x.unexplained) for x in ledger.reconcile(snapshots, fees).collect()}
    assert got == {1: (100, 10, 10, 5), 2: (200, 4, 0, 0), 3: (None, 0, 0, None), 4: (0, 0, 0, None), 5: (100, 0, 0, -10)}


def test_a_seed_gives_the_same_picks_and_another_seed_others(spark):
    rows = spark.range(500).select(F.col("id").alias("ord"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("tier"))
    picks = lambda data, seed: {x.ord for x in corpus.build_queue(data, 40, seed).collect()}
    first = picks(rows, "one")
    assert first == picks(rows.repartition(7), "one") != picks(rows, "two") and len(first) == 40
