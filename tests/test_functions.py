"""Golden vectors of the scalar functions and detectors, and properties that hold for any text."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suasion.functions import color, money, rules, text, url
from suasion.operators import corpus, detectors, telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("$1,234.56", [(123456, "USD")]), ("1.234,56 €", [(123456, "EUR")]), ("$1.234", [(123400, "USD")]), ("$19.99", [(1999, "USD")]), ("¥1200", [(1200, "JPY")]), ("¥1,200", [(1200, "JPY")]), ("$1,200", [(120000, "USD")]),
        ("call 555 1234 for 10 items", []), ("$999999999.00", []), ("Was $89.99 Now $49.99", [(8999, "USD"), (4999, "USD")]), ("apple$184.0074% off", [(18400, "USD")]), ("$12.99flash sale$3.6010% off", [(1299, "USD"), (360, "USD")]),
        ("$1,234.56 total", [(123456, "USD")]), ("$999,999.00", [(99999900, "USD")]), ("$9.9", [(990, "USD")]), ("$9", [(900, "USD")]),
    ],
)
def test_prices(spark, line, want):
    assert [(p["amount"], p["currency"]) for p in one(spark, money.parse_prices(F.lit(line)))] == want


def test_formatting(spark):
    assert one(spark, money.format_minor(F.lit(123456), F.lit("USD"))) == "1234.56"
    assert one(spark, money.format_minor(F.lit(1200), F.lit("JPY"))) == "1200"


@pytest.mark.parametrize(
    ("host", "want"),
    [("www.booking.com", "booking.com"), ("tjmaxx.tjx.com", "tjx.com"), ("www2.hm.com", "hm.com"), ("www.marksandspencer.co.uk", "marksandspencer.co.uk"), ("shop.example.com.au", "example.com.au"), ("WWW.Booking.COM.", "booking.com"), ("cool-shop.myshopify.com", "cool-shop.myshopify.com"), ("jumia.com.ng", "jumia.com.ng")],
)
def test_registrable_domain(spark, host, want):
    assert one(spark, url.registrable_domain(F.lit(host))) == want


@pytest.mark.parametrize(("link", "want"), [("https://x.com/products/blue-shirt-12345?variant=7", "/products/:slug"), ("https://x.com/p/12345", "/p/:id"), ("nonsense", "/")])
def test_path_template(spark, link, want):
    assert one(spark, url.path_template(F.lit(link))) == want


def test_contrast(spark):
    assert round(one(spark, color.contrast_ratio(F.lit("#000"), F.lit("#ffffff"))), 3) == 21.0
    assert one(spark, color.contrast_ratio(F.lit("nope"), F.lit("#fff"))) is None
    assert round(one(spark, color.contrast_ratio(F.lit("rgba(0,0,0,0.5)"), F.lit("transparent"))), 2) == 3.98  # half black on white is grey of 127.5, not rounded to 128


def candidate(spark, raw, **more):
    row = {"page_id": 1, "idx": 1, "stage": "cart", "raw_text": raw, "text": raw.lower(), "has_progress": False, "is_control": False, "in_dialog": False, "ephemeral": False, "selector_path": "body>p"} | more
    kinds = {"page_id": "long", "idx": "long"} | {k: "boolean" for k in ("has_progress", "is_control", "in_dialog", "ephemeral")}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))
    return df.withColumn("text_history", F.array().cast("array<struct<t:double,text:string>>"))


def scores(spark, raw, **more):
    return {r["pattern_id"]: r["raw_score"] for r in detectors.run_text_detectors(candidate(spark, raw, **more)).collect()}


@pytest.mark.parametrize(
    ("raw", "pattern", "least"),
    [
        ("Only 3 left in stock", "scarcity.stock", 0.75), ("Selling fast", "scarcity.stock", 0.75), ("Only 3 rooms left at this rate", "scarcity.stock", 0.75), ("Limited time offer, ends 09/21", "urgency.countdown", 0.35), ("Ends 9/17/26", "urgency.countdown", 0.35), ("Book by Jan 7, 2027", "urgency.countdown", 0.35),
        ("23 people are viewing this right now", "social_proof.live_activity", 0.35), ("17 sold in the last 24 hours", "social_proof.live_activity", 0.35), ("You're $30 away from free shipping", "goal_gradient.threshold", 0.75), ("Only $30 until free shipping", "goal_gradient.threshold", 0.75),
    ],
)
def test_detectors_fire(spark, raw, pattern, least):
    assert scores(spark, raw)[pattern] >= least - 1e-9


@pytest.mark.parametrize("raw", ["2 sizes left", "3 colors available", "Ships in 3 business days", "Low stock items alerts", "Open until 21:00", "3:45", "1,203 reviews", "482 products found", "No thanks"])
def test_detectors_stay_silent(spark, raw):
    assert scores(spark, raw) == {}


def test_shaming_button(spark):
    got = scores(spark, "No thanks, I don't want to save money", is_control=True, in_dialog=True)
    assert got["confirmshaming.decline_copy"] == 1.0


def test_innermost_drops_wrappers(spark):
    rows = [(1, 1, "a>b", 0.5), (1, 2, "a>b>c", 0.5), (2, 3, "a>b", 0.5), (1, 4, "a>bc", 0.5)]
    kept = detectors.innermost(spark.createDataFrame(rows, "page_id long, idx long, selector_path string, raw_score double"))
    assert {r["idx"] for r in kept.collect()} == {2, 3, 4}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abcXYZ@.+ 0123456789-#\n", max_size=60))
def test_scrub_is_idempotent(spark, raw):
    once = one(spark, corpus.scrub(F.lit(raw)))
    assert one(spark, corpus.scrub(F.lit(once))) == one(spark, corpus.scrub(corpus.scrub(F.lit(once))))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=0, max_value=99_999_999))
def test_format_then_parse(spark, cents):
    written = F.concat(F.lit("$"), money.format_minor(F.lit(cents).cast("long"), F.lit("USD")))
    assert one(spark, money.parse_prices(written)[0]["amount"]) == cents


def test_fnv(spark):
    assert one(spark, text.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, text.fnv1a(F.lit(""))) == 2166136261


RULES = url.SuffixRules.parse(["// comment", "", "com", "co.uk", "*.ck", "!www.ck", "blogspot.com // private", "*.compute.example.com"])


@pytest.mark.parametrize(
    ("host", "want"),
    [
        ("a.b.shop.com", "shop.com"), ("com", "com"), ("shop.co.uk", "shop.co.uk"), ("x.shop.co.uk.", "shop.co.uk"), ("a.b.c.ck", "b.c.ck"), ("c.ck", "c.ck"), ("www.ck", "www.ck"), ("x.www.ck", "www.ck"), ("me.blogspot.com", "me.blogspot.com"),
        ("a.me.blogspot.com", "me.blogspot.com"), ("vm.eu.compute.example.com", "vm.eu.compute.example.com"), ("a.b.unheard", "b.unheard"), ("localhost", "localhost"), ("192.168.0.1", "192.168.0.1"), ("[::1]", "[::1]"), ("", ""),
    ],
)
def test_suffix_rules(spark, host, want):
    assert one(spark, url.registrable_domain(F.lit(host), RULES)) == want


def test_subdomains_are_one_site(spark):
    assert {one(spark, telemetry.site_of(F.lit(o))) for o in ("https://www.shop.com", "https://secure.eu.shop.com:8443/x", "https://shop.com")} == {"shop.com"}
    assert one(spark, telemetry.site_of(F.lit("http://shop.com"))) is None
    with pytest.raises(ValueError, match="suffix rules"):
        url.SuffixRules.parse(f"r{i}.com" for i in range(url.MOST_RULES + 1))


def test_pattern_tables_equal_one_by_one(spark):
    patterns = [f"{s}://{sub}{h}/{p}" for s in ("*", "http", "https", "ftp") for sub in ("", "*.") for h in ("a.com", "b.a.com", "com", "*", "", "A.com") for p in ("*", "x")] + ["nonsense", "https://a.com", None]
    urls = ["https://a.com/", "http://b.a.com:80/q", "https://c.b.a.com", "ftp://a.com/", "https://xa.com/", "https://u:p@A.COM/x", "about:blank", None, "https:///"]

    def fits(pattern, u):
        m = re.fullmatch(r"(\*|https?)://(\*\.)?([^/]*)(/.*)", pattern or "")
        seen = re.match(r"([a-z][a-z0-9+.-]*)://(?:[^@/?#]*@)?([^:/?#]+)", (u or "").lower())
        if not m or not seen or not m[3] or m[1] not in ("*", seen[1]):
            return False
        want = m[3].lower()
        return want == "*" or seen[2] == want or bool(m[2]) and seen[2].endswith("." + want)

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r["page_id"], r["pattern"]) for r in rules.matched_patterns(pages, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()}
    assert got == {(i, p) for i, u in enumerate(urls) for p in patterns if fits(p, u)}
    plan = rules.matched_patterns(pages, spark.createDataFrame([(p,) for p in patterns], "pattern string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    assert "CartesianProduct" not in plan
