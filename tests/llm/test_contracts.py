"""The registered queries as they are registered: columns, types and laws of their contracts, over whole tables."""

import itertools
import os
import re
import zlib

import duckdb
import pytest

from suasion.llm import queries
from suasion.sources.tables import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SCORED = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
COLUMNS = {
    "op1_toxicity": SCORED,
    "op2_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op3_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op4_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op7_decontaminate": {"doc_id": "bigint", "item_id": "bigint"},
    "op8_quality": SCORED,
    "op9_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op11_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op12_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op10_mixing": {"doc_id": "bigint", "rate": "double", "copies": "bigint"},
}
ROWS = {"op9_url_filter": "pages", **dict.fromkeys(("op1_toxicity", "op2_ngram_join", "op4_sharding", "op5_secret_scan", "op6_line_dedup", "op8_quality", "op10_mixing", "op11_license_scan"), "documents")}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_keeps_its_contract(spark, name):
    out = queries.QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    if name in ROWS:
        assert len(rows) == table(spark, SF, ROWS[name]).count()
    if COLUMNS[name] is SCORED:
        least = 0.5 if name == "op1_toxicity" else 0.3
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    if name == "op9_url_filter":
        assert {r["verdict"] for r in rows} <= {"allow", "block"}
    if name == "op7_decontaminate":
        assert rows


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert rows


def test_op2_equals_brute_force(spark):
    """Every pair of texts of the smallest table, by the contract's words and shares."""
    sets = {}
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op2_ngram_join"](spark, SF).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
