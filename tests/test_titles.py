"""Pairs of titles against a look at every pair: repeated, null and empty names, and names held apart."""

import itertools
import random

import pytest

from suasion.operators import corpus


def grams(name):
    padded = f"  {name} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def brute(rows, least, apart):
    out = []
    for (k, a, s), (m, b, t) in itertools.combinations(sorted(r for r in rows if r[1] is not None), 2):
        if not apart or s == t:
            like = round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 9)
            if like >= least:
                out.append((k, m, like))
    return sorted(out)


@pytest.mark.parametrize(("least", "within"), [(0.85, ()), (0.5, ("shop",)), (1.0, ()), (0.3, ())])
def test_pairs_against_all_pairs(spark, least, within):
    r = random.Random(int(least * 100))
    words = ["red", "blue", "large", "larger", "ring", "rings", "bolt", "a", ""]
    rows = [(k, None if k % 17 == 0 else " ".join(r.choice(words) for _ in range(r.randrange(4))).strip(), r.choice("xy")) for k in range(90)]
    titles = spark.createDataFrame(rows, "id long, name string, shop string")
    got = sorted(tuple(x) for x in corpus.similar_titles(titles, "id", within, least).collect())
    assert got == brute(rows, least, bool(within))


def test_no_titles(spark):
    assert corpus.similar_titles(spark.createDataFrame([], "id long, name string"), "id", (), 0.8).count() == 0


def test_a_name_of_many_titles_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "CHUNK", 16)
    rows = [(k, "red ring" if k % 3 else "red rings", "x") for k in range(300)]
    pairs = corpus.similar_titles(spark.createDataFrame(rows, "id long, name string, shop string"), "id", (), 0.5)
    assert sorted(tuple(x) for x in pairs.collect()) == brute(rows, 0.5, False)
    sizes = pairs.rdd.glom().map(len).collect()
    assert max(sizes) < sum(sizes) / 2
