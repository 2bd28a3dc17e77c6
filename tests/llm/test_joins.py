"""Near-duplicates, top-k, decontamination, sharding, line dedup and URL filters against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from suasion.llm import components, decontaminate, line_dedup, ngram_join, sharding, topk, url_filter, url_labels


def brute_components(rows, words, num):
    sets = {}
    for i, t in rows:
        ws = [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        s = {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set())
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, sets


def near_rows(seed, n_base=12, copies=8, length=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = rng.choices(vocabulary, k=15)
    rows, i = [], 0
    for _ in range(n_base):
        base = rng.choices(vocabulary, k=length) + shared
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((i, " ".join(text)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "num", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_components_match_brute_force(docs, awkward, words, num, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 5)  # small tiles: the split paths run too
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", 200)
    rows = near_rows(seed) + [(i + 1000, t) for i, t in awkward if i is not None] + [(2000, "a b c"), (2001, "A  b\nC"), (2002, "a b")]
    want, sets = brute_components(rows, words, num)
    got = ngram_join.jaccard_components(docs(rows), words, (num, 100)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(any(r["n_shingles"] == len(s) for s in sets[r["doc_id"]]) for r in got)


def test_a_document_is_linked_by_any_of_its_texts(docs):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, b), (5, a), (5, b), (7, a + " more"), (9, "alone"), (7, "")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs(rows), 3, (90, 100)).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (9, 9)}


def test_hot_shingles_are_counted_in_parts(spark):
    nodes = spark.createDataFrame([(1, 1, b"", [7]), (2, 1, b"", [7])], "doc_id long, n long, counts binary, prefix array<long>")
    plan = ngram_join._allowed_edges(nodes, (90, 100))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_trees_lose_no_pair():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for _ in range(200):
        s = base[rng.integers(6)].copy()
        swap = rng.integers(0, len(s), rng.integers(0, 12))
        s[swap] = rng.integers(0, 2**63, len(swap), dtype=np.uint64)
        sets.append(np.unique(s))
    nodes, sizes = np.arange(200), np.array([len(s) for s in sets])
    forest = ngram_join.Forest(200)
    for a, b in ngram_join.allowed_forest(nodes, sizes, [ngram_join.count_vector(s) for s in sets], np.array([0, 200]), (90, 100)):
        forest.join(int(a), int(b))
    links = 0
    for a, b in itertools.combinations(range(200), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 90 * (sizes[a] + sizes[b] - both):
            links += 1
            assert forest.find(a) == forest.find(b)
    assert links > 100


def test_count_vector_keeps_what_goes_over_a_byte():
    many = (np.arange(5000, dtype=np.uint64) * np.uint64(1024)) + np.uint64(1)
    vector = ngram_join.count_vector(many)
    counts, over = ngram_join._unpack(vector, 64)
    assert counts.sum() + over == 5000


def test_one_document_of_each_group_stays(docs):
    rows = near_rows(5)
    want, _ = brute_components(rows, 5, 80)
    kept = ngram_join.drop_near_duplicates(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == docs(rows).columns
    assert ngram_join.drop_near_duplicates(docs([])).count() == 0


def test_connected_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k):
    points = {}
    order = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        order.append((i, np.array([np.floor(64 * float(np.float32(x))) for x in v])))
        points[i] = order[-1][1]
    out = set()
    for q, v in order:
        if q % 20 == 0:
            scored = sorted((-int(v @ w), i) for i, w in order if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8).astype(np.float32)]) for i in range(240)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # one very common vector: ties
    rows += [(500, None), (520, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, "vec_id % 20 = 0", 20).collect()}
    assert got == brute_top(rows, 20)


def test_top_k_with_few_rows(spark):
    df = spark.createDataFrame([(20, [0.5, 0.25]), (1, [0.25, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0").collect()] == [(20, 1, 1, 32 * 16 + 16 * 64)]
    assert topk.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0


def edit_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i in range(1, len(item) + 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (item[i - 1] != c))
        best = min(best, row[-1])
    return best


def test_myers_matches_dynamic_programming():
    rng = random.Random(6)
    for _ in range(150):
        item = "".join(rng.choices("ab c", k=rng.randint(1, 90)))
        text = "".join(rng.choices("ab c", k=rng.randint(0, 120)))
        assert decontaminate.best_substring(item, text)[0] == edit_distance(item, text)


def test_leaks_match_brute_force(docs, awkward, spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(200)]
    items = [" ".join(rng.choices(words, k=14)) for _ in range(6)]
    rows = list(awkward)
    for i in range(100, 160):
        text = " ".join(rng.choices(words, k=40))
        if i % 3 == 0:
            leak = list(rng.choice(items).upper() if i % 2 else rng.choice(items))
            for _ in range(rng.choice([0, 2, 5, 9, 20])):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            text = text[:70] + "".join(leak) + text[70:]
        rows.append((i, text))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "  ")], "item_id long, text string")
    want = {(i, n) for i, t in rows if t and i is not None for n, item in enumerate(items) if edit_distance(item, t.lower()[:3000]) <= int(len(item) * decontaminate.ERROR_RATE)}
    found = decontaminate.find_leaks(docs(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    texts = dict(rows)
    for r in found:
        assert edit_distance(items[r["item_id"]], texts[r["doc_id"]].lower()[r["start"] : r["end"]]) == r["distance"]
    clean = decontaminate.decontaminate(docs(rows), bench)
    assert clean.count() == len(rows) - len({i for i, _ in want})
    assert decontaminate.find_leaks(docs(rows), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs([]), bench).count() == 0


def test_many_items_go_in_blocks(docs, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 30)
    bench = spark.createDataFrame([(k, f"the {k}th item of a test of ours") for k in range(5)], "item_id long, text string")
    rows = [(k, f"before the {k}th item of a test of ours after") for k in range(5)]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(rows), bench).filter("distance = 0").collect()} == {(k, k) for k in range(5)}


def test_shards_are_contiguous_even_and_gapless(docs, awkward, tmp_path):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(900)] + [(i + 5000, t) for i, t in awkward if i is not None]
    got = sharding.assign_shards(docs(rows), 7).collect()
    assert len(got) == len(rows)
    by_id = sorted(got, key=lambda r: (r["doc_id"], r["text_crc32"], r["size"]))
    assert [r["shard"] for r in by_id] == sorted(r["shard"] for r in got)
    texts = dict(rows)
    total = 0
    for s in range(7):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        total += sum(r["size"] for r in mine)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    small = sharding.assign_shards(docs(rows[:900]), 7).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in small) - min(r[1] for r in small) <= 900
    assert sharding.assign_shards(docs([])).count() == 0
    assert sharding.assign_shards(docs([(None, "a"), (1, None)]), 2).count() == 2
    sharding.write_shards(docs(rows[:50]), str(tmp_path / "out"), 3)
    assert len(list((tmp_path / "out").glob("shard=*"))) == 3


def test_line_dedup_matches_brute_force(docs):
    long_a, long_b = "Subscribe to our newsletter for more of this content", "ALL rights reserved by the owners of these very words"
    rows = [(i, f"{'  ' * (i % 2)}{long_a.upper() if i % 3 else long_a}\nown line {i}\n{long_b if i < 4 else 'short'}\n") for i in range(8)]
    rows += [(20, None), (21, ""), (22, long_a), (22, long_a), (None, long_a)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(rows)).collect() if r["doc_id"] is not None}
    keeper = 22
    for i, t in rows:
        if i is None:
            continue
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (x.strip(" \t\n\x0b\x0c\r").lower() == long_a.lower() and i != keeper)]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert "lang" in line_dedup.dedup_lines(docs(rows)).columns
    assert line_dedup.dedup_lines(docs([])).count() == 0


URLS = [
    (1, "http://a.example.com/en/1"), (2, "https://www.example.com/en/2?x"), (3, "HTTP://Shop.NET/es/3"), (4, "http://x.net/en/4"), (5, None), (6, "no scheme"), (7, "http://host.com"), (8, "http://net/fr/"), (9, "http://evilexample.com/en/9"), (9, "http://evilexample.com/en/9"),
    (10, "http://ÉA.org/fr/1#f"), (11, "x://"), (12, "http://" + "a" * 20_000 + ".org/" + "b" * 20_000),
]


def test_urls_are_taken_apart_and_ruled(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as verdict")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, url_labels.labelled_urls(spark)).collect()}
    fits = {k: (r["host"], r["path"], r["rule"]) for k, r in got.items()}
    assert fits[1] == ("a.example.com", "/en/1", "example.com/en/")
    assert fits[2] == ("www.example.com", "/en/2", "www.example.com/en/")
    assert fits[3] == ("shop.net", "/es/3", "net/es/")
    assert fits[4] == ("x.net", "/en/4", None)
    assert fits[5] == fits[6] == ("", "", None)
    assert fits[7] == ("host.com", "", None)
    assert fits[8] == ("net", "/fr/", "net/fr/")
    assert fits[9] == ("evilexample.com", "/en/9", "com/")
    assert fits[10][0] == "Éa.org"
    assert (got[1]["verdict"], got[2]["verdict"], got[3]["verdict"]) == ("block", "allow", "block")
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}


def test_url_classifier_learns_from_its_table(spark):
    rows = [(f"http://{c}{k}.org/{'casino' if k % 2 else 'garden'}/{k}", float(k % 2)) for k in range(60) for c in "ab"]
    labelled = spark.createDataFrame(rows, "url string, label double")
    pages = spark.createDataFrame([(1, "http://zz.org/casino/77"), (2, "http://zz.org/garden/78")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, labelled, ()).collect()} == {1: "block", 2: "allow"}
    assert {r["verdict"] for r in url_filter.filter_urls(pages, labelled.limit(0), ()).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), labelled, ()).count() == 0


def test_line_hash_is_of_the_stripped_folded_line(spark):
    df = spark.createDataFrame([("\t A b\x0b",)], "s string").select(line_dedup.line_key("s").alias("k"))
    assert df.first()["k"] == "a b"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_sharded_documents_keep_every_row_and_column(docs, awkward, spark, tmp_path):
    rows = awkward + [(6, "alpha beta gamma")] * 4 + [(k, f"text {k} " * (k % 9)) for k in range(200, 260)]
    frame = docs(rows).withColumnsRenamed({"lang": "slot", "source": "mark", "label": "Size"})
    out = sharding.shard_documents(frame, 5)
    assert out.columns == ["doc_id", "text", "slot_", "mark", "n_chars", "score", "shard_", "held_out", "Size_", *sharding.RESULT]
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(i), t or "") for i, t in rows)
    for s in range(5):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    sharding.write_shards(frame, str(tmp_path / "whole"), 5)
    assert spark.read.parquet(str(tmp_path / "whole")).count() == len(rows)


def test_line_dedup_of_long_texts_and_clashing_columns(docs):
    line = "Subscribe to our newsletter for more of this content"
    rows = [(i, f"{line}\nown {i}") for i in range(6)] + [(7, "\n".join([line, "short"] * 20_000)), (7, line), (8, None)]
    frame = docs(rows).withColumnsRenamed({"score": "dropped", "shard": "_owner", "label": "lines", "lang": "digest", "source": "N_lines"})
    out = line_dedup.dedup_lines(frame)
    assert out.columns == ["doc_id", "digest", "n_chars", "dropped", "_owner", "held_out", "lines", "text", "n_lines", "n_dropped"]
    got = sorted(out.collect(), key=lambda r: (r["doc_id"], r["n_lines"]))
    assert [(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got] == [*((i, 2, 1) for i in range(6)), (7, 1, 0), (7, 40_000, 0), (8, 1, 0)]
    assert {r["dropped"] for r in got} == {9.0}
    more = line_dedup.dedup_lines(docs([*rows, (9, line)])).filter("doc_id = 7 and n_lines > 1").first()
    assert (more["n_dropped"], more["text"]) == (20_000, "\n".join(["short"] * 20_000))


def test_near_duplicates_of_clashing_columns(docs):
    frame = docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, None)]).withColumnsRenamed({"score": "gone", "shard": "_gone", "label": "component_id"})
    out = ngram_join.drop_near_duplicates(frame)
    assert out.columns == frame.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 3]


def test_url_table_generalises(spark):
    """Five folds by crc32 of the url: learnt from four of them, judged on the fifth."""
    table = url_labels.labelled_urls(spark)
    right = []
    for k in range(5):
        held = F.crc32("url") % 5 == k
        asked = table.filter(held).selectExpr("url as page_id", "url", "label")
        got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(asked, table.filter(~held), ()).collect()}
        right += [(got[r["url"]] == "block") == (r["label"] == 1.0) for r in asked.collect()]
    assert len(right) == 180
    assert np.mean(right) >= 0.75


def test_url_rules_and_grams_match_a_plain_loop(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string")
    for r in url_filter.ruled(df).collect():
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fits)[1:] if fits else (None, None))
    text = "^shop.example.org /a?$".replace("?", "")
    got = spark.createDataFrame([("shop.example.org", "/a")], "host string, path string").select(url_filter._grams(F.col("host"), F.col("path")).alias("g")).first()["g"]
    assert sorted(got) == sorted(text[i : i + n] for n in url_filter.GRAMS for i in range(len(text) - n + 1))


def all_occurrences(item, text, k):
    """The rule of the module over a whole text, by plain dynamic programming."""
    out, low = [], 0
    while True:
        row, best, stop = list(range(len(item) + 1)), None, len(text)
        for j in range(low, len(text)):
            if j >= stop:
                break
            last, row[0] = row[0], 0
            for i in range(1, len(item) + 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (item[i - 1] != text[j]))
            if row[-1] <= k and (best is None or row[-1] < best[0]):
                if best is None:
                    stop = j + 1 + 3 * k
                best = (row[-1], j + 1)
        if best is None:
            return out
        out.append(best)
        low = best[1]


def test_every_occurrence_matches_brute_force_over_whole_texts():
    rng = random.Random(41)
    items = [(k, "".join(rng.choices("abc de", k=rng.choice([5, 9, 14, 30, 61, 120])))) for k in range(14)] + [(20, "ab " * 15), (21, "é漢 🙂x" * 6)]
    items = [(i, t) for i, t in items if t.strip()]
    texts = ["ab " * 60, "", "é漢 🙂x" * 13, "word " * 9_000 + items[5][1].upper() + "tail"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 6)):
            leak = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(leak))
                leak[at] = rng.choice(["", "z", leak[at] + "z"])
            parts += ["".join(rng.choices("abc dexyz", k=rng.randint(0, 30))), "".join(leak)]
        texts.append("".join(parts))
    matcher = decontaminate.Matcher(items)
    got = {}
    for row, n, distance, start, end in matcher.occurrences(texts):
        got.setdefault((row, n), []).append((distance, end))
        assert edit_distance(items[n][1], decontaminate.fold(texts[row])[start:end]) == distance
    want = {}
    for row, text in enumerate(texts):
        for n, (_, item) in enumerate(items):
            if len(text) < 5_000 or n in (5, 14):
                found = all_occurrences(item, decontaminate.fold(text), int(len(item) * decontaminate.ERROR_RATE))
                if found:
                    want[row, n] = found
    assert {k: v for k, v in got.items() if len(texts[k[0]]) < 5_000 or k[1] in (5, 14)} == want
    assert [e for _, e in got[0, items.index((20, "ab " * 15))]] == [45, 90, 135, 180]


def test_decontamination_of_clashing_columns_ties_and_bad_bytes(docs, spark):
    bench = spark.createDataFrame([(1, "an item that is long enough to be found"), (2, "an item that is long enough to be found")], "item_id long, text string")
    frame = docs([(5, "x AN item that is long enough to be found y"), (5, "x AN item that is long enough to be found y"), (6, "z")]).withColumnsRenamed({"score": "item_id", "shard": "start", "label": "distance"})
    found = sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["distance"]) for r in decontaminate.find_leaks(frame, bench).collect())
    assert found == [(5, 1, 2, 41, 0)] * 2 + [(5, 2, 2, 41, 0)] * 2
    assert [r["doc_id"] for r in decontaminate.decontaminate(frame, bench).collect()] == [6]
    bad = spark.range(1).selectExpr("7L as doc_id", "cast(X'FFFE' as string) || 'an item that is long enough to be found' as text")
    assert decontaminate.find_leaks(bad, bench).count() == 2


def test_a_large_benchmark_is_one_pass(spark):
    items = spark.range(20_000).selectExpr("id as item_id", "concat('question ', sha2(string(id), 256)) as text")
    documents = spark.range(40).selectExpr("id as doc_id", "concat('before question ', sha2(string(id * 7), 256), ' after') as text")
    found = decontaminate.find_leaks(documents, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, 7 * k) for k in range(40)}
