"""License scans, conversation repair and hard negatives against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from suasion.llm import conversation_repair as repair
from suasion.llm import hard_negatives as hard
from suasion.llm import license_scan as lic
from suasion.llm import queries

# --- license scans ---------------------------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for phrase, label in lic.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_phrases_equal_brute_force(docs):
    rng = random.Random(5)
    vocabulary = ["MIT", "License", "apache", "general", "Public", "license", "é", "x1", "", "-", "..", "\n", "Lİcense"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", ",", "/", ""]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["mit license mit license", "general public license license", None, "", "   ", "MIT License", "x " * 50_000 + "mit license"]
    out = queries._licenses(lic.scan(docs(list(enumerate(texts))))).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out] == [brute_base(t) for t in texts]
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)


@pytest.mark.parametrize(
    ("expression", "labels", "freedom"),
    [
        ("mit", {"mit"}, 0.9),
        ("mit or gpl-3.0-only", {"mit", "gpl"}, 0.9),
        ("mit and gpl-3.0-only", {"mit", "gpl"}, 0.4),
        ("mit or apache-2.0 and agpl-3.0", {"mit", "apache", "agpl"}, 0.9),
        ("(mit or apache-2.0) and agpl-3.0", {"mit", "apache", "agpl"}, 0.3),
        ("gpl-2.0+ with classpath-exception-2.0", {"gpl"}, 0.6),
        ("gpl-2.0 with classpath-exception-2.0 and mit", {"gpl", "mit"}, 0.6),
        ("mit and licenseref-house", {"mit"}, None),
        ("cc-by-nc-4.0 or cc-by-4.0", {"cc-by-nc", "cc-by"}, 0.8),
    ],
)
def test_expressions(expression, labels, freedom):
    assert lic.parse(expression) == (labels, freedom)


@pytest.mark.parametrize("expression", ["", "mit or", "or mit", "(mit", "mit)", "mit gpl", "()", "mit with (gpl)", "(mit or gpl) with x", "unknown-1.0", "see the file", "mit ; gpl"])
def test_malformed_expressions_say_nothing(expression):
    assert lic.parse(expression) is None


def brute_freedom(tokens):
    """By Python's own operators: min for and, max for or."""
    said = {"and": "&", "or": "|", "(": "(", ")": ")"}
    return eval(" ".join(said.get(t) or f"V({lic.FREEDOM[t]})" for t in tokens), {"V": _V}).x


class _V:
    def __init__(self, x):
        self.x = x

    def __and__(self, other):
        return _V(min(self.x, other.x))

    def __or__(self, other):
        return _V(max(self.x, other.x))


def test_shunting_yard_equals_another_parser():
    rng = random.Random(2)

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(["mit", "gpl", "agpl", "apache", "cc-by-nc", "cc0"])]
        inner = grow(depth - 1) + [rng.choice(["and", "or"])] + grow(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(300):
        tokens = grow(4)
        assert lic.parse(" ".join(tokens))[1] == brute_freedom(tokens)


def test_tags_and_notices(docs):
    texts = ["# SPDX-License-Identifier: (MIT OR GPL-2.0-only) */\ncode", "License: see LICENSE file", "Permission is hereby granted, free of charge, to any", "plain prose", "License: MIT License: GPL-3.0"]
    out = {r["doc_id"]: r for r in queries._licenses(lic.scan(docs(list(enumerate(texts))))).collect()}
    assert [out[i]["labels"] for i in range(5)] == ["gpl,mit", "", "mit", "", "gpl,mit"]
    assert out[0]["freedom"] == 0.9
    assert out[3]["score"] == 0
    assert out[0]["score"] > out[2]["score"] > 0


def test_license_scan_of_awkward_rows(spark, docs, awkward):
    assert lic.scan(docs(awkward)).count() == len(awkward)
    assert lic.scan(docs([])).count() == 0
    began = time.time()
    lic.scan_text(b"license: mit " * 100_000)
    lic.scan_text(b";" * 2_000_000 + b"license: " + b"(" * 500_000)
    assert time.time() - began < 10
    broken = spark.sql("select 1L as doc_id, cast(unhex('ff6d6974206c6963656e7365') as string) as text")
    assert queries._licenses(lic.scan(broken)).first()["n_words"] == 2


# --- conversation repair ---------------------------------------------------------------------------------------------

LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Every edit list with at most two inserts in a row, the cheapest and least of those that end in legal roles."""
    kinds = faults(rows)
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    edits = []
    for (role, text), kind in zip(rows, kinds, strict=True):
        more = 3 if kind == "truncated" else 0
        here = [("D", 4, None)]
        if kind not in ("blank", "duplicate"):
            here += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        edits.append(here)
    best = None
    for chosen in itertools.product(*edits):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit, cost, left = "", 0, []
            for i, gap in enumerate(inserts):
                audit, cost, left = audit + "I" * len(gap), cost + 3 * len(gap), left + [(r, "") for r in gap]
                if i < len(rows):
                    letter, price, row = chosen[i]
                    audit, cost = audit + letter, cost + price
                    left += [row] if row else []
            if best is not None and (cost, audit) >= best[:2]:
                continue
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in left)):
                best = (cost, audit, left)
    return best


def digest(left):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


CONV = "conv_id long, turn long, role string, text string, turns string, start int"


@pytest.fixture(scope="module")
def conversations(spark):
    def make(rows):
        return spark.createDataFrame([(c, t, r, x, "clash", 0) for c, t, r, x in rows], CONV)

    return make


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest + 1)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["a.", "b?", "cut", "", None, " \t", f"t{t}!"])))
    return rows


def by_conversation(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def test_repair_equals_brute_force(conversations):
    rows = random_rows(1, 60, 3)
    got = {r["conv_id"]: r for r in repair.repair(conversations(rows)).collect()}
    turns = {}
    for r in repair.repaired_turns(conversations(rows)).orderBy("conv_id", "position").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    wanted = by_conversation(rows)
    assert set(got) == set(wanted)
    for c, plain in wanted.items():
        cost, audit, left = brute_repair(plain)
        kinds = faults(plain)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(plain)]
        r = got[c]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, digest(left)), plain
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        assert turns.get(c, []) == left


def slow_program(rows):
    """The same program over (cost, audit) pairs, for conversations too long for every edit list."""
    best = {"": (0, "")}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                for to in step[state].values():
                    if to != "s":
                        best[to] = min(best.get(to, (9**9, "")), (cost + 3, audit + "I"))
        return best

    best = inserted(best)
    for (role, _), kind in zip(rows, faults(rows), strict=True):
        then = {}
        for state, (cost, audit) in best.items():
            more = 3 if kind == "truncated" else 0
            offers = [(state, cost + 4, "D")]
            if kind not in ("blank", "duplicate"):
                offers += [(step[state][role[:1]], cost + more, "K")] if role[:1] in step[state] else []
                offers += [(to, cost + 3 + more, "R") for to in step[state].values() if to != "s"]
            for to, price, letter in offers:
                then[to] = min(then.get(to, (9**9, "")), (price, audit + letter))
        best = inserted(then)
    return min(best[s] for s in ("", "a") if s in best)


def test_long_conversations_take_the_other_path_to_the_same_end(conversations, monkeypatch):
    rows = random_rows(3, 12, 60) + [(100, i, "user", "same.") for i in range(40)] + [(101, None, "user", "same.")] * 30
    whole = sorted(map(tuple, repair.repair(conversations(rows)).collect()))
    monkeypatch.setattr(repair, "SEGMENT_TURNS", 3)
    assert sorted(map(tuple, repair.repair(conversations(rows), max_turns=4).collect())) == whole
    turns = sorted(map(tuple, repair.repaired_turns(conversations(rows)).collect()))
    assert sorted(map(tuple, repair.repaired_turns(conversations(rows), max_bytes=30).collect())) == turns
    wanted = by_conversation(rows)
    for r in repair.repair(conversations(rows)).collect():
        assert (r["cost"], r["audit"]) == slow_program(wanted[r["conv_id"]])


def test_damage(conversations):
    rows = [(c, t, r, "One. Two! Three?") for c in range(40) for t, r in enumerate(["system", "user", "assistant", "user"])] + [(None, None, None, None)]
    got = {}
    for r in repair.damage(conversations(rows)).collect():
        got.setdefault(r["conv_id"], []).extend((t["turn"], bytes(t["role"]).decode(), bytes(t["text"]).decode()) for t in r["turns"])
    wanted = {}
    for c, t, r, x in rows:
        r, x = r or " ", x or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        made = {0: [], 1: [(t, r, "")], 2: [(t, r, re.sub("[.!?]", "", x))], 3: [(t, r, x)] * 2, 4: [(t, "user", x)]}.get(kind, [(t, r, x)])
        wanted.setdefault(c, []).extend(made)
    key = lambda v: sorted(v, key=str)
    assert {c: key(v) for c, v in got.items()} == {c: key(v) for c, v in wanted.items() if v or c in got}
    assert {r["conv_id"] for r in repair.repair(conversations(rows), repair.damage).collect()} == {r[0] for r in rows}


def test_awkward_conversations(spark, conversations):
    assert repair.repair(conversations([])).count() == 0
    assert repair.repaired_turns(conversations([])).count() == 0
    rows = [(None, None, None, None), (None, 5, "user", "hi."), (7, 1, "system", "alone."), (8, -(2**62), "user", "x" * 300_000), (8, 3, "assistant", "ok.")]
    got = {r["conv_id"]: r for r in repair.repair(conversations(rows)).collect()}
    assert (got[None]["audit"], got[None]["blank"], got[None]["gaps"]) == ("DKI", 1, 0)
    assert (got[7]["audit"], got[7]["cost"]) == ("D", 4)
    assert (got[8]["audit"], got[8]["cost"], got[8]["gaps"]) == ("KK", 3, 3 + 2**62 + 1 - 2)
    dropped = conversations([(c, 0, "user", "x.") for c in range(60)])
    empty = [r for r in repair.repair(dropped, repair.damage).collect() if not r["audit"]]
    assert empty
    assert all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["cost"] == r["gaps"] == 0 for r in empty)
    broken = spark.sql("select 1L as conv_id, 0L as turn, 'user' as role, cast(unhex('ff2e') as string) as text")
    assert repair.repair(broken).first()["repaired_sha256"] == hashlib.sha256(b"user:\xff.\nassistant:").hexdigest()


# --- hard negatives --------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, score string, rank int, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if x is None else [None if e is None else float(e) for e in x], y, "clash", 0, "v") for i, x, y in rows], VEC)

    return make


def brute_mine(rows, every, k=5, m=3):
    keep = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int), y) for i, x, y in rows if i is not None and y is not None and x is not None and all(e is not None and np.isfinite(e) for e in x)]
    width = max((len(x) for _, x, _ in keep), default=0)
    keep = [(i, np.pad(x, (0, width - len(x))), y) for i, x, y in keep]
    out = []
    for a, q, mine in keep:
        if a % every:
            continue
        scored = sorted((-int(q @ x), i, y) for i, x, y in keep if i != a)
        for p, pid in [(-s, i) for s, i, y in scored if y == mine][:k]:
            found = [(-s, i) for s, i, y in scored if y != mine and 50 * p <= -100 * s <= 95 * p][:m]
            out += [(a, pid, rank + 1, i, p, s) for rank, (s, i) in enumerate(found)]
    return sorted(out)


def clustered(seed, n, width=8, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, (centres[i % 6] + spread * rng.normal(size=width)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "width", "spread"), [(1, 400, 8, 0.15), (2, 300, 2, 0.02), (3, 250, 16, 1.5)])
def test_mining_equals_brute_force(vectors, monkeypatch, seed, n, width, spread):
    monkeypatch.setattr(hard, "LEAF", 8)
    monkeypatch.setattr(hard, "MIN_BLOCKS", 1)
    rows = clustered(seed, n, width, spread)
    assert sorted(map(tuple, hard.mine(vectors(rows), "vec_id % 10 = 0").collect())) == brute_mine(rows, 10)


def test_mining_of_awkward_rows(vectors):
    rows = clustered(4, 60, 3)
    rows += [(100, [1.0, 1.0, 1.0], 1)] * 3 + [(101 + i, [0.9, 0.9, 0.9], i % 2) for i in range(40)]
    rows += [(None, [1, 1, 1], 1), (200, None, 1), (201, [1, None, 1], 1), (202, [1, float("nan"), 1], 1), (203, [float("inf"), 0, 0], 1), (204, [1, 1, 1], None), (210, [0.5], 1), (220, [], 1), (230, [-1, -1, -1], 1)]
    wanted = brute_mine(rows[:60] + [rows[60]] + rows[63:], 10)
    got = sorted(map(tuple, hard.mine(vectors(rows), "vec_id % 10 = 0").collect()))
    # the two other rows of id 100 answer, but ask no second time
    other = [r for r in got if 100 not in (r[1], r[3])]
    assert {r for r in got if r[0] == 100} == {r for r in wanted if r[0] == 100}
    assert other
    assert hard.mine(vectors([]), "vec_id % 10 = 0").count() == 0
    assert hard.mine(vectors([(1, [1, 2], 0)]), "vec_id % 10 = 0").count() == 0


def test_cover_tree_covers_and_skips(monkeypatch):
    monkeypatch.setattr(hard, "LEAF", 8)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 6)) * 400
    x = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 6)) * 5)
    top = float(np.sqrt((x * x).sum(1).max()))
    y = hard.augmented(x, top)
    assert np.allclose((y * y).sum(1), top * top)
    tree = hard.cover_tree(y)
    seen, nodes = [], [tree]

    def members(node):
        return np.concatenate([node.bucket, *map(members, node.children)])

    while nodes:
        node = nodes.pop()
        below = members(node)
        assert np.sqrt(((y[below] - y[node.centre]) ** 2).sum(1)).max() <= node.radius + 1e-9
        seen.extend(node.bucket)
        nodes.extend(node.children)
    assert sorted(seen) == list(range(2000))
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                looked.append(len(at))
            return super().__getitem__(at)

    labels = rng.integers(0, 3, 2000)
    anywhere = np.full((1, 1), -(1 << 61)), np.full((1, 1), 1 << 61)
    found = hard.search(tree, x.astype(np.float32).view(Counted), np.arange(2000), labels, x[:1], np.zeros(1, int), labels[:1], *anywhere, True, 5, np.float32)
    s = x @ x[0]
    fit = [i for i in np.lexsort((np.arange(2000), -s)) if i and labels[i] == labels[0]][:5]
    assert found.row.tolist() == fit
    assert hard.search(None, x[:0], np.zeros(0, int), np.zeros(0, int), x[:1], np.zeros(1, int), labels[:1], *anywhere, True, 5, np.float32).row.size == 0
