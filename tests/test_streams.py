"""Keyed streams and stored tables: several batches, restarts, repeats and late rows against plain folds."""

import datetime as dt
import json
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from suasion.operators.telemetry import COHORT
from suasion.sources import changes
from suasion.streaming import counters, ledger, queue, watch
from suasion.streaming.run import STORE, drain, settings

T0 = dt.datetime(2024, 1, 1)
MS0 = 1_704_067_200_000
MESSAGE = "client_id long, origin string, session_id string, ts timestamp, seq long, kind string, stage string, snapshot long, ref string, selected boolean"


def stamp(ms):
    return (T0 + dt.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds") + "Z"


def put(folder, name, rows):
    """A file of rows; files are taken in the order in which they are put."""
    folder.mkdir(exist_ok=True)
    made = 1_700_000_000 + len(list(folder.iterdir()))
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    os.utime(folder / f"{name}.json", (made, made))


# --- ledger ----------------------------------------------------------------------------------------------------------


def message(client, session, ms, seq, kind, **more):
    return {"client_id": client, "origin": "https://a.com", "session_id": session, "ts": stamp(ms), "seq": seq, "kind": kind, **more}


def fold(messages):
    """The same ledgers by a plain loop over all messages at once."""
    out, now, seen = {}, {}, set()
    for m in sorted(messages, key=lambda m: (m["client_id"], m["ts"], m["seq"])):
        if (m["client_id"], m["seq"]) in seen:
            continue
        seen.add((m["client_id"], m["seq"]))
        ms = round((dt.datetime.fromisoformat(m["ts"].rstrip("Z")) - T0).total_seconds() * 1000)
        have = now.get(m["client_id"])
        if have is None or have["session"] != m["session_id"] or ms - have["last"] > 86_400_000:
            have = now[m["client_id"]] = {"session": m["session_id"], "stages": {}, "add": [], "choice": [], "event": [], "digest": []}
            out[(m["client_id"], m["session_id"], MS0 + ms)] = have
        have["last"] = ms
        if m["kind"] == "stage":
            entered, snapshot = have["stages"].get(m["stage"], (MS0 + ms, None))
            have["stages"][m["stage"]] = (entered, m.get("snapshot") if snapshot is None else snapshot)
        else:
            have[m["kind"]].append(m["ref"])
    return {k: (v["stages"], v["add"][-50:], v["choice"][-64:], v["event"][-500:], v["digest"]) for k, v in out.items()}


def newest(rows):
    best = {}
    for r in rows:
        key = (r["client_id"], r["session_id"], r["opened_ms"])
        if key not in best or (r["closed"], r["version"]) > (best[key]["closed"], best[key]["version"]):
            best[key] = r
    return {k: ({s["stage"]: (s["entered_ms"], s["snapshot"]) for s in r["stages"]}, r["adds"], [c["addon_key"] for c in r["choices"]], r["events"], r["digests"]) for k, r in best.items()}


def test_ledger_over_batches_equals_one_fold(spark, tmp_path):
    rng = random.Random(4)
    batches, seq, ms = [], 0, 0
    for b in range(4):
        rows = []
        for _ in range(150):
            seq, ms = seq + 1, ms + rng.choice([1_000, 60_000, 600_000])
            kind = rng.choice(["stage", "add", "choice", "event", "digest"])
            rows.append(message(rng.randrange(3), f"s{ms // 40_000_000}", ms, seq, kind, stage=rng.choice(["pdp", "cart"]), snapshot=rng.choice([None, seq]), ref=f"r{seq}", selected=True))
        rows += [message(7, "long", ms - 1, 10_000 + seq + i, "event", ref=f"e{b}:{i}") for i in range(200)]
        rows += [message(7, "long", ms, 20_000 + seq + i, "add", ref=f"a{b}:{i}") for i in range(20)]
        batches.append(rows)
        put(tmp_path / "in", f"{b}", rows + rng.sample(rows, 30) + (batches[b - 1][-5:] if b else []))
    late = message(0, "s0", 0, 99_999, "event", ref="late")
    put(tmp_path / "in", "9", [message(8, "z", ms + 100_000_000, 1, "add", ref="x"), late])
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = drain(ledger.ledgers(stream), conf=STORE).collect()
    whole = [m for rows in batches for m in rows] + [message(8, "z", ms + 100_000_000, 1, "add", ref="x")]
    assert newest(rows) == fold(whole)
    assert any(r["closed"] and r["client_id"] == 7 for r in rows)  # by its timer, as nothing followed
    assert max(r["version"] for r in rows) > 1


# --- counters and events ---------------------------------------------------------------------------------------------


def cohort_rows(spark, items):
    return spark.createDataFrame([(b, "p", "p@1", "pdp", s, "fashion", "1", d, 1) for b, s, d in items], "batch_id string, pattern_id string, detector_id string, funnel_stage string, site string, origin_category string, rulepack_version string, day_bucket long, quartile int")


def as_dict(df):
    return {(r["site"], r["day_bucket"]): (r["n"], r["reporters"]) for r in df.collect()}


def test_counters_count_each_batch_once(spark, tmp_path):
    store = counters.Counters(spark, str(tmp_path / "c"))
    assert store.read().count() == 0
    assert set(store.read().columns) == {*COHORT, "n", "reporters"}
    first, second = cohort_rows(spark, [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", "y", 2)]), cohort_rows(spark, [("c", "x", 1), ("c", "x", 3)])
    wanted = {("x", 1): (4, 3), ("y", 2): (1, 1), ("x", 3): (1, 1)}
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        store.add(rows, batch)
    assert as_dict(store.read()) == wanted
    store.compact(0)
    assert as_dict(store.read()) == wanted
    store.add(first, 0)  # a batch that is in the sums already
    assert as_dict(store.read()) == wanted
    store.sweep()
    store.compact(1)
    store.compact(1)
    store.sweep()
    assert as_dict(store.read()) == wanted
    store.add(cohort_rows(spark, [("d", "x", 1)]), 2)
    assert as_dict(store.read())[("x", 1)] == (5, 4)


def test_a_version_without_success_is_no_version(spark, tmp_path):
    store = counters.Counters(spark, str(tmp_path / "c"))
    store.add(cohort_rows(spark, [("a", "x", 1)]), 0)
    (tmp_path / "c" / "sums" / "upto=5").mkdir(parents=True)
    assert as_dict(store.read()) == {("x", 1): (1, 1)}


def body(site, day=20_000):
    record = {"patternId": "a.b", "detectorId": "a.b@1", "funnelStage": "pdp", "site": site, "originCategory": "fashion", "rulepackVersion": "1", "dayBucket": day, "confidenceQuartile": 2}
    return json.dumps({"v": 3, "records": [record, record], "outcomes": []})


def test_ingest_restarts_where_it_stopped(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    stream = spark.readStream.schema("batch_id string, method string, content_type string, body string").option("maxFilesPerTrigger", 1).json(str(source))
    request = lambda i, site: {"batch_id": i, "method": "POST", "content_type": "application/json", "body": body(site)}
    put(source, "0", [request("a", "x.com"), request("b", "x.com"), {**request("c", "x.com"), "method": "GET"}])
    run = lambda: counters.ingest_counters(stream, root, ("fashion",), 20_000).awaitTermination()
    run()
    run()
    put(source, "1", [request("d", "y.com")])
    put(source, "2", [request("e", "x.com"), {**request("f", "x.com"), "body": body("x.com", 1)}])
    run()
    store = counters.Counters(spark, f"{root}/records")
    assert as_dict(store.read()) == {("x.com", 20_000): (6, 3), ("y.com", 20_000): (2, 1)}
    # as if the driver was lost after the last batch was written and before it was noted: it runs again
    (tmp_path / "store" / "offsets" / "commits" / "2").unlink()
    (tmp_path / "store" / "offsets" / "commits" / ".2.crc").unlink(missing_ok=True)
    run()
    assert as_dict(store.read()) == {("x.com", 20_000): (6, 3), ("y.com", 20_000): (2, 1)}


def test_events_are_pruned_by_whole_days(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    put(source, "0", [{"ts": stamp(ms), "event_id": i} for i, ms in enumerate([0, 86_399_999, 86_400_000, 3 * 86_400_000])])
    stream = spark.readStream.schema("ts timestamp, event_id long").json(str(source))
    counters.store_events(stream, root).awaitTermination()
    first = 19_723
    assert counters.prune(spark, f"{root}/events", first + 1) == [first]
    assert {r["event_id"] for r in counters.read_events(spark, root).collect()} == {2, 3}
    assert counters.prune(spark, f"{root}/events", first + 1) == []
    counters.append(spark.createDataFrame([(5,)], "event_id long").withColumn("ts", F.current_timestamp()).withColumn("day_bucket", F.lit(first + 3)), 0, f"{root}/events")
    assert {r["event_id"] for r in counters.read_events(spark, root).collect()} == {2, 5}


# --- page changes ----------------------------------------------------------------------------------------------------


def record(kind, ms, path="", **more):
    return SimpleNamespace(kind=kind, ts_ms=ms, seq=ms, path=path, text=more.get("text"), modal=more.get("modal", False), dialog=more.get("dialog", False), empty=more.get("empty", False))


def told(records):
    page = watch.Page()
    return [(x[0], x[1], x[2]) for r in records for x in page.take(r)]


@pytest.mark.parametrize(
    ("records", "wanted"),
    [
        # a scrim is no message; the banner beside it is one interruption
        ([record("insert", 1, "body>div1", modal=True, empty=True), record("insert", 2, "body>div2", modal=True)], [("modal", "body>div2", 2)]),
        # an empty wrapper, then the card in it: one, told of the wrapper
        ([record("insert", 1, "body>w", modal=True, empty=True), record("insert", 2, "body>w>card", modal=True)], [("modal", "body>w", 2)]),
        # a panel inside what is counted already, and a wrapper around it
        ([record("insert", 1, "body>w>a", modal=True), record("insert", 2, "body>w>a>b", modal=True), record("insert", 3, "body>w", modal=True)], [("modal", "body>w>a", 1)]),
        # mounted hidden, then revealed
        ([record("insert", 1, "body>w", dialog=True), record("show", 50, "body>w", modal=True)], [("modal", "body>w", 50)]),
        # back too soon, and back after it was away
        ([record("insert", 1, "body>w", modal=True), record("hide", 10, "body>w"), record("hide", 1400, "body>w"), record("show", 1500, "body>w", modal=True), record("hide", 2000, "body>w"), record("show", 3500, "body>w", modal=True)], [("modal", "body>w", 1), ("modal", "body>w", 3500)]),
        # removed counts as hidden
        ([record("insert", 1, "body>w", modal=True), record("remove", 10, "body>w"), record("insert", 1600, "body>w", modal=True)], [("modal", "body>w", 1), ("modal", "body>w", 1600)]),
        # asked for, and asked for while leaving
        ([record("gesture", 0), record("insert", 749, "body>w", modal=True)], []),
        ([record("gesture", 0), record("exit", 300), record("insert", 749, "body>w", modal=True)], [("modal", "body>w", 749), ("exit_modal", "body>w", 749)]),
        # nothing is kept before the page is known for a shop
        ([record("insert", 1, "body>p", text="3 left"), record("remove", 2, "body>p"), record("recording", 3), record("text", 4, "body>p", text=" 2 \n left "), record("text", 5, "body>p", text="2 left"), record("text", 6, "body>p", text="none")], [("text", "body>p", 4)]),
        ([record("recording", 0), record("insert", 1, "body>p"), record("remove", 15_000, "body>p"), record("insert", 20_000, "body>p"), record("remove", 35_000, "body>p"), record("remove", 35_001, "body>p")], [("ephemeral", "body>p", 15_000)]),
    ],
)
def test_page_memory(records, wanted):
    assert told(records) == wanted


def test_page_memory_is_bounded_and_texts_are_cut():
    page = watch.Page()
    page.take(record("recording", 0))
    for i in range(5_000):
        page.take(record("insert", i, f"body>p{i}", text=f"{i} left", dialog=True))
    assert (len(page.texts), len(page.born), len(page.modals)) == (watch.MAX_ELEMENTS, watch.MAX_ELEMENTS, watch.MAX_MODALS)
    assert len(page.take(record("text", 9_999, "body>x", text="9" * 500))[0][4]) == 120


def test_watch_over_batches_equals_one_batch(spark, tmp_path):
    rng = random.Random(1)
    rows, ms = [], 0
    for seq in range(400):
        ms += rng.choice([10, 200, 1_000, 2_000])
        path = rng.choice(["body>w", "body>w>a", "body>w>a>b", "body>p"])
        row = {"page_id": seq % 3, "ts": stamp(ms), "seq": seq, "kind": rng.choice([*changes.KINDS, "insert", "show", "text", "nonsense"]), "path": path, "text": rng.choice(["1", "22", "none", None])}
        rows.append(row | {"modal": rng.random() < 0.5, "empty": rng.random() < 0.2})
    rows += [{"page_id": None, "ts": stamp(0), "kind": "text"}, {"page_id": 1, "kind": "text"}]
    for i in range(4):
        put(tmp_path / "parts", str(i), rows[i * 100 : (i + 1) * 100] + (rows[400:] if i == 3 else []))
    put(tmp_path / "whole", "0", rows)
    keyed = lambda folder, n: sorted(tuple(str(x) for x in r) for r in drain(watch.watch(changes.page_changes(spark, str(tmp_path / folder), files_per_batch=n)), conf=STORE).collect())
    whole = keyed("whole", 1)
    assert keyed("parts", 1) == whole
    pages: dict[int, list] = {}
    for r in rows[:400]:
        if r["kind"] in changes.KINDS:
            at = round((dt.datetime.fromisoformat(r["ts"].rstrip("Z")) - T0).total_seconds() * 1000)
            pages.setdefault(r["page_id"], []).append(SimpleNamespace(**(r | {"ts_ms": MS0 + at, "dialog": False})))
    memory = {p: watch.Page() for p in pages}
    wanted = [tuple(str(y) for y in (p, *x)) for p, records in pages.items() for r in records for x in memory[p].take(r)]
    assert whole == sorted(wanted)
    assert {"text", "modal", "ephemeral"} <= {r[1] for r in whole}


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, {"spark.sql.shuffle.partitions": "7", "suasion.nothing": "1"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("suasion.nothing", None) is None


# --- queues and cards ------------------------------------------------------------------------------------------------

DAY, HOUR = 86_400_000, 3_600_000


def batches_of(messages):
    """Each reporter's batches by a plain loop, with all timers run at the end."""
    held, consent, out = {}, {}, []
    for m in sorted(messages, key=lambda m: (m["ms"], m["seq"])):
        who = m["reporter"]
        rows = held.setdefault(who, [])
        if rows and m["ms"] - rows[0][0] > DAY:
            out.append((who, rows[0][0] + DAY, [s for _, s in rows]))
            rows = held[who] = []
        if m["kind"] == "consent":
            consent[who] = m["given"]
            held[who] = rows if m["given"] else []
        elif consent.get(who, True) and m["sound"]:
            rows.append((m["ms"], m["seq"]))
            if len(rows) >= 25:
                out.append((who, m["ms"], [s for _, s in rows]))
                held[who] = []
    return sorted(out + [(who, rows[0][0] + DAY, [s for _, s in rows]) for who, rows in held.items() if rows])


def test_queue_over_batches_equals_a_loop(spark, tmp_path):
    rng = random.Random(12)
    messages, ms = [], 0
    for seq in range(500):
        ms += rng.choice([60_000] * 8 + [300_000] * 8 + [4 * HOUR])
        kind = "consent" if rng.random() < 0.02 else "row"
        messages.append({"reporter": rng.choice([0, 0, 0, 1, 2]), "ms": ms, "seq": seq, "kind": kind, "given": rng.random() < 0.6, "sound": rng.random() < 0.9})
    end = {"reporter": 99, "ms": ms + 3 * DAY, "seq": 10_000, "kind": "consent", "given": True, "sound": True}
    for b in range(4):
        put(tmp_path / "in", str(b), [m | {"ts": stamp(m["ms"])} for m in messages[b * 125 : (b + 1) * 125] + ([end] if b == 3 else [])])
    stream = spark.readStream.schema("reporter long, ts timestamp, seq long, kind string, given boolean, sound boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = sorted((r["reporter"], r["sent_ms"] - MS0, r["seqs"]) for r in drain(queue.sent_batches(stream), conf=STORE).collect())
    assert got == batches_of(messages)
    assert {len(s) for _, _, s in got} > {25}
    assert any(len(s) < 25 for _, _, s in got)


def test_cards_wait_a_minute_and_are_read_once(spark, tmp_path):
    said = [
        ("https://www.a.com", 0, "card", "c1"), ("https://pay.a.com", 60_000, "ask", None), ("https://pay.a.com", 60_001, "ask", None),  # the last moment, and only once
        ("https://b.com", 0, "card", "c2"), ("https://b.com", 60_001, "ask", None), ("https://b.com", 60_002, "ask", None),  # too late
        ("https://c.com", 0, "card", "c3"), ("https://c.com", 5, "card", "c4"), ("https://c.com", 9, "ask", None),  # the newer one
        ("https://d.com", 0, "card", "c5"), ("https://d.com", 5, "seen", None), ("https://d.com", 9, "ask", None),
        ("http://e.com", 0, "card", "c6"), ("http://e.com", 5, "ask", None),
    ]
    rows = [{"origin": o, "ts": stamp(ms), "seq": i, "kind": k, "card": c} for i, (o, ms, k, c) in enumerate(said)]
    put(tmp_path / "in", "0", [r for r in rows if r["kind"] == "card"])
    put(tmp_path / "in", "1", [r for r in rows if r["kind"] != "card"])
    stream = spark.readStream.schema("origin string, ts timestamp, seq long, kind string, card string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = sorted((r["site"], r["card"], r["asked_seq"], r["waited_ms"]) for r in drain(queue.handed_over(stream), conf=STORE).collect())
    assert got == [("a.com", "c1", 1, 60_000), ("c.com", "c4", 8, 4)]


class _Calls(dict):
    """A map in a store that notes each call."""

    def __init__(self) -> None:
        super().__init__()
        self.calls = []

    def updateValue(self, key, value):  # noqa: N802
        self.calls.append(("update", *key))

    def removeKey(self, key):  # noqa: N802
        self.calls.append(("remove", *key))

    def update(self, value):
        self.calls.append(("head",))


def test_a_page_writes_what_has_changed_alone():
    from suasion.streaming import watch

    watcher, page = watch.Watcher(), watch.Page()
    watcher.head, watcher.texts, watcher.born, watcher.modals, watcher.looks = (_Calls() for _ in range(5))
    page.texts, page.modals = {"a": "1", "b": "3"}, {"m": (True, None)}
    watcher._save(page, 5, {"texts": {"a": ("1", 0), "b": ("2", 1), "c": ("9", 2)}, "born": {}, "modals": {"m": (True, None, 0)}, "looks": {}})
    assert watcher.texts.calls == [("remove", "c"), ("update", "b")]
    assert watcher.born.calls == watcher.modals.calls == watcher.looks.calls == []


def test_rows_of_a_key_are_taken_in_order():
    import pandas as pd

    from suasion.streaming.run import in_order

    frames = [pd.DataFrame({"ts": [0, 0], "ts_ms": [5, 3], "seq": [1, 2], "kind": ["a", None]}), pd.DataFrame({"ts": [0, 0], "ts_ms": [3, 3], "seq": [1.0, None], "kind": ["c", "d"]})]
    assert [(r.ts_ms, r.kind) for r in in_order(frames)] == [(3, "c"), (3, None), (3, "d"), (5, "a")]
