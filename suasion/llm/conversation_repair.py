"""Conversation structure repair: the cheapest edits that give a conversation legal roles.

Legal are no turns at all, or an optional system turn, then one or more (user, assistant) pairs. Edits: Keep a turn (0),
Rerole it to user or assistant (3), Delete it (4; blank and repeated turns must go), Insert an empty user or assistant
turn anywhere (3); a truncated turn that is not deleted adds 3. Of the cheapest edit lists, the one whose audit (initials
of the edits, in order) is least in ASCII is taken.

One dynamic program over a DAG decides both: its nodes are (turns read, grammar state), every edge weighs one integer, and
each node keeps the smallest sum. The high digits of a weight are the cost; below them is an octal digit for each place of
the audit (D 1, I 2, K 3, R 4, as ASCII orders them), and places past the audit's end stay zero, so the order of integers
is the order of (cost, audit). Two audits of one cost that lead to one node are never prefixes of each other, as what is
more could only be inserted at a cost, so a smaller sum stays smaller whatever follows.

Conversations of up to ``MAX_TURNS`` turns and ``MAX_BYTES`` bytes are grouped, one to a row. Longer ones are sorted by
range, so that one of them may span many tasks, and cut into segments of up to ``SEGMENT_TURNS``; the same program gives
a segment's best edits from each state to each state, a fold in order picks the states at the cuts, and the segments
are edited again from there, one at a time. That fold holds the audit letters of a long conversation (some 16 bytes a
turn), no texts. Equal turns of a long conversation are counted before they are dealt out.

Defined results: a null role or text is one space; turns go by turn number (nulls first), then role, then text, both by
bytes; the first of several faults counts, of blank, repeated and truncated in this order; a role's initial is its first
character; a repeated row is a repeated turn; rows with a null conv_id are one conversation; a conversation without turns
has zeros and an empty audit; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm import common

MAX_TURNS, MAX_BYTES = 4_096, 16 << 20
SEGMENT_TURNS, SEGMENT_BYTES = 1_024, 4 << 20

#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept turn of that initial does to each state.
KEEP = {b"s": {START: SYSTEM}, b"u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, b"a": {USER: ASSISTANT}}
#: Where a turn of the only role that a reroled or inserted turn can take leads.
FORWARD = (USER, USER, ASSISTANT, USER)
ROLE_INTO = {USER: b"user", ASSISTANT: b"assistant"}
FINAL = (START, ASSISTANT)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
DELETE, INSERT, KEPT, REROLE = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR")

_BLANKS = common.BLANKS.encode()
_LEGAL = {b"su", b"ua", b"au"}
Turn = tuple[bytes, bool, bool]  # initial, must be deleted, truncated
Path = tuple[int, str]  # cost, audit

_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY_DDL = f"conv_id long, {', '.join(f'{c} long' for c in _SUMMARY)}, audit string, repaired_sha256 string"
TURNS_DDL = "conv_id long, position long, role string, text string, edit string"
_ROW = "struct<turn: bigint, role: binary, text: binary>"


def cheapest(turns: list[Turn], start: int = START) -> dict[int, Path]:
    """For each state that can be reached from ``start``: cost and audit of the cheapest edits of all the turns."""
    places = 3 * len(turns) + 2
    cost_at = 3 * places
    best: dict[int, tuple[int, int]] = {start: (0, 0)}  # integer, letters so far

    def offer(into: dict[int, tuple[int, int]], state: int, value: int, length: int, cost: int, letter: int) -> None:
        value += (cost << cost_at) + (letter << 3 * (places - 1 - length))
        if state not in into or value < into[state][0]:
            into[state] = (value, length + 1)

    def inserted(into: dict[int, tuple[int, int]]) -> None:
        for state, (value, length) in list(into.items()):
            offer(into, FORWARD[state], value, length, INSERT_COST, INSERT)
        if USER in into:
            offer(into, ASSISTANT, *into[USER], INSERT_COST, INSERT)

    inserted(best)
    for initial, must_go, truncated in turns:
        then: dict[int, tuple[int, int]] = {}
        more = TRUNCATED_COST if truncated else 0
        keeps = KEEP.get(initial, {})
        for state, (value, length) in best.items():
            offer(then, state, value, length, DELETE_COST, DELETE)
            if not must_go:
                if state in keeps:
                    offer(then, keeps[state], value, length, KEEP_COST + more, KEPT)
                offer(then, FORWARD[state], value, length, REROLE_COST + more, REROLE)
        inserted(then)
        best = then
    return {state: (value >> cost_at, format(value & ((1 << cost_at) - 1), "o").zfill(places)[:length].translate(LETTERS)) for state, (value, length) in best.items()}


def apply_audit(audit: str, turns: list[tuple[bytes, bytes]], state: int) -> tuple[list[tuple[bytes, bytes, str]], int]:
    """The (role, text, edit) that an audit leaves of (role, text) turns, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = FORWARD[state]
            out.append((ROLE_INTO[state], b"", letter))
            continue
        role, text = turns[at]
        at += 1
        if letter == "K":
            state = KEEP[role[:1]][state]
            out.append((role, text, letter))
        elif letter == "R":
            state = FORWARD[state]
            out.append((ROLE_INTO[state], text, letter))
    return out, state


def fault_of(text: bytes, repeated: bool) -> str:
    """blank, duplicate, truncated or nothing."""
    shown = text.rstrip(_BLANKS)
    if not shown:
        return "blank"
    return "duplicate" if repeated else "" if shown[-1:] in (b".", b"!", b"?") else "truncated"


def as_turn(role: bytes, fault: str) -> Turn:
    return role[:1], fault in ("blank", "duplicate"), fault == "truncated"


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each row as an array of the one turn it is, nulls as one space."""
    space = F.lit(" ")
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).cast("binary").alias("role"), F.coalesce("text", space).cast("binary").alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.array(one).alias("turns"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's rows as an array of what the row's crc32 makes of it (none, one or two turns)."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(role)
    one = F.struct(F.col("turn").cast("long").alias("turn"), role.cast("binary").alias("role"), text.cast("binary").alias("text"))
    made = F.when(kind == 0, F.array().cast(f"array<{_ROW}>")).when(kind == 3, F.array(one, one)).otherwise(F.array(one))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), made.alias("turns"))


def _bytes_of(turns: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda total, t: total + F.octet_length(t["text"]) + F.octet_length(t["role"]))


def _gaps(numbers: list[int | None]) -> int:
    known = {n for n in numbers if n is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _repair_short(batches: Iterator[pa.RecordBatch], emit: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen: set[tuple[bytes, bytes]] = set()
            turns, faults, plain, numbers = [], dict.fromkeys(("blank", "duplicate", "truncated", ""), 0), [], []
            for row in rows.as_py():
                key = (row["role"], row["text"])
                fault = fault_of(row["text"], key in seen)
                seen.add(key)
                faults[fault] += 1
                turns.append(as_turn(row["role"], fault))
                plain.append(key)
                numbers.append(row["turn"])
            illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(turns, turns[1:]))  # noqa: B905
            paths = cheapest(turns)
            cost, audit = min(paths[s] for s in FINAL if s in paths)
            kept = apply_audit(audit, plain, START)[0]
            out.extend(emit(conv, (_gaps(numbers), faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost), audit, kept))
        yield from _record_batches(out, emit)


def _record_batches(out: list[tuple], emit: Callable) -> Iterator[pa.RecordBatch]:
    schema = _ARROW[emit.__name__]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def emit_summary(conv: int | None, counts: tuple[int, ...], audit: str, kept: list) -> list[tuple]:
    digest = hashlib.sha256(b"\n".join(role + b":" + text for role, text, _ in kept)).hexdigest()
    return [(conv, *counts, audit, digest)]


def emit_turns(conv: int | None, counts: tuple[int, ...], audit: str, kept: list) -> list[tuple]:
    return [(conv, i, role, text, edit) for i, (role, text, edit) in enumerate(kept)]


_ARROW = {
    "emit_summary": pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _SUMMARY), ("audit", pa.string()), ("repaired_sha256", pa.string())]),
    "emit_turns": pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.binary()), ("text", pa.binary()), ("edit", pa.string())]),
}


def _texts(turns: DataFrame) -> DataFrame:
    """Roles and texts as strings again, whatever their bytes."""
    return turns.withColumn("role", F.col("role").cast("string")).withColumn("text", F.col("text").cast("string"))


class _Segment:
    """The turns of one conversation that a task has read since the last cut."""

    def __init__(self, conv: int | None):
        self.conv, self.bytes = conv, 0
        self.turns: list[Turn] = []
        self.rows: list[tuple[bytes, bytes]] = []
        self.numbers: list[int | None] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}

    def add(self, number: int | None, role: bytes, text: bytes, fault: str) -> None:
        turn = as_turn(role, fault)
        self.turns.append(turn)
        self.rows.append((role, b"" if turn[1] else text))
        self.numbers.append(number)
        self.faults[fault] += 1
        self.bytes += len(role) + len(self.rows[-1][1])


_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("seg", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("illegal", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("numbers", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("paths", _PATHS), ("rows", pa.list_(pa.struct([("role", pa.binary()), ("text", pa.binary())]))),
])
_SEGMENT_DDL = (
    "conv_id long, seg long, first binary, last binary, illegal long, low long, high long, numbers long, blank long, duplicate long, truncated long, "
    "paths array<struct<start: int, end: int, cost: bigint, audit: string>>, rows array<struct<role: binary, text: binary>>"
)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows (conv_id, turn, role, text, copies, first) into segments; one row each."""
    task = TaskContext.get().partitionId() << 32
    made = 0

    def closed(s: _Segment) -> pa.RecordBatch:
        nonlocal made
        known = [n for n in s.numbers if n is not None]
        paths = [{"start": start, "end": end, "cost": cost, "audit": audit} for start in range(4) for end, (cost, audit) in cheapest(s.turns, start).items()]
        illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(s.turns, s.turns[1:]))  # noqa: B905
        row = (s.conv, task + made, s.turns[0][0], s.turns[-1][0], illegal, min(known, default=None), max(known, default=None), len(set(known)), s.faults["blank"], s.faults["duplicate"], s.faults["truncated"], paths, [{"role": r, "text": t} for r, t in s.rows])
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT.types, strict=True)], schema=_SEGMENT)

    now: _Segment | None = None
    for batch in batches:
        for conv, number, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for copy in range(copies):
                if now is not None and (now.conv != conv or len(now.turns) >= SEGMENT_TURNS or now.bytes >= SEGMENT_BYTES):
                    yield closed(now)
                    now = None
                now = now or _Segment(conv)
                now.add(number, role, text, fault_of(text, copy > 0 or not first))
    if now is not None:
        yield closed(now)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold each long conversation's segments in order; one row a segment with its start state and audit, counts on the first."""
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("chosen", pa.string()), *((c, pa.int64()) for c in _SUMMARY), ("n_segments", pa.int64()), ("turn_at", pa.int64())])
    conv, open_ = None, False
    segs: list[int] = []
    hops: list[dict[int, tuple[int, str]]] = []  # for each end state: start state and audit of the segment
    best: dict[int, Path] = {}
    totals: dict[str, int] = {}
    last: bytes = b""
    low = high = None

    def done() -> pa.RecordBatch:
        state = min((best[s], s) for s in FINAL if s in best)[1]
        cost = best[state][0]
        back = []
        for seg, hop in zip(reversed(segs), reversed(hops), strict=True):
            state, audit = hop[state]
            back.append((seg, state, audit))
        gaps = high - low + 1 - totals["numbers"] if low is not None else 0
        counts = (gaps, totals["blank"], totals["duplicate"], totals["truncated"], totals["illegal"], cost)
        rows, at = [], 0
        for i, (seg, start, audit) in enumerate(reversed(back)):
            rows.append((conv, seg, start, audit, *(counts if i == 0 else (None,) * 6), len(segs) if i == 0 else None, at))
            at += len(audit) - audit.count("D")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if open_ and row["conv_id"] != conv:
                yield done()
                open_ = False
            if not open_:
                conv, open_, segs, hops, best, last, low, high = row["conv_id"], True, [], [], {START: (0, "")}, b"", None, None
                totals = dict.fromkeys(("numbers", "blank", "duplicate", "truncated", "illegal"), 0)
            elif last + row["first"] not in _LEGAL:
                totals["illegal"] += 1
            for key in totals:
                totals[key] += row[key]
            if row["low"] is not None:
                totals["numbers"] -= high == row["low"]
                low, high = row["low"] if low is None else low, row["high"]
            last = row["last"]
            then: dict[int, Path] = {}
            hop: dict[int, tuple[int, str]] = {}
            for p in row["paths"]:
                if p["start"] in best:
                    cost, audit = best[p["start"]]
                    offer = (cost + p["cost"], audit + p["audit"])
                    if p["end"] not in then or offer < then[p["end"]]:
                        then[p["end"]], hop[p["end"]] = offer, (p["start"], p["audit"])
            best = then
            segs.append(row["seg"])
            hops.append(hop)
    if open_:
        yield done()


_CHOSEN_DDL = f"conv_id long, seg long, start int, chosen string, {', '.join(f'{c} long' for c in _SUMMARY)}, n_segments long, turn_at long"


def _edit_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that each segment's audit leaves."""
    for batch in batches:
        for row in batch.to_pylist():
            kept, _ = apply_audit(row["chosen"], [(t["role"], t["text"]) for t in row["rows"]], row["start"])
            yield from _record_batches([(row["conv_id"], row["turn_at"] + i, *k) for i, k in enumerate(kept)], emit_turns)


def _edit_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a long conversation from its segments in order; texts go through the hash one segment at a time."""
    conv, counts, audit, digest, fresh, left = None, (), [], hashlib.sha256(), True, 0
    for batch in batches:
        for row in batch.to_pylist():
            if not left:
                conv, counts, audit, digest, fresh, left = row["conv_id"], tuple(row[c] for c in _SUMMARY), [], hashlib.sha256(), True, row["n_segments"]
            kept, _ = apply_audit(row["chosen"], [(t["role"], t["text"]) for t in row["rows"]], row["start"])
            for role, text, _ in kept:
                digest.update((b"" if fresh else b"\n") + role + b":" + text)
                fresh = False
            audit.append(row["chosen"])
            left -= 1
            if not left:
                yield from _record_batches([(conv, *counts, "".join(audit), digest.hexdigest())], emit_summary)


def _repair_long(listed: DataFrame, whole: bool) -> DataFrame:
    rows = listed.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*").withColumn("d", F.sha2("text", 256))
    counted = rows.groupBy("conv_id", "turn", "role", "text", "d").agg(F.count("*").alias("copies"))
    firsts = counted.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("d").alias("f_d")).agg(F.min(F.struct("turn")).alias("f_turn"))
    marked = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("d") == F.col("f_d")))
    marked = common.materialize(marked.select("conv_id", "turn", "role", "text", "copies", F.struct("turn").eqNullSafe(F.col("f_turn")).alias("is_first")))
    order = ("conv_id", "turn", "role", "text")
    segments = common.materialize(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, _SEGMENT_DDL))
    chosen = segments.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_choose, _CHOSEN_DDL)
    chosen = chosen.withColumnRenamed("conv_id", "c_conv").withColumnRenamed("seg", "c_seg")
    edited = segments.select("conv_id", "seg", "rows").join(chosen, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("seg") == F.col("c_seg"))).drop("c_conv", "c_seg")
    if not whole:
        return edited.mapInArrow(_edit_turns, TURNS_DDL.replace("role string, text string", "role binary, text binary"))
    return edited.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_edit_summary, SUMMARY_DDL)


def _repair(listed: DataFrame, whole: bool, max_turns: int, max_bytes: int) -> DataFrame:
    sizes = listed.groupBy("conv_id").agg(F.sum(F.size("turns")).alias("n"), F.sum(_bytes_of("turns")).alias("b"))
    long_ones = common.materialize(sizes.filter((F.col("n") > max_turns) | (F.col("b") > max_bytes)).select(F.col("conv_id").alias("long_id")))
    emit, ddl = (emit_summary, SUMMARY_DDL) if whole else (emit_turns, TURNS_DDL.replace("role string, text string", "role binary, text binary"))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    some = not long_ones.isEmpty()
    short = listed.join(long_ones, is_long, "left_anti") if some else listed
    grouped = short.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"))
    out = grouped.mapInArrow(lambda batches: _repair_short(batches, emit), ddl)
    return out.unionByName(_repair_long(listed.join(long_ones, is_long, "left_semi"), whole)) if some else out


def repair(conversations: DataFrame, prepare: Callable[[DataFrame], DataFrame] = plain, max_turns: int = MAX_TURNS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row a conversation: gaps, faults, illegal pairs, cost, audit, SHA-256 of the repaired ``role:text`` lines."""
    return _repair(prepare(conversations), True, max_turns, max_bytes)


def repaired_turns(conversations: DataFrame, prepare: Callable[[DataFrame], DataFrame] = plain, max_turns: int = MAX_TURNS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The repaired turns themselves: conv_id, position (from 0), role, text, edit (K, R or I)."""
    return _texts(_repair(prepare(conversations), False, max_turns, max_bytes))


#: The contract in SQL: the damage, the same program with (cost, audit) structs for integers, and the repaired lines' hash.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256))::BIGINT AS i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [4294967295] || [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS key FROM conversations
), kinds AS (
  SELECT keyed.*, xor(list_reduce(key, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind FROM keyed, bits
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds
), numbered AS (
  SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faulty AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered)
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id
), program AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'w': ''} AS z, {'c': 900000, 'w': ''} AS s, {'c': 3, 'w': 'I'} AS u, {'c': 6, 'w': 'II'} AS a FROM told
  UNION ALL
  SELECT conv_id, i, z, s, u, list_min([a, {'c': u.c + 3, 'w': u.w || 'I'}]) AS a FROM (
    SELECT conv_id, i, z, s, a, list_min([u, {'c': z.c + 3, 'w': z.w || 'I'}, {'c': s.c + 3, 'w': s.w || 'I'}, {'c': a.c + 3, 'w': a.w || 'I'}]) AS u FROM (
      SELECT p.conv_id, f.i, {'c': p.z.c + 4, 'w': p.z.w || 'D'} AS z,
        list_min([{'c': p.s.c + 4, 'w': p.s.w || 'D'}, {'c': p.z.c + keep + CASE initial WHEN 's' THEN 0 ELSE 900000 END, 'w': p.z.w || 'K'}]) AS s,
        list_min([{'c': p.u.c + 4, 'w': p.u.w || 'D'}] || list_transform([p.z, p.s, p.a], lambda x: {'c': x.c + keep + CASE initial WHEN 'u' THEN 0 ELSE 900000 END, 'w': x.w || 'K'})
          || list_transform([p.z, p.s, p.a], lambda x: {'c': x.c + keep + 3, 'w': x.w || 'R'})) AS u,
        list_min([{'c': p.a.c + 4, 'w': p.a.w || 'D'}, {'c': p.u.c + keep + CASE initial WHEN 'a' THEN 0 ELSE 900000 END, 'w': p.u.w || 'K'}, {'c': p.u.c + keep + 3, 'w': p.u.w || 'R'}]) AS a
      FROM program p JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 900000 END AS keep FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1))
), best AS (
  SELECT t.*, list_min([p.z, p.a]) AS b FROM told t JOIN program p ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.i = t.n
), letters AS (
  SELECT conv_id, b.w AS audit, unnest(range(1, len(b.w) + 1)) AS place FROM best
), placed AS (
  SELECT conv_id, place, audit[place] AS letter, len(replace(left(audit, place), 'I', '')) AS i, len(replace(left(audit, place), 'D', '')) AS m FROM letters
), led AS (
  SELECT p.*, f.role, f.text, max(CASE WHEN m = 1 AND letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS lead
  FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.letter <> 'I'
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS repaired FROM led WHERE letter <> 'D' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.w, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM o.conv_id
"""
