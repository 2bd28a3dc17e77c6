"""License scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard parser for license expressions.

One automaton runs over a text's words (A-Z lowered, parted by single spaces) and finds every place of every phrase,
overlapping ones too; another runs over the lowered text and finds tags such as ``SPDX-License-Identifier:``. What stands
behind a tag, up to the end of its line or the next tag, is parsed by the shunting-yard algorithm (``with`` binds closest, then ``and``,
then ``or``; parentheses) and evaluated twice from its postfix form: to the labels of its identifiers, and to how freely
the text may be used (the least of what ``and`` joins, the best of what ``or`` offers; a known exception lifts a strong
license to a weak one). Malformed expressions and those that name no known license say nothing.

The score is how sure a license is declared: 1 - product of (1 - weight) over the labels, each with its best finding's
weight. ``freedom`` is the least of all findings' (null without any).

Defined results: words are runs of digits, a-z and bytes beyond ASCII, so bytes that are not UTF-8 are word characters;
a null or empty text has no words, no labels and score 0; texts of any length are read whole, each held some four times
over by its task; rows with one doc_id are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm import common

#: The phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases, as words, with their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Tags before an expression, lower-case; the weight of what they declare.
TAGS = {"spdx-license-identifier:": 0.99, "license-expression:": 0.99, "license:": 0.9, "licence:": 0.9}
BASE_WEIGHT, NOTICE_WEIGHT = 0.8, 0.9
#: How freely text under a label may be used. An identifier belongs to the longest of these names that it starts with.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "zlib": 0.9, "bsl": 0.9, "apache": 0.9, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.1, "proprietary": 0.0,
}
#: Exceptions that make a license weak for what is joined to it, by how their names start.
EXCEPTIONS = ("classpath-exception", "gcc-exception", "llvm-exception", "linux-syscall-note", "openssl-exception", "autoconf-exception", "bison-exception", "font-exception")
LIFTED = FREEDOM["lgpl"]
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in _LOWER)
_GAPS = re.compile(rb" {2,}")
_TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+|\S")
#: What ends comments, quotes and sentences.
_CLOSERS = "*/->#}%\"',;. \t\r\n\f\v"
_FINDING = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())])
_EXPRESSION = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64())])
SCHEMA = pa.schema([("n_words", pa.int64()), ("findings", pa.list_(_FINDING)), ("expressions", pa.list_(_EXPRESSION)), ("score", pa.float64()), ("freedom", pa.float64())])
DDL = "n_words long, findings array<struct<label: string, base: boolean, word: bigint>>, expressions array<struct<text: string, labels: array<string>, freedom: double>>, score double, freedom double"


@cache
def phrases() -> ahocorasick.Automaton:
    """The automaton of base and notice phrases, each between spaces; a phrase may have several labels."""
    automaton = ahocorasick.Automaton()
    named: dict[str, list[tuple[str, bool]]] = {}
    for table, base in ((BASE, True), (NOTICES, False)):
        for phrase, label in table.items():
            named.setdefault(phrase, []).append((label, base))
    for phrase, found in named.items():
        automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, found))
    automaton.make_automaton()
    return automaton


@cache
def tags() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for tag in TAGS:
        automaton.add_word(tag, tag)
    automaton.make_automaton()
    return automaton


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the tokens of an expression in postfix order; nothing if they are no expression."""
    out: list[str] = []
    held: list[str] = []
    wants_operand = True
    for token in tokens:
        if token in PRECEDENCE:
            if wants_operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            wants_operand = True
        elif token == "(":
            if not wants_operand or held[-1:] == ["with"]:
                return None
            held.append(token)
        elif token == ")":
            if wants_operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not wants_operand or not token[0].isalnum():
                return None
            out.append(token)
            wants_operand = False
    if wants_operand or "(" in held:
        return None
    return out + held[::-1]


def family(identifier: str) -> str | None:
    """The label of an identifier: the longest known name that it is or starts with (up to - or +)."""
    known = [name for name in FREEDOM if identifier == name or identifier.startswith((f"{name}-", f"{name}+"))]
    return max(known, key=len, default=None)


def evaluate(postfix: list[str]) -> tuple[set[str], float | None] | None:
    """Labels and freedom of an expression in postfix order; nothing if ``with`` has no identifier on both sides.

    An unknown identifier has no label and unknown freedom: ``and`` with it is unknown, ``or`` takes what is known.
    """
    stack: list[tuple[set[str], float | None, str | None]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            label = family(token)
            stack.append(({label} if label else set(), FREEDOM[label] if label else None, token))
            continue
        (right, r, r_name), (left, l, l_name) = stack.pop(), stack.pop()
        if token == "with":
            if r_name is None or l_name is None:
                return None
            stack.append((left, max(l, LIFTED) if l is not None and r_name.startswith(EXCEPTIONS) else l, None))
        elif token == "and":
            stack.append((left | right, None if l is None or r is None else min(l, r), None))
        else:
            stack.append((left | right, max((x for x in (l, r) if x is not None), default=None), None))
    labels, freedom, _ = stack[0]
    return labels, freedom


def parse(expression: str) -> tuple[set[str], float | None] | None:
    """Labels and freedom of a license expression in lower case; nothing if it is malformed or names no known license."""
    postfix = to_postfix(_TOKEN.findall(expression))
    value = evaluate(postfix) if postfix else None
    return value if value and value[0] else None


def normalised(text: bytes) -> bytes:
    """The words, lowered, parted and enclosed by single spaces; one space if there are none."""
    return _GAPS.sub(b" ", b" " + text.translate(_WORDS) + b" ")


def scan_text(text: bytes) -> tuple[int, list[dict], list[dict], float, float | None]:
    """Number of words, findings, expressions, score and freedom of one text."""
    words = normalised(text)
    n_words = words.count(b" ") - 1
    findings, expressions = [], []
    weights: dict[str, float] = {}
    freedoms: list[float] = []
    seen = spaces = 0
    for end, (length, found) in phrases().iter(words.decode("latin-1")):
        spaces += words.count(b" ", seen, end + 1)
        seen = end + 1
        for label, base in found:
            findings.append({"label": label, "base": base, "word": spaces - length - 1})
            weights[label] = max(weights.get(label, 0.0), BASE_WEIGHT if base else NOTICE_WEIGHT)
    freedoms += [FREEDOM[label] for label in weights]
    lower = text.translate(_LOWER)
    if b"licen" in lower:
        places = list(tags().iter(lower.decode("latin-1")))
        ends = [*(end + 1 - len(tag) for end, tag in places[1:]), len(lower)][: len(places)]
        for (at, tag), until in zip(places, ends, strict=True):
            expression = lower[at + 1 : until].split(b"\n", 1)[0].decode("utf-8", "replace").rstrip(_CLOSERS).strip()
            value = parse(expression)
            if value is None:
                continue
            labels, freedom = value
            expressions.append({"text": expression, "labels": sorted(labels), "freedom": freedom})
            for label in labels:
                weights[label] = max(weights.get(label, 0.0), TAGS[tag])
            if freedom is not None:
                freedoms.append(freedom)
    miss = 1.0
    for label in sorted(weights):
        miss *= 1 - weights[label]
    return n_words, findings, expressions, 1 - miss, min(freedoms, default=None)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, findings, expressions, score, freedom of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(iter([batch]), 1):
                rows = [scan_text(x.as_py() or b"") for x in part.column(1)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(SCHEMA)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True))], names=["doc_id", *SCHEMA.names])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, {DDL}")


#: Words and base phrases in SQL.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') IF x <> ''] AS words FROM documents
), p AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    [i - 1 FOR i IN range(1, len(words)) IF words[i] = 'mit' AND words[i + 1] = 'license'] AS mit,
    [i - 1 FOR i IN range(1, len(words)) IF words[i] = 'apache' AND words[i + 1] = 'license'] AS apache,
    [i - 1 FOR i IN range(1, len(words) - 1) IF words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license'] AS gpl
  FROM w
)
SELECT doc_id, n_words, (len(mit) + len(apache) + len(gpl))::BIGINT AS n_base,
  list_min(mit || apache || gpl)::BIGINT AS first_word, list_max(mit || apache || gpl)::BIGINT AS last_word,
  array_to_string([x FOR x IN [CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END] IF x IS NOT NULL], ',') AS base_labels
FROM p
"""
