"""Column expressions over labels and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: charge kinds in order of precedence, with their words
LINE_KINDS = (
    ("tax", ("tax", "vat", "gst", "hst", "sales tax", "duty", "duties")),
    ("shipping", ("shipping", "delivery", "postage", "freight", "carriage")),
    ("discount", ("discount", "promo", "coupon", "savings?", "credit", "voucher")),
    (
        "mandatory_fee",
        (
            "service fee", "handling", "processing fee", "convenience fee", "resort fee", "destination fee", "amenity fee", "cleaning fee", "service charge", "parking fee", "occupancy fee", "urban fee", "hotel fee", "host fee",
            r"taxes?\s*(?:and|&|\+)\s*fees?", "facility (?:fee|charge)", "booking fee", "order fee", "fulfillment fee", "regulatory (?:fee|recovery)", "environmental fee", "surcharge", "platform fee", "delivery fee", "small order fee", "carrier fee",
        ),
    ),
)
# fixed values: add-on families
ADDONS = (
    ("protection", r"\bprotection(?: plan)?\b"),
    ("warranty", r"\bwarranty\b"),
    ("insurance", r"\binsurance\b|\binsured\b"),
    ("gift_wrap", r"\bgift[- ]?wrap(?:ping)?\b|\bgift (?:box|bag|message)\b"),
    ("tip", r"\btips?\b|\bgratuity\b"),
    ("donation", r"\bdonat(?:e|ion)\b|\bround up\b"),
    ("carbon_offset", r"\bcarbon (?:offset|neutral)\b|\boffset (?:my|your|the)? ?(?:carbon|emissions)\b"),
    ("expedited", r"\bexpedited\b|\bpriority (?:shipping|handling|processing)\b|\brush (?:order|processing)\b"),
    ("signature", r"\bsignature (?:confirmation|required)\b"),
)
SPACE = r"[\s   -     　﻿]"


def normalize_text(text: Column) -> Column:
    """Lower case, straight quotes, single spaces, no blanks at the ends."""
    straight = F.translate(F.lower(text), "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(straight, SPACE + "+", " "))


def line_item_kind(label: Column) -> Column:
    """First kind with a word in the label, else unknown."""
    t = F.lower(label)
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in LINE_KINDS:
        out = out.when(t.rlike(r"\b(?:" + "|".join(words) + r")\b"), kind)
    return out.when(t.rlike("|".join(p for _, p in ADDONS)), "optional_addon").otherwise("unknown")


def addon_keys(label: Column) -> Column:
    """Every add-on family that the label names."""
    t = F.lower(label)
    return F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p in ADDONS)))


def dedup_key(text: Column) -> Column:
    """Lower case, digit runs as #, single spaces: texts that differ in numbers alone share a key."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), SPACE + "+", " "))


def clock_seconds(text: Column) -> Column:
    """Seconds of the first H:MM or H:MM:SS in a text; null without one."""
    part = lambda k: F.regexp_extract(text, r"\b(\d{1,3}):([0-5]\d)(?::([0-5]\d))?\b", k)
    number = lambda k: part(k).cast("int")
    return F.when(part(1) != "", F.when(part(3) != "", number(1) * 3600 + number(2) * 60 + number(3)).otherwise(number(1) * 60 + number(2)))


def normalize_title(title: Column) -> Column:
    """Lower case up to the first bar or spaced dash, other signs as single spaces."""
    head = F.element_at(F.split(F.lower(title), r"\s[|\-–—]\s"), 1)
    return F.trim(F.regexp_replace(head, r"[^a-z0-9]+", " "))


def trigrams(title: Column) -> Column:
    padded = F.concat(F.lit("  "), title, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of padded trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units (as code points, for text of the basic plane)."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    step = lambda h, c: h.bitwiseXOR(c) * F.lit(16777619).cast("long")
    hashed = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: step(h, c).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.when(F.length(text) > 0, hashed).otherwise(F.lit(2166136261).cast("long"))


def luhn_valid(digits: Column) -> Column:
    """Card-like numbers: 13 to 19 digits that pass the Luhn test."""
    bare = F.regexp_replace(digits, r"[^0-9]", "")
    return (F.length(bare) >= 13) & (F.length(bare) <= 19) & F.call_function("luhn_check", bare)
