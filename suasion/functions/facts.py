"""What a detection says of its text: counts, places, quotes, quantities, triggers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: forms of counts, places and quantities, and their limits
COUNT = r"\bonly (\d{1,4})\b|\b(\d{1,4}) (?:left|remaining)\b"
PLACE = r"\b(?:left|in stock|available|remaining)\s+(?:at|near)\s+(?!(?:this|the|a|checkout|your cart)\b)([a-z][a-z0-9'&.-]*(?: [a-z][a-z0-9'&.-]*){0,3})"
PLACE_END = r"\s(?:for|today|tomorrow|to|in|by|and|with|on|when|if)\b.*$"
NEARBY = r"\b(?:nearby|near you|in store|in-store|for (?:store )?pickup|at your store)\b"
AT_THIS_PRICE = r"\bat this (?:price|rate|sale price|deal)\b|\bat (?:the |this )?sale price\b"
QUANTITIES = (
    r"\b(\d{1,3})\s*(?:months?|mos?)\b",
    r"\b(\d{1,3})\s*(?:years?|yrs?)\b",
    r"\b(\d{1,4})\s*(?:pack|count|ct|pcs|pieces|items|units|bars|cans|bottles|servings|meals)\b",
    r"\bpack of\s*(\d{1,4})\b",
)
MONTHLY, YEARLY = r"\bper (?:month|mo)\b|\bmonthly\b", r"\bper (?:year|yr)\b|\bannual(?:ly)?\b"
QUOTE_FROM, QUOTE_SHARE, SAMPLE, PLACE_MOST = 80, 0.6, 240, 48
ADD_NAME = r"(?i)\badd to (cart|bag|basket|order)\b|\badd item\b|\bbuy now\b|\badd to my bag\b"
CHECKOUT_NAME = (
    r"(?i)\bcheckout\b|\bcheck out\b|\bplace order\b|\bcontinue to payment\b|\bproceed to\b|\bpay now\b|\bcomplete (order|purchase)\b"
    r"|\bi'?ll reserve\b|\breserve (?:now|tickets?|room)\b|\bbook now\b|\bconfirm (?:and pay|booking|reservation)\b"
)
SEAT = r"(?i)\b(?:section|sec\.?)\s+[a-z]?\d{1,4}\b|\brow\s+(?:\d{1,3}|[a-z]{1,2})\b(?![a-z])"
PRICED = r"(?i)[$£€¥₹]\s?\d|\b\d[\d,.]*\s?(?:usd|eur|gbp|cad|aud)\b"
ADD_PHRASES = ("add to cart", "add to bag", "add to basket", "addtocart", "addtobag", "atc")


def _capital_words(text: Column) -> Column:
    """Each letter at the start of a word in upper case; the rest as it is."""
    parts = F.regexp_extract_all(text, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def scarcity_facts(text: Column) -> Column:
    """struct<count, scope, place> of a lower-case stock claim: how many, and whether it holds for a place or a price."""
    count = F.coalesce(F.nullif(F.regexp_extract(text, COUNT, 1), F.lit("")), F.nullif(F.regexp_extract(text, COUNT, 2), F.lit(""))).cast("int")
    named = F.trim(F.regexp_replace(F.regexp_extract(text, PLACE, 1), PLACE_END, ""))
    scope = F.when(text.rlike(PLACE) | text.rlike(NEARBY), "location").when(text.rlike(AT_THIS_PRICE), "price")
    place = F.when(F.length(named).between(2, PLACE_MOST), _capital_words(named))
    return F.struct(count.alias("count"), scope.alias("scope"), place.alias("place"))


def quoted_sentence(text: Column, pattern: str) -> Column:
    """Of a long text the first sentence or bullet that matches, if it is much shorter than the whole; else null."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\s*[•|]\s*"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    hit = F.get(F.filter(parts, lambda s: F.lower(s).rlike(pattern)), F.lit(0))
    return F.when((F.length(text) >= QUOTE_FROM) & (F.size(parts) >= 2) & (F.length(hit) <= F.length(text) * QUOTE_SHARE), hit)


def evidence_text(*texts: Column) -> Column:
    """The first text that says anything, in single blanks, SAMPLE characters at most."""
    said = F.coalesce(*(F.nullif(F.trim(F.coalesce(t, F.lit(""))), F.lit("")) for t in texts), F.lit(""))
    return F.substring(F.regexp_replace(said, r"\s+", " "), 1, SAMPLE)


def quantity_of(text: Column) -> Column:
    """How many months, years or pieces an option is for; null where it does not say."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int") for p in QUANTITIES]
    counted = reduce(F.coalesce, (F.when(n.between(1, 9999), n) for n in found))
    return F.coalesce(counted, F.when(text.rlike(MONTHLY), 1).when(text.rlike(YEARLY), 12))


def trigger_of(name: Column, attributes: Column) -> Column:
    """add_to_cart, checkout_intent or null, by the name of what was clicked and its attribute texts (an array)."""
    spaced = F.transform(attributes, lambda a: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.regexp_replace(a, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+", " ")), F.lit(" ")))
    by_attribute = F.exists(spaced, lambda a: reduce(lambda x, y: x | y, (a.contains(f" {p} ") for p in ADD_PHRASES)))
    adds = name.rlike(ADD_NAME) | F.coalesce(by_attribute, F.lit(False))
    return F.when(adds, "add_to_cart").when(name.rlike(CHECKOUT_NAME) | (name.rlike(SEAT) & name.rlike(PRICED)), "checkout_intent")
