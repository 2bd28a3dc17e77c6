"""Rule packs as column expressions: cheap text classes, denied addresses, match patterns, what a click chose."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.functions import lexicons as lex
from suasion.functions.url import host_suffixes

# fixed values: wording of choices; declining wins
OPT_IN = r"(?i)\badd\b|\binclude\b|\byes\b|\bprotect\b|\bselect\b|\bchoose\b"
OPT_OUT = r"(?i)\bremove\b|\bno,? thanks\b|\bdecline\b|\bskip\b|\bdelete\b"
LABELS_AND_ENDS = r"^\(\^\|\\\.\)\(([a-z0-9|-]+)\)\\\.(?:\(([a-z0-9|]+)\)|([a-z0-9-]+))\$$"
BARE_SUFFIX = r"^\\\.([a-z0-9-]+)\$$"


def char_class(text: Column) -> Column:
    """Bits: 1 a digit, 2 a currency sign, 4 a colon, 8 a percent sign, 16 a trigger word."""
    bit = lambda on, value: F.when(on, value).otherwise(0)
    words = "|".join(re.escape(w) for w in lex.TRIGGERS)
    return bit(text.rlike("[0-9]"), 1) + bit(text.rlike("[$£€¥₹]"), 2) + bit(text.contains(":"), 4) + bit(text.contains("%"), 8) + bit(F.lower(text).rlike(words), 16)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^@/?#]*@)?([^:/?#]+)", 1))


def denied(url: Column, schemes: tuple[str, ...], suffixes: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    """Whether a pack rules an address out: by scheme, by the end of its host, or by any host pattern (one alternation)."""
    host = host_of(url)
    out = F.lit(False)
    for s in schemes:
        out = out | url.startswith(s)
    for s in suffixes:
        out = out | (host == s.removeprefix(".")) | host.endswith(s)
    return out | host.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else out


def matches_pattern(url: Column, pattern: str) -> Column:
    """A match pattern of the form scheme://host/*: * as scheme is http or https, *. before a host takes in its subdomains."""
    scheme, _, rest = pattern.partition("://")
    host, at = rest.partition("/")[0], host_of(url)
    by_scheme = url.rlike("^https?://") if scheme == "*" else url.startswith(scheme + "://")
    if host == "*":
        return by_scheme
    bare = host.removeprefix("*.")
    return by_scheme & ((at == bare) | at.endswith("." + bare) if host.startswith("*.") else at == bare)


def exclude_matches(patterns: DataFrame) -> DataFrame:
    """Host patterns as match patterns: (match, expressible). What cannot be said as one comes back as it is, not expressible."""
    p = F.col("pattern")
    part = lambda k: F.regexp_extract(p, LABELS_AND_ENDS, k)
    ends = F.when(part(2) != "", part(2)).otherwise(part(3))
    names = F.transform(F.split(part(1), r"\|"), lambda n: F.transform(F.split(ends, r"\|"), lambda e: F.concat(n, F.lit("."), e)))
    hosts = F.when(p.rlike(LABELS_AND_ENDS), F.flatten(names)).when(p.rlike(BARE_SUFFIX), F.array(F.regexp_extract(p, BARE_SUFFIX, 1)))
    each = patterns.select("pattern", hosts.alias("hosts")).select("pattern", F.explode_outer("hosts").alias("host"))
    match = F.when(F.col("host").isNull(), p).otherwise(F.concat(F.lit("https://*."), F.col("host"), F.lit("/*")))
    return each.select(match.alias("match"), F.col("host").isNotNull().alias("expressible")).distinct()


def click_choice(label: Column) -> Column:
    """True: chosen, false: declined, null: says neither."""
    return F.when(label.rlike(OPT_OUT), False).when(label.rlike(OPT_IN), True)


def matched_patterns(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """(page_id, pattern) of every match pattern that a page's url meets. Needs page_id, url; pattern.

    A pattern is ``scheme://host/...``: the scheme http, https or *, the host a name, *.name (the name and all below it) or *;
    others meet nothing. Hosts are cut into their suffixes, so that patterns meet them by equal keys; each host is looked up
    once, however many pages it has, and Spark splits a host that has very many when the pages come back to it.
    """
    form = r"^(\*|https?)://(\*\.)?([^/]*)(/.*)$"
    part = lambda k: F.regexp_extract("pattern", form, k)
    read = patterns.filter(F.col("pattern").rlike(form)).select("pattern", part(1).alias("p_scheme"), (part(2) != "").alias("below"), F.lower(part(3)).alias("p_host")).filter("p_host <> ''").distinct()
    scheme, host = F.regexp_extract(F.lower("url"), r"^([a-z][a-z0-9+.-]*)://", 1), F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1)
    located = pages.select("page_id", scheme.alias("scheme"), host.alias("host")).filter("host <> ''")
    keys = located.select("scheme", "host").distinct().select("scheme", "host", F.explode(F.array_append(host_suffixes(F.col("host")), F.lit("*"))).alias("key"))
    fits = (F.col("key") == F.col("p_host")) & ((F.col("p_scheme") == "*") | (F.col("p_scheme") == F.col("scheme"))) & (F.col("below") | (F.col("key") == F.col("host")) | (F.col("key") == "*"))
    met = keys.join(read, fits).select("scheme", "host", "pattern").distinct()
    return located.join(met, ["scheme", "host"]).select("page_id", "pattern")
