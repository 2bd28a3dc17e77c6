"""Column expressions over URLs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from suasion.functions.bind import once

# fixed values: public suffixes of more than one label that shops in the corpus use
MULTI_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.nz", "com.ng", "com.sa", "co.jp", "com.br", "com.mx", "co.in", "co.za", "com.tr", "com.sg", "com.hk", "co.kr", "myshopify.com")
#: More rules than these are no list for an expression.
MOST_RULES = 50_000


@dataclass(frozen=True)
class SuffixRules:
    """Public suffixes, ICANN's and private ones alike: plain (co.uk), wildcard (ck for *.ck), exception (www.ck for !www.ck)."""

    plain: frozenset[str] = frozenset(MULTI_SUFFIXES)
    wildcard: frozenset[str] = frozenset()
    exception: frozenset[str] = frozenset()

    @classmethod
    def parse(cls, lines: Iterable[str]) -> SuffixRules:
        """From lines as the public suffix list writes them: a rule up to the first blank, comments with //."""
        rules = {line.split()[0].lower().strip(".") for line in lines if line.strip() and not line.lstrip().startswith("//")}
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} suffix rules; at most {MOST_RULES} can be part of an expression")
        wild = frozenset(r[2:] for r in rules if r.startswith("*."))
        out = frozenset(r[1:] for r in rules if r.startswith("!"))
        return cls(frozenset(r for r in rules if not r.startswith(("*.", "!"))), wild, out)


DEFAULT_RULES = SuffixRules()


def origin_of(url: Column) -> Column:
    """scheme://host, without port; null where there is none."""
    return F.nullif(F.lower(F.concat(F.regexp_extract(url, r"^(https?)://", 1), F.lit("://"), F.regexp_extract(url, r"^https?://(?:[^@/?#]*@)?([^:/?#]+)", 1))), F.lit("://"))


def host_suffixes(host: Column) -> Column:
    """The host and all that is left of it as labels go from the left, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def registrable_domain(host: Column, rules: SuffixRules = DEFAULT_RULES) -> Column:
    """The part of a host that is registered: the label before the public suffix, and the suffix.

    An exception comes before the longest rule; a name under no rule has its last label for a suffix. IP addresses, and
    hosts that are a suffix themselves, are given whole.
    """
    name = F.regexp_replace(F.lower(host), r"\.$", "")

    def found(suffixes: Column) -> Column:
        def is_suffix(s: Column, i: Column) -> Column:
            rest = F.coalesce(F.get(suffixes, i + 1), F.lit(""))
            return (s.isin(*rules.plain) if rules.plain else F.lit(False)) | (rest.isin(*rules.wildcard) if rules.wildcard else F.lit(False)) | (rest == "")

        kept = F.get(F.filter(suffixes, lambda s: s.isin(*rules.exception)), F.lit(0)) if rules.exception else F.lit(None).cast("string")
        below = F.filter(F.transform(suffixes, lambda s, i: F.when(is_suffix(s, i), i)), lambda i: i.isNotNull())
        return F.coalesce(kept, F.get(suffixes, F.get(below, F.lit(0)) - 1))

    address = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | name.contains(":")
    return F.when(address, name).otherwise(F.coalesce(once(host_suffixes(name), found), name))


def path_template(url: Column) -> Column:
    """Up to six path segments with ids, uuids and slugs masked."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    parts = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, 6)
    masked = F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^\d+$"), ":id")
        .when(F.lower(s).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), ":uuid")
        .when(s.rlike(r"\d{4,}") | (F.length(s) > 24), ":slug")
        .otherwise(F.lower(s)),
    )
    return F.concat(F.lit("/"), F.array_join(masked, "/"))
