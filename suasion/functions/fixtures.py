"""Pages as test fixtures: personal data out, scripts and remote references out, clocks frozen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from suasion.functions.bind import once
from suasion.functions.text import luhn_valid

# fixed values: what is personal, in order, and what stands in its place
CARD = r"\b(?:\d[ -]?){13,19}\b"
EMAIL = ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[email redacted]")
RULES = (
    ("phone-us", r"\b(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", "[phone redacted]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[ssn redacted]"),
    ("postal-us", r"(?i)\b\d{5}(?:-\d{4})?\b(?=[^\d]*(?:zip|postal|address)|\s*(?:,|<))", "[postal redacted]"),
    ("street-address", r"\b\d{1,5}\s+[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Ter)\b\.?", "[address redacted]"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[jwt redacted]"),
    ("set-cookie", r"(?i)\b(?:session|sess|sid|auth|token|jwt|csrf|xsrf)[_-]?(?:id|token)?=[A-Za-z0-9._%-]{8,}", "[cookie redacted]"),
    ("account-token", r"(?i)\b(order|account|member|customer|loyalty|reward|invoice|confirmation)([\s#:_-]{1,3})([A-Za-z0-9]{8,})\b", "$1$2[token redacted]"),
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{16,}=*", "[bearer redacted]"),
    ("jsonld-person-name", r'("(?:author|reviewedBy|creator)"\s*:\s*\{[^}]*?"name"\s*:\s*")(?!\[name redacted\])([^"]{1,80})(")', "$1[name redacted]$3"),
    ("jsonld-avatar", r'("(?:image|photo|avatar)"\s*:\s*")https?://[^"]{1,300}(")', "$1about:blank$2"),
)
PIXEL = "data:image/gif;base64,R0lGODlhAQABAAAAACH5BAEKAAEALAAAAAABAAEAAAICTAEAOw=="
MARKUP = (
    (r'(?is)<script\b(?![^>]*type\s*=\s*["\']application/ld\+json["\'])[^>]*>.*?</script>', ""),
    (r'(?i)<link\b[^>]*rel\s*=\s*["\'](?:preload|prefetch|dns-prefetch|preconnect)["\'][^>]*>', ""),
    (r'(?i)\son[a-z]+\s*=\s*"[^"]*"', ""),
    (r"(?i)\son[a-z]+\s*=\s*'[^']*'", ""),
    (r'(?i)\s(src|href)\s*=\s*"(?!data:|#)[^"]*"', ' $1="about:blank"'),
    (r"(?i)\s(src|href)\s*=\s*'(?!data:|#)[^']*'", " $1='about:blank'"),
    (r'(?i)\ssrcset\s*=\s*"[^"]*"', ""),
    (r"(?i)data:image/[a-z+]+;base64,[A-Za-z0-9+/=]{4096,}", PIXEL),
)
EPOCH = r"\b1[6-9]\d{11}\b"


def _without_cards(text: Column) -> Column:
    """Card numbers are those digit runs that pass the Luhn test; the text between and the runs take turns."""

    def told_apart(t: Column) -> Column:
        return F.struct(t.alias("text"), F.split(t, CARD, -1).alias("between"), F.regexp_extract_all(t, F.lit(f"({CARD})"), F.lit(1)).alias("runs"))

    def clean(x: Column) -> Column:
        stand_ins = F.transform(x["runs"], lambda run: F.when(luhn_valid(run), F.lit("[card redacted]")).otherwise(run))
        return F.when(F.size(x["runs"]) > 0, F.array_join(F.zip_with(x["between"], stand_ins, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(x["text"])

    return once(once(text, told_apart), clean)


def scrub_fixture(text: Column) -> Column:
    """A page without personal data. To scrub twice is to scrub once."""
    out = _without_cards(F.regexp_replace(text, EMAIL[1], EMAIL[2]))
    for _, pattern, stand_in in RULES:
        out = F.regexp_replace(out, pattern, stand_in)
    return out


def pii_hits(text: Column) -> Column:
    """map<rule, how often> of what scrub_fixture would replace; rules that find nothing are left out.

    Each rule reads what the one before has left, worked out once: a text and the counts so far go from rule to rule.
    """

    def rule(name: str, pattern: str, stand_in: str | None) -> Callable[[Column], Column]:
        def step(so_far: Column) -> Column:
            found = F.regexp_extract_all(so_far["text"], F.lit(f"({pattern})"), F.lit(1))
            found = F.filter(found, luhn_valid) if stand_in is None else found
            left = _without_cards(so_far["text"]) if stand_in is None else F.regexp_replace(so_far["text"], pattern, stand_in)
            return F.struct(left.alias("text"), F.array_append(so_far["counts"], F.struct(F.lit(name).alias("rule"), F.size(found).alias("n"))).alias("counts"))

        return step

    out = F.struct(text.alias("text"), F.array().cast("array<struct<rule:string,n:int>>").alias("counts"))
    for each in (EMAIL, ("card-number", CARD, None), *RULES):
        out = once(out, rule(*each))
    return F.map_from_entries(F.filter(out["counts"], lambda c: c["n"] > 0))


def normalise_html(html: Column, freeze_clock_to: int | None = None) -> Column:
    """A page that loads nothing and runs nothing; with ``freeze_clock_to`` its 13-digit epochs are all that one."""
    out = html
    for pattern, stand_in in MARKUP:
        out = F.regexp_replace(out, pattern, stand_in)
    return out if freeze_clock_to is None else F.regexp_replace(out, EPOCH, str(freeze_clock_to))
