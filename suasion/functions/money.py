"""Prices in text: parsing and formatting in minor units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.functions.bind import bound

# fixed values: currency signs, the form of a number and of a price, the largest plausible amount
SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR"}
NUMBER = r"(?:\d{1,3}(?:[.,\s]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+[.,]\d{2}|\d+[.,]\d(?!\d)|\d+(?!\d))"
PRICE = rf"(?:[$£€¥₹]\s?|(?:USD|GBP|EUR|JPY|INR|CAD|AUD)\s){NUMBER}|{NUMBER}\s?[$£€¥₹]"
MOST = 100_000_000
#: What stands around the number in what is written like a price.
AROUND = "$£€¥₹ \t\n\r\f\x0bUSDEGBPJYINRCA"
#: How sure an amount with a sign or code is.
CONFIDENCE = 0.9
#: What a text must hold to be worth the longer pattern.
SIGN = "[$£€¥₹]|USD|GBP|EUR|JPY|INR|CAD|AUD"


def _coded(token: Column) -> Column:
    """The currency of a sign or code."""
    return F.coalesce(*(F.when(token == s, F.lit(c)) for s, c in SYMBOLS.items()), F.nullif(token, F.lit("")), F.lit("USD"))


def _bare(raw: Column) -> Column:
    """Digits and separators of what is written like a price."""
    return F.translate(raw, AROUND, "")


def _tail(bare: Column) -> Column:
    return F.regexp_extract(bare, r"[.,](\d*)$", 1)


def _decimals(bare: Column) -> Column:
    """The decimals as written, or null: of two kinds of separator the last is decimal; a single one before exactly three digits is not."""
    both = bare.contains(".") & bare.contains(",")
    return F.when((bare.contains(".") | bare.contains(",")) & (both | ~bare.rlike(r"[.,]\d{3}$")), _tail(bare))


def _amount(bare: Column, decimals: Column, yen: Column) -> Column:
    digits = F.translate(bare, ".,", "")
    # the decimals are the last digits, so whole and fraction are both cut from the bare digits
    cut = F.coalesce(F.length(decimals), F.lit(0))
    whole = F.coalesce(F.nullif(F.substring(digits, F.lit(1), F.length(digits) - cut), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    cents = F.rpad(F.concat(F.coalesce(decimals, F.lit("")), F.lit("00")), 2, "0").cast("long")
    return F.when(yen, whole).otherwise(whole * 100 + cents)


def minor_units(raw: Column, currency: Column) -> Column:
    """A written number in minor units."""
    bare = F.regexp_replace(raw, r"[^0-9.,]", "")
    return _amount(bare, _decimals(bare), currency == "JPY")


def _written(text: Column) -> Column:
    """All that is written like a price, in order; a text without a sign is not looked at."""
    return F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(f"({PRICE})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _yen(raw: Column) -> Column:
    return raw.contains("¥") | raw.contains("JPY")


def with_amounts(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """The rows with struct<n, low, high>: how many plausible prices ``parse_prices`` finds in a text, the lowest and the highest.

    Most texts write one price at most: its amount is made by columns that are bound one by one, so that it is compiled; only
    texts with several go through lambdas, which are interpreted.
    """
    raws, first = F.col("_raws"), F.get("_raws", F.lit(0))
    one = bound(bound(rows, "_raws", _written(text)), "_bare", _bare(first))
    one = bound(bound(one, "_decimals", _decimals(F.col("_bare"))), "_one", _amount(F.col("_bare"), F.col("_decimals"), _yen(first)))
    read = F.transform(raws, lambda r: F.struct(_yen(r).alias("yen"), _bare(r).alias("bare")))
    split = F.transform(read, lambda x: F.struct(x["yen"].alias("yen"), x["bare"].alias("bare"), _decimals(x["bare"]).alias("decimals")))
    several = F.transform(split, lambda x: _amount(x["bare"], x["decimals"], x["yen"]))
    one = bound(one, "_all", F.when(F.size(raws) > 1, F.filter(several, lambda a: a <= MOST)))
    alone = F.when((F.size(raws) == 1) & (F.col("_one") <= MOST), F.col("_one"))
    said = lambda n, low, high: F.struct(n.alias("n"), low.alias("low"), high.alias("high"))
    found = F.when(F.size(raws) > 1, said(F.size("_all"), F.array_min("_all"), F.array_max("_all"))).otherwise(said(alone.isNotNull().cast("int"), alone, alone))
    return bound(one.select(*rows.columns, "_raws", "_one", "_all"), name, found).select(*rows.columns, name)


def parse_prices(text: Column) -> Column:
    """All plausible prices of a text in order: array<struct<amount, currency, raw, start, end, fraction, confidence>>.

    ``start`` and ``end`` are places in the text, from 0, end exclusive; ``fraction`` are the decimals as written. Each step
    is bound once, by a transform of its own, so nothing is worked out twice; a text without a sign is not looked at.
    """
    read = F.transform(_placed(text, _written(text)), lambda r: F.struct(r["raw"].alias("raw"), r["start"].alias("start"), _coded(F.regexp_extract(r["raw"], "[$£€¥₹]|[A-Z]{3}", 0)).alias("currency"), _bare(r["raw"]).alias("bare")))
    split = F.transform(read, lambda x: F.struct(x["raw"].alias("raw"), x["start"].alias("start"), x["currency"].alias("currency"), x["bare"].alias("bare"), _decimals(x["bare"]).alias("decimals")))
    priced = F.transform(
        split,
        lambda x: F.struct(
            _amount(x["bare"], x["decimals"], x["currency"] == "JPY").alias("amount"), x["currency"].alias("currency"), x["raw"].alias("raw"), x["start"].alias("start"), (x["start"] + F.length(x["raw"])).alias("end"),
            F.coalesce(x["decimals"], F.lit("")).alias("fraction"), F.lit(CONFIDENCE).alias("confidence"),
        ),
    )
    return F.filter(priced, lambda p: p["amount"] <= MOST)


def _placed(text: Column, raws: Column) -> Column:
    """Each written price with where (from 0) it begins: array<struct<raw, start>>.

    What is written like a price is one wherever it stands, so the next place of its text is its own.
    """
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw: string, start: int>>").alias("found"))

    def step(so_far: Column, raw: Column) -> Column:
        start = F.call_function("locate", raw, text, so_far["at"] + 1) - 1
        return F.struct((start + F.length(raw)).alias("at"), F.array_append(so_far["found"], F.struct(raw.alias("raw"), start.alias("start"))).alias("found"))

    return F.aggregate(raws, none, step, lambda x: x["found"])


def without_price(text: Column, raw: Column) -> Column:
    """A text without its only written price, as a label: single blanks, no dash or colon at the end, 120 characters at most."""
    before = F.split_part(text, raw, F.lit(1))
    rest = F.concat(before, F.substring(text, F.length(before) + F.length(raw) + 1, F.length(text)))
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"[:•\-–—]+\s*$", "")), F.lit(1), F.lit(120))


def format_minor(amount: Column, currency: Column) -> Column:
    cents = F.concat(F.floor(amount / 100).cast("string"), F.lit("."), F.lpad((amount % 100).cast("string"), 2, "0"))
    return F.when(currency == "JPY", amount.cast("string")).otherwise(cents)


def encode_money(money: Column) -> Column:
    """struct<amount, currency, confidence> as it goes over a wire: the amount as a decimal text."""
    return F.struct(money["amount"].cast("string").alias("minor"), money["currency"].alias("currency"), money["confidence"].alias("confidence"))


def decode_money(wire: Column) -> Column:
    """The reverse; an amount that is no whole number is null."""
    whole = F.when(wire["minor"].rlike(r"^-?\d+$"), wire["minor"].try_cast("long"))
    return F.struct(whole.alias("amount"), wire["currency"].alias("currency"), wire["confidence"].alias("confidence"))
