"""A 128-bit text hash of two multiplicative halves, in plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: where the halves begin, what is added to each character of the second, and the multiplier 2**40 + LOW
BEGIN, ADDED, LOW = (0xCBF29CE4, 0x84222325), (0, 0x9E37), 0x1B3
_WORD = 0xFFFFFFFF


def _step(high: Column, low: Column, code: Column) -> Column:
    """(high, low) of ((high, low) xor code) times 2**40 + LOW, modulo 2**64, in halves that never overflow."""
    low = low.bitwiseXOR(code)
    product = low * F.lit(LOW).cast("long")
    top = high * F.lit(LOW).cast("long") + F.shiftright(product, 32) + F.shiftleft(low, 8)
    return F.struct(top.bitwiseAND(F.lit(_WORD)).alias("high"), product.bitwiseAND(F.lit(_WORD)).alias("low"))


def create_hash(text: Column) -> Column:
    """64 hexadecimal digits: both halves, twice. Characters of the basic plane count by code point; null stays null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    halves = []
    for begin, added in zip(BEGIN, ADDED, strict=True):
        first = F.struct(F.lit(0).cast("long").alias("high"), F.lit(begin).cast("long").alias("low"))
        halves.append(F.aggregate(codes, first, _folder(added)))
    hexed = [F.concat(*(F.lpad(F.lower(F.hex(h[k])), 8, "0") for k in ("high", "low"))) for h in halves]
    return F.concat(*hexed, *hexed)


def _folder(added: int):  # noqa: ANN202
    def fold(h: Column, c: Column) -> Column:
        return _step(h["high"], h["low"], c + F.lit(added))

    return fold
