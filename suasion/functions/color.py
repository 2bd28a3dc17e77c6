"""Colours and WCAG contrast as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from suasion.functions.bind import once


def parse_color(css: Column) -> Column:
    """struct(r, g, b, a) of rgb(), rgba(), #rgb, #rrggbb, #rrggbbaa and transparent; else null."""
    s = F.lower(F.trim(css))
    rgb = r"^rgba?\(\s*([\d.]+)[\s,]+([\d.]+)[\s,]+([\d.]+)(?:[\s,/]+([\d.]+)(%)?)?\s*\)$"
    part = lambda k: F.regexp_extract(s, rgb, k)
    number = lambda k: part(k).try_cast("double")
    alpha = F.when(part(4) == "", F.lit(1.0)).when(part(5) == "%", number(4) / 100).otherwise(number(4))
    long_hex = F.when(s.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(s, "([0-9a-f])", "$1$1")).otherwise(s)
    byte = lambda at: F.conv(F.substring(long_hex, at, 2), 16, 10).cast("double")
    made = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))
    zero = F.lit(0.0)
    hexed = made(byte(2), byte(4), byte(6), F.when(F.length(long_hex) == 9, byte(8) / 255).otherwise(F.lit(1.0)))
    return F.when(s == "transparent", made(zero, zero, zero, zero)).when(s.rlike(rgb), made(number(1), number(2), number(3), alpha)).when(s.rlike("^#(?:[0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})$"), hexed)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time; null for null."""
    return once(value, lambda v: F.when(v.isNotNull(), use(v)))


def composite(fg: Column, bg: Column) -> Column:
    over = lambda c: (fg[c] * fg["a"] + bg[c] * (1 - fg["a"])).alias(c)
    return F.struct(over("r"), over("g"), over("b"), F.lit(1.0).alias("a"))


def luminance(c: Column) -> Column:
    def channel(v: Column) -> Column:
        s = v / 255
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(c["r"]) + 0.7152 * channel(c["g"]) + 0.0722 * channel(c["b"])


def contrast_ratio(foreground: Column, background: Column) -> Column:
    """1 to 21; translucent colours are laid over white, or over the background. Null unless both parse."""
    white = F.struct(F.lit(255.0).alias("r"), F.lit(255.0).alias("g"), F.lit(255.0).alias("b"), F.lit(1.0).alias("a"))

    def ratio(front: Column, back: Column) -> Column:
        levels = F.transform(F.array(composite(front, back), back), luminance)
        return (F.array_max(levels) + 0.05) / (F.array_min(levels) + 0.05)

    back = _once(parse_color(background), lambda c: composite(c, white))
    return _once(back, lambda b: _once(parse_color(foreground), lambda f: ratio(f, b)))
