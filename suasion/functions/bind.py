"""Naming a value inside an expression, so that it is worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a dear value as a column, worked out once a row whatever reads it.

    A projection may be folded into what follows, and its value with it into each place that names it; a generator is not.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
