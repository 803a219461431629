"""Naming a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row.

    An expression used inside a lambda is otherwise computed again for every
    element that the lambda sees.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread_out(df: DataFrame, array: str, value: str, place: str = "p") -> DataFrame:
    """A row for each element of `array`, with its place instead of the array; an empty array has none.

    posexplode() would do, but for it the optimiser adds a filter on the array's
    size below, which computes the array's expression a second time.
    """
    others = [c for c in df.columns if c != array]
    out = df.select(*others, F.posexplode_outer(array).alias(place, value))
    return out.filter(F.col(place).isNotNull())
