"""Column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def only_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def ln(c: Column) -> Column:
    """The natural logarithm as SQL has it: minus infinity at 0 and NaN below, where the engine's own is null."""
    return F.when(c > 0, F.log(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL has it: infinite or NaN over 0, where the engine's own fails."""
    over_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b != 0, a / b).when(b == 0, over_zero)


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def var_or_zero(c: Column) -> Column:
    """Sample variance, 0 below two values."""
    return F.coalesce(F.var_samp(c), F.lit(0.0))
