"""Small numeric column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: z-scores and group errors map to [0, 1) as m / (m + 3).
HALF_SCORE_AT = 3.0


def clamp01(c: Column) -> Column:
    """Into [0, 1]; null stays null (Spark's greatest / least would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def squash(c: Column) -> Column:
    return clamp01(c / (c + F.lit(HALF_SCORE_AT)))


def usable_std(c: Column) -> Column:
    """Standard deviation fit to divide by: tiny or missing spread counts as 1."""
    ok = c.isNotNull() & ~F.isnan(c) & (c > 1e-12)
    return F.when(ok, c).otherwise(F.lit(1.0))


def add_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mean_present(columns: list[Column]) -> Column:
    """Mean of the non-null columns; null when all are null."""
    total = add_all([F.coalesce(c, F.lit(0.0)) for c in columns])
    count = add_all([c.isNotNull().cast("int") for c in columns])
    return total / F.when(count > 0, count)


def scaled(c: Column, anchor: float, span: float, falling: bool = False) -> Column:
    """One-sided distance from ``anchor`` in units of ``span``, clamped to [0, 1]."""
    away = (F.lit(anchor) - c) if falling else (c - F.lit(anchor))
    return clamp01(away / F.lit(span))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
