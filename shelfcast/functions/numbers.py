"""Clipping, rounding and error measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WMAPE_EPSILON = 1e-8


def clip_at_zero(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and infinities become 0, all else is clipped at 0."""
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(usable, clip_at_zero(value)).otherwise(F.lit(0.0))


def whole_quantity(value: Column) -> Column:
    """Nearest whole number, halves away from zero, never negative, as BIGINT."""
    value = value.cast("double")
    return F.greatest(F.lit(0.0), F.round(F.nanvl(value, F.lit(0.0)))).cast("bigint")


def wmape(actual: Column, predicted: Column) -> Column:
    """Aggregate: sum of absolute errors over the sum of absolute actuals.

    Rows where either side is null do not count; null when no row counts.
    """
    both = actual.isNotNull() & predicted.isNotNull()
    error = F.sum(F.when(both, F.abs(actual - predicted)))
    volume = F.sum(F.when(both, F.abs(actual)))
    return error / (volume + F.lit(WMAPE_EPSILON))
