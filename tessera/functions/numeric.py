"""Numeric helpers that behave alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q6(value: Column) -> Column:
    """Rounded to six decimals by an explicit floor; ``round`` differs between engines."""
    return (F.floor(value * 1e6 + 0.5) / 1e6).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percentile(value: Column, p: float | list[float]) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(value, F.array(*map(F.lit, p)) if isinstance(p, list) else F.lit(p))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where either side is constant."""
    # Constancy is told by the extremes: a merged variance of equal values may be off zero by rounding.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
