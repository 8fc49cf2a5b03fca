"""Scalar helpers.  ANSI mode raises on a zero divisor, so every ratio goes through here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Plain quotient as double; null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_zero_as_one(numerator: Column, denominator: Column) -> Column:
    """Quotient in which a zero denominator counts as one."""
    safe = F.when(denominator == 0, F.lit(1.0)).otherwise(denominator.cast("double"))
    return numerator.cast("double") / safe


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def non_negative(forecast: Column) -> Column:
    """Forecasts below zero become zero."""
    return F.greatest(forecast, F.lit(0.0))


def to_log(target: Column) -> Column:
    return F.log1p(target.cast("double"))


def from_log(prediction: Column) -> Column:
    return F.expm1(prediction)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null for a constant column (``corr`` raises)."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(
        F.covar_pop(x, y),
        F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)),
    )


def steady_round(value: Column, digits: int = 4) -> Column:
    """Round half up with a small push, for results that are compared across engines.

    Means of money often land exactly half way between two roundings; the push of
    a thousandth of a unit keeps summation order from deciding which side they take.
    """
    scale = F.lit(float(10**digits))
    return F.rint(value.cast("double") * scale + F.lit(0.001)) / scale
