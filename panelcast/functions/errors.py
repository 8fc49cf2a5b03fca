"""The six forecast error measures, as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_DENOMINATOR = 1e-9  # fixed value: floor for |actual| in the percentage error


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(F.abs(actual - forecast))


def rmse(actual: Column, forecast: Column) -> Column:
    return F.sqrt(F.avg((actual - forecast) * (actual - forecast)))


def mape(actual: Column, forecast: Column) -> Column:
    floor = F.greatest(F.abs(actual), F.lit(SMALLEST_DENOMINATOR))
    return F.avg(F.abs(actual - forecast) / floor) * 100.0


def bias(actual: Column, forecast: Column) -> Column:
    return F.avg(forecast - actual)


def wape(actual: Column, forecast: Column) -> Column:
    return F.try_divide(F.sum(F.abs(actual - forecast)), F.sum(actual)) * 100.0


def accuracy(actual: Column, forecast: Column) -> Column:
    share = wape(actual, forecast)
    return F.when(share.isNotNull(), F.greatest(F.lit(100.0) - share, F.lit(0.0)))


MEASURES = {
    "mae": mae,
    "rmse": rmse,
    "mape": mape,
    "bias": bias,
    "wape": wape,
    "accuracy": accuracy,
}
