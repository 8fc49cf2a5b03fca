"""Error tables and error measures of forecasts in long form.

A forecast frame has the series keys, ``model``, ``period`` (the period forecast),
``y_true`` and ``y_pred``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import MONTH
from panelcast.functions.errors import MEASURES
from panelcast.functions.numeric import ratio
from panelcast.operators.cleaning import DateRange, outside


def score(
    forecasts: DataFrame,
    groups: list[str | Column],
    measures: tuple[str, ...] = tuple(MEASURES),
    prefix: str = "",
) -> DataFrame:
    """Error measures per group in one aggregation."""
    y, p = F.col("y_true"), F.col("y_pred")
    return forecasts.groupBy(*groups).agg(*[MEASURES[m](y, p).alias(f"{prefix}{m}") for m in measures])


def masked_score(forecasts: DataFrame, groups: list[str], ranges: list[DateRange], on: str = "period") -> DataFrame:
    """Scores that leave out shock periods."""
    kept = forecasts.where(outside(F.col(on), ranges))
    return score(kept, groups, ("mae", "rmse", "mape", "bias"))


def monthly_scores(forecasts: DataFrame, groups: list[str]) -> DataFrame:
    """Daily forecasts summed to months and scored there."""
    months = forecasts.groupBy(*groups, MONTH.bucket(F.col("period")).alias("period")).agg(
        F.sum("y_true").alias("y_true"), F.sum("y_pred").alias("y_pred")
    )
    return score(months, groups, prefix="monthly_")


def error_table(forecasts: DataFrame) -> DataFrame:
    """Absolute and relative error of every forecast."""
    error = F.col("y_pred") - F.col("y_true")
    return forecasts.withColumns(
        {
            "error": error,
            "abs_error": F.abs(error),
            "abs_error_pct": ratio(F.abs(error), F.col("y_true")) * 100,
            "error_pct": ratio(error, F.col("y_true")) * 100,
        }
    )


def compare(actual: DataFrame, forecast: DataFrame, on: list[str], value: str) -> DataFrame:
    """Actual next to forecast, keeping periods that only one side has."""
    return (
        actual.select(*on, F.col(value).alias(f"{value}_real"))
        .join(forecast.select(*on, F.col(value).alias(f"{value}_pred")), on, "outer")
    )


def compare_totals(both: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Totals, difference and MAPE of a comparison; unmatched periods stay out of the MAPE."""
    real, pred = F.col(f"{value}_real"), F.col(f"{value}_pred")
    totals = both.groupBy(*groups).agg(
        F.coalesce(F.sum(real), F.lit(0.0)).alias("total_real"),
        F.coalesce(F.sum(pred), F.lit(0.0)).alias("total_pred"),
        (F.avg(ratio(F.abs(real - pred), real)) * 100).alias("mape"),
    )
    return totals.withColumn("diff", F.col("total_pred") - F.col("total_real"))


def long_measures(wide: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """One row per measure."""
    return wide.unpivot(ids, measures, "metric", "value")
