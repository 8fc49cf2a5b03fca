"""Forecasts without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.calendar import Grain


def naive_last(df: DataFrame, grain: Grain, series_keys: list[str]) -> DataFrame:
    """One step ahead: each period is forecast with the row before it."""
    w = Window.partitionBy(*series_keys).orderBy(grain.period)
    value = F.col(grain.revenue).cast("double")
    return _forecasts(df, grain, series_keys, "naive_last", F.lag(value, 1).over(w))


def seasonal_naive(df: DataFrame, grain: Grain, series_keys: list[str], season: int) -> DataFrame:
    """One step ahead from one season ago, or from the last row while history is short."""
    w = Window.partitionBy(*series_keys).orderBy(grain.period)
    value = F.col(grain.revenue).cast("double")
    forecast = F.coalesce(F.lag(value, season).over(w), F.lag(value, 1).over(w))
    return _forecasts(df, grain, series_keys, f"seasonal_naive_{season}", forecast)


def _forecasts(df, grain, series_keys, model, forecast) -> DataFrame:
    """The long form all forecasts share; the first row of a series has no history."""
    return df.select(
        *series_keys,
        F.lit(model).alias("model"),
        F.col(grain.period).alias("period"),
        F.col(grain.revenue).cast("double").alias("y_true"),
        forecast.alias("y_pred"),
    ).where(F.col("y_pred").isNotNull())


def trend_line(df: DataFrame, grain: Grain, series_keys: list[str]) -> DataFrame:
    """Least-squares line over the position in the series: slope, intercept and fit."""
    w = Window.partitionBy(*series_keys).orderBy(grain.period)
    rows = df.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    y = F.col(grain.revenue).cast("double")
    return rows.groupBy(*series_keys).agg(
        F.regr_slope(y, F.col("_x")).alias("slope"),
        F.regr_intercept(y, F.col("_x")).alias("intercept"),
        F.regr_r2(y, F.col("_x")).alias("r2"),
    )


def _steps(origin: DataFrame, grain: Grain, horizon: int) -> DataFrame:
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    ahead = origin.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    shift = "add_months(_last, step)" if grain.unit == "month" else "date_add(_last, step)"
    return ahead.withColumn("period", F.expr(shift))


def _origin(df: DataFrame, grain: Grain, series_keys: list[str]) -> DataFrame:
    """End of each history: last period, last value, number of rows."""
    value = F.col(grain.revenue).cast("double")
    return df.groupBy(*series_keys).agg(
        F.max(grain.period).alias("_last"),
        F.max_by(value, F.col(grain.period)).alias("_value"),
        F.count(F.lit(1)).alias("_n"),
    )


def naive_ahead(df: DataFrame, grain: Grain, series_keys: list[str], horizon: int) -> DataFrame:
    """``horizon`` steps past the end of history, all at the last value."""
    return _steps(_origin(df, grain, series_keys), grain, horizon).select(
        *series_keys, "period", "step", F.col("_value").alias("y_pred")
    ).where(F.col("period").isNotNull())


def seasonal_ahead(
    df: DataFrame, grain: Grain, series_keys: list[str], horizon: int, season: int
) -> DataFrame:
    """``horizon`` steps that repeat the last season over and over.

    Each step names the row it copies by its distance from the end, and meets it in an
    equi-join with the last season of every series.
    """
    from_end = F.row_number().over(Window.partitionBy(*series_keys).orderBy(F.desc(grain.period)))
    recent = (
        df.withColumn("_from_end", from_end)
        .where(F.col("_from_end") <= season)
        .select(*series_keys, "_from_end", F.col(grain.revenue).cast("double").alias("_season_value"))
    )
    steps = _steps(_origin(df, grain, series_keys), grain, horizon).withColumn(
        "_from_end", F.lit(season) - (F.col("step") - 1) % season
    )
    return steps.join(recent, [*series_keys, "_from_end"], "left").select(
        *series_keys, "period", "step", F.coalesce("_season_value", "_value").alias("y_pred")
    ).where(F.col("period").isNotNull())
