"""Forecasts past the end of the data, and as they would have been made in the past."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import Bounds, Grain
from panelcast.operators import recursion
from panelcast.operators.ranking import latest_row
from panelcast.plans.feature_frame import FeatureConfig, create_features
from panelcast.plans.period_tables import imputed, staged_metrics
from panelcast.plans.tuning import ridge_predict
from panelcast.session import stage
from panelcast.sources.facts import Facts


def scoring_rows(
    table: DataFrame, cfg: FeatureConfig, grain: Grain, series_keys: list[str], features: list[str]
) -> DataFrame:
    """Newest feature row of each series: its target is the period still to come."""
    frame, _ = create_features(table, cfg, grain, series_keys, features)
    return latest_row(frame.select(*series_keys, grain.period, *features), grain.period, series_keys)


def next_period_ridge(
    table: DataFrame,
    models: DataFrame,
    cfg: FeatureConfig,
    grain: Grain,
    series_keys: list[str],
    features: list[str],
) -> DataFrame:
    rows = scoring_rows(table, cfg, grain, series_keys, features)
    predicted = ridge_predict(rows, models, features, series_keys)
    return _labelled(predicted, grain, series_keys, F.col("y_pred"))


def next_period_pooled(
    table: DataFrame,
    model: PipelineModel,
    cfg: FeatureConfig,
    grain: Grain,
    series_keys: list[str],
    features: list[str],
) -> DataFrame:
    rows = scoring_rows(table, cfg, grain, series_keys, features)
    return _labelled(model.transform(rows), grain, series_keys, F.col("prediction"))


def _labelled(predicted: DataFrame, grain: Grain, series_keys: list[str], value) -> DataFrame:
    last = F.col(grain.period)
    return predicted.select(
        *series_keys,
        last.alias("last_observed"),
        grain.shift(last).alias("period"),
        value.alias("y_pred"),
    )


def recursive_pooled(
    table: DataFrame,
    model: PipelineModel,
    cfg: FeatureConfig,
    grain: Grain,
    series_keys: list[str],
    features: list[str],
    horizon: int,
) -> DataFrame:
    """Recursive forecast with any fitted pipeline."""
    return recursion.recursive(table, model.transform, "prediction", features, cfg, grain, series_keys, horizon)


CUTOFF = "cutoff"


def as_of_each(metrics: DataFrame, cutoffs: list[dt.date], period: str) -> DataFrame:
    """Every row once for each cutoff that knows it, with the cutoff's month as a further series key."""
    known = F.array(*[F.lit(c.replace(day=1)) for c in sorted({c.replace(day=1) for c in cutoffs})])
    return metrics.withColumn(CUTOFF, F.explode(F.filter(known, lambda c: c >= F.trunc(period, "month"))))


def simulate_cutoffs(
    facts: Facts,
    cutoffs: list[dt.date],
    series_keys: list[str],
    forecaster: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """Forecast the month after each cutoff from facts up to the end of that month only.

    Metrics, top categories and first sightings of a month do not depend on later months,
    so the facts are read once, up to the last cutoff.  The cutoff then is a series key like
    any other: medians, windows, models and forecasts are taken per series and cutoff, in
    one plan whatever the number of cutoffs.  ``forecaster`` gets the table and its keys.
    """
    after = max((c.replace(day=1) + dt.timedelta(days=32)).replace(day=1) for c in cutoffs)
    metrics = stage(staged_metrics(facts, Bounds(before=after), series_keys), "metrics")
    keys = [*series_keys, CUTOFF]
    return forecaster(imputed(as_of_each(metrics, cutoffs, "month"), keys), keys)


def append_forecast(history: DataFrame, forecast: DataFrame, grain: Grain, series_keys: list[str]) -> DataFrame:
    """History with the forecast rows behind it."""
    observed = history.select(
        *series_keys,
        F.col(grain.period).alias("period"),
        F.col(grain.revenue).cast("double").alias("value"),
        F.lit(False).alias("is_forecast"),
    )
    ahead = forecast.select(
        *series_keys, "period", F.col("y_pred").alias("value"), F.lit(True).alias("is_forecast")
    )
    return observed.unionByName(ahead)


