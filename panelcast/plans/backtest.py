"""Expanding-window backtests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import ridge
from panelcast.operators.splits import with_origins
from panelcast.operators.trees import Candidate
from panelcast.operators.windows import series_window
from panelcast.plans.tuning import fit_pipeline, pooled_forecasts, with_series_value


def ridge_backtest(
    rows: DataFrame,
    features: list[str],
    label: str,
    period: str,
    series_keys: list[str],
    alpha: DataFrame | float,
    test_size: int,
    min_train: int,
) -> DataFrame:
    """A fresh ridge for every origin of every series, in one pass.

    The moments of the rows before each origin are running aggregates of one window, so
    an origin costs a p × p solve and no refit over history.
    """
    columns = [*series_keys, period, "target_period", *features, label]
    flagged = with_origins(rows.select(*columns), period, series_keys, test_size, min_train)
    known = ridge.with_moments_before(flagged, features, label, series_window(series_keys, period))
    origins = known.where(F.col("is_origin") & (F.col("_n") > 0))
    if isinstance(alpha, DataFrame):
        origins = with_series_value(origins, alpha.select(*series_keys, "alpha"), series_keys)
    else:
        origins = origins.withColumn("alpha", F.lit(float(alpha)))
    fitted = ridge.with_coefficients(origins, len(features))
    return fitted.select(
        *series_keys,
        F.lit("ridge").alias("model"),
        "t",
        F.col("target_period").alias("period"),
        F.col(label).alias("y_true"),
        ridge.linear(features).alias("y_pred"),
    )


def pooled_backtest(
    rows: DataFrame,
    candidate: Candidate,
    point: dict,
    features: list[str],
    label: str,
    period: str,
    series_keys: list[str],
    refits: list[dt.date],
    end: dt.date,
) -> DataFrame:
    """Refit a pooled model at each date and forecast up to the next one.

    A fit at date ``d`` sees only rows whose target lies before ``d``.  The dates are
    few (one per month of the backtest); each fit runs on the cluster.
    """
    parts = []
    for begin, stop in zip(refits, [*refits[1:], end]):
        train = rows.where(F.col("target_period") < F.lit(begin))
        test = rows.where((F.col("target_period") >= F.lit(begin)) & (F.col("target_period") < F.lit(stop)))
        model = fit_pipeline(train, candidate, features, label, point)
        parts.append(pooled_forecasts(model, test, candidate.name, label, series_keys))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
