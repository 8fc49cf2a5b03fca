"""Alert rules over scores and period tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import ratio

MONTH_INDEX = "year(period) * 12 + month(period)"  # consecutive months differ by one

# The thresholds of the rules.
MAPE_ALERT = 15.0
BIAS_MONTHS = 2
REALIZATION_BAND = (90.0, 110.0)
MAPE_DRIFT = 1.3


def mape_alerts(scores: DataFrame, limit: float = MAPE_ALERT) -> DataFrame:
    return scores.where(F.col("mape") > limit)


def bias_runs(monthly_bias: DataFrame, groups: list[str], longer_than: int = BIAS_MONTHS) -> DataFrame:
    """Runs of consecutive months whose bias keeps one sign, longer than the limit.

    A month that is missing or has no bias ends a run.
    """
    signed = monthly_bias.withColumn("bias_sign", F.signum("bias").cast("int"))
    in_sign = F.row_number().over(Window.partitionBy(*groups, "bias_sign").orderBy("period"))
    runs = signed.where(F.col("bias").isNotNull()).withColumn("_run", F.expr(MONTH_INDEX) - in_sign)
    return (
        runs.where(F.col("bias_sign") != 0)
        .groupBy(*groups, "bias_sign", "_run")
        .agg(
            F.min("period").alias("first_period"),
            F.max("period").alias("last_period"),
            F.count(F.lit(1)).alias("months"),
        )
        .where(F.col("months") > longer_than)
        .drop("_run")
    )


def realization(forecasts: DataFrame, groups: list[str], band: tuple[float, float] = REALIZATION_BAND) -> DataFrame:
    """Forecast over actual in percent, and whether it lies within the band."""
    sums = forecasts.groupBy(*groups).agg(F.sum("y_true").alias("_y"), F.sum("y_pred").alias("_p"))
    rate = ratio(F.col("_p"), F.col("_y")) * 100
    return sums.select(*groups, rate.alias("realization_rate_pct")).withColumn(
        "in_band", F.col("realization_rate_pct").between(*band)
    )


def mape_drift(
    monthly_mape: DataFrame, groups: list[str], baseline: DataFrame | float, factor: float = MAPE_DRIFT
) -> DataFrame:
    """Three-month rolling MAPE against the baseline; only where all three months are there.

    ``baseline`` is one number or a frame with one ``baseline_mape`` per group.
    """
    w = Window.partitionBy(*groups).orderBy(F.expr(MONTH_INDEX)).rangeBetween(-2, 0)
    rolled = monthly_mape.withColumns(
        {"rolling_mape": F.avg("mape").over(w), "_n": F.count("mape").over(w)}
    ).where(F.col("_n") == 3)
    if isinstance(baseline, DataFrame):
        rolled = rolled.join(baseline, groups, "left")
    else:
        rolled = rolled.withColumn("baseline_mape", F.lit(float(baseline)))
    return rolled.drop("_n").withColumn(
        "drifted", F.col("rolling_mape") > factor * F.col("baseline_mape")
    )


def population_stability(
    df: DataFrame, value: str, period: str, groups: list[str], split: dt.date, bins: int = 10
) -> DataFrame:
    """Population stability index of the rows from ``split`` on against those before.

    Bins are quantiles of the rows before; an empty share counts as one in ten thousand.
    Quantile edges, counts and the index all come from aggregates; edges come back to
    the rows through a window over the series at period grain.
    """
    w = Window.partitionBy(*groups)
    old = F.col(period) < F.lit(split)
    edges = F.percentile(F.when(old, F.col(value)), F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    placed = df.where(F.col(value).isNotNull()).withColumn("_edges", edges.over(w)).withColumn(
        "_bin", F.size(F.filter("_edges", lambda e: e < F.col(value)))
    )
    counts = placed.groupBy(*groups).agg(
        F.count(F.when(old, 1)).alias("_old"),
        F.count(F.when(~old, 1)).alias("_new"),
        *[F.count(F.when(old & (F.col("_bin") == b), 1)).alias(f"_o{b}") for b in range(bins)],
        *[F.count(F.when(~old & (F.col("_bin") == b), 1)).alias(f"_n{b}") for b in range(bins)],
    )
    index = F.lit(0.0)
    for b in range(bins):
        was = F.greatest(ratio(F.col(f"_o{b}"), F.col("_old")), F.lit(1e-4))
        now = F.greatest(ratio(F.col(f"_n{b}"), F.col("_new")), F.lit(1e-4))
        index = index + (now - was) * F.ln(now / was)
    return counts.select(*groups, index.alias("psi"))
