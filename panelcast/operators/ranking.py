"""Top rows, latest rows, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASELINES = ("naive_last", "seasonal_naive_12", "seasonal_naive_7")


def strongest(df: DataFrame, score: str, k: int, name: str = "feature") -> DataFrame:
    """The ``k`` rows with the largest absolute score, names deciding ties."""
    return df.orderBy(F.desc(F.abs(score)), F.asc(name)).limit(k)


def latest_row(df: DataFrame, period: str, series_keys: list[str]) -> DataFrame:
    """Last row of each series, by a mergeable aggregate."""
    packed = F.max_by(F.struct(*df.columns), F.col(period)).alias("row")
    return df.groupBy(*series_keys).agg(packed).select("row.*")


def last_rows(df: DataFrame, period: str, series_keys: list[str], n: int) -> DataFrame:
    """Last ``n`` rows of each series."""
    from_end = F.row_number().over(Window.partitionBy(*series_keys).orderBy(F.desc(period)))
    return df.withColumn("_from_end", from_end).where(F.col("_from_end") <= n).drop("_from_end")


def leaderboard(scores: DataFrame, series_keys: list[str], measure: str = "mape") -> DataFrame:
    """Models ranked per series, names deciding ties."""
    w = Window.partitionBy(*series_keys).orderBy(F.asc_nulls_last(measure), F.asc("model"))
    return scores.withColumn("place", F.row_number().over(w))


def winner(scores: DataFrame, series_keys: list[str], measure: str = "mape") -> DataFrame:
    """Best candidate per series; baselines are listed but never chosen."""
    board = leaderboard(scores.where(~F.col("model").isin(*BASELINES)), series_keys, measure)
    return board.where(F.col("place") == 1).drop("place")


def skill(scores: DataFrame, series_keys: list[str], baseline: str = "naive_last") -> DataFrame:
    """Each model against the baseline of its series: 1 - mape / baseline mape."""
    w = Window.partitionBy(*series_keys)
    reference = F.max(F.when(F.col("model") == baseline, F.col("mape"))).over(w)
    return (
        scores.withColumn("baseline_mape", reference)
        .where(F.col("model") != baseline)
        .withColumn("skill", 1 - F.try_divide(F.col("mape"), F.col("baseline_mape")))
        .withColumn("beats_baseline", F.col("mape") < F.col("baseline_mape"))
    )
