"""Gaps in the calendar of a series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.calendar import Grain


def densify(df: DataFrame, grain: Grain, series_keys: list[str]) -> DataFrame:
    """One row for every period between the first and last of each series.

    Each row is spread up to the row that follows it, so the table is read once:
    no calendar is built beside it and joined back.
    """
    period = grain.period
    w = Window.partitionBy(*series_keys).orderBy(period)
    following = F.coalesce(F.lead(period).over(w), grain.shift(F.col(period)))
    values = [c for c in df.columns if c not in (*series_keys, period)]
    spread = df.withColumn("_next", following).withColumn(
        "_day", F.explode(F.sequence(F.col(period), grain.shift(F.col("_next"), -1), grain.step()))
    )
    observed = F.col("_day") == F.col(period)
    return spread.select(
        *series_keys,
        F.col("_day").alias(period),
        *[F.when(observed, F.col(c)).alias(c) for c in values],
    )


def fill_both_ways(df: DataFrame, columns: list[str], period: str, series_keys: list[str]) -> DataFrame:
    """Last value seen, or the next one where none has been seen yet.

    What has no value behind it lies before the first value of its series, so that one
    value fills it; a frame running to the end from every row would cost rows squared.
    """
    w = Window.partitionBy(*series_keys).orderBy(period)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(whole))
            for c in columns
        }
    )


def missing_days(df: DataFrame, period: str, series_keys: list[str], months: tuple[dt.date, dt.date]) -> DataFrame:
    """Days without a row in the closed months from ``months[0]`` up to, not including, ``months[1]``.

    Each row names the days up to the row after it, and the first row also those before
    it, so one pass finds the gaps and a series that stops early is reported to the end.
    """
    start, end = F.lit(months[0]), F.date_sub(F.lit(months[1]), 1)
    w = Window.partitionBy(*series_keys).orderBy(period)
    following = F.coalesce(F.lead(period).over(w), F.date_add(end, 1))

    def days(first, last):
        first, last = F.greatest(first, start), F.least(last, end)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))

    behind = days(F.date_add(period, 1), F.date_sub(following, 1))
    before = F.when(F.row_number().over(w) == 1, days(start, F.date_sub(period, 1))).otherwise(
        F.array().cast("array<date>")
    )
    gaps = df.withColumn("_gaps", F.concat(before, behind))
    return gaps.select(*series_keys, F.explode("_gaps").alias(period))
