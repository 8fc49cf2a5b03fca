"""Row-level preparation: parsing, null and outlier handling, cuts in time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DateRange = tuple[dt.date, dt.date]


def coerce_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse the text columns that exist; what cannot be parsed becomes null."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(
        {c: F.try_to_timestamp(F.col(c)) for c in columns if c in text}
    )


def drop_undated(df: DataFrame, ts: str) -> DataFrame:
    return df.na.drop(subset=[ts])


def as_of(df: DataFrame, period: str, cutoff: dt.date) -> DataFrame:
    """History known at ``cutoff``."""
    return df.where(F.col(period) <= F.lit(cutoff))


def pick_month(df: DataFrame, period: str, month: dt.date) -> DataFrame:
    """Rows of one calendar month, as a plain range."""
    first = F.lit(month.replace(day=1))
    return df.where((F.col(period) >= first) & (F.col(period) < F.add_months(first, 1)))


def outside(period: Column, ranges: list[DateRange]) -> Column:
    """True where ``period`` is in none of the closed ``ranges``."""
    keep = F.lit(True)
    for start, end in ranges:
        keep = keep & ~period.between(F.lit(start), F.lit(end))
    return keep


def audit(df: DataFrame, period: str) -> DataFrame:
    """Rows, columns, first and last period, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    )


def clean_trailing(
    df: DataFrame,
    columns: list[str],
    period: str,
    series_keys: list[str],
    rows: int = 12,
    low: float = 0.05,
    high: float = 0.95,
) -> DataFrame:
    """Fill nulls and clip outliers with what the rows before show.

    A null takes the last value seen; a value outside the ``low``..``high`` percentiles
    of the ``rows`` before it is moved to the nearer bound.  No row looks ahead.
    """
    w = Window.partitionBy(*series_keys).orderBy(period)
    before = w.rowsBetween(-rows, -1)
    filled = df.withColumns(
        {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    )
    bounds = {f"_{c}_bounds": F.percentile(F.col(c), F.array(F.lit(low), F.lit(high))).over(before) for c in columns}
    clipped = {
        c: F.when(F.col(f"_{c}_bounds").isNull(), F.col(c)).otherwise(
            F.least(F.greatest(F.col(c), F.col(f"_{c}_bounds")[0]), F.col(f"_{c}_bounds")[1])
        )
        for c in columns
    }
    return filled.withColumns(bounds).withColumns(clipped).drop(*bounds)


def zscore(df: DataFrame, columns: list[str], series_keys: list[str]) -> DataFrame:
    """Standardise with the population deviation; a constant column becomes zero."""
    w = Window.partitionBy(*series_keys)
    return df.withColumns(
        {
            f"{c}_z": F.coalesce(
                F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0)
            )
            for c in columns
        }
    )


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Indicator columns for a fixed list of values."""
    return df.withColumns(
        {f"{column}_is_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    )
