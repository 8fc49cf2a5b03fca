"""Rows against a table of date ranges: an equi-join on calendar bins, whatever the number of ranges.

A range is spread over the months it touches, a row meets the ranges of its own month, and
the exact ends are compared there; so neither side is compared with all of the other, and a
month of many rows is split as any hot key.  Ranges are closed; one that ends before it
starts, or lacks an end, holds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BIN, _LOW, _HIGH = "_bin", "_low", "_high"


def _binned(ranges: DataFrame, low: str, high: str, *names: str) -> DataFrame:
    """Every range once for each month it touches."""
    first, last = F.to_date(low), F.to_date(high)
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    known = ranges.where(first.isNotNull() & last.isNotNull() & (first <= last))
    return known.select(*names, first.alias(_LOW), last.alias(_HIGH), F.explode(months).alias(_BIN))


def _within(df: DataFrame, period: str):
    return (F.trunc(df[period], "month") == F.col(_BIN)) & df[period].between(F.col(_LOW), F.col(_HIGH))


def outside_ranges(df: DataFrame, period: str, ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose ``period`` lies in none of the ``ranges``; rows without a period stay."""
    binned = _binned(ranges, start, end).distinct()
    return df.join(binned, _within(df, period), "left_anti")


def in_segments(
    df: DataFrame, period: str, segments: DataFrame, name: str = "name", low: str = "lo", high: str = "hi", out: str = "segment"
) -> DataFrame:
    """Rows with the segments they lie in, one row for each; rows in none drop out.

    Segments may share end points and overlap, as lines that are to meet do.
    """
    binned = _binned(segments, low, high, F.col(name).alias(out))
    return df.join(binned, _within(df, period), "inner").drop(_BIN, _LOW, _HIGH)
