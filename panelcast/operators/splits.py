"""Splits that respect time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail_holdout(
    df: DataFrame, period: str, series_keys: list[str], test_size: int, strict: bool = True
) -> DataFrame:
    """Label the last ``test_size`` periods of each series ``test``, the rest ``train``.

    ``strict`` fails when a series has nothing left to train on.
    """
    if test_size <= 0:
        raise ValueError("test_size must be positive")
    from_end = F.row_number().over(Window.partitionBy(*series_keys).orderBy(F.desc(period)))
    length = F.count(F.lit(1)).over(Window.partitionBy(*series_keys))
    split = F.when(from_end <= test_size, "test").otherwise("train")
    if strict:
        short = F.raise_error(F.lit(f"a series has no more than {test_size} periods"))
        split = F.when(length <= test_size, short.cast("string")).otherwise(split)
    return df.withColumn("split", split)


def phase(
    period: Column, train_end: dt.date, backtest_end: dt.date, final_end: dt.date | None = None
) -> Column:
    """``train`` / ``backtest`` / ``final`` by date; null behind the last phase in scope."""
    label = F.when(period <= F.lit(train_end), "train").when(period <= F.lit(backtest_end), "backtest")
    return label if final_end is None else label.when(period <= F.lit(final_end), "final")


def segments(df: DataFrame, period: str, bounds: list[tuple[str, dt.date | None, dt.date]]) -> DataFrame:
    """Rows with the segments they lie in.

    Segments are closed and may share an end point, so that drawn lines meet; such a
    point appears once for each.
    """
    p = F.col(period)
    inside = [
        F.when((p >= F.lit(low) if low else F.lit(True)) & (p <= F.lit(high)), F.lit(name))
        for name, low, high in bounds
    ]
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*inside))))


def period_axis(df: DataFrame, period: str) -> DataFrame:
    """Distinct periods with their position and number.

    Folds are cut on this axis and not on rows, so that all series of a panel share
    their cut dates.  The calendar bounds its length.
    """
    w = Window.partitionBy().orderBy(period)
    return (
        df.select(period)
        .distinct()
        .select(
            period,
            (F.row_number().over(w) - 1).cast("bigint").alias("position"),
            F.count(F.lit(1)).over(Window.partitionBy()).alias("length"),
        )
    )


def fold_axis(df: DataFrame, period: str, n_splits: int) -> DataFrame:
    """Expanding folds: period × fold with its role (``train`` or ``test``).

    Fold ``f`` of ``k`` tests a block of ``length div (k+1)`` periods and trains on all
    periods before it; the last fold ends with the last period.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    axis = period_axis(df, period)
    size = F.floor(F.col("length") / (n_splits + 1))
    folds = axis.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(n_splits)])))
    start = F.col("length") - (F.lit(n_splits) - F.col("fold")) * size
    role = F.when(F.col("position") < start, "train").when(F.col("position") < start + size, "test")
    return folds.withColumn("role", role).where(F.col("role").isNotNull()).select(
        period, "position", "fold", "role"
    )


def with_folds(df: DataFrame, period: str, n_splits: int) -> DataFrame:
    """Rows repeated for each fold they take part in (at most ``n_splits`` times)."""
    return df.join(fold_axis(df, period, n_splits).drop("position"), period, "inner")


def with_origins(
    df: DataFrame, period: str, series_keys: list[str], test_size: int, min_train: int
) -> DataFrame:
    """Position ``t`` of each row in its series and whether it is a backtest origin.

    Origins are the last ``test_size`` rows, never before ``min_train``: a model that
    predicts row ``t`` is fitted on the rows before ``t``.
    """
    order = Window.partitionBy(*series_keys).orderBy(period)
    t = (F.row_number().over(order) - 1).cast("bigint")
    n = F.count(F.lit(1)).over(Window.partitionBy(*series_keys))
    start = F.greatest(F.lit(min_train), n - test_size)
    return df.withColumn("t", t).withColumn("is_origin", F.col("t") >= start)


def with_origins_from(
    df: DataFrame, period: str, series_keys: list[str], start: dt.date, end: dt.date
) -> DataFrame:
    """As :func:`with_origins`, from a start date to an end date; rows behind it drop out.

    Fails when a series ends before the start date.
    """
    w = Window.partitionBy(*series_keys)
    t = (F.row_number().over(w.orderBy(period)) - 1).cast("bigint")
    late = F.raise_error(F.lit(f"no data from {start} on")).cast("boolean")
    first = F.lit(start)
    flag = F.when(F.max(period).over(w) < first, late).otherwise(F.col(period) >= first)
    return df.where(F.col(period) <= F.lit(end)).withColumn("t", t).withColumn("is_origin", flag)
