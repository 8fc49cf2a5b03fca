"""Period buckets, period bounds and calendar columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    """One period length: the name of its period column and of its revenue column."""

    unit: str
    period: str
    revenue: str

    def bucket(self, ts: Column) -> Column:
        """DATE of the period that holds ``ts``."""
        return F.trunc(ts, "month") if self.unit == "month" else F.to_date(ts)

    def shift(self, period: Column, steps: int = 1) -> Column:
        """The period ``steps`` after ``period``."""
        if self.unit == "month":
            return F.add_months(F.trunc(period, "month"), steps)
        return F.date_add(period, steps)

    def step(self) -> Column:
        return F.expr("interval 1 month" if self.unit == "month" else "interval 1 day")


MONTH = Grain("month", "month", "monthly_revenue")
DAY = Grain("day", "date", "daily_revenue")


@dataclass(frozen=True)
class Bounds:
    """Complete periods only: ``start <= period < before``; either side may be open."""

    start: dt.date | None = None
    before: dt.date | None = None

    @classmethod
    def through(cls, start: dt.date | None, last: dt.date | None) -> "Bounds":
        """Bounds whose upper end ``last`` is itself included."""
        return cls(start, last + dt.timedelta(days=1) if last else None)

    def check(self, grain: Grain) -> "Bounds":
        """Bounds must lie between periods: a cut inside a month is no complete month."""
        if grain.unit == "month" and any(d is not None and d.day != 1 for d in (self.start, self.before)):
            raise ValueError("monthly bounds must be first days of months")
        return self

    def keep(self, df: DataFrame, column: str, lower: bool = True) -> DataFrame:
        """Range filter on a raw timestamp or date column, so that it reaches the scan.

        ``lower=False`` leaves the lower end open, for first-seen questions, which
        need the whole past.
        """
        kind = df.schema[column].dataType
        if lower and self.start is not None:
            df = df.where(F.col(column) >= F.lit(self.start).cast(kind))
        if self.before is not None:
            df = df.where(F.col(column) < F.lit(self.before).cast(kind))
        return df


def month_table_columns(period: Column) -> dict[str, Column]:
    return {"year": F.year(period), "month_num": F.month(period)}


def day_table_columns(period: Column) -> dict[str, Column]:
    return {
        "year": F.year(period),
        "month": F.month(period),
        "day": F.dayofmonth(period),
        "day_of_week": F.weekday(period),
    }


def calendar_features(period: str, grain: Grain) -> dict[str, str]:
    """Calendar position of a period; daily grain adds weekday and month-edge flags."""
    out = {"quarter": f"quarter({period})", "month_num": f"month({period})"}
    if grain.unit == "day":
        out |= {
            "day_of_week": f"weekday({period})",
            "is_weekend": f"int(weekday({period}) >= 5)",
            "is_month_start": f"int(day({period}) = 1)",
            "is_month_end": f"int({period} = last_day({period}))",
            "day_of_month": f"day({period})",
        }
    return out


def month_cycle(period: str) -> dict[str, str]:
    """Month of year on the unit circle."""
    angle = f"2 * pi() * month({period}) / 12"
    return {"month_sin": f"sin({angle})", "month_cos": f"cos({angle})"}


def period_label(period: Column) -> Column:
    return F.date_format(period, "yyyy-MM-dd")
