"""The registered queries and the SQL they are checked against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.present import present
from panelcast.functions.calendar import Bounds

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Parameters of the checks: the phases of the backtest.
TRAIN_END = dt.date(2001, 3, 1)
BACKTEST_START = dt.date(2001, 4, 1)
BACKTEST_END = dt.date(2001, 6, 1)
FINAL = dt.date(2001, 7, 1)
DAY_TRAIN_END = dt.date(2001, 3, 31)
DAY_BACKTEST_START = dt.date(2001, 4, 1)
DAY_BACKTEST_END = dt.date(2001, 6, 30)

SERIES = {"": [], "_by_nation": ["nation"], "_by_brand": ["brand"]}


_complete: dict[str, Bounds] = {}


def complete(spark: SparkSession, folder: str) -> Bounds:
    """Complete months only: those before the month of the newest order, looked up once per folder."""
    if folder not in _complete:
        newest = spark.read.parquet(f"{folder}/orders.parquet").agg(F.max("o_orderdate")).first()[0]
        _complete[folder] = Bounds(before=newest.date().replace(day=1))
    return _complete[folder]


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"registered twice: {name}")
    QUERIES[name] = lambda spark, folder: present(query(spark, folder))
    if sql is not None:
        SQL[name] = sql
