"""Range tables, cutoffs as a key, mergeable sketches, categories found in the data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelcast.functions.calendar import MONTH
from panelcast.operators import ranges, rollup
from panelcast.plans import forecast

DAY0 = dt.date(2020, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def dated(spark):
    rng = random.Random(1)
    rows = [(i, DAY0 + dt.timedelta(days=rng.randint(0, 900))) for i in range(600)] + [(-1, None)]
    bounds = []
    for i in range(3000):
        low = DAY0 + dt.timedelta(days=3 * rng.randint(0, 300))
        bounds.append((f"r{i}", low, low + dt.timedelta(days=rng.choice([-2, 0, 1, 70]) if i % 40 == 0 else rng.choice([-1, 0]))))
    bounds += [("open", None, DAY0), ("open", DAY0, None), bounds[0]]
    return (
        rows, bounds, spark.createDataFrame(rows, "id long, day date"), spark.createDataFrame(bounds, "name string, lo date, hi date"),
    )


def test_outside_thousands_of_ranges(dated):
    rows, bounds, df, table = dated
    got = ranges.outside_ranges(df, "day", table, "lo", "hi")
    inside = lambda d: any(lo and hi and lo <= d <= hi for _, lo, hi in bounds)
    want = {i for i, d in rows if d is None or not inside(d)}
    assert {r.id for r in got.collect()} == want and 0 < len(want) < len(rows)
    assert "NestedLoop" not in plan_of(got)[1] and "Cartesian" not in plan_of(got)[1]


def test_segments_that_overlap(dated):
    rows, bounds, df, table = dated
    got = ranges.in_segments(df, "day", table)
    want = sorted((i, n) for i, d in rows for n, lo, hi in bounds if d and lo and hi and lo <= d <= hi)
    assert sorted((r.id, r.segment) for r in got.collect()) == want
    assert got.columns == ["id", "day", "segment"]
    assert "NestedLoop" not in plan_of(got)[1] and "Cartesian" not in plan_of(got)[1]


def test_the_plan_does_not_grow_with_the_cutoffs(spark):
    table = spark.createDataFrame(
        [(n, dt.date(2018 + m // 12, m % 12 + 1, 1), float(m)) for n in "ab" for m in range(30)], "nation string, month date, monthly_revenue double"
    )
    few = [dt.date(2019, 12, 1), dt.date(2020, 1, 31), dt.date(2020, 2, 1)]
    many = [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(60)]
    sizes = [len(plan_of(forecast.as_of_each(table, cuts, MONTH.period))[0].splitlines()) for cuts in (few, many)]
    assert sizes[0] == sizes[1]
    got = forecast.as_of_each(table, few, MONTH.period).groupBy("nation", "cutoff").agg(F.max("month").alias("last"), F.count("*").alias("n"))
    want = sorted((n, c.replace(day=1), c.replace(day=1), 12 * (c.year - 2018) + c.month) for n in "ab" for c in few)
    assert sorted(map(tuple, got.collect())) == want


def test_sketches_merge_to_any_group(spark):
    rng = random.Random(2)
    rows = [(d, "xy"[u % 2], f"u{u}") for d in range(20) for u in {rng.randint(0, 5000) for _ in range(900)}] + [(3, "x", None), (99, "x", None)]
    df = spark.createDataFrame(rows, "day int, side string, user string")
    daily = rollup.distinct_sketches(df, ["day", "side"], "user")
    for groups in (["side"], []):
        got = rollup.sketched_counts(rollup.merged_sketches(daily, groups), "n").collect()
        for r in got:
            exact = len({u for _, s, u in rows if u and (not groups or s == r.side)})
            assert abs(r.n - exact) <= 3 * rollup.sketch_error() * exact
    assert daily.where("day = 99").isEmpty()


def test_categories_found_in_the_data_lose_nothing(spark):
    rows = [(m, c, n) for m in (1, 2) for c, n in [("a", 5), ("b", 3), ("c", 3), (None, 2), ("other", 7), ("d", 1)]] + [(3, "d", 4)]
    df = spark.createDataFrame(rows, "month int, category string, n long")
    wide = rollup.pivot_found(df, ["month"], "category", "n", 2)
    assert wide.columns == ["month", "a", "b", "other"]
    assert sorted(map(tuple, wide.collect())) == [(1, 5, 3, 13), (2, 5, 3, 13), (3, 0, 0, 4)]
    empty = rollup.pivot_found(df.where("false"), ["month"], "category", "n")
    assert empty.columns == ["month", "other"] and empty.isEmpty()
