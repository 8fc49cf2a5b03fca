import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAY, MONTH
from panelcast.operators import baselines, calendar_fill, cleaning, monitoring, ranking, scoring, splits


def monthly(spark, lengths):
    rows = []
    for key, n in lengths.items():
        for i, d in enumerate(pd.date_range("2020-01-01", periods=n, freq="MS")):
            rows.append((key, d.date(), float(i + 1)))
    return spark.createDataFrame(rows, "key string, month date, monthly_revenue double")


def test_holdout(spark):
    df = monthly(spark, {"a": 10, "b": 4})
    out = splits.tail_holdout(df, "month", ["key"], 3).groupBy("key", "split").count().collect()
    assert {(r.key, r.split): r["count"] for r in out} == {
        ("a", "train"): 7, ("a", "test"): 3, ("b", "train"): 1, ("b", "test"): 3,
    }
    with pytest.raises(ValueError):
        splits.tail_holdout(df, "month", ["key"], 0)
    with pytest.raises(PySparkException):
        splits.tail_holdout(df, "month", ["key"], 4).collect()
    assert splits.tail_holdout(df, "month", ["key"], 4, strict=False).where("key = 'b' and split = 'train'").isEmpty()


@pytest.mark.parametrize("n,k", [(24, 4), (10, 3), (7, 2)])
def test_folds(spark, n, k):
    df = monthly(spark, {"a": n, "b": n - 2})
    out = splits.fold_axis(df, "month", k).toPandas()
    size = n // (k + 1)
    for f in range(k):
        got = out[out["fold"] == f]
        start = n - (k - f) * size
        assert list(sorted(got[got["role"] == "train"]["position"])) == list(range(start))
        assert list(sorted(got[got["role"] == "test"]["position"])) == list(range(start, start + size))
    with pytest.raises(ValueError):
        splits.fold_axis(df, "month", 1)


def test_origins_from_needs_data(spark):
    df = monthly(spark, {"a": 5})
    with pytest.raises(PySparkException):
        splits.with_origins_from(df, "month", ["key"], dt.date(2021, 1, 1), dt.date(2022, 1, 1)).collect()


def test_segments_share_points(spark):
    df = monthly(spark, {"a": 6})
    bounds = [("x", None, dt.date(2020, 3, 1)), ("y", dt.date(2020, 3, 1), dt.date(2020, 5, 1))]
    out = splits.segments(df, "month", bounds).groupBy("segment").count().collect()
    assert {r.segment: r["count"] for r in out} == {"x": 3, "y": 3}


def test_seasonal_ahead_is_cyclic_and_falls_back(spark):
    df = monthly(spark, {"long": 15, "short": 5})
    out = baselines.seasonal_ahead(df, MONTH, ["key"], 26, 12).orderBy("key", "step").toPandas()
    long = out[out["key"] == "long"]["y_pred"].tolist()
    season = [float(v) for v in range(4, 16)]
    assert long == (season * 3)[:26]
    short = out[out["key"] == "short"]["y_pred"].tolist()
    assert short[:7] == [5.0] * 7 and short[7:12] == [1.0, 2.0, 3.0, 4.0, 5.0] and short[12] == 5.0
    assert str(out[out["key"] == "long"]["period"].iloc[0]) == "2021-04-01"
    with pytest.raises(ValueError):
        baselines.naive_ahead(df, MONTH, ["key"], 0)


def test_scores(spark):
    rows = [("m", 10.0, 12.0), ("m", 20.0, 15.0), ("m", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, y_true double, y_pred double")
    r = scoring.score(df, ["model"]).first()
    assert r.mae == pytest.approx(7 / 3) and r.bias == pytest.approx(-1.0)
    assert r.rmse == pytest.approx(np.sqrt((4 + 25) / 3)) and r.wape == pytest.approx(7 / 30 * 100)
    assert r.mape == pytest.approx((0.2 + 0.25) / 3 * 100) and r.accuracy == pytest.approx(100 - 7 / 30 * 100)
    zero = spark.createDataFrame([("m", 0.0, 1.0)], df.schema)
    assert scoring.score(zero, ["model"]).first().wape is None


def test_winner_ignores_baselines(spark):
    rows = [("naive_last", 1.0), ("ridge", 5.0), ("forest", 5.0)]
    df = spark.createDataFrame(rows, "model string, mape double")
    assert ranking.winner(df, []).first().model == "forest"
    assert {r.model: r.beats_baseline for r in ranking.skill(df, []).collect()} == {"ridge": False, "forest": False}


def test_densify_and_missing_days(spark):
    days = ["2020-01-30", "2020-02-02", "2020-02-03", "2020-02-10"]
    rows = [("a", dt.date.fromisoformat(d), 1.0) for d in days] + [("b", dt.date(2020, 1, 15), 2.0)]
    df = spark.createDataFrame(rows, "key string, date date, daily_revenue double")
    dense = calendar_fill.densify(df, DAY, ["key"])
    assert dense.count() == 12 + 1 and dense.where("daily_revenue is not null").count() == 5
    gaps = calendar_fill.missing_days(df, "date", ["key"], (dt.date(2020, 2, 1), dt.date(2020, 3, 1)))
    got = {(r.key, str(r.date)) for r in gaps.collect()}
    every = {str(d.date()) for d in pd.date_range("2020-02-01", "2020-02-29")}
    want = {("a", d) for d in every - set(days)} | {("b", d) for d in every}
    assert got == want and gaps.count() == len(want)


def test_missing_days_before_the_first_row(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 27),)], "date date")
    gaps = calendar_fill.missing_days(df, "date", [], (dt.date(2020, 2, 1), dt.date(2020, 3, 1)))
    assert gaps.count() == 28


def test_dense_months(spark):
    rows = [(dt.date(2020, 1, 1), 1.0), (dt.date(2020, 4, 1), 2.0)]
    df = spark.createDataFrame(rows, "month date, monthly_revenue double")
    assert [str(r[0]) for r in calendar_fill.densify(df, MONTH, []).orderBy("month").select("month").collect()] == [
        "2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01",
    ]


def test_clean_trailing_looks_back_only(spark):
    df = monthly(spark, {"a": 20}).withColumn(
        "monthly_revenue", F.when(F.col("month") == "2020-10-01", 1e6).otherwise(F.col("monthly_revenue"))
    )
    out = cleaning.clean_trailing(df, ["monthly_revenue"], "month", ["key"]).orderBy("month").toPandas()
    assert out["monthly_revenue"].max() < 1e6 and out["monthly_revenue"].iloc[0] == 1.0


def test_bias_runs(spark):
    signs = [1, 1, 1, -1, 1, -1, -1, -1, -1, 0]
    rows = [("a", dt.date(2020, i + 1, 1), float(s)) for i, s in enumerate(signs)]
    df = spark.createDataFrame(rows, "key string, period date, bias double")
    got = {(r.bias_sign, r.months, str(r.first_period)) for r in monitoring.bias_runs(df, ["key"]).collect()}
    assert got == {(1, 3, "2020-01-01"), (-1, 4, "2020-06-01")}


def test_population_stability(spark):
    days = pd.date_range("2020-01-01", periods=200, freq="D")
    pdf = pd.DataFrame({"key": "a", "date": days.date, "same": np.tile(np.arange(10.0), 20), "moved": np.arange(200.0)})
    df = spark.createDataFrame(pdf)
    cut = dt.date(2020, 4, 10)
    same = monitoring.population_stability(df, "same", "date", ["key"], cut).first().psi
    moved = monitoring.population_stability(df, "moved", "date", ["key"], cut).first().psi
    assert abs(same) < 1e-9 and moved > 1.0


def test_runs_and_rolling_errors_stop_at_a_missing_month(spark):
    months = ["2020-01-01", "2020-02-01", "2020-03-01", "2020-05-01", "2020-06-01"]
    df = spark.createDataFrame([("a", m, 1.0, 10.0 * i) for i, m in enumerate(months)], "key string, period string, bias double, mape double")
    df = df.withColumn("period", F.to_date("period"))
    runs = monitoring.bias_runs(df, ["key"]).collect()
    assert [(r.months, str(r.first_period), str(r.last_period)) for r in runs] == [(3, "2020-01-01", "2020-03-01")]
    rolled = monitoring.mape_drift(df, ["key"], 5.0).collect()
    assert [(str(r.period), r.rolling_mape, r.drifted) for r in rolled] == [("2020-03-01", 10.0, True)]
