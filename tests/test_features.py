"""Window features against pandas, feature counts, and no look-ahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAY, MONTH
from panelcast.operators import windows as W
from panelcast.plans.feature_frame import SHARED_METRICS, FeatureConfig, create_features, supervised


def month_frame(spark, months=24):
    dates = pd.date_range("2017-01-01", periods=months, freq="MS")
    pdf = pd.DataFrame(
        {
            "month": dates.date,
            "monthly_revenue": np.arange(months, dtype=float),
            "total_orders": 10,
            "total_items": 20,
            "total_freight": 5.0,
            "unique_customers": 7,
            "avg_installments": 2.0,
            "avg_review_score": 4.0,
            "year": dates.year,
            "month_num": dates.month,
        }
    )
    return spark.createDataFrame(pdf)


def panel(spark, series=3, rows=60, seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for s in range(series):
        dates = pd.date_range("2020-01-01", periods=rows, freq="D")
        values = {c: rng.integers(0, 50, rows).astype(float) for c in SHARED_METRICS}
        revenue = rng.normal(1000, 300, rows).round(2)
        revenue[rng.integers(0, rows, 5)] = 0.0
        parts.append(pd.DataFrame({"key": f"s{s}", "date": dates.date, "daily_revenue": revenue, **values}))
    pdf = pd.concat(parts)
    return spark.createDataFrame(pdf), pdf


def test_reference_frame(spark):
    cfg = FeatureConfig(
        ("monthly_revenue", *SHARED_METRICS), (1, 2, 3, 6, 12), (3, 6, 12), target_col="monthly_revenue_next"
    )
    rows, names = supervised(month_frame(spark), cfg, MONTH, [])
    assert len(names) == len(set(names)) == 172
    out = rows.orderBy("month").toPandas()
    assert len(out) == 11
    assert list(out["monthly_revenue_next"]) == [float(v) for v in range(13, 24)]


@pytest.mark.parametrize("grain,count", [(MONTH, 124), (DAY, 279)])
def test_default_feature_counts(spark, grain, count):
    table = month_frame(spark) if grain is MONTH else panel(spark)[0].where("key = 's0'").drop("key")
    _, names = create_features(table, FeatureConfig.default(grain), grain, [])
    assert len(names) == count


def test_flags_are_honoured(spark):
    cfg = FeatureConfig.default(MONTH, add_seasonality=False, add_trend=True)
    frame, names = create_features(month_frame(spark), cfg, MONTH, [])
    assert "month_sin" not in names and "month_index" in names
    assert [r[0] for r in frame.orderBy("month").select("month_index").collect()] == list(range(24))


def test_windows_match_pandas(spark):
    df, pdf = panel(spark)
    cfg = FeatureConfig(("daily_revenue", "total_orders"), (1, 7), (3, 7), ratios=())
    frame, names = create_features(df, cfg, DAY, ["key"])
    ours = frame.toPandas().sort_values(["key", "date"]).reset_index(drop=True)
    want = []
    for _, g in pdf.sort_values(["key", "date"]).groupby("key"):
        cols = {}
        for c in cfg.base_cols:
            x, before = g[c], g[c].shift(1)
            for k in cfg.lags:
                cols[f"{c}_lag_{k}"] = x.shift(k)
            for n in cfg.rolling_windows:
                roll = before.rolling(n, min_periods=1)
                for kind in ("mean", "std", "min", "max"):
                    cols[f"{c}_roll_{kind}_{n}"] = getattr(roll, kind)()
                cols[f"{c}_ema_{n}"] = before.ewm(span=n, adjust=False).mean()
            change = x.pct_change().shift(1).replace([np.inf, -np.inf], 0).fillna(0)
            cols[f"{c}_pct_change"] = change
        want.append(pd.DataFrame(cols))
    want = pd.concat(want).reset_index(drop=True)
    for c in want:
        np.testing.assert_allclose(ours[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("spans", [[3], [7, 14, 28, 30], [1, 2, 200], [3, 400]])
def test_ema_over_many_blocks(spark, spans):
    rows = 2600
    rng = np.random.default_rng(7)
    x = np.abs(rng.normal(1e6, 4e5, rows))
    dates = pd.date_range("2010-01-01", periods=rows, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"date": dates.date, "x": x}))
    blocks, _ = W.add_ema_blocks(df, ["x"], spans, "date", [])
    w = W.block_window([], "date")
    ours = blocks.selectExpr("date", *[f"{W.ema('x', s, spans, w)} AS e{s}" for s in spans]).toPandas()
    ours = ours.sort_values("date")
    for s in spans:
        want = pd.Series(x).shift(1).ewm(span=s, adjust=False).mean()
        np.testing.assert_allclose(ours[f"e{s}"].astype(float), want, rtol=1e-10, err_msg=str(s))


def test_blocks_stay_finite():
    for spans in ([3], [2, 5000], [3, 30, 365]):
        for span, length in W.ema_blocks(spans).items():
            rate = 1 - 2 / (span + 1)
            assert rate**length < 1e-17
            assert np.isfinite(rate ** -float(length) * 1e15)


def test_no_look_ahead(spark):
    df, _ = panel(spark, series=2)
    cfg = FeatureConfig.default(DAY)
    cut = "date'2020-02-10'"
    changed = df.withColumn("daily_revenue", F.when(F.expr(f"date >= {cut}"), F.lit(9e9)).otherwise(F.col("daily_revenue")))
    out = []
    for d in (df, changed):
        frame, names = create_features(d, cfg, DAY, ["key"])
        out.append(frame.where(f"date <= {cut}").select("key", "date", *names).toPandas().sort_values(["key", "date"]))
    pd.testing.assert_frame_equal(out[0].reset_index(drop=True), out[1].reset_index(drop=True))


def test_only_keeps_values(spark):
    df, _ = panel(spark)
    cfg = FeatureConfig.default(DAY)
    pick = ["daily_revenue_ema_7", "freight_ratio_lag_7", "is_weekend", "total_orders_pct_change"]
    some, _ = create_features(df, cfg, DAY, ["key"], pick)
    every, _ = create_features(df, cfg, DAY, ["key"])
    a, b = (d.select("key", "date", *pick).toPandas().sort_values(["key", "date"]).reset_index(drop=True) for d in (some, every))
    pd.testing.assert_frame_equal(a, b)


def test_one_exchange_for_a_wide_frame(spark):
    df, _ = panel(spark)
    frame, _ = create_features(df, FeatureConfig.default(DAY), DAY, ["key"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort ") == 2
