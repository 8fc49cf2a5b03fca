import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAY, MONTH, Bounds
from panelcast.operators import recursion, ridge, selection
from panelcast.operators.ranking import latest_row
from panelcast.operators.splits import with_folds
from panelcast.operators.trees import candidates
from panelcast.plans import backtest, forecast, tuning
from panelcast.plans.feature_frame import FeatureConfig, create_features, supervised
from panelcast.plans.period_tables import daily_table, monthly_table
from panelcast.session import stage, staging_path
from panelcast.sources import storage
from panelcast.sources.star_schema import retail_facts

SF = "/root/testdata/sf0.001"
CFG = FeatureConfig.default(MONTH)
PICK = [
    "monthly_revenue_lag_1", "monthly_revenue_lag_6", "monthly_revenue_roll_mean_3", "monthly_revenue_roll_std_6",
    "monthly_revenue_ema_6", "total_orders_lag_1", "monthly_revenue_pct_change", "month_num", "month_sin", "quarter",
]


def closed_form(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return np.concatenate([[y.mean() - beta @ mean], beta])


@pytest.fixture(scope="module")
def table(spark):
    return stage(monthly_table(retail_facts(spark, SF), Bounds(before=dt.date(2001, 8, 1)), ["nation"]), "t")


@pytest.fixture(scope="module")
def rows(spark, table):
    return stage(supervised(table, CFG, MONTH, ["nation"], PICK)[0], "r")


def test_ridge_against_closed_form(rows):
    pdf = rows.toPandas().sort_values(["nation", "month"])
    models = ridge.fit(rows, PICK, "label", ["nation"], [0.01, 10.0, 500.0]).collect()
    for m in models:
        g = pdf[pdf["nation"] == m.nation]
        want = closed_form(g[PICK].to_numpy(float), g["label"].to_numpy(), m.alpha)
        np.testing.assert_allclose(m.coefficients, want, rtol=1e-7, atol=1e-6)


def test_constant_feature_gets_no_weight(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=40), "c": 0.1, "label": rng.normal(size=40)})
    m = ridge.fit(spark.createDataFrame(pdf), ["a", "c"], "label", [], [1.0]).first()
    assert m.coefficients[2] == 0.0
    want = closed_form(pdf[["a"]].to_numpy(), pdf["label"].to_numpy(), 1.0)
    np.testing.assert_allclose(m.coefficients[:2], want, rtol=1e-9)


def test_backtest_equals_refits(rows):
    bt = backtest.ridge_backtest(rows, PICK, "label", "month", ["nation"], 10.0, 3, 6).toPandas()
    pdf = rows.toPandas().sort_values(["nation", "month"])
    assert len(bt) == 3 * pdf["nation"].nunique()
    for nation in sorted(pdf["nation"].unique())[:4]:
        g = pdf[pdf["nation"] == nation].reset_index(drop=True)
        for r in bt[bt["nation"] == nation].itertuples():
            beta = closed_form(g[PICK].to_numpy(float)[: r.t], g["label"].to_numpy()[: r.t], 10.0)
            want = beta[0] + beta[1:] @ g[PICK].to_numpy(float)[r.t]
            assert r.y_pred == pytest.approx(want, rel=1e-7) and r.y_true == g["label"][r.t]


def test_pooled_ridge_is_the_same_ridge(rows):
    whole = ridge.fit(rows, PICK, "label", [], [10.0]).first().coefficients
    model = tuning.pooled_ridge(rows, PICK, "label", 10.0).stages[-1]
    np.testing.assert_allclose([model.intercept, *model.coefficients.toArray()], whole, rtol=1e-6)


def test_chosen_penalty_is_the_best_on_folds(rows):
    cv = tuning.ridge_cv(rows, PICK, "label", "month", ["nation"], n_splits=3)
    best = tuning.best_alpha(cv, ["nation"])
    assert cv.count() == 12 * best.count()
    joined = cv.join(best.withColumnRenamed("cv_mape", "b").drop("alpha"), "nation")
    assert joined.where("cv_mape < b").isEmpty()


@pytest.mark.parametrize("grain", [MONTH, DAY])
def test_recursion_reads_the_same_features(spark, table, grain):
    """The newest row's features in the recursion are those of the feature frame."""
    keys = ["nation"]
    cfg = FeatureConfig.default(grain)
    if grain is DAY:
        source = daily_table(retail_facts(spark, SF), Bounds(before=dt.date(2001, 8, 1)), keys)
        pick = ["daily_revenue_ema_28", "revenue_per_order_lag_7", "freight_ratio_roll_std_7", "items_per_order_ema_7",
                "daily_revenue_pct_change", "is_month_end", "day_of_week", "month_cos"]
    else:
        source, pick = table, PICK
    source = stage(source, "s")
    frame, _ = create_features(source, cfg, grain, keys, pick)
    newest = latest_row(frame.select(*keys, grain.period, *pick), grain.period, keys).toPandas().set_index("nation")
    # One model per feature: the forecast of the first step is the feature itself.
    for i, name in enumerate(pick):
        beta = [0.0] * (len(pick) + 1)
        beta[i + 1] = 1.0
        models = source.select("nation").distinct().withColumn("coefficients", F.array(*[F.lit(b) for b in beta]))
        one = recursion.recursive_ridge(source, models, pick, grain, keys, 1).toPandas().set_index("nation")
        want = newest[name].astype(float).clip(lower=0).fillna(0)
        np.testing.assert_allclose(one["y_pred"].loc[want.index].fillna(0), want, rtol=1e-9, atol=1e-9, err_msg=name)
        if grain is DAY and i == 3:
            break


def test_recursion_keeps_moving(spark, table):
    models = ridge.fit(supervised(table, CFG, MONTH, ["nation"], PICK)[0], PICK, "label", ["nation"], [10.0])
    out = recursion.recursive_ridge(table, models, PICK, MONTH, ["nation"], 6).toPandas()
    assert (out["y_pred"] >= 0).all() and out.groupby("nation").size().eq(6).all()
    first = out[out["step"] == 1].set_index("nation")["y_pred"]
    one_step = forecast.next_period_ridge(table, models, CFG, MONTH, ["nation"], PICK).toPandas().set_index("nation")
    np.testing.assert_allclose(first.loc[one_step.index], one_step["y_pred"].clip(lower=0), rtol=1e-9)


def test_pooled_recursion_matches_ridge_recursion(spark, table, rows):
    pick = PICK[:3]
    model = tuning.pooled_ridge(rows, pick, "label", 10.0)
    line = model.stages[-1]
    beta = [line.intercept, *line.coefficients.toArray()]
    models = table.select("nation").distinct().withColumn("coefficients", F.array(*[F.lit(float(b)) for b in beta]))
    a = recursion.recursive_ridge(table, models, pick, MONTH, ["nation"], 2).toPandas()
    b = forecast.recursive_pooled(table, model, CFG, MONTH, ["nation"], pick, 2).toPandas()
    both = a.merge(b, on=["nation", "period"])
    assert len(both) == len(a)
    np.testing.assert_allclose(both["y_pred_x"], both["y_pred_y"], rtol=1e-8)


FEW = {"random_forest": ({"maxDepth": 3}, {"maxDepth": 4}), "ridge": ({"alpha": 1.0}, {"alpha": 500.0})}


def test_search_is_repeatable_and_refuses_unknown_names(rows):
    known = candidates(forest_trees=5, grids=FEW)
    found = [tuning.search(rows, PICK[:4], "label", "month", ["ridge", "random_forest"], known, 2) for _ in range(2)]
    assert [t.name for t in found[0]] == ["ridge", "random_forest"]
    assert [t.cv_mape for t in found[0]] == pytest.approx([t.cv_mape for t in found[1]])
    with pytest.raises(ValueError, match="nothing"):
        tuning.search(rows, PICK[:4], "label", "month", ["nothing"], known, 2)


def test_grids_hold_every_point():
    sizes = {n: len(c.grid) for n, c in candidates().items()}
    assert sizes == {
        "ridge": 12, "random_forest": 120, "extra_trees": 4, "gradient_boosting": 30720, "hist_gradient_boosting": 100, "linear": 1,
    }


def test_log_target_comes_back(spark):
    rows = spark.createDataFrame([(float(i), float(np.expm1(0.1 * i + 2))) for i in range(40)], "x double, label double")
    model = tuning.fit_pipeline(rows, candidates()["linear"], ["x"], "label", log_target=True)
    path = staging_path(spark, "log-model")
    storage.save_model(model, path)
    out = storage.load_model(path).transform(rows).toPandas()
    np.testing.assert_allclose(out["prediction"], out["label"], rtol=1e-6)


def test_selection_chain(spark, rows):
    settings = selection.SelectionSettings(trees=5, depth=4, at_least=3, at_most=4, step=3)
    train = rows.withColumn("constant", F.lit(1.0))
    names = [*PICK, "constant"]
    picked = [
        selection.select_features(train, names, "label", lambda d, k: with_folds(d, "month", k), settings)
        for _ in range(2)
    ]
    assert picked[0].features == picked[1].features and 3 <= len(picked[0].features) <= 4
    assert "constant" not in picked[0].stages[1][1]
    dropped = {(r.dropped_by, r.feature) for r in picked[0].dropped(spark).collect()}
    assert ("variance", "constant") in dropped and len(dropped) == len(names) - len(picked[0].features)


def test_uncorrelated_looks_at_dropped_features_too():
    m = np.array([[1, 0.9, 0.1], [0.9, 1, 0.8], [0.1, 0.8, 1]])
    assert selection.uncorrelated(["a", "b", "c"], m, 0.7) == ["a"]


def test_saved_model_scores_the_same(spark, rows):
    model = tuning.pooled_ridge(rows, PICK, "label", 1.0)
    path = staging_path(spark, "m")
    storage.save_model(model, path)
    a = model.transform(rows).agg(F.sum("prediction")).first()[0]
    b = storage.load_model(path).transform(rows).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b)
    assert {n for n, _ in selection.linear_importances(model.stages[-1], PICK)} == set(PICK)


def test_no_cross_join_without_series(spark, rows):
    one = stage(rows.where("nation = 'NATION_1'").drop("nation"), "g")
    best = tuning.best_alpha(tuning.ridge_cv(one, PICK, "label", "month", [], n_splits=2), [])
    fitted = tuning.ridge_fit(one, PICK, "label", [], best)
    out = tuning.ridge_predict(one, fitted, PICK, [])
    assert out.where("y_pred is null").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tune_reports_the_backtest_and_refits(spark, rows):
    known = candidates(forest_trees=5, grids=FEW)
    settings = selection.SelectionSettings(trees=5, depth=3, at_least=3, at_most=5, step=4)
    result = tuning.tune(
        rows, PICK, "label", "month", ["nation"], dt.date(2001, 3, 1), dt.date(2001, 6, 1),
        ["linear", "random_forest", "ridge", "seasonal_naive_12"], known, settings, n_splits=2,
    )
    board = result.leaderboard.collect()
    models = {"linear", "random_forest", "ridge"}
    assert {r.model for r in board} == models | {"naive_last", "seasonal_naive_12"} and result.winner.name in models
    meta = result.metadata(spark).first()
    assert meta.best_model == result.winner.name and meta.feature_names == result.features
    assert result.model.transform(rows).where("prediction is null").isEmpty()
    with pytest.raises(ValueError):
        tuning.tune(
            rows, PICK, "label", "month", ["nation"], dt.date(2001, 3, 1), dt.date(2001, 6, 1),
            ["unknown"], known, settings, n_splits=2,
        )


def test_halving_finds_what_an_exhaustive_search_finds(rows):
    grid = tuple({"maxDepth": d, "featureSubsetStrategy": f} for d in (1, 3, 5) for f in ("all", "sqrt"))
    known = candidates(forest_trees=9, grids={"random_forest": grid, "gradient_boosting": ({"maxIter": 4, "maxDepth": 2}, {"maxIter": 400, "maxDepth": 1})})
    budget = tuning.Budget(points=6, trees=9, rounds=6)
    found = {t.name: t for t in tuning.halving_search(rows, PICK[:4], "label", "month", ["ridge", "random_forest", "gradient_boosting"], known, 2, budget=budget)}
    whole = {t.name: t for t in tuning.search(rows, PICK[:4], "label", "month", ["ridge", "random_forest"], known, 2)}
    # nothing is saved on a ridge
    assert found["ridge"] == whole["ridge"]
    # the survivor is compared with all its trees, and a good point: no worse than the median of the whole search
    kept = found["random_forest"]
    assert kept.point["numTrees"] == 9 and {k: v for k, v in kept.point.items() if k != "numTrees"} in grid
    every = sorted(
        tuning.search(rows, PICK[:4], "label", "month", ["random_forest"], candidates(forest_trees=9, grids={"random_forest": (p,)}), 2)[0].cv_mape
        for p in grid
    )
    assert whole["random_forest"].cv_mape <= kept.cv_mape <= every[len(grid) // 2]
    assert found["gradient_boosting"].point["maxIter"] in (4, 6)  # no more rounds than the budget has
    with pytest.raises(ValueError):
        tuning.halving_search(rows, PICK[:4], "label", "month", ["nothing"], known, 2)


def test_what_a_budget_draws_and_spends():
    known = candidates()
    budget = tuning.Budget(points=5, eta=3, trees=100, rounds=30)
    drawn = budget.sampled(known["gradient_boosting"])
    assert len(drawn) == 5 and drawn == budget.sampled(known["gradient_boosting"]) and all(p in known["gradient_boosting"].grid for p in drawn)
    assert budget.sampled(known["extra_trees"]) == list(known["extra_trees"].grid)
    assert tuning.rungs_of(27, 3) == [27, 9, 3, 1] and tuning.rungs_of(5, 3) == [5, 2, 1] and tuning.rungs_of(1, 3) == [1]
    spent = [budget.spent(known["random_forest"], {"maxDepth": 5}, left)["numTrees"] for left in (2, 1, 0)]
    assert spent == [12, 34, 100]
    assert budget.spent(known["gradient_boosting"], {"maxIter": 1500}, 0)["maxIter"] == 30
    assert budget.spent(known["ridge"], {"alpha": 1.0}, 2) == {"alpha": 1.0}
