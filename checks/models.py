"""Models, forecasts, scores, figures, monitoring, streaming (sections K to O, and what needs them)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import BACKTEST_END, BACKTEST_START, FINAL, SERIES, SQL, TRAIN_END, add, complete
from checks.series import days, months, trained, training_rows, two_baselines, two_sql
from checks.tables import MEASURES_SQL, measures
from panelcast.functions.calendar import DAY, MONTH
from panelcast.functions.numeric import steady_round
from panelcast.operators import baselines, kpis, monitoring, ranking, recursion, ridge, scoring, selection
from panelcast.operators.order_level import ORDER_TS, order_rows
from panelcast.operators.rollup import roll_up
from panelcast.operators.calendar_fill import missing_days
from panelcast.operators.splits import with_folds
from panelcast.operators.trees import candidates
from panelcast.plans import backtest, forecast, tuning
from panelcast.plans.feature_frame import FeatureConfig, supervised
from panelcast.session import stage, staging_path
from panelcast.sources import storage
from panelcast.sources.facts import read_tables
from panelcast.sources.star_schema import retail_facts
from panelcast.streaming import incremental
from panelcast.streaming.raw_facts import LINES, MonthlyFollower, tagged
from panelcast.streaming.sums import DailySums

TWO = list(SERIES.items())[:2]
CFG = FeatureConfig.default(MONTH)

# --- K01, K02: baselines -----------------------------------------------------------------------

for suffix, keys in TWO:
    for daily, season in ((False, 12), (True, 7)):
        grain = DAY if daily else MONTH
        table = (days if daily else months)
        cte = (S.days if daily else S.months)(keys)
        name, p, y = ("days", "date", "daily_revenue") if daily else ("months", "month", "monthly_revenue")
        over = f"OVER {S.order_window(keys, p)}"
        tail = f"{'daily' if daily else 'monthly'}{suffix}"
        out = f"{S.lead_list(keys, 'model', f'{p} AS period')}, {S.r(y, 'y_true')}, {S.r('p', 'y_pred')}"
        add(
            f"k01_naive_{tail}",
            lambda s, d, keys=keys, grain=grain, table=table: baselines.naive_last(table(s, d, keys), grain, keys),
            f"""WITH {cte} SELECT {out} FROM (SELECT *, 'naive_last' AS model, lag({y}) {over} AS p FROM {name})
                WHERE p IS NOT NULL""",
        )
        add(
            f"k02_seasonal_{tail}",
            lambda s, d, keys=keys, grain=grain, table=table, season=season: baselines.seasonal_naive(
                table(s, d, keys), grain, keys, season
            ),
            f"""WITH {cte} SELECT {out} FROM (SELECT *, 'seasonal_naive_{season}' AS model,
                coalesce(lag({y}, {season}) {over}, lag({y}) {over}) AS p FROM {name}) WHERE p IS NOT NULL""",
        )
    add(
        f"k01_naive_ahead{suffix}",
        lambda s, d, keys=keys: baselines.naive_ahead(months(s, d, keys), MONTH, keys, 6),
        f"""WITH {S.months(keys)}, l AS (SELECT * FROM months QUALIFY row_number() OVER ({S.part(keys)} ORDER BY month DESC) = 1),
            e AS (SELECT *, unnest(range(1, 7)) AS step FROM l)
            SELECT {S.lead_list(keys, 'step')}, CAST(month + to_months(CAST(step AS INTEGER)) AS DATE) AS period,
            {S.r('monthly_revenue', 'y_pred')} FROM e""",
    )
    same = " AND ".join([*[f"e.{k} = h.{k}" for k in keys], "h.back = 7 - ((step - 1) % 7)"])
    add(
        f"k02_seasonal_ahead{suffix}",
        lambda s, d, keys=keys: baselines.seasonal_ahead(days(s, d, keys), DAY, keys, 31, 7),
        f"""WITH {S.days(keys).replace('days AS (', 'days AS MATERIALIZED (')}, h AS MATERIALIZED (SELECT *, row_number() OVER ({S.part(keys)} ORDER BY date DESC) AS back FROM days),
            e AS (SELECT *, unnest(range(1, 32)) AS step FROM h WHERE back = 1)
            SELECT {S.lead_list([f'e.{k}' for k in keys], 'step')}, e.date + CAST(step AS INTEGER) AS period,
            {S.r('coalesce(h.daily_revenue, e.daily_revenue)', 'y_pred')} FROM e LEFT JOIN h ON {same}""",
    )

# --- K03, K08 to K13: ridge on two features, which SQL can solve --------------------------------

PAIR = ["monthly_revenue_lag_1", "monthly_revenue_roll_mean_3"]
X1, X2 = PAIR


def pair_rows(s, d, keys):
    return supervised(months(s, d, keys), CFG, MONTH, keys, PAIR)[0]


def moments_sql(over="", pair=PAIR):
    x1, x2 = pair
    return f"""count(*) {over} AS n, avg({x1}) {over} AS m1, avg({x2}) {over} AS m2, avg(label) {over} AS my,
      stddev_pop({x1}) {over} AS s1, stddev_pop({x2}) {over} AS s2, covar_pop({x1}, {x2}) {over} AS c12,
      covar_pop({x1}, label) {over} AS c1, covar_pop({x2}, label) {over} AS c2"""


def slopes_sql(alpha):
    """Slopes of the standardised two-feature ridge by Cramer's rule."""
    a12, d = "(n * c12 / (s1 * s2))", f"(n + {alpha})"
    b1, b2 = "(n * c1 / s1)", "(n * c2 / s2)"
    det = f"({d} * {d} - {a12} * {a12})"
    return (
        f"({b1} * {d} - {a12} * {b2}) / {det} / s1 AS g1, ({b2} * {d} - {a12} * {b1}) / {det} / s2 AS g2"
    )


PREDICT = f"my + g1 * ({X1} - m1) + g2 * ({X2} - m2)"


def pair_sql(keys):
    return f"{S.months(keys)}, {S.supervised(keys, False, PAIR)}"


def expanding_sql(keys, alpha):
    over = f"OVER ({S.part(keys)} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{pair_sql(keys)},
    mo AS (SELECT *, row_number() OVER {S.order_window(keys, 'month')} - 1 AS t,
             count(*) OVER ({S.part(keys)}) AS total, {moments_sql(over)} FROM sup),
    bt AS (SELECT *, label AS y, {PREDICT} AS p FROM (SELECT *, {slopes_sql(alpha)} FROM mo))"""


def ridge_bt(s, d, keys, alpha=10.0, test=24):
    return backtest.ridge_backtest(pair_rows(s, d, keys), PAIR, "label", "month", keys, alpha, test, 6)


for suffix, keys in TWO:
    add(
        f"k03_ridge_backtest{suffix}",
        lambda s, d, keys=keys: ridge_bt(s, d, keys),
        f"""WITH {expanding_sql(keys, 10.0)} SELECT {S.lead_list(keys, "'ridge' AS model", 't')},
            target_period AS period, {S.r('y', 'y_true')}, {S.r('p', 'y_pred')} FROM bt
            WHERE t >= greatest(6, total - 24)""",
    )
    group = f"GROUP BY {', '.join(keys)}" if keys else ""

    def k03_fit(s, d, keys=keys):
        models = ridge.fit(pair_rows(s, d, keys), PAIR, "label", keys, [1.0, 100.0])
        return models.select(
            *keys, "alpha", *[F.col("coefficients")[i].alias(n) for i, n in enumerate(["b0", "b1", "b2"])]
        )

    add(
        f"k03_ridge_coefficients{suffix}",
        k03_fit,
        f"""WITH {pair_sql(keys)}, mo AS (SELECT {S.lead_list(keys, '')} {moments_sql()} FROM sup {group}),
            g AS (SELECT *, {slopes_sql('alpha')} FROM (SELECT *, unnest([1.0, 100.0]) AS alpha FROM mo))
            SELECT {S.lead_list(keys, '')} {S.r('alpha', 'alpha')}, {S.r('my - g1 * m1 - g2 * m2', 'b0')},
            {S.r('g1', 'b1')}, {S.r('g2', 'b2')} FROM g""",
    )
    add(
        f"k08_trend_line{suffix}",
        lambda s, d, keys=keys: baselines.trend_line(months(s, d, keys), MONTH, keys),
        f"""WITH {S.months(keys)}, x AS (SELECT *, row_number() OVER {S.order_window(keys, 'month')} - 1 AS i FROM months)
            SELECT {S.lead_list(keys, '')} {S.r('regr_slope(monthly_revenue, i)', 'slope')},
            {S.r('regr_intercept(monthly_revenue, i)', 'intercept')}, {S.r('regr_r2(monthly_revenue, i)', 'r2')}
            FROM x {group}""",
    )

ALPHAS = ", ".join(str(a) for a in ridge.ALPHAS)


def cv_sql(keys, k=4, panel=None):
    """CV score of every penalty: fold moments, slopes, test errors; ``panel`` for one model over its series."""
    by, fold_by = S.lead_list(keys, ""), S.lead_list(keys, "fold")
    return f"""{pair_sql(panel or keys)}, tr AS (SELECT * FROM sup WHERE target_period <= DATE '{TRAIN_END}'),
    axis AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS position, count(*) OVER () AS n
             FROM (SELECT DISTINCT month FROM tr)),
    folds AS (SELECT month, position, fold, n - ({k} - fold) * (n // {k + 1}) AS start, n // {k + 1} AS size
              FROM (SELECT *, unnest(range({k})) AS fold FROM axis)),
    fr AS (SELECT tr.*, fold, position < start AS is_train FROM tr JOIN folds USING (month)
           WHERE position < start + size),
    mo AS (SELECT {fold_by}, {moments_sql()} FROM fr WHERE is_train GROUP BY {fold_by}),
    g AS (SELECT *, {slopes_sql('alpha')} FROM (SELECT *, unnest([{ALPHAS}]) AS alpha FROM mo)),
    er AS (SELECT {fold_by}, alpha, 100 * avg(abs(label - ({PREDICT})) / greatest(abs(label), 1e-9)) AS mape
           FROM fr JOIN g USING ({fold_by}) WHERE NOT is_train GROUP BY {fold_by}, alpha),
    cv AS (SELECT {by} alpha, avg(mape) AS cv_mape FROM er GROUP BY {by} alpha),
    best AS (SELECT * FROM cv QUALIFY row_number() OVER ({S.part(keys)} ORDER BY cv_mape, alpha) = 1)"""


def pair_cv(s, d, keys):
    train = pair_rows(s, d, keys).where(F.col("target_period") <= F.lit(TRAIN_END))
    return tuning.ridge_cv(train, PAIR, "label", "month", keys)


def k11(s, d, keys):
    """Best penalty per series, refitted on training and backtest rows."""
    rows = stage(pair_rows(s, d, keys), "pair")
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    best = tuning.best_alpha(tuning.ridge_cv(train, PAIR, "label", "month", keys), keys)
    scope = rows.where(F.col("target_period") <= F.lit(BACKTEST_END))
    return tuning.ridge_fit(scope, PAIR, "label", keys, best)


for suffix, keys in TWO:
    by = S.lead_list(keys, "")
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    add(
        f"k09_ridge_search{suffix}",
        lambda s, d, keys=keys: pair_cv(s, d, keys),
        f"WITH {cv_sql(keys)} SELECT {by} {S.r('alpha', 'alpha')}, {S.r('cv_mape', 'cv_mape')} FROM cv",
    )
    add(
        f"k09_best_penalty{suffix}",
        lambda s, d, keys=keys: tuning.best_alpha(pair_cv(s, d, keys), keys),
        f"WITH {cv_sql(keys)} SELECT {by} {S.r('alpha', 'alpha')}, {S.r('cv_mape', 'cv_mape')} FROM best",
    )
    using = f"JOIN best USING ({', '.join(keys)})" if keys else "JOIN best ON true"
    add(
        f"k11_refit_winner{suffix}",
        lambda s, d, keys=keys: k11(s, d, keys).select(
            *keys, "alpha", *[F.col("coefficients")[i].alias(f"b{i}") for i in range(3)]
        ),
        f"""WITH {cv_sql(keys)}, m2 AS (SELECT {by} {moments_sql()} FROM sup
              WHERE target_period <= DATE '{BACKTEST_END}' {group}),
            g2_ AS (SELECT *, {slopes_sql('alpha')} FROM m2 {using})
            SELECT {by} {S.r('alpha', 'alpha')}, {S.r('my - g1 * m1 - g2 * m2', 'b0')}, {S.r('g1', 'b1')},
            {S.r('g2', 'b2')} FROM g2_""",
    )


def rivals(s, d, keys):
    """Scores of both baselines and two ridges over the same 24 periods."""
    rows = stage(pair_rows(s, d, keys), "pair")
    parts = [
        backtest.ridge_backtest(rows, PAIR, "label", "month", keys, a, 24, 6)
        .withColumn("model", F.lit(f"ridge_{int(a)}"))
        .drop("t")
        for a in (1.0, 200.0)
    ]
    first = dt.date(1999, 8, 1)
    base = two_baselines(s, d, keys).where(F.col("period") >= F.lit(first))
    every = base.unionByName(parts[0]).unionByName(parts[1]).where(F.col("period") >= F.lit(first))
    return scoring.score(every, [*keys, "model"])


def rivals_sql(keys):
    by = S.lead_list(keys, "model")
    def one(a):
        return f"""SELECT {S.lead_list(keys, f"'ridge_{int(a)}' AS model")}, label AS y, {PREDICT} AS p
          FROM (SELECT *, {slopes_sql(a)} FROM mo) WHERE t >= greatest(6, total - 24)
          AND target_period >= DATE '1999-08-01'"""
    over = f"OVER ({S.part(keys)} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{two_sql(keys)}, {S.supervised(keys, False, PAIR)},
    mo AS (SELECT *, row_number() OVER {S.order_window(keys, 'month')} - 1 AS t,
             count(*) OVER ({S.part(keys)}) AS total, {moments_sql(over)} FROM sup),
    every_ AS (SELECT {by}, y, p FROM fc WHERE month >= DATE '1999-08-01' UNION ALL {one(1.0)} UNION ALL {one(200.0)}),
    sc AS (SELECT {by}, {measures()}, 100 * avg(abs(y - p) / greatest(abs(y), 1e-9)) AS raw FROM every_ GROUP BY {by})"""


for suffix, keys in TWO:
    by = S.lead_list(keys, "model")
    add(
        f"k10_choose_model{suffix}",
        lambda s, d, keys=keys: ranking.winner(rivals(s, d, keys), keys),
        f"""WITH {rivals_sql(keys)} SELECT * EXCLUDE (raw) FROM sc WHERE model LIKE 'ridge%'
            QUALIFY row_number() OVER ({S.part(keys)} ORDER BY raw, model) = 1""",
    )
    add(
        f"k12_skill{suffix}",
        lambda s, d, keys=keys: ranking.skill(rivals(s, d, keys), keys).select(
            *keys, "model", "mape", "baseline_mape", "skill", "beats_baseline"
        ),
        f"""WITH {rivals_sql(keys)}, b AS (SELECT *, max(CASE WHEN model = 'naive_last' THEN raw END)
              OVER ({S.part(keys)}) AS base_ FROM sc)
            SELECT {by}, mape, {S.r('base_', 'baseline_mape')}, {S.r('1 - raw / base_', 'skill')},
            raw < base_ AS beats_baseline FROM b WHERE model <> 'naive_last'""",
    )

# --- K13 to K15: past the end of the data ----------------------------------------------------------


def k13(s, d, keys):
    table = stage(months(s, d, keys), "months")
    rows, _ = supervised(table, CFG, MONTH, keys, PAIR)
    models = ridge.fit(rows, PAIR, "label", keys, [10.0])
    return forecast.next_period_ridge(table, models, CFG, MONTH, keys, PAIR)


def k14(s, d, keys):
    table = stage(months(s, d, keys), "months")
    rows, _ = supervised(table, CFG, MONTH, keys, PAIR)
    models = ridge.fit(rows, PAIR, "label", keys, [10.0])
    return recursion.recursive_ridge(table, models, PAIR, MONTH, keys, 4)


def line(x1, x2):
    return f"my + g1 * ({x1} - m1) + g2 * ({x2} - m2)"


for suffix, keys in TWO:
    by = S.lead_list(keys, "")
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    using = f"JOIN g USING ({', '.join(keys)})" if keys else "JOIN g ON true"
    fitted = f"""{pair_sql(keys)}, mo AS (SELECT {by} {moments_sql()} FROM sup {group}),
        g AS (SELECT *, {slopes_sql(10.0)} FROM mo),
        b_ AS (SELECT {by} month, monthly_revenue AS y, row_number() OVER ({S.part(keys)} ORDER BY month DESC) AS back FROM months),
        ends AS (SELECT {by} max(CASE WHEN back = 1 THEN month END) AS last,
          {', '.join(f'max(CASE WHEN back = {i + 1} THEN y END) AS y{i}' for i in range(4))} FROM b_ {group}),
        s12 AS (SELECT *, greatest({line('y1', '(y1 + y2 + y3) / 3')}, 0) AS p1,
                  greatest({line('y0', '(y0 + y1 + y2) / 3')}, 0) AS p2, {line('y1', '(y1 + y2 + y3) / 3')} AS raw1
                FROM ends {using}),
        s3 AS (SELECT *, greatest({line('p1', '(p1 + y0 + y1) / 3')}, 0) AS p3 FROM s12),
        s4 AS (SELECT *, greatest({line('p2', '(p2 + p1 + y0) / 3')}, 0) AS p4 FROM s3)"""
    add(
        f"k13_next_month{suffix}",
        lambda s, d, keys=keys: k13(s, d, keys),
        f"""WITH {fitted} SELECT {by} last AS last_observed, CAST(last + INTERVAL 1 MONTH AS DATE) AS period,
            {S.r('raw1', 'y_pred')} FROM s12""",
    )
    steps = " UNION ALL ".join(
        f"SELECT {by} CAST(last + to_months({h}) AS DATE) AS period, {h} AS step, {S.r(f'p{h}', 'y_pred')} FROM s4"
        for h in (1, 2, 3, 4)
    )
    add(f"k14_recursive{suffix}", lambda s, d, keys=keys: k14(s, d, keys), f"WITH {fitted} {steps}")

DAILY_PICK = [
    "daily_revenue_lag_1",
    "daily_revenue_lag_7",
    "daily_revenue_roll_mean_28",
    "daily_revenue_ema_7",
    "revenue_per_order_lag_1",
    "day_of_week",
    "is_weekend",
    "month_sin",
]


def k14_daily(s, d):
    keys, cfg = ["nation"], FeatureConfig.default(DAY)
    table = stage(days(s, d, keys), "days")
    rows, _ = supervised(table, cfg, DAY, keys, DAILY_PICK)
    models = ridge.fit(rows, DAILY_PICK, "label", keys, [10.0])
    return recursion.recursive_ridge(table, models, DAILY_PICK, DAY, keys, 31)


add("k14_recursive_31_days_by_nation", k14_daily)

CUTOFFS = [dt.date(2001, 4, 1), dt.date(2001, 5, 1), dt.date(2001, 6, 1)]
TARGETS = ", ".join(f"DATE '{c}'" for c in [*CUTOFFS[1:], FINAL])


def naive_next(table, keys):
    return baselines.naive_ahead(table, MONTH, keys, 1).select(*keys, "period", "y_pred")


def ridge_next(table, keys):
    rows, _ = supervised(table, CFG, MONTH, keys, PAIR)
    models = ridge.fit(rows, PAIR, "label", keys, [10.0])
    return forecast.next_period_ridge(table, models, CFG, MONTH, keys, PAIR).select(*keys, "period", "y_pred")


for suffix, keys in TWO:
    back = "CAST(period - INTERVAL 1 MONTH AS DATE) AS cutoff"
    naive = f"""WITH {S.months(keys)}, f AS (SELECT {S.lead_list(keys, 'month AS period')},
          lag(monthly_revenue) OVER {S.order_window(keys, 'month')} AS p FROM months)
        SELECT {S.lead_list(keys, 'period')}, {S.r('p', 'y_pred')}, {back} FROM f WHERE period IN ({TARGETS})"""
    add(
        f"k15_simulated_naive{suffix}",
        lambda s, d, keys=keys: forecast.simulate_cutoffs(
            retail_facts(s, d), CUTOFFS, keys, naive_next
        ),
        naive,
    )
    add(
        f"k15_simulated_ridge{suffix}",
        lambda s, d, keys=keys: forecast.simulate_cutoffs(
            retail_facts(s, d), CUTOFFS, keys, ridge_next
        ),
        f"""WITH {expanding_sql(keys, 10.0)}, f AS (SELECT {S.lead_list(keys, 'target_period AS period')}, p FROM bt)
            SELECT {S.lead_list(keys, 'period')}, {S.r('p', 'y_pred')}, {back} FROM f WHERE period IN ({TARGETS})""",
    )

    def a08(s, d, keys=keys):
        path = staging_path(s, "forecasts")
        for c in CUTOFFS:
            made = forecast.simulate_cutoffs(retail_facts(s, d), [c], keys, naive_next)
            storage.write_cutoff(made.drop("cutoff"), path, str(c))
        return storage.read_cutoff(s, path)

    add(f"a08_newest_version{suffix}", a08, f"SELECT * FROM ({naive}) WHERE cutoff = DATE '{CUTOFFS[-1]}'")

# --- Pooled MLlib models ---------------------------------------------------------------------------

MANY = [
    "monthly_revenue_lag_1",
    "monthly_revenue_lag_6",
    "monthly_revenue_roll_mean_3",
    "monthly_revenue_roll_std_6",
    "monthly_revenue_ema_6",
    "total_orders_lag_1",
    "avg_review_score_lag_2",
    "avg_installments_lag_6",
    "month_num",
    "month_sin",
]
KNOWN = candidates()
# The whole grids of a forest and of boosting are hours of fits; these are explicit smaller ones.
GRIDS = {
    "random_forest": tuple({"maxDepth": 5, "featureSubsetStrategy": f} for f in ("sqrt", "0.5")),
    "gradient_boosting": ({"maxIter": 200, "stepSize": 0.05, "maxDepth": 2},),
    "hist_gradient_boosting": ({"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},),
}
FEWER = candidates(grids=GRIDS)
CONFIGURED = ["ridge", "random_forest", "gradient_boosting", "hist_gradient_boosting"]


def many_rows(s, d):
    return stage(supervised(months(s, d, ["nation"]), CFG, MONTH, ["nation"], MANY)[0], "many")


def fitted_scores(s, d, name):
    """Fit on the training phase, score the backtest phase."""
    rows = many_rows(s, d)
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    test = rows.where(F.col("target_period").between(F.lit(BACKTEST_START), F.lit(BACKTEST_END)))
    model = tuning.fit_tuned(train, tuning.Tuned(name, KNOWN[name].grid[0], 0.0), KNOWN, MANY, "label")
    return tuning.pooled_forecasts(model, test, name, "label", ["nation"])


for key, name in {
    "k04_random_forest": "random_forest",
    "k05_gradient_boosting": "gradient_boosting",
    "k06_hist_gradient_boosting": "hist_gradient_boosting",
    "k07_extra_trees": "extra_trees",
}.items():
    add(key, lambda s, d, name=name: fitted_scores(s, d, name))

add(
    "k03_ridge_many_features_by_nation",
    lambda s, d: backtest.ridge_backtest(many_rows(s, d), MANY, "label", "month", ["nation"], 10.0, 12, 24),
)


def k09_pooled(s, d):
    rows = many_rows(s, d)
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    best = tuning.search(train, MANY, "label", "month", ["ridge", "random_forest"], FEWER)
    test = rows.where(F.col("target_period").between(F.lit(BACKTEST_START), F.lit(BACKTEST_END)))
    parts = [
        scoring.score(
            tuning.pooled_forecasts(tuning.fit_tuned(train, t, FEWER, MANY, "label"), test, t.name, "label", []),
            ["model"],
        )
        for t in best
    ]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return ranking.leaderboard(tuning.leaderboard_with_params(scores, best), [])


add("k09_pooled_search", k09_pooled)

# A stated budget: the ridge with all its penalties, four points of each other grid, 60 trees and 20 rounds.
SPARING = tuning.Budget(points=4, trees=60, rounds=20)


def k09_halving(s, d):
    rows = many_rows(s, d)
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    best = tuning.halving_search(train, MANY, "label", "month", CONFIGURED, KNOWN, 2, budget=SPARING)
    test = rows.where(F.col("target_period").between(F.lit(BACKTEST_START), F.lit(BACKTEST_END)))
    parts = [
        scoring.score(
            tuning.pooled_forecasts(tuning.fit_tuned(train, t, KNOWN, MANY, "label"), test, t.name, "label", []), ["model"]
        )
        for t in best
    ]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return ranking.leaderboard(tuning.leaderboard_with_params(scores, best), [])


add("k09_halving_search", k09_halving)

# One split on a feature of few values is a least-squares fit that SQL can find: MLlib then tries every
# cut between two values.  A boosted second round fits twice what the first leaves over.
SPLIT = ["year_no", "month_num"]


def split_rows(s, d):
    return staged_pair(s, d).withColumns({"year_no": F.year("month"), "month_num": F.month("month")})


def one_split(s, d, name, **settings):
    rows = split_rows(s, d)
    known = candidates()[name]
    stump = type(known)(name, known.kind, known.settings | {"maxDepth": 1, "featureSubsetStrategy": "all"} | settings)
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    test = rows.where(F.col("target_period") > F.lit(TRAIN_END))
    model = tuning.fit_pipeline(train, stump, SPLIT, "label")
    return cents(tuning.pooled_forecasts(model, test, name, "label", ["nation"]))


def stump_sql(target, rows, out):
    """CTE ``out``: the feature, cut and the two means of the best single split of ``target`` over ``rows``."""
    cuts = " UNION ALL ".join(
        f"SELECT {i} AS f, {c} AS cut, avg(t) FILTER ({c}_ <= {c}) AS low, avg(t) FILTER ({c}_ > {c}) AS high,"
        f" count(*) FILTER ({c}_ <= {c}) AS nl, count(*) FILTER ({c}_ > {c}) AS nh"
        f" FROM (SELECT DISTINCT {c} FROM {rows}) CROSS JOIN (SELECT {c} AS {c}_, {target} AS t FROM {rows}) GROUP BY {c}"
        for i, c in enumerate(SPLIT)
    )
    # the split that leaves the least squares is the one whose means are furthest from the mean of all
    return f"""{out} AS (SELECT * FROM ({cuts}) WHERE nl > 0 AND nh > 0
        ORDER BY nl * nh * (low - high) * (low - high) / (nl + nh) DESC LIMIT 1)"""


def stump_value(out):
    return f"CASE WHEN (CASE {out}.f WHEN 0 THEN year_no ELSE month_num END) <= {out}.cut THEN {out}.low ELSE {out}.high END"


SPLIT_ROWS = f"""{pair_sql(['nation'])}, sr AS (SELECT nation, month, target_period, label, year(month) AS year_no,
      month(month) AS month_num FROM sup), st AS (SELECT * FROM sr WHERE target_period <= DATE '{TRAIN_END}'), {stump_sql('label', 'st', 's1')}"""
ONE = f"""WITH {SPLIT_ROWS} SELECT nation, 'MODEL' AS model, target_period AS period, {S.r('label', 'y_true', 2)},
    {S.r(stump_value('s1'), 'y_pred', 2)} FROM sr CROSS JOIN s1 WHERE target_period > DATE '{TRAIN_END}'"""
TWICE = f"""WITH {SPLIT_ROWS}, sv AS (SELECT st.*, 2 * (label - {stump_value('s1')}) AS rest FROM st CROSS JOIN s1),
    {stump_sql('rest', 'sv', 's2')}
    SELECT nation, 'MODEL' AS model, target_period AS period, {S.r('label', 'y_true', 2)},
    {S.r(f"{stump_value('s1')} + 0.1 * {stump_value('s2')}", 'y_pred', 2)}
    FROM sr CROSS JOIN s1 CROSS JOIN s2 WHERE target_period > DATE '{TRAIN_END}'"""
BARE = {"numTrees": 1, "bootstrap": False}
BOOST = {"maxIter": 2, "stepSize": 0.1, "subsamplingRate": 1.0}
add("k04_one_split", lambda s, d: one_split(s, d, "random_forest", **BARE), ONE.replace("MODEL", "random_forest"))
add("k07_one_split", lambda s, d: one_split(s, d, "extra_trees", **BARE), ONE.replace("MODEL", "extra_trees"))
add("k05_two_rounds", lambda s, d: one_split(s, d, "gradient_boosting", **BOOST), TWICE.replace("MODEL", "gradient_boosting"))
add("k06_two_rounds", lambda s, d: one_split(s, d, "hist_gradient_boosting", **BOOST), TWICE.replace("MODEL", "hist_gradient_boosting"))
STUMP = selection.SelectionSettings(
    correlation_limit=1.01, trees=1, depth=1, step=1, at_least=1, at_most=1, bootstrap=False
)


def stump_rows(s, d):
    return split_rows(s, d).where(F.col("target_period") <= F.lit(TRAIN_END))


def stump_chain(s, d):
    return selection.select_features(stump_rows(s, d), SPLIT, "label", lambda df, k: with_folds(df, "month", k), STUMP)


BEST_FEATURE = "CASE f WHEN 0 THEN 'year_no' ELSE 'month_num' END"
add(
    "j05_ranking_of_one_split",
    lambda s, d: selection.importance_table(s, selection.importances(stump_rows(s, d), SPLIT, "label", STUMP)),
    f"""WITH {SPLIT_ROWS}, r AS (SELECT unnest(['year_no', 'month_num']) AS feature)
        SELECT row_number() OVER (ORDER BY feature <> {BEST_FEATURE}) AS place, feature,
        CAST(feature = {BEST_FEATURE} AS INT) AS importance FROM r CROSS JOIN s1""",
)
add(
    "j03_elimination_to_one",
    lambda s, d: s.createDataFrame([(c,) for c in dict(stump_chain(s, d).stages)["elimination"]], "feature string"),
    f"WITH {SPLIT_ROWS} SELECT {BEST_FEATURE} AS feature FROM s1",
)
add(
    "j07_chain_of_one_split",
    lambda s, d: stump_chain(s, d).funnel(s),
    """SELECT * FROM (VALUES (0, 'original', 2), (1, 'variance', 2), (2, 'correlation', 2), (3, 'elimination', 1))
       t(stage_no, stage, feature_count)""",
)
# The cap at work: no feature is eliminated, one is allowed.
CAPPED = selection.SelectionSettings(
    correlation_limit=1.01, trees=1, depth=1, step=1, at_least=2, at_most=1, bootstrap=False
)


def capped(s, d):
    return selection.select_features(stump_rows(s, d), SPLIT, "label", lambda df, k: with_folds(df, "month", k), CAPPED)


add(
    "j04_cap_to_one",
    lambda s, d: s.createDataFrame(
        [(name, c) for name, kept in capped(s, d).stages for c in kept if name in ("elimination", "cap")], "stage string, feature string"
    ),
    f"""WITH {SPLIT_ROWS} SELECT 'cap' AS stage, {BEST_FEATURE} AS feature FROM s1
        UNION ALL SELECT 'elimination', unnest(['year_no', 'month_num'])""",
)


def j08_pair(s, d):
    """A line on the feature that a correlation limit of zero leaves, against a ridge without penalty on both."""
    rows = staged_pair(s, d)
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    test = rows.where(F.col("target_period") > F.lit(TRAIN_END))
    chosen = selection.exact_stages(train, PAIR, 0.0).features
    parts = [
        tuning.pooled_forecasts(tuning.fit_pipeline(train, KNOWN["linear"], cols, "label"), test, label, "label", ["nation"])
        for label, cols in (("all_features", PAIR), ("selected_features", chosen))
    ]
    scores = scoring.score(parts[0].unionByName(parts[1]), ["model"], ("mae", "mape"))
    return scores.withColumns({c: steady_round(F.col(c), 2) for c in ("mae", "mape")})


add(
    "j08_all_against_selected_pair",
    j08_pair,
    f"""WITH {pair_sql(['nation'])}, tr AS (SELECT * FROM sup WHERE target_period <= DATE '{TRAIN_END}'),
        mo AS (SELECT {moments_sql()} FROM tr), g AS (SELECT *, {slopes_sql(0.0)} FROM mo),
        l AS (SELECT regr_intercept(label, {X1}) AS a, regr_slope(label, {X1}) AS b FROM tr),
        fc AS (SELECT 'all_features' AS model, label AS y, {PREDICT} AS p FROM sup CROSS JOIN g WHERE target_period > DATE '{TRAIN_END}'
          UNION ALL SELECT 'selected_features', label, a + b * {X1} FROM sup CROSS JOIN l WHERE target_period > DATE '{TRAIN_END}')
        SELECT model, {S.r('avg(abs(y - p))', 'mae', 2)}, {S.r('100 * avg(abs(y - p) / greatest(abs(y), 1e-9))', 'mape', 2)} FROM fc GROUP BY model""",
)
# Linear models have a closed form: MLlib's fits on one or two features are checked by SQL.
# Cents are compared, since MLlib solves in another order of operations.


def cents(df):
    return df.withColumns({c: steady_round(F.col(c), 2) for c in ("y_true", "y_pred") if c in df.columns})


def staged_pair(s, d):
    return stage(pair_rows(s, d, ["nation"]), "pair")


def k08_linear(s, d):
    rows = staged_pair(s, d)
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    test = rows.where(F.col("target_period").between(F.lit(BACKTEST_START), F.lit(BACKTEST_END)))
    model = tuning.fit_pipeline(train, KNOWN["linear"], [X1], "label")
    return cents(tuning.pooled_forecasts(model, test, "linear", "label", ["nation"]))


def line_sql(begin, stop, train):
    """One-feature least squares on ``train``, applied to targets from ``begin`` to before ``stop``."""
    return f"""SELECT nation, 'linear' AS model, target_period AS period, {S.r('label', 'y_true', 2)},
      {S.r(f'a + b * {X1}', 'y_pred', 2)} FROM sup JOIN (SELECT regr_intercept(label, {X1}) AS a,
      regr_slope(label, {X1}) AS b FROM sup WHERE {train}) f ON true
      WHERE target_period >= DATE '{begin}' AND target_period < DATE '{stop}'"""


add(
    "k08_linear_regression",
    k08_linear,
    f"WITH {pair_sql(['nation'])} " + line_sql(BACKTEST_START, FINAL, f"target_period <= DATE '{TRAIN_END}'"),
)
def f08_model(s, d):
    """The line fitted to log(1 + label), its forecasts back on the scale of the label."""
    rows = staged_pair(s, d)
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    test = rows.where(F.col("target_period").between(F.lit(BACKTEST_START), F.lit(BACKTEST_END)))
    model = tuning.fit_pipeline(train, KNOWN["linear"], [X1], "label", log_target=True)
    return cents(tuning.pooled_forecasts(model, test, "linear", "label", ["nation"]))


add(
    "f08_log_target_model",
    f08_model,
    f"""WITH {pair_sql(['nation'])} SELECT nation, 'linear' AS model, target_period AS period, {S.r('label', 'y_true', 2)},
      {S.r(f'exp(a + b * {X1}) - 1', 'y_pred', 2)} FROM sup JOIN (SELECT regr_intercept(ln(1 + label), {X1}) AS a,
      regr_slope(ln(1 + label), {X1}) AS b FROM sup WHERE target_period <= DATE '{TRAIN_END}') f ON true
      WHERE target_period >= DATE '{BACKTEST_START}' AND target_period < DATE '{FINAL}'""",
)
REFITS = [dt.date(2001, 4, 1), dt.date(2001, 5, 1), dt.date(2001, 6, 1)]
add(
    "i06_pooled_backtest",
    lambda s, d: cents(
        backtest.pooled_backtest(
            staged_pair(s, d), KNOWN["linear"], {}, [X1], "label", "month", ["nation"], REFITS, FINAL
        )
    ),
    f"WITH {pair_sql(['nation'])} "
    + " UNION ALL ".join(
        line_sql(b, e, f"target_period < DATE '{b}'") for b, e in zip(REFITS, [*REFITS[1:], FINAL])
    ),
)


def a07(s, d):
    rows = staged_pair(s, d)
    path = staging_path(s, "model")
    model = tuning.pooled_ridge(rows.where(F.col("target_period") <= F.lit(TRAIN_END)), PAIR, "label", 10.0)
    storage.save_model(model, path)
    later = rows.where(F.col("target_period") > F.lit(TRAIN_END))
    return cents(tuning.pooled_forecasts(storage.load_model(path), later, "ridge", "label", ["nation"]))


def pooled_sql(where):
    return f"""{pair_sql(['nation'])}, mo AS (SELECT {moments_sql()} FROM sup WHERE {where}),
        g AS (SELECT *, {slopes_sql(10.0)} FROM mo)"""


add(
    "a07_model_round_trip",
    a07,
    f"""WITH {pooled_sql(f"target_period <= DATE '{TRAIN_END}'")}
        SELECT nation, 'ridge' AS model, target_period AS period, {S.r('label', 'y_true', 2)},
        {S.r(PREDICT, 'y_pred', 2)} FROM sup JOIN g ON true WHERE target_period > DATE '{TRAIN_END}'""",
)
POOLED_STEPS = f"""{pooled_sql('true')},
    b_ AS (SELECT nation, month, monthly_revenue AS y, row_number() OVER (PARTITION BY nation ORDER BY month DESC) AS back FROM months),
    ends AS (SELECT nation, max(CASE WHEN back = 1 THEN month END) AS last,
      {', '.join(f'max(CASE WHEN back = {i + 1} THEN y END) AS y{i}' for i in range(4))} FROM b_ GROUP BY nation),
    s12 AS (SELECT *, {line('y1', '(y1 + y2 + y3) / 3')} AS p1, greatest({line('y0', '(y0 + y1 + y2) / 3')}, 0) AS p2
            FROM ends JOIN g ON true),
    s3 AS (SELECT *, greatest({line('greatest(p1, 0)', '(greatest(p1, 0) + y0 + y1) / 3')}, 0) AS p3 FROM s12)"""


def k13_pooled(s, d):
    model = tuning.pooled_ridge(staged_pair(s, d), PAIR, "label", 10.0)
    return cents(forecast.next_period_pooled(months(s, d, ["nation"]), model, CFG, MONTH, ["nation"], PAIR))


add(
    "k13_next_month_pooled",
    k13_pooled,
    f"""WITH {POOLED_STEPS} SELECT nation, last AS last_observed, CAST(last + INTERVAL 1 MONTH AS DATE) AS period,
        {S.r('p1', 'y_pred', 2)} FROM s12""",
)


def k14_pooled(s, d):
    model = tuning.pooled_ridge(staged_pair(s, d), PAIR, "label", 10.0)
    return cents(forecast.recursive_pooled(months(s, d, ["nation"]), model, CFG, MONTH, ["nation"], PAIR, 3))


add(
    "k14_recursive_pooled",
    k14_pooled,
    f"WITH {POOLED_STEPS} "
    + " UNION ALL ".join(
        f"""SELECT nation, CAST(last + to_months({h}) AS DATE) AS period, {h} AS step,
            {S.r(f'greatest(p{h}, 0)', 'y_pred', 2)} FROM s3"""
        for h in (1, 2, 3)
    ),
)


DAILY_PAIR = ["daily_revenue_roll_mean_7", "daily_revenue_ema_7"]
DAILY_STEPS = 31


def k14_daily_pooled(s, d):
    """One ridge over all nations, 31 days ahead."""
    keys, table = ["nation"], stage(days(s, d, ["nation"]), "days")
    cfg = FeatureConfig.default(DAY)
    rows, _ = supervised(table, cfg, DAY, keys, DAILY_PAIR)
    model = tuning.pooled_ridge(stage(rows, "daily-pair"), DAILY_PAIR, "label", 10.0)
    return cents(forecast.recursive_pooled(table, model, cfg, DAY, keys, DAILY_PAIR, DAILY_STEPS))


# The average over seven days weighs what lies 200 rows back with 1e-25.
DAILY_RECURSION = f"""WITH RECURSIVE {S.days(['nation']).replace('days AS (', 'days AS MATERIALIZED (')},
    base AS MATERIALIZED (SELECT nation, date, daily_revenue AS y, row_number() OVER (PARTITION BY nation ORDER BY date) - 1 AS i FROM days),
    em AS (SELECT a.nation, a.i, sum(b.y * CASE WHEN b.i = 0 THEN pow(0.75, a.i - 1) ELSE 0.25 * pow(0.75, a.i - 1 - b.i) END) AS {DAILY_PAIR[1]}
           FROM base a JOIN base b ON a.nation = b.nation AND b.i < a.i AND b.i >= a.i - 200 GROUP BY a.nation, a.i),
    fe AS MATERIALIZED (SELECT nation, date, y, {DAILY_PAIR[1]}, lead(y) OVER w AS label,
           avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS {DAILY_PAIR[0]}
           FROM base LEFT JOIN em USING (nation, i) WINDOW w AS (PARTITION BY nation ORDER BY date)),
    mo AS (SELECT {moments_sql(pair=DAILY_PAIR)} FROM fe WHERE label IS NOT NULL AND {DAILY_PAIR[1]} IS NOT NULL),
    g AS MATERIALIZED (SELECT *, {slopes_sql(10.0)} FROM mo),
    ends AS (SELECT nation, max(date) AS date, list(y ORDER BY date) AS h FROM fe GROUP BY nation),
    st AS (SELECT 0 AS step, nation, date, y, h[len(h) - 7 : len(h) - 1] AS past, {DAILY_PAIR[1]} AS e FROM ends JOIN fe USING (nation, date)
      UNION ALL SELECT step + 1, nation, date + 1, greatest(my + g1 * (list_avg(past) - m1) + g2 * (e - m2), 0),
        list_append(past[2:], y), 0.75 * e + 0.25 * y FROM st CROSS JOIN g WHERE step < {DAILY_STEPS})
    SELECT nation, date AS period, step, {S.r('y', 'y_pred', 2)} FROM st WHERE step > 0"""
add("k14_recursive_pooled_31_days", k14_daily_pooled, DAILY_RECURSION)


DAILY_MEAN = DAILY_PAIR[0]


def daily_backtest(s, d):
    """One line over all nations on the mean of seven days, refitted each month of the daily backtest."""
    cfg = FeatureConfig.default(DAY)
    rows, _ = supervised(days(s, d, ["nation"]), cfg, DAY, ["nation"], [DAILY_MEAN])
    return backtest.pooled_backtest(
        stage(rows, "daily-mean"), KNOWN["linear"], {}, [DAILY_MEAN], "label", "date", ["nation"], REFITS, FINAL
    )


def d13_model(s, d):
    scores = scoring.monthly_scores(daily_backtest(s, d), ["nation", "model"])
    return scores.withColumns({c: steady_round(F.col(c), 2) for c in scores.columns if c.startswith("monthly_")})


DAILY_FORECASTS = f"""{S.days(['nation']).replace('days AS (', 'days AS MATERIALIZED (')},
    fe AS MATERIALIZED (SELECT nation, lead(date) OVER w AS target, lead(daily_revenue) OVER w AS label,
      avg(daily_revenue) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS x FROM days WINDOW w AS (PARTITION BY nation ORDER BY date)),
    sup AS MATERIALIZED (SELECT * FROM fe WHERE label IS NOT NULL AND x IS NOT NULL),
    fc AS (""" + " UNION ALL ".join(
    f"""SELECT nation, 'linear' AS model, target AS period, label AS y, a + b * x AS p FROM sup CROSS JOIN
        (SELECT regr_intercept(label, x) AS a, regr_slope(label, x) AS b FROM sup WHERE target < DATE '{begin}')
        WHERE target >= DATE '{begin}' AND target < DATE '{stop}'"""
    for begin, stop in zip(REFITS, [*REFITS[1:], FINAL])
) + ")"
add(
    "d13_daily_backtest_of_model",
    lambda s, d: cents(daily_backtest(s, d)),
    f"WITH {DAILY_FORECASTS} SELECT nation, model, period, {S.r('y', 'y_true', 2)}, {S.r('p', 'y_pred', 2)} FROM fc",
)
add(
    "d13_monthly_scores_of_model",
    d13_model,
    f"""WITH {DAILY_FORECASTS}, m AS (SELECT nation, model, date_trunc('month', period) AS month, sum(y) AS y, sum(p) AS p FROM fc GROUP BY ALL)
        SELECT nation, model, {', '.join(S.r(e, 'monthly_' + n, 2) for n, e in MEASURES_SQL.items())} FROM m GROUP BY nation, model""",
)


def k14_forest(s, d):
    rows = many_rows(s, d)
    tuned = tuning.Tuned("random_forest", KNOWN["random_forest"].grid[0], 0.0)
    model = tuning.fit_tuned(rows, tuned, KNOWN, MANY, "label")
    return forecast.recursive_pooled(months(s, d, ["nation"]), model, CFG, MONTH, ["nation"], MANY, 3)


add("k14_recursive_forest", k14_forest)


def k11_pooled(s, d):
    rows, names = trained(s, d, ["nation"], False)
    result = tuning.tune(
        stage(rows, "supervised"), names, "label", "month", ["nation"], TRAIN_END, BACKTEST_END,
        CONFIGURED, FEWER,
    )
    path = staging_path(s, "metadata")
    storage.write_report(result.metadata(s), path)
    storage.save_model(result.model, staging_path(s, "model"))
    written = s.read.schema(result.metadata(s).schema).json(path)
    return result.leaderboard.join(written, F.col("model") == F.col("best_model"), "left").drop("best_model")


add("k11_tune_and_select", k11_pooled)


def k11_ridge(s, d):
    """The pooled ridge with all its penalties and both baselines, on two features."""
    settings = selection.SelectionSettings(correlation_limit=1.01)
    result = tuning.tune(
        staged_pair(s, d), PAIR, "label", "month", ["nation"], TRAIN_END, BACKTEST_END,
        ["seasonal_naive_12", "ridge"], KNOWN, settings,
    )
    return result.leaderboard.select("model", "mape", "best_params", "place")


AFTER = f"target_period > DATE '{TRAIN_END}' AND target_period <= DATE '{BACKTEST_END}'"
LAST = "OVER (PARTITION BY nation ORDER BY target_period)"
add(
    "k11_tune_ridge_and_baselines",
    k11_ridge,
    f"""WITH {cv_sql([], 4, ['nation'])}, m2 AS (SELECT {moments_sql()} FROM tr),
        g2_ AS (SELECT *, {slopes_sql('alpha')} FROM m2 JOIN best ON true),
        past AS (SELECT target_period, label AS y, lag(label) {LAST} AS p1,
          coalesce(lag(label, 12) {LAST}, lag(label) {LAST}) AS p12 FROM sup),
        fc AS (SELECT 'ridge' AS model, label AS y, {PREDICT} AS p FROM sup JOIN g2_ ON true WHERE {AFTER}
          UNION ALL SELECT 'naive_last', y, p1 FROM past WHERE {AFTER}
          UNION ALL SELECT 'seasonal_naive_12', y, p12 FROM past WHERE {AFTER}),
        sc AS (SELECT model, 100 * avg(abs(y - p) / greatest(abs(y), 1e-9)) AS raw FROM fc GROUP BY model)
        SELECT model, {S.r('raw', 'mape')}, row_number() OVER (ORDER BY raw, model) AS place,
          CASE WHEN model = 'ridge' THEN (SELECT '[(''alpha'', ' || CAST(CAST(alpha AS DOUBLE) AS VARCHAR) || ')]' FROM best) END AS best_params
        FROM sc""",
)


def a07_table(s, d):
    path = staging_path(s, "coefficients")
    storage.write_table(k11(s, d, ["nation"]), path)
    return s.read.parquet(path).select(
        "nation", "alpha", *[F.col("coefficients")[i].alias(f"b{i}") for i in range(3)]
    )


add("a07_coefficient_table", a07_table, SQL["k11_refit_winner_by_nation"])


def a06(s, d):
    path = staging_path(s, "leaderboard")
    board = ranking.leaderboard(scoring.score(two_baselines(s, d, ["nation"]), ["nation", "model"]), ["nation"])
    storage.write_report(board, path)
    return s.read.schema(board.schema).json(path)


add("a06_report_sinks", a06, SQL["g06_leaderboard_by_nation"])


# --- J: filters that need a model -------------------------------------------------------------------


def folds(df, k):
    return with_folds(df, "month", k)


def full_selection(s, d, settings=selection.SelectionSettings()):
    rows, names = training_rows(s, d, ["nation"])
    return rows, selection.select_features(rows, names, "label", folds, settings)


def stage_of(s, d, stage_name):
    """Features in order after one stage of the whole chain; after its end, if it had no need of the stage."""
    stages = full_selection(s, d)[1].stages
    kept = dict(stages).get(stage_name, stages[-1][1])
    return s.createDataFrame([(i, c) for i, c in enumerate(kept)], "place int, feature string")


def j08(s, d):
    """The same pooled ridge on all features and on the selected ones."""
    rows, names = trained(s, d, ["nation"], False)
    rows = stage(rows, "supervised")
    train = rows.where(F.col("target_period") <= F.lit(TRAIN_END))
    test = rows.where(F.col("target_period") > F.lit(TRAIN_END))
    chosen = selection.select_features(train, names, "label", folds).features
    parts = [
        tuning.pooled_forecasts(tuning.pooled_ridge(train, cols, "label", 10.0), test, label, "label", ["nation"])
        for label, cols in (("all_features", names), ("selected_features", chosen))
    ]
    return scoring.score(parts[0].unionByName(parts[1]), ["model"])


add("j03_elimination", lambda s, d: stage_of(s, d, "elimination"))
add("j04_cap_by_importance", lambda s, d: stage_of(s, d, "cap"))
add("j05_importance_ranking", lambda s, d: selection.importance_table(s, full_selection(s, d)[1].ranking))
add("j07_select_features", lambda s, d: full_selection(s, d)[1].funnel(s))
add("j08_all_against_selected", j08)

# --- L: error measures --------------------------------------------------------------------------------

for suffix, keys in TWO:
    by = S.lead_list(keys, "model")
    for i, name in enumerate(MEASURES_SQL):
        add(
            f"l0{i + 1}_{name}{suffix}",
            lambda s, d, keys=keys, name=name: scoring.score(two_baselines(s, d, keys), [*keys, "model"], (name,)),
            f"WITH {two_sql(keys)} SELECT {by}, {measures('', (name,))} FROM fc GROUP BY {by}",
        )
    shocks = [(dt.date(1998, 5, 1), dt.date(1998, 6, 1))]
    add(
        f"l07_masked_score{suffix}",
        lambda s, d, keys=keys, shocks=shocks: scoring.masked_score(
            two_baselines(s, d, keys), [*keys, "model"], shocks
        ),
        f"""WITH {two_sql(keys)} SELECT {by}, {measures('', ('mae', 'rmse', 'mape', 'bias'))} FROM fc
            WHERE month NOT BETWEEN DATE '1998-05-01' AND DATE '1998-06-01' GROUP BY {by}""",
    )
    add(
        f"l08_error_table{suffix}",
        lambda s, d, keys=keys: scoring.error_table(two_baselines(s, d, keys)),
        f"""WITH {two_sql(keys)} SELECT {S.lead_list(keys, 'model', 'month AS period')}, {S.r('y', 'y_true')},
            {S.r('p', 'y_pred')}, {S.r('p - y', 'error')}, {S.r('abs(p - y)', 'abs_error')},
            {S.r('abs(p - y) / nullif(y, 0) * 100', 'abs_error_pct')}, {S.r('(p - y) / nullif(y, 0) * 100', 'error_pct')}
            FROM fc""",
    )
    add(
        f"l09_all_measures{suffix}",
        lambda s, d, keys=keys: scoring.score(two_baselines(s, d, keys), [*keys, "model"]),
        f"WITH {two_sql(keys)} SELECT {by}, {measures()} FROM fc GROUP BY {by}",
    )

# --- C06, M: business figures --------------------------------------------------------------------------


def in_context(s, d, keys):
    table = stage(months(s, d, keys), "months")
    made = baselines.naive_last(table, MONTH, keys)
    return kpis.with_context(made, table, keys)


def context_sql(keys):
    w = S.order_window([*keys], "period")
    return f"""{S.months(keys)}, cx AS (SELECT {S.lead_list(keys, "'naive_last' AS model", 'month AS period')},
      monthly_revenue AS y, lag(monthly_revenue) OVER {S.order_window(keys, 'month')} AS p,
      total_orders, total_freight, top_category, new_sellers, unique_customers FROM months),
    kp AS (SELECT *, y / nullif(lag(y) OVER {w}, 0) - 1 AS revenue_growth, y / nullif(total_orders, 0) AS avg_ticket,
      y / nullif(unique_customers, 0) AS arpu, total_freight / nullif(y, 0) AS freight_ratio,
      total_orders / nullif(unique_customers, 0) AS frequency, total_freight / nullif(total_orders, 0) AS avg_freight
      FROM cx WHERE p IS NOT NULL)"""


CONTEXT_SELECT = f"""period, {S.r('y', 'y_true')}, {S.r('p', 'y_pred')}, total_orders,
    {S.r('total_freight', 'total_freight')}, top_category, new_sellers, unique_customers"""
KPI = ["revenue_growth", "avg_ticket", "arpu", "freight_ratio", "frequency", "avg_freight"]
SUMMARY = {
    "total_real": "sum(y)",
    "total_forecast": "sum(p)",
    "realization_rate_pct": "CASE WHEN sum(y) > 0 THEN sum(p) / sum(y) * 100 ELSE 0 END",
    "revenue_deviation": "sum(p) - sum(y)",
    "avg_growth_pct": "avg(revenue_growth) * 100",
    "avg_ticket": "avg(avg_ticket)",
    "avg_arpu": "avg(arpu)",
    "avg_freight_ratio_pct": "avg(freight_ratio) * 100",
    "avg_orders_per_customer": "avg(frequency)",
}


def summarised(s, d, keys):
    groups = [*keys, "model"]
    return kpis.summary(kpis.period_kpis(in_context(s, d, keys), groups), groups)


for suffix, keys in TWO:
    by = S.lead_list(keys, "model")
    add(
        f"c06_backtest_context{suffix}",
        lambda s, d, keys=keys: in_context(s, d, keys),
        f"WITH {context_sql(keys)} SELECT {by}, {CONTEXT_SELECT} FROM cx WHERE p IS NOT NULL",
    )
    add(
        f"m01_period_kpis{suffix}",
        lambda s, d, keys=keys: kpis.period_kpis(in_context(s, d, keys), [*keys, "model"]),
        f"WITH {context_sql(keys)} SELECT {by}, {CONTEXT_SELECT}, {', '.join(S.r(k, k) for k in KPI)} FROM kp",
    )
    same = " AND ".join(f"t.{k} = kp.{k}" for k in keys) or "true"
    mode = f"""tc AS (SELECT {S.lead_list(keys, 'top_category')} FROM (SELECT {S.lead_list(keys, 'top_category')},
        row_number() OVER ({S.part(keys)} ORDER BY count(*) DESC, top_category) AS place FROM kp
        WHERE top_category IS NOT NULL GROUP BY {S.lead_list(keys, 'top_category')}) WHERE place = 1)"""
    summed = f"""{context_sql(keys)}, {mode}, sm AS (SELECT {by}, {', '.join(S.r(e, n) for n, e in SUMMARY.items())},
        CAST(sum(new_sellers) AS BIGINT) AS total_new_sellers FROM kp GROUP BY {by})"""
    join = f"LEFT JOIN tc USING ({', '.join(keys)})" if keys else "LEFT JOIN tc ON true"
    add(
        f"m02_summary{suffix}",
        lambda s, d, keys=keys: summarised(s, d, keys),
        f"WITH {summed} SELECT sm.*, top_category FROM sm {join}",
    )
    add(
        f"m03_long_measures{suffix}",
        lambda s, d, keys=keys: scoring.long_measures(summarised(s, d, keys), [*keys, "model"], list(SUMMARY)),
        f"""WITH {summed} SELECT {by}, metric, value FROM (SELECT * EXCLUDE (total_new_sellers) FROM sm)
            UNPIVOT (value FOR metric IN ({', '.join(SUMMARY)}))""",
    )

# --- N: monitoring ------------------------------------------------------------------------------------

FIRST = dt.date(1995, 1, 1)


def monthly_errors(s, d, keys):
    made = baselines.naive_last(days(s, d, keys), DAY, keys)
    return scoring.score(made, [*keys, "model", MONTH.bucket(F.col("period")).alias("month")]).withColumnRenamed(
        "month", "period"
    )


def monthly_errors_sql(keys):
    return f"""{S.days(keys)}, f AS (SELECT {S.lead_list(keys, "'naive_last' AS model")},
      CAST(date_trunc('month', date) AS DATE) AS period, daily_revenue AS y,
      lag(daily_revenue) OVER {S.order_window(keys, 'date')} AS p FROM days),
    me AS (SELECT {S.lead_list(keys, 'model', 'period')}, avg(p - y) AS bias,
      100 * avg(abs(y - p) / greatest(abs(y), 1e-9)) AS mape FROM f WHERE p IS NOT NULL GROUP BY ALL)"""


for suffix, keys in TWO:
    by = S.lead_list(keys, "model")
    each = f"FROM (SELECT DISTINCT {', '.join(keys)} FROM orows)" if keys else ""
    add(
        f"n01_missing_days{suffix}",
        lambda s, d, keys=keys: missing_days(
            roll_up(order_rows(retail_facts(s, d), DAY, keys, complete(s, d)), DAY, keys), "date", keys, (FIRST, complete(s, d).before)
        ),
        f"""WITH {S.BASE}, {S.order_rows(keys)}, g AS (SELECT {S.lead_list(keys, '')}
              CAST(unnest(generate_series(DATE '1995-01-01', {S.CUT} - 1, INTERVAL 1 DAY)) AS DATE) AS date {each})
            SELECT {S.lead_list(keys, 'date')} FROM g EXCEPT SELECT {S.lead_list(keys, 'date')} FROM orows""",
    )
    add(
        f"n02_mape_alerts{suffix}",
        lambda s, d, keys=keys: monitoring.mape_alerts(
            scoring.score(two_baselines(s, d, keys), [*keys, "model"], ("mape",)), 7.0
        ),
        f"""WITH {two_sql(keys)} SELECT {by}, {measures('', ('mape',))} FROM fc GROUP BY {by}
            HAVING {MEASURES_SQL['mape']} > 7.0""",
    )
    add(
        f"n03_bias_runs{suffix}",
        lambda s, d, keys=keys: monitoring.bias_runs(monthly_errors(s, d, keys), [*keys, "model"]),
        f"""WITH {monthly_errors_sql(keys)}, sg AS (SELECT *, CAST(sign(bias) AS BIGINT) AS bias_sign,
              year(period) * 12 + month(period)
              - row_number() OVER (PARTITION BY {by}, sign(bias) ORDER BY period) AS run FROM me)
            SELECT {by}, bias_sign, min(period) AS first_period, max(period) AS last_period, count(*) AS months
            FROM sg WHERE bias_sign <> 0 GROUP BY {by}, bias_sign, run HAVING count(*) > 2""",
    )
    add(
        f"n04_realization{suffix}",
        lambda s, d, keys=keys: monitoring.realization(two_baselines(s, d, keys), [*keys, "model"]),
        f"""WITH {two_sql(keys)} SELECT {by}, {S.r('sum(p) / nullif(sum(y), 0) * 100', 'realization_rate_pct')},
            sum(p) / nullif(sum(y), 0) * 100 BETWEEN 90 AND 110 AS in_band FROM fc GROUP BY {by}""",
    )

    def n05(s, d, keys=keys):
        groups = [*keys, "model"]
        errors = stage(scoring.score(two_baselines(s, d, keys), [*groups, "period"], ("mape",)), "errors")
        base = errors.groupBy(*groups).agg(F.avg("mape").alias("baseline_mape"))
        return monitoring.mape_drift(errors, groups, base).drop("mape")

    add(
        f"n05_mape_drift{suffix}",
        n05,
        f"""WITH {two_sql(keys)}, me AS (SELECT {by}, month AS period,
              100 * avg(abs(y - p) / greatest(abs(y), 1e-9)) AS mape FROM fc GROUP BY {by}, month),
            b AS (SELECT {by}, avg(mape) AS baseline_mape FROM me GROUP BY {by}),
            ro AS (SELECT {by}, period, avg(mape) OVER w AS rolling_mape, count(mape) OVER w AS n FROM me
              WINDOW w AS (PARTITION BY {by} ORDER BY year(period) * 12 + month(period) RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
            SELECT {by}, period, {S.r('rolling_mape', 'rolling_mape')}, {S.r('baseline_mape', 'baseline_mape')},
            rolling_mape > 1.3 * baseline_mape AS drifted FROM ro JOIN b USING ({by}) WHERE n = 3""",
    )

    def n06(s, d, keys=keys):
        table = stage(
            days(s, d, keys).selectExpr(
                *keys, "date", "try_divide(daily_revenue, total_orders) AS ticket",
                "double(total_orders) AS orders", "double(unique_customers) AS customers",
            ),
            "drift",
        )
        parts = [
            monitoring.population_stability(table, v, "date", keys, dt.date(2001, 1, 1)).withColumn("variable", F.lit(v))
            for v in ("ticket", "orders", "customers")
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    using = f"JOIN ed USING ({', '.join([*keys, 'variable'])})"
    add(
        f"n06_population_drift{suffix}",
        n06,
        f"""WITH {S.days(keys)}, v AS (
              SELECT {S.lead_list(keys, 'date')}, unnest(['ticket', 'orders', 'customers']) AS variable,
                unnest([daily_revenue / nullif(total_orders, 0), total_orders, unique_customers]) AS x FROM days),
            ed AS (SELECT {S.lead_list(keys, 'variable')},
                quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges
              FROM v WHERE x IS NOT NULL AND date < DATE '2001-01-01' GROUP BY {S.lead_list(keys, 'variable')}),
            bn AS (SELECT {S.lead_list(keys, 'variable')}, date < DATE '2001-01-01' AS old,
                len([e for e in edges if e < x]) AS bin FROM v {using} WHERE x IS NOT NULL),
            tot AS (SELECT {S.lead_list(keys, 'variable')}, count(*) FILTER (old) AS o, count(*) FILTER (NOT old) AS n
              FROM bn GROUP BY ALL),
            cells AS (SELECT {S.lead_list([f'tot.{k}' for k in keys], 'tot.variable')}, b,
                greatest(count(*) FILTER (old AND bin = b) / any_value(o), 1e-4) AS was,
                greatest(count(*) FILTER (NOT old AND bin = b) / any_value(n), 1e-4) AS now
              FROM (SELECT *, unnest(range(10)) AS b FROM tot) tot JOIN bn USING ({S.lead_list(keys, 'variable')})
              GROUP BY {S.lead_list([f'tot.{k}' for k in keys], 'tot.variable')}, b)
            SELECT {S.lead_list(keys, 'variable')}, {S.r('sum((now - was) * ln(now / was))', 'psi')}
            FROM cells GROUP BY {S.lead_list(keys, 'variable')}""",
    )

# --- O: arriving facts ----------------------------------------------------------------------------------


def o01(s, d, keys):
    """Orders arrive in three files with all months mixed, so every batch corrects old months."""
    arrivals = staging_path(s, "arrivals")
    facts = order_rows(retail_facts(s, d), MONTH, keys, complete(s, d)).drop("month")
    facts.repartition(3, "order_id").write.parquet(arrivals)
    stream = s.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    target = staging_path(s, "target")
    incremental.follow(
        stream, MONTH, ORDER_TS, lambda known: roll_up(known, MONTH, keys),
        staging_path(s, "store"), target, staging_path(s, "progress"),
    ).awaitTermination()
    return s.read.parquet(target)


for suffix, keys in TWO:
    add(
        f"o01_arriving_orders{suffix}", lambda s, d, keys=keys: o01(s, d, keys), SQL[f"d04_monthly_roll_up{suffix}"]
    )


def o01_raw(s, d, keys):
    """Raw orders, payments, reviews and items in three deliveries, each table dealt differently over them.

    So two thirds of the lines come before or after their orders, and late items change
    top categories and first sightings of months already computed.
    """
    facts = retail_facts(s, d)
    follower = MonthlyFollower(facts, keys, staging_path(s, "follower"))
    arrivals = staging_path(s, "deliveries")
    tables = {n: getattr(facts, n) for n in ("orders", *LINES)}
    for delivery in range(3):
        for shift, (name, df) in enumerate(tables.items()):
            own = df.where(F.pmod(F.xxhash64("order_id") + shift, F.lit(3)) == delivery)
            own.write.mode("append").parquet(f"{arrivals}/{name}")
        streams = {n: s.readStream.schema(df.schema).parquet(f"{arrivals}/{n}") for n, df in tables.items()}
        follower.follow(tagged(streams)).awaitTermination()
    return follower.table(complete(s, d))


for suffix, keys in TWO:
    add(f"o01_raw_facts{suffix}", lambda s, d, keys=keys: o01_raw(s, d, keys), SQL[f"d11_monthly_table{suffix}"])


def o01_events(s, d):
    schema = read_tables(s, d, ["events"])["events"].schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    target = staging_path(s, "target")
    incremental.follow(
        stream, DAY, "ts", incremental.daily_sums(DAY, ["event_type"], "value"),
        staging_path(s, "store"), target, staging_path(s, "progress"),
    ).awaitTermination()
    return s.read.parquet(target)


add(
    "o01_arriving_events",
    o01_events,
    f"""SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS row_count, {S.r('sum(value)', 'total')}
        FROM events GROUP BY CAST(ts AS DATE), event_type""",
)


def o01_sums(s, d):
    """Events in four deliveries by time, every tenth of them in the last: days long closed get late events."""
    events = read_tables(s, d, ["events"])["events"]
    arrivals = staging_path(s, "deliveries")
    second = F.col("ts").cast("timestamp").cast("double")
    low, high = events.agg(F.min(second), F.max(second)).first()
    quarter = F.floor(4 * (second - low) / (high - low))
    late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    number = F.when(late, 3).otherwise(F.least(quarter, F.lit(3)))
    follower = DailySums(s, "ts", ["event_type"], "value", "2 days", staging_path(s, "sums"))
    for delivery in range(4):
        events.where(number == delivery).write.mode("append").parquet(arrivals)
        follower.run(s.readStream.schema(events.schema).parquet(arrivals))
    return follower.table()


add("o01_sums_from_state", o01_sums, SQL["o01_arriving_events"])
