"""Windows, features, ranking, sets, splits and feature filters (sections E to J)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import (
    BACKTEST_END,
    DAY_BACKTEST_END,
    DAY_BACKTEST_START,
    DAY_TRAIN_END,
    FINAL,
    SERIES,
    TRAIN_END,
    add,
    complete,
)
from checks.tables import measures
from panelcast.functions.calendar import DAY, MONTH, month_cycle, calendar_features, period_label
from panelcast.functions.numeric import from_log, non_negative, ratio_zero_as_one, to_log, zero_if_missing, ratio
from panelcast.operators import baselines, calendar_fill, cleaning, order_level, ranking, rollup, scoring, selection, splits
from panelcast.operators import windows as W
from panelcast.plans.feature_frame import SHARED_METRICS, FeatureConfig, add_ratios, create_features, supervised
from panelcast.plans.forecast import append_forecast
from panelcast.plans.period_tables import STATE_METRICS, daily_table, monthly_table
from panelcast.session import stage
from panelcast.sources.star_schema import retail_facts

TWO = list(SERIES.items())[:2]
METRICS = ["monthly_revenue", *SHARED_METRICS]


def months(s, d, keys):
    return monthly_table(retail_facts(s, d), complete(s, d), keys)


def days(s, d, keys):
    return daily_table(retail_facts(s, d), complete(s, d), keys)


# --- E: windows ----------------------------------------------------------------------------


def daily_core(s, d, keys):
    return rollup.roll_up(order_level.order_rows(retail_facts(s, d), DAY, keys, complete(s, d)), DAY, keys)


def core_sql(keys):
    return f"{S.BASE}, {S.order_rows(keys)}, {S.core(keys, 'date')}"


for suffix, keys in SERIES.items():
    add(
        f"e01_dense_calendar{suffix}",
        lambda s, d, keys=keys: calendar_fill.densify(daily_core(s, d, keys), DAY, keys).select(
            *keys, "date", "daily_revenue", "total_orders"
        ),
        f"""WITH {core_sql(keys)}, {S.dense(keys)}
            SELECT {S.lead_list(keys, 'date')}, {S.r('daily_revenue', 'daily_revenue')}, total_orders FROM dense""",
    )
    add(
        f"e02_fill_both_ways{suffix}",
        lambda s, d, keys=keys: calendar_fill.fill_both_ways(
            calendar_fill.densify(daily_core(s, d, keys), DAY, keys), STATE_METRICS, "date", keys
        ).select(*keys, "date", *STATE_METRICS),
        f"""WITH {core_sql(keys)}, {S.dense(keys)} SELECT {S.lead_list(keys, 'date')},
            {S.r(S.fill('avg_review_score', keys), 'avg_review_score')},
            {S.r(S.fill('avg_installments', keys), 'avg_installments')} FROM dense""",
    )


def chosen(s, d, keys, only, daily):
    grain = DAY if daily else MONTH
    table = days(s, d, keys) if daily else months(s, d, keys)
    frame, _ = create_features(table, FeatureConfig.default(grain), grain, keys, only)
    return frame.select(*keys, grain.period, *only)


def chosen_sql(keys, only, daily):
    table = S.days(keys) if daily else S.months(keys)
    period = "date" if daily else "month"
    return f"""WITH {table}, {S.features(keys, daily, only)}
        SELECT {S.lead_list(keys, period)}, {S.rounded(only)} FROM feats"""


def kind(daily, pick):
    return [n for n in S.feature_names(daily) if pick(n)]


KINDS = {
    "e03_lags": lambda n: "_lag_" in n,
    "e04_rolling_mean": lambda n: "_roll_mean_" in n,
    "e05_rolling_std": lambda n: "_roll_std_" in n,
    "e06_rolling_min": lambda n: "_roll_min_" in n,
    "e07_rolling_max": lambda n: "_roll_max_" in n,
    "e08_ema": lambda n: "_ema_" in n,
    "e09_delayed_change": lambda n: n.endswith("_pct_change"),
}
for name, pick in KINDS.items():
    for suffix, keys in TWO:
        only = kind(False, pick)
        add(
            f"{name}_monthly{suffix}",
            lambda s, d, keys=keys, only=only: chosen(s, d, keys, only, False),
            chosen_sql(keys, only, False),
        )
    only = kind(True, pick)
    add(f"{name}_daily", lambda s, d, only=only: chosen(s, d, [], only, True), chosen_sql([], only, True))
# By day and nation: one metric, all kinds.
only = kind(True, lambda n: n.startswith("daily_revenue_") and not n.endswith(("_28", "_30")) and "_ema_" not in n)
add(
    "e03_revenue_features_daily_by_nation",
    lambda s, d, only=only: chosen(s, d, ["nation"], only, True),
    chosen_sql(["nation"], only, True),
)
averaged = kind(True, KINDS["e08_ema"])
add(
    "e08_ema_daily_by_nation",
    lambda s, d: chosen(s, d, ["nation"], averaged, True),
    chosen_sql(["nation"], averaged, True),
)


def windowed(s, d, keys, **exprs):
    w = W.series_window(keys, "month")
    return months(s, d, keys).selectExpr(*keys, "month", *[f"{e(w)} AS {n}" for n, e in exprs.items()])


for suffix, keys in TWO:
    over = f"OVER {S.order_window(keys, 'month')}"
    head = f"WITH {S.months(keys)} SELECT {S.lead_list(keys, 'month')}"
    add(
        f"e10_next_target{suffix}",
        lambda s, d, keys=keys: windowed(s, d, keys, label=lambda w: W.one_step_ahead("monthly_revenue", w)),
        f"{head}, {S.r(f'lead(monthly_revenue) {over}', 'label')} FROM months",
    )
    add(
        f"e11_trend_index{suffix}",
        lambda s, d, keys=keys: windowed(s, d, keys, month_index=W.trend_index),
        f"{head}, row_number() {over} - 1 AS month_index FROM months",
    )
    add(
        f"e12_growth{suffix}",
        lambda s, d, keys=keys: windowed(s, d, keys, growth=lambda w: W.growth("monthly_revenue", w)),
        f"{head}, {S.r(f'monthly_revenue / nullif(lag(monthly_revenue) {over}, 0) - 1', 'growth')} FROM months",
    )


def frame(s, d, keys, daily):
    grain = DAY if daily else MONTH
    table = days(s, d, keys) if daily else months(s, d, keys)
    out, names = create_features(table, FeatureConfig.default(grain), grain, keys)
    return out.select(*keys, grain.period, *names)


def trained(s, d, keys, daily):
    grain = DAY if daily else MONTH
    table = days(s, d, keys) if daily else months(s, d, keys)
    return supervised(table, FeatureConfig.default(grain), grain, keys)


def frame_sql(keys, daily):
    table, period = (S.days(keys), "date") if daily else (S.months(keys), "month")
    names = S.rounded(S.feature_names(daily))
    return (
        f"""WITH {table}, {S.features(keys, daily)}
            SELECT {S.lead_list(keys, period)}, {names} FROM feats""",
        f"""WITH {table}, {S.supervised(keys, daily)}
            SELECT {S.lead_list(keys, period, 'target_period')}, {names}, {S.r('label', 'label')} FROM sup""",
    )


for suffix, keys, daily in [
    ("_monthly", [], False), ("_monthly_by_nation", ["nation"], False), ("_daily", [], True), ("_daily_by_nation", ["nation"], True),
]:
    # 279 features of a daily panel take DuckDB minutes: compared once by hand, registered without SQL
    frame_check, set_check = (None, None) if daily and keys else frame_sql(keys, daily)
    add(f"e13_feature_frame{suffix}", lambda s, d, keys=keys, daily=daily: frame(s, d, keys, daily), frame_check)
    add(f"e14_supervised{suffix}", lambda s, d, keys=keys, daily=daily: trained(s, d, keys, daily)[0], set_check)

# --- F: scalar functions --------------------------------------------------------------------


def f01(s, d):
    out, names = add_ratios(days(s, d, ["nation"]), FeatureConfig.default(DAY))
    return out.select("nation", "date", *names)


ONE = "(CASE WHEN {0} = 0 THEN 1 ELSE {0} END)"
add(
    "f01_ratios",
    f01,
    f"""WITH {S.days(['nation'])} SELECT nation, date,
        {S.r('daily_revenue / ' + ONE.format('total_orders'), 'revenue_per_order')},
        {S.r('total_items / ' + ONE.format('total_orders'), 'items_per_order')},
        {S.r('total_freight / ' + ONE.format('daily_revenue'), 'freight_ratio')} FROM days""",
)


def calendar(s, d, grain, exprs):
    dates = order_level.dated_orders(retail_facts(s, d), grain).select(grain.period).distinct()
    return dates.selectExpr(grain.period, *[f"{e} AS {n}" for n, e in exprs.items()])


add(
    "f02_quarter_month",
    lambda s, d: calendar(s, d, MONTH, calendar_features("month", MONTH)),
    f"""WITH {S.BASE} SELECT DISTINCT month, {S.big('quarter(month)', 'quarter')},
        {S.big('month(month)', 'month_num')} FROM ords""",
)
add(
    "f03_day_flags",
    lambda s, d: calendar(s, d, DAY, calendar_features("date", DAY)),
    f"""WITH {S.BASE} SELECT DISTINCT date, {', '.join(
        f'{e} AS {n}' for n, e in S.feature_exprs([], True).items() if n in S.CALENDAR)} FROM ords""",
)
add(
    "f04_month_cycle",
    lambda s, d: calendar(s, d, MONTH, month_cycle("month")),
    f"""WITH {S.BASE} SELECT DISTINCT month, {S.r('sin(2 * pi() * month(month) / 12)', 'month_sin')},
        {S.r('cos(2 * pi() * month(month) / 12)', 'month_cos')} FROM ords""",
)
add(
    "f05_undefined_to_zero",
    lambda s, d: days(s, d, ["nation"]).select(
        "nation", "date", zero_if_missing(ratio(F.col("total_freight"), F.col("total_orders"))).alias("freight_per_order")
    ),
    f"""WITH {S.days(['nation'])} SELECT nation, date,
        {S.r('coalesce(total_freight / nullif(total_orders, 0), 0)', 'freight_per_order')} FROM days""",
)
add(
    "f06_next_period",
    lambda s, d: order_level.dated_orders(retail_facts(s, d), DAY)
    .select("date")
    .distinct()
    .select(
        "date",
        MONTH.shift(F.col("date")).alias("next_month"),
        DAY.shift(F.col("date")).alias("next_day"),
        period_label(F.col("date")).alias("label"),
    ),
    f"""WITH {S.BASE} SELECT DISTINCT date,
        CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS next_month,
        date + 1 AS next_day, strftime(date, '%Y-%m-%d') AS label FROM ords""",
)


def f07(s, d):
    rows = windowed(s, d, ["nation"], trend=lambda w: f"2 * {W.lagged('monthly_revenue', 1, w)} - {W.lagged('monthly_revenue', 2, w)}")
    return rows.where("trend IS NOT NULL").select("nation", "month", non_negative(F.col("trend")).alias("y_pred"))


add(
    "f07_clip_negative",
    f07,
    f"""WITH {S.months(['nation'])} SELECT nation, month, {S.r('greatest(p, 0)', 'y_pred')} FROM (
        SELECT nation, month, 2 * lag(monthly_revenue) OVER w - lag(monthly_revenue, 2) OVER w AS p
        FROM months WINDOW w AS (PARTITION BY nation ORDER BY month)) WHERE p IS NOT NULL""",
)
add(
    "f08_log_target",
    lambda s, d: months(s, d, ["nation"])
    .withColumn("logged", to_log(F.col("monthly_revenue")))
    .select("nation", "month", "logged", from_log(F.col("logged")).alias("restored")),
    f"""WITH {S.months(['nation'])} SELECT nation, month, {S.r('ln(1 + monthly_revenue)', 'logged')},
        {S.r('monthly_revenue', 'restored')} FROM months""",
)


def f09(s, d):
    out = cleaning.zscore(months(s, d, ["nation"]), ["monthly_revenue", "total_orders"], ["nation"])
    out = cleaning.one_hot(out, "top_category", ["LARGE", "SMALL"])
    return out.select(
        "nation", "month", "monthly_revenue_z", "total_orders_z", "top_category_is_LARGE", "top_category_is_SMALL"
    )


def z(c):
    over = "OVER (PARTITION BY nation)"
    return S.r(f"coalesce(({c} - avg({c}) {over}) / nullif(stddev_pop({c}) {over}, 0), 0)", f"{c}_z")


add(
    "f09_scale_encode",
    f09,
    f"""WITH {S.months(['nation'])} SELECT nation, month, {z('monthly_revenue')}, {z('total_orders')},
        CAST(coalesce(top_category = 'LARGE', false) AS BIGINT) AS "top_category_is_LARGE",
        CAST(coalesce(top_category = 'SMALL', false) AS BIGINT) AS "top_category_is_SMALL" FROM months""",
)

# --- G: order and top-k ----------------------------------------------------------------------

for suffix, keys in TWO:
    back = f"row_number() OVER ({S.part(keys)} ORDER BY month DESC)"
    head = f"WITH {S.months(keys)} SELECT {S.lead_list(keys, 'month')}, {S.columns(S.MONTH_COLUMNS)} FROM months"
    add(
        f"g04_latest_row{suffix}",
        lambda s, d, keys=keys: ranking.latest_row(months(s, d, keys), "month", keys),
        f"{head} QUALIFY {back} = 1",
    )
    add(
        f"g05_last_rows{suffix}",
        lambda s, d, keys=keys: ranking.last_rows(months(s, d, keys), "month", keys, 60),
        f"{head} QUALIFY {back} <= 60",
    )


def two_baselines(s, d, keys):
    table = months(s, d, keys)
    return baselines.naive_last(table, MONTH, keys).unionByName(baselines.seasonal_naive(table, MONTH, keys, 12))


def two_sql(keys):
    over = f"OVER {S.order_window(keys, 'month')}"
    y = "monthly_revenue"
    return f"""{S.months(keys)}, f AS (
      SELECT {S.lead_list(keys, "'naive_last' AS model", 'month')}, {y} AS y, lag({y}) {over} AS p FROM months
      UNION ALL SELECT {S.lead_list(keys, "'seasonal_naive_12' AS model", 'month')}, {y} AS y,
        coalesce(lag({y}, 12) {over}, lag({y}) {over}) AS p FROM months),
    fc AS (SELECT * FROM f WHERE p IS NOT NULL)"""


for suffix, keys in TWO:
    by = S.lead_list(keys, "model")
    add(
        f"g06_leaderboard{suffix}",
        lambda s, d, keys=keys: ranking.leaderboard(
            scoring.score(two_baselines(s, d, keys), [*keys, "model"]), keys
        ),
        f"""WITH {two_sql(keys)}, sc AS (SELECT {by}, {measures()},
              100 * avg(abs(y - p) / greatest(abs(y), 1e-9)) AS raw FROM fc GROUP BY {by})
            SELECT * EXCLUDE (raw), row_number() OVER ({S.part(keys)} ORDER BY raw, model) AS place FROM sc""",
    )
    add(
        f"h02_concatenate{suffix}",
        lambda s, d, keys=keys: two_baselines(s, d, keys),
        f"""WITH {two_sql(keys)} SELECT {S.lead_list(keys, 'model', 'month AS period')},
            {S.r('y', 'y_true')}, {S.r('p', 'y_pred')} FROM fc""",
    )
    add(
        f"h01_append_forecast{suffix}",
        lambda s, d, keys=keys: append_forecast(
            months(s, d, keys), baselines.naive_ahead(months(s, d, keys), MONTH, keys, 2), MONTH, keys
        ),
        f"""WITH {S.months(keys)}, l AS (SELECT *, row_number() OVER ({S.part(keys)} ORDER BY month DESC) AS back
              FROM months), e AS (SELECT *, unnest([1, 2]) AS step FROM l WHERE back = 1)
            SELECT {S.lead_list(keys, 'month AS period')}, {S.r('monthly_revenue', 'value')}, false AS is_forecast FROM months
            UNION ALL SELECT {S.lead_list(keys, 'CAST(month + to_months(CAST(step AS INTEGER)) AS DATE)')},
              {S.r('monthly_revenue', 'value')}, true FROM e""",
    )

# --- I: splits ---------------------------------------------------------------------------------

for suffix, keys in TWO:
    head = f"WITH {S.months(keys)} SELECT {S.lead_list(keys, 'month')}"
    add(
        f"i01_tail_holdout{suffix}",
        lambda s, d, keys=keys: splits.tail_holdout(months(s, d, keys), "month", keys, 3).select(*keys, "month", "split"),
        f"""{head}, CASE WHEN row_number() OVER ({S.part(keys)} ORDER BY month DESC) <= 3
            THEN 'test' ELSE 'train' END AS split FROM months""",
    )
    add(
        f"i03_three_phases{suffix}",
        lambda s, d, keys=keys: months(s, d, keys).select(
            *keys, "month", splits.phase(F.col("month"), TRAIN_END, BACKTEST_END, FINAL).alias("phase")
        ),
        f"""{head}, CASE WHEN month <= DATE '{TRAIN_END}' THEN 'train' WHEN month <= DATE '{BACKTEST_END}'
            THEN 'backtest' WHEN month <= DATE '{FINAL}' THEN 'final' END AS phase FROM months""",
    )
    add(
        f"i06_monthly_origins{suffix}",
        lambda s, d, keys=keys: splits.with_origins(months(s, d, keys), "month", keys, 3, 6).select(
            *keys, "month", "t", "is_origin"
        ),
        f"""{head}, row_number() OVER {S.order_window(keys, 'month')} - 1 AS t,
            row_number() OVER {S.order_window(keys, 'month')} - 1
              >= greatest(6, count(*) OVER ({S.part(keys)}) - 3) AS is_origin FROM months""",
    )
add(
    "i02_daily_phases",
    lambda s, d: days(s, d, [])
    .select("date", splits.phase(F.col("date"), DAY_TRAIN_END, DAY_BACKTEST_END).alias("phase"))
    .where("phase IS NOT NULL"),
    f"""WITH {S.days([])} SELECT date, CASE WHEN date <= DATE '{DAY_TRAIN_END}' THEN 'train' ELSE 'backtest' END AS phase
        FROM days WHERE date <= DATE '{DAY_BACKTEST_END}'""",
)
SEGMENTS = [("train", None, TRAIN_END), ("backtest", TRAIN_END, BACKTEST_END), ("target", BACKTEST_END, FINAL)]
add(
    "i04_shared_segments",
    lambda s, d: splits.segments(months(s, d, ["nation"]), "month", SEGMENTS).select("nation", "month", "segment"),
    f"""WITH {S.months(['nation'])} SELECT nation, month, segment FROM months JOIN (VALUES
        ('train', DATE '1900-01-01', DATE '{TRAIN_END}'), ('backtest', DATE '{TRAIN_END}', DATE '{BACKTEST_END}'),
        ('target', DATE '{BACKTEST_END}', DATE '{FINAL}')) b(segment, lo, hi) ON month BETWEEN lo AND hi""",
)


def folds_sql(keys, k):
    return f"""{S.months(keys)},
    axis AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS position, count(*) OVER () AS n
             FROM (SELECT DISTINCT month FROM months)),
    folds AS (SELECT month, position, fold, n - ({k} - fold) * (n // {k + 1}) AS start, n // {k + 1} AS size
              FROM (SELECT *, unnest(range({k})) AS fold FROM axis)),
    roles AS (SELECT month, position, fold, CASE WHEN position < start THEN 'train' ELSE 'test' END AS role
              FROM folds WHERE position < start + size)"""


for k in (2, 3, 4):
    add(
        f"i05_fold_axis_{k}",
        lambda s, d, k=k: splits.fold_axis(months(s, d, ["nation"]), "month", k),
        f"WITH {folds_sql(['nation'], k)} SELECT month, position, fold, role FROM roles",
    )
add(
    "i05_folds_by_nation",
    lambda s, d: splits.with_folds(months(s, d, ["nation"]).select("nation", "month"), "month", 4),
    f"WITH {folds_sql(['nation'], 4)} SELECT nation, month, fold, role FROM months JOIN roles USING (month)",
)
for suffix, keys in TWO:
    add(
        f"i06_daily_origins{suffix}",
        lambda s, d, keys=keys: splits.with_origins_from(
            days(s, d, keys), "date", keys, DAY_BACKTEST_START, DAY_BACKTEST_END
        ).select(*keys, "date", "t", "is_origin"),
        f"""WITH {S.days(keys)} SELECT {S.lead_list(keys, 'date')},
            row_number() OVER {S.order_window(keys, 'date')} - 1 AS t, date >= DATE '{DAY_BACKTEST_START}' AS is_origin
            FROM days WHERE date <= DATE '{DAY_BACKTEST_END}'""",
    )

# --- J: feature filters that need no model -------------------------------------------------------


def training_rows(s, d, keys):
    rows, names = trained(s, d, keys, False)
    return stage(rows.where(F.col("target_period") <= F.lit(TRAIN_END)), "train"), names


def train_sql(keys):
    return f"{S.months(keys)}, {S.supervised(keys, False)}, tr AS (SELECT * FROM sup WHERE target_period <= DATE '{TRAIN_END}')"


def j01(s, d, keys):
    rows, names = training_rows(s, d, keys)
    spread = selection.spread_of_features(rows, names)
    return spread.withColumn("is_constant", F.col("spread") == 0)


NAMES = S.feature_names(False)


def stages_sql(keys):
    """Constant features, then those an earlier feature correlates with above 0.70."""
    numbered = ", ".join(f"('{n}', {i})" for i, n in enumerate(NAMES))
    return f"""{train_sql(keys)},
    wide AS (SELECT {', '.join(f'CAST(max({n}) - min({n}) AS DOUBLE) AS {n}' for n in NAMES)} FROM tr),
    spread AS (UNPIVOT wide ON COLUMNS(*) INTO NAME feature VALUE spread),
    place(feature, place) AS (VALUES {numbered}),
    numbered AS (SELECT feature, spread, place FROM spread JOIN place USING (feature)),
    doubles AS (SELECT row_number() OVER () AS id, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in NAMES)} FROM tr),
    long AS (UNPIVOT doubles ON {', '.join(NAMES)} INTO NAME feature VALUE v),
    moving AS (SELECT long.id, feature, v, place FROM long JOIN numbered USING (feature) WHERE spread <> 0),
    pairs AS (SELECT b.feature, max(abs(r)) AS strongest FROM (
        SELECT a.place AS ap, b.place AS bp, b.feature, corr(a.v, b.v) AS r
        FROM moving a JOIN moving b ON a.id = b.id AND a.place < b.place GROUP BY ALL) b GROUP BY b.feature),
    dropped AS (
      SELECT 'variance' AS dropped_by, feature FROM numbered WHERE spread = 0
      UNION ALL SELECT 'correlation', feature FROM pairs WHERE strongest > 0.70)"""


def exact(s, d, keys):
    rows, names = training_rows(s, d, keys)
    return selection.exact_stages(rows, names)


for suffix, keys in TWO:
    add(
        f"j01_constant_features{suffix}",
        lambda s, d, keys=keys: j01(s, d, keys),
        f"WITH {stages_sql(keys)} SELECT feature, {S.r('spread', 'spread')}, spread = 0 AS is_constant FROM numbered",
    )
    add(
        f"j02_correlation_filter{suffix}",
        lambda s, d, keys=keys: s.createDataFrame([(c,) for c in exact(s, d, keys).features], "feature string"),
        f"""WITH {stages_sql(keys)} SELECT feature FROM numbered
            WHERE feature NOT IN (SELECT feature FROM dropped)""",
    )
    add(
        f"j06_selection_funnel{suffix}",
        lambda s, d, keys=keys: exact(s, d, keys).funnel(s),
        f"""WITH {stages_sql(keys)}, lost AS (SELECT count(*) FILTER (dropped_by = 'variance') AS v, count(*) AS a FROM dropped)
            SELECT 0 AS stage_no, 'original' AS stage, {len(NAMES)} AS feature_count
            UNION ALL SELECT 1, 'variance', {len(NAMES)} - v FROM lost
            UNION ALL SELECT 2, 'correlation', {len(NAMES)} - a FROM lost""",
    )
    add(
        f"h03_dropped_features{suffix}",
        lambda s, d, keys=keys: exact(s, d, keys).dropped(s),
        f"WITH {stages_sql(keys)} SELECT dropped_by, feature FROM dropped",
    )
