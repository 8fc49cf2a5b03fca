"""Sources, projections, joins and aggregations (sections A to D)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import BACKTEST_START as NEXT
from checks.registry import FINAL, SERIES, SQL, TRAIN_END, add, complete
from panelcast.functions.calendar import DAY, MONTH, Bounds, Grain, day_table_columns, month_table_columns
from panelcast.operators import baselines, calendar_fill, cleaning, order_level, ranges, ranking, rollup, scoring
from panelcast.operators.selection import correlation_matrix, correlation_table
from panelcast.plans.feature_frame import SHARED_METRICS, FeatureConfig, create_features, supervised
from panelcast.plans.period_tables import STATE_METRICS, VOLUME_METRICS, daily_table, monthly_table
from panelcast.session import stage, staging_path
from panelcast.sources import storage
from panelcast.sources.facts import read_tables, table_sizes
from panelcast.sources.layout import bucketed
from panelcast.sources.star_schema import retail_facts

def categories(s, d, keys):
    f = retail_facts(s, d)
    return rollup.category_counts(rollup.sightings(f, MONTH, keys, complete(s, d)), f, MONTH, keys, complete(s, d))


def newcomers(s, d, keys):
    f = retail_facts(s, d)
    return rollup.new_entities(rollup.sightings(f, MONTH, keys, complete(s, d)), f, MONTH, keys)


# --- A: sources and sinks -----------------------------------------------------------

TABLES = ["orders", "lineitem", "customer", "part", "supplier", "nation", "region", "events"]
SIZES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)

add("a01_raw_tables", lambda s, d: table_sizes(read_tables(s, d, TABLES)), SIZES)


def a02(s, d):
    folder = staging_path(s, "raw")
    raw = read_tables(s, d, TABLES)
    storage.materialise_once(raw, folder)
    return table_sizes(storage.materialise_once(raw, folder))


add("a02_materialise_once", a02, SIZES)


def a03(s, d):
    path = staging_path(s, "months")
    storage.write_periods(monthly_table(retail_facts(s, d), complete(s, d), ["nation"]), path, "month")
    return storage.read_periods(s, path)[0]


add(
    "a03_period_round_trip",
    a03,
    f"WITH {S.months(['nation'])} SELECT nation, month, {S.columns(S.MONTH_COLUMNS)} FROM months",
)


def a04(s, d):
    path = staging_path(s, "days")
    storage.write_periods(daily_table(retail_facts(s, d), complete(s, d)), path, "date")
    table, period = storage.read_periods(s, path)
    return table.withColumn("period_column", F.lit(period))


add(
    "a04_read_periods",
    a04,
    f"WITH {S.days([])} SELECT date, {S.columns(S.DAY_COLUMNS)}, 'date' AS period_column FROM days",
)


def a05(s, d):
    rows, names = supervised(monthly_table(retail_facts(s, d), complete(s, d)), FeatureConfig.default(MONTH), MONTH, [])
    path = staging_path(s, "supervised")
    storage.write_table(rows, path)
    return s.read.parquet(path)


add(
    "a05_supervised_round_trip",
    a05,
    f"""WITH {S.months([])}, {S.supervised([], False)}
    SELECT month, target_period, {S.rounded(S.feature_names(False))}, {S.r('label', 'label')} FROM sup""",
)

# --- B: projections, filters, predicates ---------------------------------------------


def texts(s, d):
    """Event times as text, unusable for one event type."""
    events = read_tables(s, d, ["events"])["events"]
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("ts").cast("string"))
    return events.select("event_type", text.alias("ts"))


def b01(s, d):
    return cleaning.coerce_timestamps(texts(s, d), ["ts", "absent"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("ts").alias("parsed"),
        F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"),
    )


TEXTS = "SELECT event_type, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(ts AS VARCHAR) END AS txt FROM events"
add(
    "b01_parse_timestamps",
    b01,
    f"""SELECT event_type, count(*) AS row_count, count(ts) AS parsed,
        CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
        FROM (SELECT event_type, try_cast(txt AS TIMESTAMP) AS ts FROM ({TEXTS})) GROUP BY event_type""",
)
add(
    "b02_drop_undated",
    lambda s, d: cleaning.drop_undated(cleaning.coerce_timestamps(texts(s, d), ["ts"]), "ts")
    .groupBy("event_type")
    .agg(F.count(F.lit(1)).alias("row_count")),
    f"""SELECT event_type, count(*) AS row_count FROM ({TEXTS})
        WHERE try_cast(txt AS TIMESTAMP) IS NOT NULL GROUP BY event_type""",
)


def count_by(period, df):
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("row_count"))


add(
    "b03_month_bucket",
    lambda s, d: count_by("month", order_level.dated_orders(retail_facts(s, d), MONTH)),
    f"WITH {S.BASE} SELECT month, count(*) AS row_count FROM ords GROUP BY month",
)
add(
    "b04_day_bucket",
    lambda s, d: count_by(
        "date", read_tables(s, d, ["events"])["events"].select(DAY.bucket(F.col("ts")).alias("date"))
    ),
    "SELECT CAST(ts AS DATE) AS date, count(*) AS row_count FROM events GROUP BY 1",
)
add(
    "b05_complete_months",
    lambda s, d: count_by("month", order_level.dated_orders(retail_facts(s, d), MONTH, complete(s, d))),
    f"WITH {S.BASE} SELECT month, count(*) AS row_count FROM ords WHERE month < {S.CUT} GROUP BY month",
)
add(
    "b05_complete_days",
    lambda s, d: count_by(
        "date",
        order_level.dated_orders(
            retail_facts(s, d), DAY, Bounds.through(dt.date(1997, 1, 1), dt.date(2001, 7, 22))
        ),
    ),
    f"""WITH {S.BASE} SELECT date, count(*) AS row_count FROM ords
        WHERE date >= DATE '1997-01-01' AND date <= DATE '2001-07-22' GROUP BY date""",
)
add(
    "b06_month_calendar",
    lambda s, d: order_level.dated_orders(retail_facts(s, d), MONTH)
    .select("month")
    .distinct()
    .withColumns(month_table_columns(F.col("month"))),
    f"""WITH {S.BASE} SELECT DISTINCT month, CAST(year(month) AS BIGINT) AS year,
        CAST(month(month) AS BIGINT) AS month_num FROM ords""",
)
add(
    "b06_day_calendar",
    lambda s, d: order_level.dated_orders(retail_facts(s, d), DAY)
    .select("date")
    .distinct()
    .withColumns(day_table_columns(F.col("date"))),
    f"""WITH {S.BASE} SELECT DISTINCT date, CAST(year(date) AS BIGINT) AS year,
        CAST(month(date) AS BIGINT) AS month, CAST(day(date) AS BIGINT) AS day,
        CAST(isodow(date) - 1 AS BIGINT) AS day_of_week FROM ords""",
)
add(
    "b07_prune_rename",
    lambda s, d: retail_facts(s, d)
    .items.select("product_id", "freight_value")
    .withColumnRenamed("freight_value", "freight")
    .groupBy("product_id")
    .agg(F.sum("freight").alias("freight")),
    f"WITH {S.BASE} SELECT product_id, {S.r('sum(freight_value)', 'freight')} FROM lines GROUP BY product_id",
)
for suffix, keys in list(SERIES.items())[:2]:
    add(
        f"b08_as_of{suffix}",
        lambda s, d, keys=keys: cleaning.as_of(monthly_table(retail_facts(s, d), complete(s, d), keys), "month", TRAIN_END),
        f"""WITH {S.months(keys)} SELECT {S.lead_list(keys, 'month')}, {S.columns(S.MONTH_COLUMNS)}
            FROM months WHERE month <= DATE '{TRAIN_END}'""",
    )


def b09(s, d, keys):
    table = monthly_table(retail_facts(s, d), complete(s, d), keys)
    cfg = FeatureConfig.default(MONTH)
    frame, names = create_features(table, cfg, MONTH, keys)
    return frame.na.drop(subset=[*names, cfg.target_col]).select(*keys, "month", "label")


for suffix, keys in list(SERIES.items())[:2]:
    add(
        f"b09_drop_incomplete{suffix}",
        lambda s, d, keys=keys: b09(s, d, keys),
        f"""WITH {S.months(keys)}, {S.supervised(keys, False)}
            SELECT {S.lead_list(keys, 'month')}, {S.r('label', 'label')} FROM sup""",
    )

SHOCKS = [(dt.date(1998, 5, 21), dt.date(1998, 5, 31)), (dt.date(2000, 2, 1), dt.date(2000, 2, 3))]
add(
    "b10_outside_shocks",
    lambda s, d: baselines.naive_last(daily_table(retail_facts(s, d), complete(s, d)), DAY, []).where(
        cleaning.outside(F.col("period"), SHOCKS)
    ),
    f"""WITH {S.days([])} SELECT 'naive_last' AS model, date AS period, {S.r('daily_revenue', 'y_true')},
        {S.r('p', 'y_pred')}
        FROM (SELECT *, lag(daily_revenue) OVER (ORDER BY date) AS p FROM days)
        WHERE p IS NOT NULL AND date NOT BETWEEN DATE '1998-05-21' AND DATE '1998-05-31'
          AND date NOT BETWEEN DATE '2000-02-01' AND DATE '2000-02-03'""",
)
add(
    "b11_pick_month",
    lambda s, d: cleaning.pick_month(daily_table(retail_facts(s, d), complete(s, d), ["nation"]), "date", FINAL),
    f"""WITH {S.days(['nation'])} SELECT nation, date, {S.columns(S.DAY_COLUMNS)} FROM days
        WHERE date_trunc('month', date) = DATE '{FINAL}'""",
)
add(
    "b12_audit",
    lambda s, d: cleaning.audit(order_level.dated_orders(retail_facts(s, d), DAY), "date"),
    f"""WITH {S.BASE} SELECT count(*) AS row_count, 4 AS column_count, min(date) AS first_period,
        max(date) AS last_period FROM ords""",
)


def b13(s, d):
    cleaned = cleaning.clean_trailing(
        rollup.roll_up(order_level.order_rows(retail_facts(s, d), MONTH, ["nation"], complete(s, d)), MONTH, ["nation"]),
        ["monthly_revenue", "avg_review_score"],
        "month",
        ["nation"],
    )
    return cleaned.select("nation", "month", "monthly_revenue", "avg_review_score")


def clipped(c):
    q = "quantile_cont({c}, {p}) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    low, high = q.format(c=c, p=0.05), q.format(c=c, p=0.95)
    return f"CASE WHEN {low} IS NULL THEN {c} ELSE least(greatest({c}, {low}), {high}) END"


add(
    "b13_clean_trailing",
    b13,
    f"""WITH {S.BASE}, {S.order_rows(['nation'])}, {S.core(['nation'], 'month')},
    filled AS (SELECT nation, month, monthly_revenue,
      last_value(avg_review_score IGNORE NULLS) OVER (PARTITION BY nation ORDER BY month
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg_review_score FROM core)
    SELECT nation, month, {S.r(clipped('monthly_revenue'), 'monthly_revenue')},
           {S.r(clipped('avg_review_score'), 'avg_review_score')} FROM filled""",
)

# --- C: joins ---------------------------------------------------------------------------


def c01(s, d, split):
    f = retail_facts(s, d)
    if split:  # payments, reviews and items as three tables
        f = type(f)(f.orders, f.payments, f.reviews, f.items, f.customers, f.products)
    orders = order_level.dated_orders(f, MONTH).join(order_level.order_measures(f), "order_id", "left")
    return orders.select(
        "order_id", "customer_id", "month", "payment_value", "payment_installments", "review_score",
        F.coalesce("total_items", F.lit(0)).alias("total_items"), "total_freight",
    )


C01 = f"""WITH {S.BASE}, p AS (SELECT order_id, sum(payment_value) AS payment_value,
      avg(payment_installments) AS payment_installments FROM lines GROUP BY order_id),
    v AS (SELECT order_id, avg(review_score) AS review_score FROM lines
          WHERE review_score IS NOT NULL GROUP BY order_id),
    i AS (SELECT order_id, count(order_item_id) AS total_items, sum(freight_value) AS total_freight
          FROM lines GROUP BY order_id)
    SELECT order_id, customer_id, month, {S.r('payment_value', 'payment_value')},
      {S.r('payment_installments', 'payment_installments')}, {S.r('review_score', 'review_score')},
      coalesce(total_items, 0) AS total_items, {S.r('total_freight', 'total_freight')}
    FROM ords LEFT JOIN p USING (order_id) LEFT JOIN v USING (order_id) LEFT JOIN i USING (order_id)"""
add("c01_orders_with_measures", lambda s, d: c01(s, d, False), C01)
add("c01_orders_with_three_tables", lambda s, d: c01(s, d, True), C01)


def c02(s, d):
    f = retail_facts(s, d)
    return order_level.with_customers(order_level.dated_orders(f, MONTH), f, ["nation"]).select(
        "order_id", "customer_id", "customer_unique_id", "nation", "month"
    )


add(
    "c02_orders_with_customers",
    c02,
    f"""WITH {S.BASE} SELECT order_id, customer_id, customer_unique_id, nation, month
        FROM ords LEFT JOIN custs USING (customer_id)""",
)


def c03(s, d):
    f = retail_facts(s, d)
    per_product = f.items.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_product.join(f.products, "product_id", "left")
        .groupBy("product_category_name", "brand")
        .agg(F.sum("n").alias("item_count"))
    )


add(
    "c03_items_with_products",
    c03,
    f"""WITH {S.BASE} SELECT product_category_name, brand, count(*) AS item_count
        FROM lines LEFT JOIN prods USING (product_id) GROUP BY ALL""",
)
add(
    "c04_items_with_periods",
    lambda s, d: order_level.dated_items(retail_facts(s, d), MONTH, [], complete(s, d))
    .groupBy("month", "product_id")
    .agg(F.count(F.lit(1)).alias("item_count")),
    f"""WITH {S.BASE} SELECT month, product_id, count(*) AS item_count
        FROM lines JOIN ords USING (order_id) WHERE month < {S.CUT} GROUP BY ALL""",
)


def c05(s, d, keys):
    f = retail_facts(s, d)
    core = rollup.roll_up(order_level.order_rows(f, MONTH, keys, complete(s, d)), MONTH, keys)
    fresh = newcomers(s, d, keys)
    return core.join(fresh, [*keys, "month"], "left").select(
        *keys, "month", "total_orders", F.coalesce("new_sellers", F.lit(0)).cast("bigint").alias("new_sellers")
    )


for suffix, keys in list(SERIES.items())[:2]:
    add(
        f"c05_side_metrics{suffix}",
        lambda s, d, keys=keys: c05(s, d, keys),
        f"WITH {S.months(keys)} SELECT {S.lead_list(keys, 'month', 'total_orders', 'new_sellers')} FROM months",
    )


def july(s, d, keys):
    """Actual days of the last month against a forecast that repeats the last week."""
    days = daily_table(retail_facts(s, d), complete(s, d), keys)
    known = cleaning.as_of(days, "date", dt.date(2001, 6, 30))
    ahead = baselines.seasonal_ahead(known, DAY, keys, 35, 7)
    forecast = ahead.select(*keys, F.col("period").alias("date"), F.col("y_pred").alias("daily_revenue"))
    return scoring.compare(cleaning.pick_month(days, "date", FINAL), forecast, [*keys, "date"], "daily_revenue")


def july_sql(keys):
    on = S.lead_list(keys, "date")
    same = " AND ".join([*[f"e.{k} = h.{k}" for k in keys], "h.back = 7 - ((step - 1) % 7)"])
    return f"""{S.days(keys).replace('days AS (', 'days AS MATERIALIZED (')},
    hist AS MATERIALIZED (SELECT *, row_number() OVER ({S.part(keys)} ORDER BY date DESC) AS back
             FROM days WHERE date <= DATE '2001-06-30'),
    ends AS (SELECT {S.lead_list(keys, 'date AS last', 'daily_revenue AS v')},
             unnest(generate_series(1, 35)) AS step FROM hist WHERE back = 1),
    ahead AS (SELECT {S.lead_list([f'e.{k}' for k in keys], 'e.last + CAST(step AS INTEGER) AS date')},
              coalesce(h.daily_revenue, e.v) AS p FROM ends e LEFT JOIN hist h ON {same}),
    real AS (SELECT {on}, daily_revenue AS a FROM days WHERE date_trunc('month', date) = DATE '{FINAL}'),
    both_ AS (SELECT {on}, a, p FROM real FULL JOIN ahead USING ({on}))"""


for suffix, keys in list(SERIES.items())[:2]:
    add(
        f"c07_compare{suffix}",
        lambda s, d, keys=keys: july(s, d, keys),
        f"""WITH {july_sql(keys)} SELECT {S.lead_list(keys, 'date')}, {S.r('a', 'daily_revenue_real')},
            {S.r('p', 'daily_revenue_pred')} FROM both_""",
    )
    add(
        f"c07_compare_totals{suffix}",
        lambda s, d, keys=keys: scoring.compare_totals(july(s, d, keys), "daily_revenue", keys),
        f"""WITH {july_sql(keys)} SELECT {S.lead_list(keys, '')}
            {S.r('coalesce(sum(a), 0)', 'total_real')}, {S.r('coalesce(sum(p), 0)', 'total_pred')},
            {S.r('avg(abs(a - p) / nullif(a, 0)) * 100', 'mape')},
            {S.r('coalesce(sum(p), 0) - coalesce(sum(a), 0)', 'diff')}
            FROM both_ {'GROUP BY ' + ', '.join(keys) if keys else ''}""",
    )


def c08(s, d):
    f = retail_facts(s, d)
    july = Bounds(FINAL, complete(s, d).before).keep(f.orders, order_level.ORDER_TS)
    return july.join(order_level.payments_per_order(order_level.within(f, july).payments), "order_id").agg(
        F.sum("payment_value").alias("total"),
        F.to_date(F.max(order_level.ORDER_TS)).alias("last_day"),
    )


add(
    "c08_reconcile_month",
    c08,
    f"""WITH {S.BASE} SELECT {S.r('sum(payment_value)', 'total')}, max(date) AS last_day
        FROM ords JOIN lines USING (order_id) WHERE month = DATE '{FINAL}'""",
)

# --- D: aggregations -------------------------------------------------------------------

add(
    "d01_payments_per_order",
    lambda s, d: order_level.payments_per_order(retail_facts(s, d).payments),
    f"""WITH {S.BASE} SELECT order_id, {S.r('sum(payment_value)', 'payment_value')},
        {S.r('avg(payment_installments)', 'payment_installments')} FROM lines GROUP BY order_id""",
)
add(
    "d02_reviews_per_order",
    lambda s, d: order_level.reviews_per_order(retail_facts(s, d).reviews),
    f"""WITH {S.BASE} SELECT order_id, {S.r('avg(review_score)', 'review_score')} FROM lines
        WHERE review_score IS NOT NULL GROUP BY order_id""",
)
add(
    "d03_items_per_order",
    lambda s, d: order_level.items_per_order(retail_facts(s, d).items),
    f"""WITH {S.BASE} SELECT order_id, count(order_item_id) AS total_items,
        {S.r('sum(freight_value)', 'total_freight')} FROM lines GROUP BY order_id""",
)

for suffix, keys in SERIES.items():
    on = S.lead_list(keys, "month")
    core_columns = [c for c in S.MONTH_COLUMNS if c not in ("top_category", "new_sellers", "year", "month_num")]
    add(
        f"d04_monthly_roll_up{suffix}",
        lambda s, d, keys=keys: rollup.roll_up(
            order_level.order_rows(retail_facts(s, d), MONTH, keys, complete(s, d)), MONTH, keys
        ),
        f"WITH {S.BASE}, {S.order_rows(keys)}, {S.core(keys, 'month')} SELECT {on}, {S.columns(core_columns)} FROM core",
    )
    day_columns = [c for c in S.DAY_COLUMNS if c not in ("year", "month", "day", "day_of_week")]
    add(
        f"d05_daily_roll_up{suffix}",
        lambda s, d, keys=keys: rollup.roll_up(
            order_level.order_rows(retail_facts(s, d), DAY, keys, complete(s, d)), DAY, keys
        ),
        f"""WITH {S.BASE}, {S.order_rows(keys)}, {S.core(keys, 'date')}
            SELECT {S.lead_list(keys, 'date')}, {S.columns(day_columns)} FROM core""",
    )
    add(
        f"d06_top_category{suffix}",
        lambda s, d, keys=keys: rollup.top_category(
            categories(s, d, keys), [*keys, "month"]
        ),
        f"WITH {S.BASE}, {S.items(keys)} SELECT {on}, top_category FROM tops",
    )
    add(
        f"d07_new_entities{suffix}",
        lambda s, d, keys=keys: newcomers(s, d, keys),
        f"WITH {S.BASE}, {S.items(keys)} SELECT {on}, new_sellers FROM fresh",
    )
    add(
        f"d11_monthly_table{suffix}",
        lambda s, d, keys=keys: monthly_table(retail_facts(s, d), complete(s, d), keys),
        f"WITH {S.months(keys)} SELECT {on}, {S.columns(S.MONTH_COLUMNS)} FROM months",
    )
    add(
        f"d12_daily_table{suffix}",
        lambda s, d, keys=keys: daily_table(retail_facts(s, d), complete(s, d), keys),
        f"WITH {S.days(keys)} SELECT {S.lead_list(keys, 'date')}, {S.columns(S.DAY_COLUMNS)} FROM days",
    )

for suffix, keys in list(SERIES.items())[:2]:
    on = S.lead_list(keys, "month")
    add(
        f"g02_top_per_series{suffix}",
        lambda s, d, keys=keys: rollup.top_category(
            categories(s, d, keys).groupBy(*keys, "product_category_name").agg(F.sum("item_count").alias("item_count")),
            keys,
        ),
        f"""WITH {S.BASE}, {S.items(keys)}, n AS (SELECT {S.lead_list(keys, 'product_category_name')},
              sum(item_count) AS n FROM cats GROUP BY ALL)
            SELECT {S.lead_list(keys, 'product_category_name AS top_category')} FROM n
            QUALIFY row_number() OVER ({S.part(keys)} ORDER BY n DESC, product_category_name) = 1""",
    )
    add(
        f"d08_distinct_customers{suffix}",
        lambda s, d, keys=keys: rollup.distinct_per_group(
            order_level.with_customers(
                order_level.dated_orders(retail_facts(s, d), MONTH), retail_facts(s, d), keys
            ),
            [*keys, "month"],
            "customer_unique_id",
            "unique_customers",
        ),
        f"""WITH {S.BASE} SELECT {on}, count(DISTINCT customer_unique_id) AS unique_customers
            FROM ords LEFT JOIN custs USING (customer_id) GROUP BY {on}""",
    )


def d09(s, d):
    rows = order_level.order_rows(retail_facts(s, d), DAY, ["nation"], complete(s, d))
    filled = rollup.impute_median(rollup.roll_up(rows, DAY, ["nation"]), STATE_METRICS, ["nation"])
    return filled.select("nation", "date", *STATE_METRICS)


add(
    "d09_median_imputation",
    d09,
    f"""WITH {S.BASE}, {S.order_rows(['nation'])}, {S.core(['nation'], 'date')} SELECT nation, date,
        {S.r('coalesce(avg_review_score, median(avg_review_score) OVER (PARTITION BY nation))', 'avg_review_score')},
        {S.r('coalesce(avg_installments, median(avg_installments) OVER (PARTITION BY nation))', 'avg_installments')}
        FROM core""",
)


def d10(s, d):
    rows = order_level.order_rows(retail_facts(s, d), DAY, ["nation"], complete(s, d))
    dense = calendar_fill.densify(rollup.roll_up(rows, DAY, ["nation"]), DAY, ["nation"])
    return dense.na.fill(0, subset=VOLUME_METRICS).select("nation", "date", *VOLUME_METRICS)


add(
    "d10_zero_imputation",
    d10,
    f"""WITH {S.BASE}, {S.order_rows(['nation'])}, {S.core(['nation'], 'date')}, {S.dense(['nation'])}
        SELECT nation, date, coalesce(total_items, 0) AS total_items,
        {S.r('coalesce(total_freight, 0)', 'total_freight')},
        coalesce(unique_customers, 0) AS unique_customers, coalesce(total_orders, 0) AS total_orders FROM dense""",
)
MEASURES_SQL = {
    "mae": "avg(abs(y - p))",
    "rmse": "sqrt(avg((y - p) * (y - p)))",
    "mape": "100 * avg(abs(y - p) / greatest(abs(y), 1e-9))",
    "bias": "avg(p - y)",
    "wape": "sum(abs(y - p)) / nullif(sum(y), 0) * 100",
    "accuracy": "CASE WHEN sum(y) <> 0 THEN greatest(100 - sum(abs(y - p)) / sum(y) * 100, 0) END",
}


def measures(prefix="", names=tuple(MEASURES_SQL)):
    return ", ".join(S.r(MEASURES_SQL[n], prefix + n) for n in names)


for suffix, keys in list(SERIES.items())[:2]:
    add(
        f"d13_monthly_scores_of_days{suffix}",
        lambda s, d, keys=keys: scoring.monthly_scores(
            baselines.naive_last(daily_table(retail_facts(s, d), complete(s, d), keys), DAY, keys), [*keys, "model"]
        ),
        f"""WITH {S.days(keys)}, f AS (SELECT {S.lead_list(keys, 'date')}, daily_revenue AS y,
              lag(daily_revenue) OVER {S.order_window(keys, 'date')} AS p FROM days),
            m AS (SELECT {S.lead_list(keys, "date_trunc('month', date) AS month")}, sum(y) AS y, sum(p) AS p
                  FROM f WHERE p IS NOT NULL GROUP BY ALL)
            SELECT {S.lead_list(keys, "'naive_last' AS model")}, {measures('monthly_')}
            FROM m {'GROUP BY ' + ', '.join(keys) if keys else ''}""",
    )
    add(
        f"d14_modal_category{suffix}",
        lambda s, d, keys=keys: rollup.modal_value(
            rollup.top_category(
                categories(s, d, keys), [*keys, "month"]
            ),
            "top_category",
            keys,
        ),
        f"""WITH {S.BASE}, {S.items(keys)}, n AS (SELECT {S.lead_list(keys, 'top_category')}, count(*) AS n
              FROM tops GROUP BY ALL)
            SELECT {S.lead_list(keys, 'top_category')} FROM (SELECT *, row_number() OVER
              ({S.part(keys)} ORDER BY n DESC, top_category) AS place FROM n) WHERE place = 1""",
    )
    add(
        f"d15_month_of_year{suffix}",
        lambda s, d, keys=keys: rollup.five_numbers(
            monthly_table(retail_facts(s, d), complete(s, d), keys), "monthly_revenue", [*keys, "month_num"]
        ),
        f"""WITH {S.months(keys)} SELECT {S.lead_list(keys, 'month_num')},
            {', '.join(S.r(f'quantile_cont(monthly_revenue, {q})', n) for n, q in
                       zip(['low', 'q1', 'median', 'q3', 'high'], [0, 0.25, 0.5, 0.75, 1]))}
            FROM months GROUP BY ALL""",
    )

METRICS = ["monthly_revenue", *SHARED_METRICS]


def d16(s, d):
    table = monthly_table(retail_facts(s, d), complete(s, d))
    return correlation_table(s, METRICS, correlation_matrix(table, METRICS))


add(
    "d16_correlation_matrix",
    d16,
    f"WITH {S.months([])} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {S.r(f'corr({a}, {b})', 'correlation')} FROM months"
        for a in METRICS
        for b in METRICS
    ),
)


def d17(s, d):
    rows, names = supervised(monthly_table(retail_facts(s, d), complete(s, d)), FeatureConfig.default(MONTH), MONTH, [])
    return rollup.correlation_with(stage(rows, "supervised"), names, "label")


CORRELATED = f"""WITH {S.months([])}, {S.supervised([], False)},
    wide AS (SELECT {', '.join(f'corr({n}, label) AS {n}' for n in S.feature_names(False))} FROM sup),
    long AS (UNPIVOT wide ON COLUMNS(*) INTO NAME feature VALUE correlation)"""
add("d17_correlation_with_target", d17, f"{CORRELATED} SELECT feature, {S.r('correlation', 'correlation')} FROM long")
add(
    "g03_strongest_features",
    lambda s, d: ranking.strongest(d17(s, d), "correlation", 15),
    f"""{CORRELATED} SELECT feature, {S.r('correlation', 'correlation')} FROM long
        ORDER BY abs(correlation) DESC, feature LIMIT 15""",
)

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def d18(s, d):
    return rollup.pivot_found(categories(s, d, []), ["month"], "product_category_name", "item_count")


PIVOTED = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN product_category_name = '{c}' THEN item_count END), 0) AS BIGINT) AS {c}" for c in CATEGORIES
)
REST = f"CAST(coalesce(sum(CASE WHEN product_category_name NOT IN ({', '.join(repr(c) for c in CATEGORIES)}) THEN item_count END), 0) AS BIGINT) AS other"
add(
    "d18_category_columns",
    d18,
    f"WITH {S.BASE}, {S.items([])} SELECT month, {PIVOTED}, {REST} FROM cats GROUP BY month",
)
# Only the three largest categories get a column; the other three add up beside them.


def d18_largest(s, d):
    """The three largest categories and the rest, the columns named by their place."""
    wide = rollup.pivot_found(categories(s, d, []), ["month"], "product_category_name", "item_count", 3)
    cells = ", ".join(f"{i}, `{c}`" for i, c in enumerate(wide.columns[1:], 1))
    return wide.selectExpr("month", f"stack(4, {cells}) AS (place, item_count)")


LARGEST = f"""WITH {S.BASE}, {S.items([])}, t AS (SELECT product_category_name AS c, row_number() OVER
      (ORDER BY sum(item_count) DESC, product_category_name) AS place FROM cats GROUP BY product_category_name)
    SELECT month, place, CAST(coalesce(sum(item_count), 0) AS BIGINT) AS item_count FROM (SELECT DISTINCT month FROM cats)
    CROSS JOIN (SELECT unnest(range(1, 5)) AS place) LEFT JOIN (SELECT month, least(place, 4) AS place, item_count FROM cats JOIN t ON c = product_category_name)
    USING (month, place) GROUP BY month, place"""
add("d18_largest_categories", d18_largest, LARGEST)
SERIES_OF_ITEMS = Grain("month", "month", "item_count")
ITEM_FEATURES = FeatureConfig(("item_count",), (1, 2), (3,), ratios=())


def d18_features(s, d):
    """Every category's item counts as a series of its own, through the feature frame."""
    counts = categories(s, d, [])
    frame, names = create_features(counts, ITEM_FEATURES, SERIES_OF_ITEMS, ["product_category_name"])
    return frame.select("product_category_name", "month", "item_count", *names, "label")


ITEMS_OVER = "(PARTITION BY product_category_name ORDER BY month)"
ITEM_ROWS = "OVER (PARTITION BY product_category_name ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
add(
    "d18_category_features",
    d18_features,
    f"""WITH RECURSIVE {S.BASE}, {S.items([])},
        b AS MATERIALIZED (SELECT product_category_name, month, CAST(item_count AS DOUBLE) AS x, item_count,
               row_number() OVER {ITEMS_OVER} AS i FROM cats),
        e AS (SELECT product_category_name, i + 1 AS i, x AS ema FROM b WHERE i = 1
          UNION ALL SELECT e.product_category_name, e.i + 1, 0.5 * e.ema + 0.5 * b.x FROM e JOIN b USING (product_category_name, i))
        SELECT product_category_name, month, CAST(item_count AS BIGINT) AS item_count, {', '.join(S.r(expr, name) for name, expr in {
            'item_count_lag_1': f'lag(x, 1) OVER {ITEMS_OVER}', 'item_count_lag_2': f'lag(x, 2) OVER {ITEMS_OVER}',
            'item_count_roll_mean_3': f'avg(x) {ITEM_ROWS}', 'item_count_roll_std_3': f'stddev_samp(x) {ITEM_ROWS}',
            'item_count_roll_min_3': f'min(x) {ITEM_ROWS}', 'item_count_roll_max_3': f'max(x) {ITEM_ROWS}', 'item_count_ema_3': 'ema',
            'item_count_pct_change': f'coalesce(lag(x, 1) OVER {ITEMS_OVER} / nullif(lag(x, 2) OVER {ITEMS_OVER}, 0) - 1, 0)',
            'month_sin': 'sin(2 * pi() * month(month) / 12)', 'month_cos': 'cos(2 * pi() * month(month) / 12)',
            'label': f'lead(x) OVER {ITEMS_OVER}'}.items())},
        CAST(quarter(month) AS BIGINT) AS quarter, CAST(month(month) AS BIGINT) AS month_num
        FROM b LEFT JOIN e USING (product_category_name, i)""",
)


def d08_sketches(s, d, keys):
    """Distinct customers per month from daily sketches, beside the exact count; the estimate keeps three standard errors."""
    orders = order_level.with_customers(order_level.dated_orders(retail_facts(s, d), DAY, complete(s, d)), retail_facts(s, d), keys)
    daily = rollup.distinct_sketches(orders, [*keys, "date"], "customer_unique_id")
    merged = rollup.merged_sketches(daily, [*keys, MONTH.bucket(F.col("date")).alias("month")])
    rough = rollup.sketched_counts(merged, "estimate")
    exact = rollup.distinct_per_group(
        orders.withColumn("month", MONTH.bucket(F.col("date"))), [*keys, "month"], "customer_unique_id", "unique_customers"
    )
    close = F.abs(F.col("estimate") - F.col("unique_customers")) <= F.ceil(3 * rollup.sketch_error() * F.col("unique_customers"))
    return exact.join(rough, [*keys, "month"], "left").select(*keys, "month", "unique_customers", close.alias("estimate_is_close"))


for suffix, keys in list(SERIES.items())[:2]:
    add(
        f"d08_sketches_of_days{suffix}",
        lambda s, d, keys=keys: d08_sketches(s, d, keys),
        f"""WITH {S.BASE} SELECT {S.lead_list(keys, 'month')}, count(DISTINCT customer_unique_id) AS unique_customers, true AS estimate_is_close
            FROM ords LEFT JOIN custs USING (customer_id) WHERE month < {S.CUT} GROUP BY {S.lead_list(keys, 'month')}""",
    )


# --- B10, I04 against tables of ranges ----------------------------------------------------------


def shock_table(s, d):
    """A shock from every 7th day that customers of nation 3 ordered on, over as many days as its day of month has tens."""
    dates = order_level.dated_orders(retail_facts(s, d), DAY, complete(s, d)).select("date").distinct()
    day = F.datediff("date", F.lit("1990-01-01"))
    return dates.where(day % 7 == 0).select(
        F.col("date").alias("start"), F.expr("date_add(date, int(dayofmonth(date) / 10))").alias("end")
    )


def b10_table(s, d):
    rows = daily_table(retail_facts(s, d), complete(s, d), ["nation"]).select("nation", "date", "daily_revenue")
    return ranges.outside_ranges(rows, "date", shock_table(s, d))


SHOCK_TABLE = f"""sh AS (SELECT DISTINCT date AS start, date + CAST(day(date) // 10 AS INTEGER) AS stop FROM ords
    WHERE month < {S.CUT} AND (date - DATE '1990-01-01') % 7 = 0)"""
add(
    "b10_outside_range_table",
    b10_table,
    f"""WITH {S.days(['nation'])}, {SHOCK_TABLE} SELECT nation, date, {S.r('daily_revenue', 'daily_revenue')} FROM days
        WHERE NOT EXISTS (SELECT 1 FROM sh WHERE date BETWEEN start AND stop)""",
)


def i04_table(s, d):
    rows = daily_table(retail_facts(s, d), complete(s, d)).select("date", "daily_revenue")
    named = shock_table(s, d).withColumn("name", F.date_format("start", "yyyy-MM-dd"))
    return ranges.in_segments(rows, "date", named, "name", "start", "end")


add(
    "i04_segments_of_range_table",
    i04_table,
    f"""WITH {S.days([])}, {SHOCK_TABLE} SELECT date, {S.r('daily_revenue', 'daily_revenue')}, strftime(start, '%Y-%m-%d') AS segment
        FROM days JOIN sh ON date BETWEEN start AND stop""",
)


# --- D11 from bucketed facts, D04 of one month ----------------------------------------------------

for suffix, keys in SERIES.items():
    add(
        f"d11_from_bucketed_facts{suffix}",
        lambda s, d, keys=keys: monthly_table(bucketed(retail_facts(s, d), 16), complete(s, d), keys),
        SQL[f"d11_monthly_table{suffix}"],
    )
    add(
        f"d04_one_month{suffix}",
        lambda s, d, keys=keys: rollup.roll_up(
            order_level.order_rows(retail_facts(s, d), MONTH, keys, Bounds(TRAIN_END, NEXT)), MONTH, keys
        ),
        f"SELECT * FROM ({SQL[f'd04_monthly_roll_up{suffix}']}) WHERE month = DATE '{TRAIN_END}'",
    )
