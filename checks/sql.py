"""Building blocks of the SQL the queries are checked against (DuckDB dialect)."""

from __future__ import annotations

from panelcast.plans.feature_frame import DAY_LAGS, DAY_WINDOWS, MONTH_LAGS, MONTH_WINDOWS, SHARED_METRICS

CUT = "(SELECT CAST(date_trunc('month', max(o_orderdate)) AS DATE) FROM orders)"

BASE = """
lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
         l_partkey AS product_id, l_partkey AS seller_id,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS payment_value,
         l_quantity AS payment_installments,
         CASE WHEN l_returnflag = 'R' THEN l_linenumber % 5 + 1 END AS review_score,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))
              AS DECIMAL(18,4)) AS freight_value
  FROM lineitem),
custs AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id, n_name AS nation
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
prods AS (
  SELECT p_partkey AS product_id, p_type AS product_category_name, p_brand AS brand FROM part),
ords AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ts,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) AS date
  FROM orders WHERE o_orderdate IS NOT NULL)"""


def r(expr: str, name: str, digits: int = 4) -> str:
    """Same rounding as ``steady_round``."""
    scale = f"{10**digits}.0"
    return f"floor(CAST({expr} AS DOUBLE) * {scale} + 0.501) / {scale} AS {name}"


def big(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def lead_list(keys: list[str], *more: str) -> str:
    """Comma list of the keys and more columns."""
    return ", ".join([*keys, *more])


def part(keys: list[str]) -> str:
    return f"PARTITION BY {', '.join(keys)}" if keys else ""


def order_window(keys: list[str], period: str) -> str:
    return f"({part(keys)} ORDER BY {period})"


def customer_keys(keys):
    return [k for k in keys if k == "nation"]


def product_keys(keys):
    return [k for k in keys if k == "brand"]


def order_rows(keys: list[str]) -> str:
    pk = product_keys(keys)
    how = "JOIN" if pk else "LEFT JOIN"
    return f"""
om AS (
  SELECT {lead_list(pk, 'order_id')}, sum(payment_value) AS payment_value,
         avg(payment_installments) AS payment_installments, avg(review_score) AS review_score,
         count(order_item_id) AS total_items, sum(freight_value) AS total_freight
  FROM lines {'LEFT JOIN prods USING (product_id)' if pk else ''}
  GROUP BY {lead_list(pk, 'order_id')}),
orows AS (
  SELECT ords.order_id, ts, month, date, customer_unique_id, {lead_list(keys, '')}
         payment_value, payment_installments, review_score, total_items, total_freight
  FROM ords LEFT JOIN custs USING (customer_id) {how} om USING (order_id)
  WHERE month < {CUT})"""


def core(keys: list[str], period: str) -> str:
    revenue = "monthly_revenue" if period == "month" else "daily_revenue"
    days = "count(DISTINCT date) AS active_days," if period == "month" else ""
    return f"""
core AS (
  SELECT {lead_list(keys, period)},
         coalesce(CAST(sum(payment_value) AS DOUBLE), 0) AS {revenue},
         count(order_id) AS total_orders,
         avg(review_score) AS avg_review_score, {days}
         CAST(coalesce(sum(total_items), 0) AS BIGINT) AS total_items,
         coalesce(CAST(sum(total_freight) AS DOUBLE), 0) AS total_freight,
         count(DISTINCT customer_unique_id) AS unique_customers,
         avg(payment_installments) AS avg_installments
  FROM orows GROUP BY {lead_list(keys, period)})"""


def items(keys: list[str]) -> str:
    ck, pk = customer_keys(keys), product_keys(keys)
    return f"""
ditems AS (
  SELECT l.order_id, l.product_id, l.seller_id, o.ts, o.month, o.date,
         {lead_list([*ck, *pk], '')} product_category_name
  FROM lines l JOIN ords o USING (order_id) LEFT JOIN custs USING (customer_id)
       LEFT JOIN prods USING (product_id)
  WHERE o.month < {CUT}),
cats AS (
  SELECT {lead_list(keys, 'month', 'product_category_name')}, count(*) AS item_count
  FROM ditems WHERE product_category_name IS NOT NULL
  GROUP BY {lead_list(keys, 'month', 'product_category_name')}),
tops AS (
  SELECT {lead_list(keys, 'month')}, product_category_name AS top_category
  FROM (SELECT *, row_number() OVER (PARTITION BY {lead_list(keys, 'month')}
                  ORDER BY item_count DESC, product_category_name) AS place FROM cats)
  WHERE place = 1),
fresh AS (
  SELECT {lead_list(keys, 'month')}, count(*) AS new_sellers
  FROM (SELECT {lead_list(keys, 'seller_id')}, CAST(date_trunc('month', min(ts)) AS DATE) AS month
        FROM ditems GROUP BY {lead_list(keys, 'seller_id')})
  GROUP BY {lead_list(keys, 'month')})"""


MONTH_COLUMNS = [
    "monthly_revenue", "total_orders", "avg_review_score", "active_days", "total_items", "total_freight",
    "unique_customers", "avg_installments", "top_category", "new_sellers", "year", "month_num",
]
DAY_COLUMNS = [
    "daily_revenue", "total_orders", "avg_review_score", "total_items", "total_freight",
    "unique_customers", "avg_installments", "year", "month", "day", "day_of_week",
]
REAL = {
    "monthly_revenue", "daily_revenue", "avg_review_score", "total_freight", "avg_installments",
}


def months(keys: list[str]) -> str:
    """CTEs up to ``months``, the monthly period table."""
    on = lead_list(keys, "month")
    return f"""{BASE}, {order_rows(keys)}, {core(keys, 'month')}, {items(keys)},
months AS (
  SELECT {lead_list(keys, 'month')}, monthly_revenue, total_orders,
         coalesce(avg_review_score, median(avg_review_score) OVER ({part(keys)})) AS avg_review_score,
         active_days, total_items, total_freight, unique_customers,
         coalesce(avg_installments, median(avg_installments) OVER ({part(keys)})) AS avg_installments,
         top_category, CAST(coalesce(new_sellers, 0) AS BIGINT) AS new_sellers,
         CAST(year(month) AS BIGINT) AS year, CAST(month(month) AS BIGINT) AS month_num
  FROM core LEFT JOIN tops USING ({on}) LEFT JOIN fresh USING ({on}))"""


def dense(keys: list[str]) -> str:
    """CTE ``dense``: daily core with every calendar day of each series."""
    spans = f"SELECT {lead_list(keys, 'min(date) AS lo', 'max(date) AS hi')} FROM core"
    if keys:
        spans += f" GROUP BY {lead_list(keys)}"
    return f"""
grid AS (
  SELECT {lead_list(keys, 'CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date')}
  FROM ({spans})),
dense AS (SELECT * FROM grid LEFT JOIN core USING ({lead_list(keys, 'date')}))"""


def fill(column: str, keys: list[str], period: str = "date") -> str:
    w = f"{part(keys)} ORDER BY {period}"
    return (
        f"coalesce(last_value({column} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({column} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


def days(keys: list[str]) -> str:
    """CTEs up to ``days``, the daily period table."""
    return f"""{BASE}, {order_rows(keys)}, {core(keys, 'date')}, {dense(keys)},
days AS (
  SELECT {lead_list(keys, 'date')}, coalesce(daily_revenue, 0) AS daily_revenue,
         coalesce(total_orders, 0) AS total_orders,
         {fill('avg_review_score', keys)} AS avg_review_score,
         coalesce(total_items, 0) AS total_items, coalesce(total_freight, 0) AS total_freight,
         coalesce(unique_customers, 0) AS unique_customers,
         {fill('avg_installments', keys)} AS avg_installments,
         CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
         CAST(day(date) AS BIGINT) AS day, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week
  FROM dense)"""


def columns(names: list[str]) -> str:
    """Select list with doubles rounded."""
    return ", ".join(r(n, n) if n in REAL else n for n in names)


# --- features ---------------------------------------------------------------------


def feature_inputs(daily: bool) -> tuple[list[str], tuple, tuple]:
    if daily:
        ratios = ["revenue_per_order", "items_per_order", "freight_ratio"]
        return ["daily_revenue", *SHARED_METRICS, *ratios], DAY_LAGS, DAY_WINDOWS
    return ["monthly_revenue", *SHARED_METRICS, "items_per_order"], MONTH_LAGS, MONTH_WINDOWS


def feature_exprs(keys: list[str], daily: bool) -> dict[str, str]:
    """Every feature by name, over the CTE ``base`` joined with ``emas``."""
    cols, lags, wins = feature_inputs(daily)
    p = "date" if daily else "month"
    w = f"{part(keys)} ORDER BY {p}"
    out = {}
    for c in cols:
        for k in lags:
            out[f"{c}_lag_{k}"] = f"lag({c}, {k}) OVER ({w})"
        for n in wins:
            frame = f"OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            out[f"{c}_roll_mean_{n}"] = f"avg({c}) {frame}"
            out[f"{c}_roll_std_{n}"] = f"stddev_samp({c}) {frame}"
            out[f"{c}_roll_min_{n}"] = f"min({c}) {frame}"
            out[f"{c}_roll_max_{n}"] = f"max({c}) {frame}"
            out[f"{c}_ema_{n}"] = f"{c}_ema_{n}"
        out[f"{c}_pct_change"] = (
            f"coalesce(lag({c}, 1) OVER ({w}) / nullif(lag({c}, 2) OVER ({w}), 0) - 1, 0)"
        )
    out["quarter"] = f"CAST(quarter({p}) AS BIGINT)"
    out["month_num"] = f"CAST(month({p}) AS BIGINT)"
    if daily:
        out["day_of_week"] = f"CAST(isodow({p}) - 1 AS BIGINT)"
        out["is_weekend"] = f"CAST(isodow({p}) >= 6 AS BIGINT)"
        out["is_month_start"] = f"CAST(day({p}) = 1 AS BIGINT)"
        out["is_month_end"] = f"CAST({p} = last_day({p}) AS BIGINT)"
        out["day_of_month"] = f"CAST(day({p}) AS BIGINT)"
    out["month_sin"] = f"sin(2 * pi() * month({p}) / 12)"
    out["month_cos"] = f"cos(2 * pi() * month({p}) / 12)"
    return out


CALENDAR = {"quarter", "month_num", "day_of_week", "is_weekend", "is_month_start", "is_month_end", "day_of_month"}


def features(keys: list[str], daily: bool, only: list[str] | None = None) -> str:
    """CTEs from ``months``/``days`` up to ``feats``: features, label and target period."""
    cols, _, wins = feature_inputs(daily)
    p, table, revenue = ("date", "days", "daily_revenue") if daily else ("month", "months", "monthly_revenue")
    one = "CASE WHEN {0} = 0 THEN 1 ELSE {0} END"
    ratios = f"CAST(total_items AS DOUBLE) / {one.format('total_orders')} AS items_per_order"
    if daily:
        ratios += (
            f", daily_revenue / {one.format('total_orders')} AS revenue_per_order"
            f", total_freight / {one.format('daily_revenue')} AS freight_ratio"
        )
    plain = [c for c in cols if c not in ("items_per_order", "revenue_per_order", "freight_ratio")]
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in plain)
    ema = [
        f"sum(b.{c} * CASE WHEN b.i = 0 THEN pow({1 - 2 / (n + 1)!r}, a.i - 1) "
        f"ELSE {2 / (n + 1)!r} * pow({1 - 2 / (n + 1)!r}, a.i - 1 - b.i) END) AS {c}_ema_{n}"
        for c in cols
        for n in wins
        if only is None or f"{c}_ema_{n}" in only
    ] or ["count(*) AS none"]
    same = "".join(f"a.{k} = b.{k} AND " for k in keys)
    exprs = {n: e for n, e in feature_exprs(keys, daily).items() if only is None or n in only}
    listed = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    w = order_window(keys, p)
    ak = ", ".join([*[f"a.{k}" for k in keys], f"a.{p}"])
    return f"""
base AS (
  SELECT {lead_list(keys, p)}, {doubles}, {ratios},
         row_number() OVER {w} - 1 AS i
  FROM {table}),
emas AS (
  SELECT {ak}, {', '.join(ema)}
  FROM base a JOIN base b ON {same} b.i < a.i GROUP BY {ak}),
feats AS (
  SELECT {lead_list(keys, p)}, {listed},
         lead({revenue}) OVER {w} AS label, lead({p}) OVER {w} AS target_period
  FROM base LEFT JOIN emas USING ({lead_list(keys, p)}))"""


def feature_names(daily: bool) -> list[str]:
    return list(feature_exprs([], daily))


def supervised(keys: list[str], daily: bool, only: list[str] | None = None) -> str:
    """CTE ``sup``: rows of ``feats`` without nulls."""
    names = only or feature_names(daily)
    known = " AND ".join(f"{n} IS NOT NULL" for n in [*names, "label"])
    return f"{features(keys, daily, only)}, sup AS (SELECT * FROM feats WHERE {known})"


def rounded(names: list[str]) -> str:
    return ", ".join(n if n in CALENDAR else r(n, n) for n in names)
