"""Business figures of a monthly backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import ratio
from panelcast.operators.windows import growth, series_window

CONTEXT = ["total_orders", "total_freight", "top_category", "new_sellers", "unique_customers"]


def with_context(forecasts: DataFrame, months: DataFrame, series_keys: list[str]) -> DataFrame:
    """Add the context columns that exist, of the month that was forecast."""
    present = [c for c in CONTEXT if c in months.columns]
    context = months.select(*series_keys, F.col("month").alias("period"), *present)
    return forecasts.join(context, [*series_keys, "period"], "left")


def period_kpis(backtest: DataFrame, groups: list[str]) -> DataFrame:
    """Growth and the ratios whose inputs exist, per forecast month."""
    have = set(backtest.columns)
    revenue = F.col("y_true")
    parts = {
        "avg_ticket": (revenue, "total_orders"),
        "arpu": (revenue, "unique_customers"),
        "freight_ratio": ("total_freight", revenue),
        "frequency": ("total_orders", "unique_customers"),
        "avg_freight": ("total_freight", "total_orders"),
    }
    out = {"revenue_growth": F.expr(growth("y_true", series_window(groups, "period")))}
    for name, (top, bottom) in parts.items():
        if all(not isinstance(x, str) or x in have for x in (top, bottom)):
            top, bottom = (F.col(x) if isinstance(x, str) else x for x in (top, bottom))
            out[name] = ratio(top, bottom)
    return backtest.withColumns(out)


def summary(kpis: DataFrame, groups: list[str]) -> DataFrame:
    """The eleven summary figures; figures whose inputs are missing are null."""
    have = set(kpis.columns)

    def mean(column: str, factor: float = 1.0):
        return F.avg(column) * factor if column in have else F.lit(None).cast("double")

    real, pred = F.sum("y_true"), F.sum("y_pred")
    rate = F.when(real > 0, F.try_divide(pred, real) * 100).otherwise(F.lit(0.0))
    top = (
        F.mode("top_category", deterministic=True)
        if "top_category" in have
        else F.lit(None).cast("string")
    )
    sellers = F.sum("new_sellers") if "new_sellers" in have else F.lit(None).cast("bigint")
    return kpis.groupBy(*groups).agg(
        real.alias("total_real"),
        pred.alias("total_forecast"),
        rate.alias("realization_rate_pct"),
        (pred - real).alias("revenue_deviation"),
        mean("revenue_growth", 100.0).alias("avg_growth_pct"),
        mean("avg_ticket").alias("avg_ticket"),
        mean("arpu").alias("avg_arpu"),
        mean("freight_ratio", 100.0).alias("avg_freight_ratio_pct"),
        mean("frequency").alias("avg_orders_per_customer"),
        sellers.alias("total_new_sellers"),
        top.alias("top_category"),
    )
