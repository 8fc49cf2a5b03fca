"""The two period tables, from raw facts to cleaned metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAY, MONTH, Bounds, day_table_columns, month_table_columns
from panelcast.operators.calendar_fill import densify, fill_both_ways
from panelcast.operators.order_level import order_rows
from panelcast.operators.rollup import (
    category_counts,
    impute_median,
    new_entities,
    roll_up,
    sightings,
    top_category,
)
from panelcast.session import stage, staged
from panelcast.sources.facts import Facts

STATE_METRICS = ["avg_review_score", "avg_installments"]
VOLUME_METRICS = ["total_items", "total_freight", "unique_customers", "total_orders"]


def monthly_metrics(
    facts: Facts, bounds: Bounds | None = None, series_keys: list[str] | None = None
) -> DataFrame:
    """Monthly metrics per series before imputation: no month depends on what comes after it."""
    keys = series_keys or []
    core = roll_up(order_rows(facts, MONTH, keys, bounds), MONTH, keys)
    seen = sightings(facts, MONTH, keys, bounds)
    tops = top_category(category_counts(seen, facts, MONTH, keys, bounds), [*keys, "month"])
    return _together(core, tops, new_entities(seen, facts, MONTH, keys), keys)


def staged_metrics(
    facts: Facts, bounds: Bounds | None = None, series_keys: list[str] | None = None
) -> DataFrame:
    """:func:`monthly_metrics` of parts written one after the other.

    The disk holds the shuffles of one part at a time.  Items meet their orders once for
    certain; the sightings go when top categories and new sellers have been taken from them.
    """
    keys = series_keys or []
    core = stage(roll_up(order_rows(facts, MONTH, keys, bounds), MONTH, keys), "core")
    with staged(sightings(facts, MONTH, keys, bounds), "sightings") as seen:
        tops = stage(top_category(category_counts(seen, facts, MONTH, keys, bounds), [*keys, "month"]), "tops")
        fresh = stage(new_entities(seen, facts, MONTH, keys), "fresh")
    return _together(core, tops, fresh, keys)


def _together(core: DataFrame, tops: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "month"]
    return (
        core.join(tops, on, "left")
        .join(fresh, on, "left")
        .withColumn("new_sellers", F.coalesce(F.col("new_sellers"), F.lit(0).cast("bigint")))
        .withColumns(month_table_columns(F.col("month")))
    )


def imputed(metrics: DataFrame, series_keys: list[str]) -> DataFrame:
    """Missing scores take the median of their series in this table, missing volumes are zero."""
    return impute_median(metrics, STATE_METRICS, series_keys).na.fill(0, subset=VOLUME_METRICS)


def monthly_table(
    facts: Facts, bounds: Bounds | None = None, series_keys: list[str] | None = None
) -> DataFrame:
    """Monthly metrics per series.  A month without orders has no row."""
    keys = series_keys or []
    return imputed(monthly_metrics(facts, bounds, keys), keys)


def daily_table(
    facts: Facts, bounds: Bounds | None = None, series_keys: list[str] | None = None
) -> DataFrame:
    """Daily metrics per series for every calendar day between its first and last order."""
    keys = series_keys or []
    core = roll_up(order_rows(facts, DAY, keys, bounds), DAY, keys)
    dense = densify(core, DAY, keys).na.fill(0, subset=["daily_revenue", *VOLUME_METRICS])
    return fill_both_ways(dense, STATE_METRICS, "date", keys).withColumns(
        day_table_columns(F.col("date"))
    )
