"""Aggregations to period grain.

Every grouping here has a map-side partial form.  Distinct counts are taken in two
steps, first one row per counted thing, then a count, so that a period or series
holding a third of all rows is spread over the things it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.calendar import MONTH, Bounds, Grain
from panelcast.functions.numeric import correlation, ratio
from panelcast.operators.order_level import ORDER_TS, dated_items
from panelcast.sources.facts import Facts


def roll_up(orders: DataFrame, grain: Grain, series_keys: list[str]) -> DataFrame:
    """Order rows to the period metrics.

    Days of a month are counted exactly as bits of one integer, which merges like
    a sum and needs no second distinct.
    """
    period = grain.period
    monthly = grain.unit == "month"
    day_bit = F.expr(f"shiftleft(1L, dayofmonth({ORDER_TS}))")
    per_customer = orders.groupBy(*series_keys, period, "customer_unique_id").agg(
        F.sum("payment_value").alias("revenue"),
        F.count("order_id").alias("orders"),
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_count"),
        F.sum("total_items").alias("items"),
        F.sum("total_freight").alias("freight"),
        F.sum("payment_installments").alias("inst_sum"),
        F.count("payment_installments").alias("inst_count"),
        *([F.bit_or(day_bit).alias("days")] if monthly else []),
    )

    def total(name: str, kind: str) -> Column:
        return F.coalesce(F.sum(name).cast(kind), F.lit(0).cast(kind))

    return per_customer.groupBy(*series_keys, period).agg(
        total("revenue", "double").alias(grain.revenue),
        F.sum("orders").alias("total_orders"),
        ratio(F.sum("score_sum"), F.sum("score_count")).alias("avg_review_score"),
        *([F.bit_count(F.bit_or("days")).cast("bigint").alias("active_days")] if monthly else []),
        total("items", "bigint").alias("total_items"),
        total("freight", "double").alias("total_freight"),
        F.count("customer_unique_id").alias("unique_customers"),
        ratio(F.sum("inst_sum"), F.sum("inst_count")).alias("avg_installments"),
    )


def distinct_per_group(df: DataFrame, groups: list[str], thing: str, name: str) -> DataFrame:
    """Exact distinct count in two steps."""
    return (
        df.select(*groups, thing).distinct().groupBy(*groups).agg(F.count(thing).alias(name))
    )


def sightings(
    facts: Facts, grain: Grain, series_keys: list[str], bounds: Bounds | None = None
) -> DataFrame:
    """Items per product, seller and period, and when each was first sold in it.

    Top categories and new sellers both start here, so that items meet their orders
    once.  Only the upper bound is applied: first sightings need the whole past.
    """
    keys = facts.customer_keys(series_keys)
    return (
        dated_items(facts, grain, series_keys, bounds, whole_past=True)
        .groupBy(*keys, grain.period, "product_id", "seller_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ORDER_TS).alias("first_ts"))
        # Both conditions always hold.  Every use of this table reads both columns for
        # them, so its plan is the same wherever it occurs and its shuffle is reused.
        .where((F.col("n") > 0) & F.col("first_ts").isNotNull())
    )


def category_counts(
    seen: DataFrame, facts: Facts, grain: Grain, series_keys: list[str], bounds: Bounds | None = None
) -> DataFrame:
    """Items per series, period and known category, from :func:`sightings`.

    The product dimension meets counts and not items, however hot a product is.
    """
    product_keys = facts.product_keys(series_keys)
    if bounds is not None and bounds.start is not None:
        seen = seen.where(F.col(grain.period) >= F.lit(bounds.start))
    products = facts.products.select("product_id", "product_category_name", *product_keys)
    return (
        seen.join(products, "product_id", "left")
        .where(F.col("product_category_name").isNotNull())
        .groupBy(*series_keys, grain.period, "product_category_name")
        .agg(F.sum("n").alias("item_count"))
    )


def top_category(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Most frequent category per group, the alphabetically first of equals."""
    best = F.min(F.struct((-F.col("item_count")).alias("n"), F.col("product_category_name").alias("c")))
    return counts.groupBy(*groups).agg(best.alias("best")).select(
        *groups, F.col("best.c").alias("top_category")
    )


def new_entities(seen: DataFrame, facts: Facts, grain: Grain, series_keys: list[str]) -> DataFrame:
    """Sellers per period not seen before (per series), from :func:`sightings`."""
    product_keys = facts.product_keys(series_keys)
    if product_keys:
        seen = seen.join(facts.products.select("product_id", *product_keys), "product_id", "left")
    first = (
        seen.where(F.col("seller_id").isNotNull())
        .groupBy(*series_keys, "seller_id")
        .agg(F.min("first_ts").alias("first_seen"))
    )
    return first.groupBy(*series_keys, grain.bucket(F.col("first_seen")).alias(grain.period)).agg(
        F.count(F.lit(1)).alias("new_sellers")
    )


def impute_median(df: DataFrame, columns: list[str], series_keys: list[str]) -> DataFrame:
    """Nulls take the median of their series in this table."""
    w = Window.partitionBy(*series_keys)
    return df.withColumns({c: F.coalesce(F.col(c), F.median(c).over(w)) for c in columns})


SKETCH = "sketch"


def distinct_sketches(df: DataFrame, groups: list[str], thing: str, size: int = 12) -> DataFrame:
    """One mergeable sketch (HLL with 2^``size`` registers) of the distinct ``thing`` per group; nulls do not count.

    The count read from it has a relative standard error of :func:`sketch_error`.
    """
    return df.where(F.col(thing).isNotNull()).groupBy(*groups).agg(F.hll_sketch_agg(thing, F.lit(size)).alias(SKETCH))


def merged_sketches(sketches: DataFrame, groups: list[str | Column]) -> DataFrame:
    """Sketches of larger groups, from those of smaller ones: days to months, series to their total."""
    return sketches.groupBy(*groups).agg(F.hll_union_agg(SKETCH).alias(SKETCH))


def sketched_counts(sketches: DataFrame, name: str) -> DataFrame:
    """The sketches replaced by the distinct counts they stand for."""
    return sketches.withColumn(name, F.hll_sketch_estimate(SKETCH)).drop(SKETCH)


def sketch_error(size: int = 12) -> float:
    """Relative standard error of a sketched count."""
    return 1.04 / 2 ** (size / 2)


def modal_value(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """Most frequent value, the smallest of equals; nulls do not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*groups).agg(best.alias("best")).select(*groups, F.col("best.v").alias(column))


def five_numbers(df: DataFrame, value: str, groups: list[str | Column]) -> DataFrame:
    """Minimum, quartiles and maximum of period-grain values."""
    q = F.percentile(F.col(value), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ["low", "q1", "median", "q3", "high"]
    summary = df.groupBy(*groups).agg(q.alias("q"))
    kept = [c for c in summary.columns if c != "q"]
    return summary.select(*kept, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def correlation_with(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Correlation of every column with the target from one pass, one row per column."""
    wide = df.agg(*[correlation(F.col(c), F.col(target)).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "correlation")


def pivot_values(
    df: DataFrame, groups: list[str], column: str, values: list[str], amount: str
) -> DataFrame:
    """One column per listed value; cells without rows are zero."""
    wide = df.groupBy(*groups).pivot(column, values).agg(F.sum(amount))
    return wide.na.fill(0, subset=values)


OTHER = "other"


def pivot_found(df: DataFrame, groups: list[str], column: str, amount: str, most: int = 100) -> DataFrame:
    """One column per value that the data hold, largest first, and ``other`` for all the rest.

    The first pass takes the ``most`` values of the largest amounts, so the width is
    bounded; nothing is lost, as what has no column of its own (nulls too) adds to ``other``.
    """
    sums = df.where(F.col(column).isNotNull() & (F.col(column) != OTHER)).groupBy(column).agg(F.sum(amount).alias("_sum"))
    values = [r[0] for r in sums.orderBy(F.desc("_sum"), column).limit(most).collect()]
    kept = df.withColumn(column, F.when(F.col(column).isin(values), F.col(column)).otherwise(OTHER))
    return pivot_values(kept, groups, column, [*values, OTHER], amount)
