"""From raw facts to one row per order.

Payments, reviews and items are brought to order level before any join, so an
order with several of each is not counted several times.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import Bounds, Grain
from panelcast.operators.cleaning import coerce_timestamps, drop_undated
from panelcast.sources.facts import Facts

ORDER_TS = "order_purchase_timestamp"
KEYS_SENT = 1 << 20  # order keys sent to the scan of the lines at most: 16 MB


def payments_per_order(payments: DataFrame) -> DataFrame:
    return payments.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.avg("payment_installments").alias("payment_installments"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.avg("review_score").alias("review_score")
    )


def items_per_order(items: DataFrame) -> DataFrame:
    return items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count("order_item_id").alias("total_items"),
        F.sum("freight_value").alias("total_freight"),
    )


def order_measures(facts: Facts, product_keys: list[str] | None = None) -> DataFrame:
    """All order-level measures in one aggregation.

    The three tables are stacked and grouped once, which costs one shuffle (with
    partial sums before it) where three aggregates joined to each other would cost
    three.  With ``product_keys`` the grain is order × product key.
    """
    if facts.lines is not None:
        stacked = facts.lines
    else:
        stacked = (
            facts.payments.select("order_id", "payment_value", "payment_installments")
            .unionByName(facts.reviews.select("order_id", "review_score"), allowMissingColumns=True)
            .unionByName(
                facts.items.select("order_id", "order_item_id", "freight_value"),
                allowMissingColumns=True,
            )
        )
    if product_keys:
        stacked = stacked.join(facts.products.select("product_id", *product_keys), "product_id", "left")
    return (
        stacked.where(F.col("order_id").isNotNull())
        .groupBy("order_id", *(product_keys or []))
        .agg(
            F.sum("payment_value").alias("payment_value"),
            F.avg("payment_installments").alias("payment_installments"),
            F.avg("review_score").alias("review_score"),
            F.count("order_item_id").alias("total_items"),
            F.sum("freight_value").alias("total_freight"),
        )
    )


def dated_orders(
    facts: Facts,
    grain: Grain,
    bounds: Bounds | None = None,
    whole_past: bool = False,
) -> DataFrame:
    """Orders with a usable timestamp, their period, and the bounds pushed to the scan."""
    orders = drop_undated(coerce_timestamps(facts.orders, [ORDER_TS]), ORDER_TS)
    if bounds is not None:
        orders = bounds.check(grain).keep(orders, ORDER_TS, lower=not whole_past)
    return orders.select(
        "order_id", "customer_id", ORDER_TS, grain.bucket(F.col(ORDER_TS)).alias(grain.period)
    )


def with_customers(orders: DataFrame, facts: Facts, series_keys: list[str]) -> DataFrame:
    """Add the person behind the customer id and the series keys customers carry.

    No broadcast hint: Spark broadcasts the dimension where its size allows and
    otherwise splits a hot customer at run time (skew join).
    """
    columns = ["customer_id", "customer_unique_id", *facts.customer_keys(series_keys)]
    return orders.join(facts.customers.select(*columns), "customer_id", "left")


def within(facts: Facts, orders: DataFrame) -> Facts:
    """``facts`` whose line-level tables hold the lines of ``orders`` alone, before anything is shuffled.

    The keys of the orders are counted, which reads the pruned side only; up to
    ``KEYS_SENT`` of them go to the tasks that scan the lines.  Beyond that the lines stay
    as they are, and the join by order does the same after a shuffle.
    """
    keys = orders.select("order_id").where(F.col("order_id").isNotNull())
    if keys.count() > KEYS_SENT:
        return facts
    keys = F.broadcast(keys)
    tables = {n: getattr(facts, n) for n in ("payments", "reviews", "items", "lines")}
    return replace(facts, **{n: df.join(keys, "order_id", "left_semi") for n, df in tables.items() if df is not None})


def order_rows(
    facts: Facts, grain: Grain, series_keys: list[str], bounds: Bounds | None = None
) -> DataFrame:
    """One wide row per order (per order × product key for series by product).

    Orders meet their measures before their customers, so that tables bucketed by order
    (``sources.layout``) meet without a shuffle.  With a lower bound only the lines of the
    orders asked for are grouped.
    """
    product_keys = facts.product_keys(series_keys)
    orders = dated_orders(facts, grain, bounds)
    if bounds is not None and bounds.start is not None:
        facts = within(facts, orders)
    how = "inner" if product_keys else "left"
    return with_customers(orders.join(order_measures(facts, product_keys), "order_id", how), facts, series_keys)


def dated_items(
    facts: Facts,
    grain: Grain,
    series_keys: list[str],
    bounds: Bounds | None = None,
    whole_past: bool = False,
) -> DataFrame:
    """Items that inherit the period of their order; items of undated orders drop out."""
    orders = dated_orders(facts, grain, bounds, whole_past)
    keys = facts.customer_keys(series_keys)
    if keys:
        orders = orders.join(facts.customers.select("customer_id", *keys), "customer_id", "left")
    return facts.items.select("order_id", "product_id", "seller_id").join(
        orders.select("order_id", ORDER_TS, grain.period, *keys), "order_id", "inner"
    )
