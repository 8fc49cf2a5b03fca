"""Binding of an order/lineitem star schema to the engine's facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.facts import Facts


# The columns read, with their types; naming them spares a look into the
# file footers for every query.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    ),
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "part": "p_partkey bigint, p_type string, p_brand string",
    "nation": "n_nationkey int, n_name string",
}


def _hundredths(column: str) -> Column:
    """A double with two decimals as a whole number of hundredths."""
    return F.rint(F.col(column) * 100).cast("bigint")


def _money(ten_thousandths: Column) -> Column:
    return (
        ten_thousandths.cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(4,4)")
    ).cast("decimal(18,4)")


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Line items as payments, reviews and items in one wide table.

    Money is multiplied as whole numbers and summed as decimals, so sums do not depend
    on the order of addition; casting each double to decimal would cost three times as much.
    """
    price = _hundredths("l_extendedprice")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_partkey").alias("seller_id"),
        _money(price * (100 - _hundredths("l_discount"))).alias("payment_value"),
        F.col("l_quantity").alias("payment_installments"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") % 5 + 1).alias("review_score"),
        _money(price * _hundredths("l_tax")).alias("freight_value"),
    )


def retail_facts(spark: SparkSession, folder: str) -> Facts:
    t = {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
        for name, schema in SCHEMAS.items()
    }
    lines = order_lines(t["lineitem"])
    customers = t["customer"].join(
        t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return Facts(
        orders=t["orders"].select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        ),
        payments=lines.select("order_id", "payment_value", "payment_installments"),
        reviews=lines.where(F.col("review_score").isNotNull()).select("order_id", "review_score"),
        items=lines.select(
            "order_id", "order_item_id", "product_id", "seller_id", "freight_value"
        ),
        customers=customers.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("n_name").alias("nation"),
        ),
        products=t["part"].select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.col("p_brand").alias("brand"),
        ),
        lines=lines,
    )
