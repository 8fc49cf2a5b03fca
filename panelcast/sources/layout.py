"""Facts stored so that joins and groupings by order need no shuffle."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import staging_path
from panelcast.sources.facts import Facts

BY_ORDER = ("orders", "payments", "reviews", "items", "lines")


def bucketed(facts: Facts, buckets: int, folder: str | None = None) -> Facts:
    """Orders and their lines written in ``buckets`` buckets by order id, and read from there.

    One shuffle when the facts are stored, none by order in any table built from them.
    A bucket should hold what a task can sort; tables meet bucket by bucket, so all have the
    same number.  One wide table of lines is stored once; payments, reviews and items are
    then its columns.
    """
    spark = facts.orders.sparkSession
    folder = folder or staging_path(spark, "bucketed")

    def stored(df: DataFrame, name: str) -> DataFrame:
        table = f"panelcast_{name}_{uuid.uuid4().hex}"
        (
            df.repartition(buckets, "order_id")
            .write.format("parquet")
            .bucketBy(buckets, "order_id")
            .sortBy("order_id")
            .option("path", f"{folder}/{name}")
            .saveAsTable(table)
        )
        return spark.table(table)

    if facts.lines is None:
        return replace(facts, **{n: stored(getattr(facts, n), n) for n in BY_ORDER if getattr(facts, n) is not None})
    lines = stored(facts.lines, "lines")
    return replace(
        facts,
        orders=stored(facts.orders, "orders"),
        lines=lines,
        payments=lines.select(*facts.payments.columns),
        reviews=lines.select(*facts.reviews.columns).where(F.col("review_score").isNotNull()),
        items=lines.select(*facts.items.columns),
    )
