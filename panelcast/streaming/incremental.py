"""Period table kept up to date while facts arrive.

Each micro-batch is added to a fact store partitioned by period; then only the
periods it touched are recomputed, from the store, and replace their partitions.
Distinct counts stay exact and late facts correct old periods.  A batch that is
replayed after a failure overwrites what it wrote before, so every step is
idempotent and none relies on executor state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelcast.functions.calendar import Grain

Recompute = Callable[[DataFrame], DataFrame]


def touched_periods(store: DataFrame, batch_id: int, period: str) -> list:
    """Periods a stored batch has rows of, from its folders; the calendar bounds their number."""
    own = store.where(F.col("_batch") == F.lit(batch_id))
    return [r[0] for r in own.select(period).distinct().collect()]


def absorb(
    batch: DataFrame,
    batch_id: int,
    grain: Grain,
    ts: str,
    recompute: Recompute,
    store: str,
    target: str,
) -> None:
    """Add one micro-batch and bring the touched periods up to date.

    The batch is read once, when it is stored; its rows are gathered by period in tasks
    of about equal size, however many rows one period has.
    """
    spark: SparkSession = batch.sparkSession
    dated = batch.where(F.col(ts).isNotNull()).withColumn(grain.period, grain.bucket(F.col(ts)))
    (
        dated.hint("rebalance", F.col(grain.period))
        .withColumn("_batch", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(grain.period, "_batch")
        .parquet(store)
    )
    stored = spark.read.schema(dated.schema.add("_batch", "long")).parquet(store)
    periods = touched_periods(stored, batch_id, grain.period)
    if not periods:
        return
    known = stored.drop("_batch").where(F.col(grain.period).isin(periods))
    (
        recompute(known)
        .repartition(grain.period)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(grain.period)
        .parquet(target)
    )


def follow(
    arrivals: DataFrame,
    grain: Grain,
    ts: str,
    recompute: Recompute,
    store: str,
    target: str,
    progress: str,
) -> StreamingQuery:
    """Process everything that has arrived, then stop; a rerun goes on from ``progress``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        absorb(batch, batch_id, grain, ts, recompute, store, target)

    return (
        arrivals.writeStream.foreachBatch(step)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def daily_sums(grain: Grain, keys: list[str], value: str) -> Recompute:
    """Rows and sum of a value per period and series, for :func:`follow`."""

    def recompute(known: DataFrame) -> DataFrame:
        return known.groupBy(grain.period, *keys).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(value).alias("total")
        )

    return recompute
