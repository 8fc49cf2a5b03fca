"""Monthly table kept up to date while raw orders, payments, reviews and items arrive in any order.

A payment, review or item knows its order and not its month.  It waits until its order is
there and is then filed under the order's month, so that a correction reads the months it
touches and no others.  A batch is carried through in steps, each of which writes folders
named by the batch: a replayed batch overwrites what it wrote before.

1. New orders are filed by month; of rows that repeat an order the first to arrive counts.
2. Lines of the batch (payments, reviews and items in one wide table) meet all orders,
   lines that waited meet the new ones.  All are filed in one pass: matched lines by month,
   the others without a month, where they wait on.
3. The months touched are those of the new orders and of the filed lines.  Their order
   rows, core metrics, sightings (items per product and seller) and top categories are
   computed again from their own folders.
4. A seller whose first sighting moves changes the number of new sellers of the month it
   leaves and of the month it enters, wherever these are; so new sellers are counted from
   the sightings of all months, one row per seller, and the months whose counts are not
   those of before are replaced too.

Period tables have one folder per month, replaced as a whole.  The medians for missing
scores depend on all months and are taken when the table is read.  Undated orders are not
filed, and their lines wait for ever.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelcast.functions.calendar import MONTH, Bounds, month_table_columns
from panelcast.operators.cleaning import coerce_timestamps, drop_undated
from panelcast.operators.order_level import ORDER_TS, order_rows
from panelcast.operators.rollup import category_counts, new_entities, roll_up, sightings, top_category
from panelcast.plans.period_tables import imputed
from panelcast.session import shuffles_removed
from panelcast.sources.facts import Facts
from panelcast.sources.storage import exists, is_complete, remove

LINES = ("payments", "reviews", "items")
TABLE = "_table"

_PERIOD = MONTH.period
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # the name Spark gives to the folder of null


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """The arriving tables as one stream (or batch); ``_table`` tells them apart."""
    out = None
    for name, df in tables.items():
        rows = df.withColumn(TABLE, F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _period_last(schema: T.StructType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name != _PERIOD], T.StructField(_PERIOD, T.DateType())])


def _filed_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_PERIOD, T.DateType()), T.StructField("_batch", T.LongType())])


class MonthlyFollower:
    """Absorbs batches of raw facts below ``folder``; ``facts`` gives the dimensions and the columns of the raw tables."""

    def __init__(self, facts: Facts, series_keys: list[str], folder: str):
        facts = replace(facts, lines=None)
        facts.product_keys(series_keys)  # series by product would split an order, which lines alone cannot
        self.facts, self.keys, self.folder = facts, list(series_keys), folder.rstrip("/")
        self.spark: SparkSession = facts.orders.sparkSession
        self.orders = coerce_timestamps(facts.orders, [ORDER_TS]).schema
        self.lines = tagged({n: getattr(facts, n) for n in LINES}).schema

    # --- folders --------------------------------------------------------------------

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _file(self, df: DataFrame, name: str, batch_id: int) -> list:
        """Write rows under their month (or under none) and this batch; gives the months written."""
        path = self._path(name)
        (
            df.withColumn("_batch", F.lit(batch_id))
            .hint("rebalance", F.col(_PERIOD))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_PERIOD, "_batch")
            .parquet(path)
        )
        written = self._filed(name, df.drop(_PERIOD, "_batch").schema).where(F.col("_batch") == batch_id)
        return [r[0] for r in written.select(_PERIOD).distinct().collect() if r[0] is not None]

    def _filed(self, name: str, schema: T.StructType) -> DataFrame:
        """Rows by month and batch; none before the first are filed."""
        full, path = _filed_schema(schema), self._path(name)
        return self.spark.read.schema(full).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], full)

    def _replace(self, df: DataFrame, name: str) -> None:
        """Period-grain rows take the place of their months' folders."""
        (
            df.repartition(_PERIOD)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_PERIOD)
            .parquet(self._path(name))
        )

    def _kept(self, name: str, schema: T.StructType) -> DataFrame:
        """A period table as it stands; nothing before its first batch."""
        full = _period_last(schema)
        path = self._path(name)
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(path)

    # --- one batch ------------------------------------------------------------------

    def absorb(self, batch: DataFrame, batch_id: int) -> list:
        """Bring the tables up to date with a batch of :func:`tagged` rows; gives the months changed."""
        orders = batch.where(F.col(TABLE) == "orders").select(*self.facts.orders.columns)
        lines = batch.where(F.col(TABLE).isin(*LINES)).select(*self.lines.names)
        with shuffles_removed(self.spark), shuffles_removed(batch.sparkSession):
            touched = {*self._file_orders(orders, batch_id), *self._file_lines(lines, batch_id)}
            changed = self._recompute(sorted(touched), batch_id) if touched else []
        # this batch's copy holds all that still waits
        remove(self.spark, self._path(f"lines/{_PERIOD}={_NO_MONTH}/_batch={batch_id - 2}"))
        return changed

    def _known_orders(self) -> DataFrame:
        return self._filed("orders", self.orders)

    def _file_orders(self, orders: DataFrame, batch_id: int) -> list:
        names = orders.columns
        dated = drop_undated(coerce_timestamps(orders, [ORDER_TS]), ORDER_TS).where(F.col("order_id").isNotNull())
        first = F.min(F.struct(ORDER_TS, *[c for c in names if c not in ("order_id", ORDER_TS)])).alias("row")
        once = dated.groupBy("order_id").agg(first).select("order_id", "row.*").select(*names)
        earlier = self._known_orders().where(F.col("_batch") < batch_id).select("order_id")
        fresh = once.join(earlier, "order_id", "left_anti")
        return self._file(fresh.withColumn(_PERIOD, MONTH.bucket(F.col(ORDER_TS))), "orders", batch_id)

    def _file_lines(self, lines: DataFrame, batch_id: int) -> list:
        orders = self._known_orders().where(F.col("_batch") <= batch_id)
        known = orders.select("order_id", _PERIOD)
        fresh = orders.where(F.col("_batch") == batch_id).select("order_id", _PERIOD)
        arrived = lines.where(F.col("order_id").isNotNull())
        # what waited has met all earlier orders already; an order is filed once, so no line doubles
        met = arrived.join(known, "order_id", "left").unionByName(self._waiting(batch_id).join(fresh, "order_id", "left"))
        return self._file(met.select(*lines.columns, _PERIOD), "lines", batch_id)

    def _waiting(self, batch_id: int) -> DataFrame:
        """What the batch before left waiting."""
        filed = self._filed("lines", self.lines).where(F.col(_PERIOD).isNull() & (F.col("_batch") == batch_id - 1))
        apart = self._path(f"waiting/{batch_id - 1}")  # where folders written by earlier versions keep them
        lines = filed.select(*self.lines.names)
        return lines.unionByName(self.spark.read.schema(self.lines).parquet(apart)) if is_complete(self.spark, apart) else lines

    def _recompute(self, months: list, batch_id: int) -> list:
        inside = F.col(_PERIOD).isin(months)
        orders = self._known_orders().where(inside)
        lines = self._filed("lines", self.lines).where(inside)
        own = replace(
            self.facts,
            orders=orders.select(*self.facts.orders.columns),
            lines=lines.drop(TABLE, _PERIOD, "_batch"),
            **{n: lines.where(F.col(TABLE) == n).select(*getattr(self.facts, n).columns) for n in LINES},
        )
        core = roll_up(order_rows(own, MONTH, self.keys), MONTH, self.keys)
        seen = sightings(own, MONTH, self.keys)
        self._replace(core, "core")
        self._replace(seen, "seen")
        now = self._kept("seen", seen.schema).where(inside)
        self._replace(top_category(category_counts(now, self.facts, MONTH, self.keys), [*self.keys, _PERIOD]), "tops")
        return self._count_new_sellers(months, core.schema, seen.schema, batch_id)

    def _count_new_sellers(self, months: list, core_schema, seen_schema, batch_id: int) -> list:
        """Count new sellers again; gives ``months`` and the others whose counts change.

        The sightings of all months are read once and grouped to one row per seller.  What is
        compared and written after that has one row per series and month.
        """
        on = [*self.keys, _PERIOD]
        counts = new_entities(self._kept("seen", seen_schema), self.facts, MONTH, self.keys)
        rows = self._kept("core", core_schema).select(*on)
        path = self._path(f"fresh-{batch_id}")
        rows.join(counts, on, "left").na.fill(0, subset=["new_sellers"]).write.mode("overwrite").parquet(path)
        schema = T.StructType([*rows.schema.fields, *counts.select("new_sellers").schema.fields])
        now, before = self.spark.read.schema(schema).parquet(path), self._kept("fresh", schema)
        same = [F.col(f"now.{c}").eqNullSafe(F.col(f"before.{c}")) for c in (*on, "new_sellers")]
        other = now.alias("now").join(before.alias("before"), same, "left_anti")
        moved = {r[0] for r in other.select(_PERIOD).distinct().collect()}
        changed = sorted({*months, *self._noted(moved, batch_id)})
        self._replace(now.where(F.col(_PERIOD).isin(changed)), "fresh")
        remove(self.spark, path)
        return changed

    def _noted(self, moved: set, batch_id: int) -> set:
        """``moved``, and what this batch noted before it was replayed; noted before the counts are replaced."""
        note = self._path(f"moved/{batch_id}")
        if is_complete(self.spark, note):
            moved = moved | {r[0] for r in self.spark.read.schema("month date").parquet(note).collect()}
        self.spark.createDataFrame([(m,) for m in sorted(moved)], "month date").coalesce(1).write.mode("overwrite").parquet(note)
        return moved

    # --- reading and streaming --------------------------------------------------------

    def table(self, bounds: Bounds | None = None) -> DataFrame:
        """The monthly table of all that has been absorbed, or of the months within ``bounds``."""
        on = [*self.keys, _PERIOD]
        read = lambda name: self.spark.read.parquet(self._path(name)).withColumn(_PERIOD, F.to_date(_PERIOD))
        core = read("core") if bounds is None else bounds.check(MONTH).keep(read("core"), _PERIOD)
        every = core.join(read("tops"), on, "left").join(read("fresh"), on, "left")
        every = every.withColumn("new_sellers", F.coalesce("new_sellers", F.lit(0).cast("bigint")))
        return imputed(every.withColumns(month_table_columns(F.col(_PERIOD))), self.keys)

    def follow(self, arrivals: DataFrame) -> StreamingQuery:
        """Absorb everything that has arrived in a stream of :func:`tagged` rows, then stop; a rerun goes on."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.absorb(batch, batch_id)

        return (
            arrivals.writeStream.foreachBatch(step)
            .option("checkpointLocation", self._path("progress"))
            .trigger(availableNow=True)
            .start()
        )
