"""Daily counts and sums per series kept in Spark's state store, and no late event lost.

Additive metrics need no recomputation: one row of state per day and series is brought up
to date by each batch, and the watermark lets the state of old days go.  Events of such a
day that arrive later do not reach the state.  They are found by counting: every event is
also filed raw, by day, and the rows of a day's files (known from their footers) are
compared with the rows its state has seen.  Only days that differ are computed again from
the raw files, and their rows take the place of the state's; as the state of such a day is
gone, it never overrules them.

A run carries everything that has arrived through both queries and then closes the books.
After a failure at any point the next run goes on: both queries resume from their
checkpoints, replayed batches overwrite the folders they wrote, and days stay open for the
comparison until a run has noted them as closed.

Days are those of UTC.  Events without a timestamp are left out; a null series key is a
series of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.calendar import DAY
from panelcast.session import stage
from panelcast.sources.storage import exists, remove

_DATE = DAY.period


class DailySums:
    """row_count and total of ``value`` per day and series, below ``folder``; ``delay`` is the watermark's."""

    def __init__(self, spark: SparkSession, ts: str, series_keys: list[str], value: str, delay: str, folder: str):
        self.spark, self.ts, self.keys, self.value, self.delay = spark, ts, list(series_keys), value, delay
        self.folder = folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = self._path(name)
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _rows(self, stream: DataFrame) -> DataFrame:
        return stream.select(F.col(self.ts).cast("timestamp").alias("_ts"), *self.keys, self.value).where("_ts is not null")

    def _schema(self, rows: DataFrame) -> T.StructType:
        kind = T.DoubleType() if isinstance(rows.schema[self.value].dataType, (T.FloatType, T.DoubleType)) else None
        total = kind or rows.agg(F.sum(self.value)).schema[0].dataType
        fields = [rows.schema[k] for k in self.keys]
        return T.StructType([*fields, T.StructField("row_count", T.LongType()), T.StructField("total", total)])

    def _sums(self) -> list:
        return [F.count(F.lit(1)).alias("row_count"), F.sum(self.value).alias("total")]

    # --- the two queries ---------------------------------------------------------------

    def _file_raw(self, batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn(_DATE, F.to_date("_ts"))
            .hint("rebalance", F.col(_DATE))
            .withColumn("_batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_DATE, "_batch")
            .parquet(self._path("raw"))
        )

    def _note_state(self, batch: DataFrame, batch_id: int) -> None:
        """The state's rows that a batch changed, under the batch's number."""
        batch.write.mode("overwrite").parquet(self._path(f"state/_batch={batch_id}"))

    def run(self, stream: DataFrame) -> list:
        """Carry all that has arrived through, then close the books; gives the days computed again from the raw files."""
        rows = self._rows(stream)
        raw = rows.writeStream.foreachBatch(self._file_raw).option("checkpointLocation", self._path("progress/raw"))
        windowed = rows.withWatermark("_ts", self.delay).groupBy(F.window("_ts", "1 day").alias("_window"), *self.keys)
        state = windowed.agg(*self._sums()).select(F.to_date("_window.start").alias(_DATE), *self.keys, "row_count", "total")
        kept = state.writeStream.outputMode("update").foreachBatch(self._note_state).option("checkpointLocation", self._path("progress/state"))
        queries = [q.trigger(availableNow=True).start() for q in (raw, kept)]
        for q in queries:
            q.awaitTermination()
        return self._close(rows.schema, self._schema(rows))

    # --- closing the books --------------------------------------------------------------

    def _close(self, raw_schema: T.StructType, sums: T.StructType) -> list:
        with_batch = T.StructType([*raw_schema.fields, T.StructField(_DATE, T.DateType()), T.StructField("_batch", T.LongType())])
        raw = self._read("raw", with_batch)
        done = self._closed()
        days = [r[0] for r in raw.where(F.col("_batch") > done).select(_DATE).distinct().collect()]  # the calendar bounds them
        if not days:
            return []
        inside = F.col(_DATE).isin(days)
        dated = T.StructType([*sums.fields, T.StructField(_DATE, T.DateType())])
        seen = self._read("state", T.StructType([*dated.fields, T.StructField("_batch", T.LongType())])).where(inside)
        known = self._read("table", dated).where(inside).withColumn("_batch", F.lit(-1).cast("long"))
        newest = seen.unionByName(known).groupBy(_DATE, *self.keys).agg(
            F.max_by("row_count", "_batch").alias("row_count"), F.max_by("total", "_batch").alias("total")
        )
        newest = stage(newest, "daily-state")
        # footers tell how many rows a day's files hold: no column is read
        filed = raw.where(inside).groupBy(_DATE).agg(F.count(F.lit(1)).alias("filed"))
        held = newest.groupBy(_DATE).agg(F.sum("row_count").alias("held"))
        short = filed.join(held, _DATE, "left").where(~F.col("filed").eqNullSafe(F.col("held")))
        again = sorted(r[0] for r in short.select(_DATE).collect())
        last = raw.agg(F.max("_batch")).first()[0]
        rows = newest.select(*dated.names)
        if again:
            afresh = raw.where(F.col(_DATE).isin(again)).groupBy(_DATE, *self.keys).agg(*self._sums()).select(*dated.names)
            rows = rows.where(~F.col(_DATE).isin(again)).unionByName(afresh)
        (
            rows.hint("rebalance", F.col(_DATE))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_DATE)
            .parquet(self._path("table"))
        )
        self.spark.createDataFrame([(last,)], "batch long").coalesce(1).write.mode("overwrite").parquet(self._path(f"closed/{last:019d}"))
        remove(self.spark, self._path("state"))  # all of it stands in the table now
        return again

    def _closed(self) -> int:
        """The last raw batch whose days a run has closed."""
        path = self._path("closed")
        if not exists(self.spark, path):
            return -1
        return self.spark.read.schema("batch long").option("recursiveFileLookup", True).parquet(path).agg(F.max("batch")).first()[0]

    def table(self) -> DataFrame:
        """date, series keys, row_count and total of all events carried through."""
        return self.spark.read.parquet(self._path("table")).withColumn(_DATE, F.to_date(_DATE))
