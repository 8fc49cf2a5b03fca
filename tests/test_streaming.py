import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from panelcast.functions.calendar import MONTH
from panelcast.operators.order_level import ORDER_TS
from panelcast.operators.rollup import roll_up
from panelcast.session import staging_path
from panelcast.streaming import incremental, sums


def facts(spark, days, start=0):
    rows = [
        (start + i, f"u{i % 3}", pd.Timestamp(d).to_pydatetime(), 10.0 + i, 2.0, 4.0, 1, 0.5) for i, d in enumerate(days)
    ]
    return spark.createDataFrame(
        rows,
        f"order_id long, customer_unique_id string, {ORDER_TS} timestamp, payment_value double, "
        "payment_installments double, review_score double, total_items long, total_freight double",
    )


def months(df):
    return roll_up(df, MONTH, [])


def test_late_facts_and_replay(spark):
    store, target = staging_path(spark, "store"), staging_path(spark, "target")
    first = facts(spark, ["2020-01-05", "2020-01-09", "2020-02-01"])
    late = facts(spark, ["2020-01-31", "2020-03-02"], start=100)
    for batch, number in ((first, 0), (late, 1), (late, 1)):  # the last batch is replayed
        incremental.absorb(batch, number, MONTH, ORDER_TS, months, store, target)
    got = spark.read.parquet(target).select("month", "monthly_revenue", "total_orders", "unique_customers", "active_days")
    every = first.unionByName(late).withColumn("month", F.trunc(ORDER_TS, "month"))
    want = months(every).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_touched_months_are_rewritten(spark):
    store, target = staging_path(spark, "store"), staging_path(spark, "target")
    incremental.absorb(facts(spark, ["2020-01-05", "2020-02-01"]), 0, MONTH, ORDER_TS, months, store, target)
    name = F.input_file_name()
    before = {r.month: r.f for r in spark.read.parquet(target).select("month", name.alias("f")).collect()}
    incremental.absorb(facts(spark, ["2020-02-20"], 9), 1, MONTH, ORDER_TS, months, store, target)
    after = {r.month: r.f for r in spark.read.parquet(target).select("month", name.alias("f")).collect()}
    january, february = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    assert before[january] == after[january] and before[february] != after[february]


def test_stream_resumes(spark):
    arrivals = staging_path(spark, "arrivals")
    paths = [staging_path(spark, n) for n in ("store", "target", "progress")]
    schema = facts(spark, ["2020-01-01"]).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        incremental.follow(stream, MONTH, ORDER_TS, months, *paths).awaitTermination()
        return spark.read.parquet(paths[1]).agg(F.sum("total_orders")).first()[0]

    facts(spark, ["2020-01-05", "2020-02-01"]).coalesce(1).write.mode("append").parquet(arrivals)
    assert run() == 2
    facts(spark, ["2020-01-06", "2020-02-01", "2020-02-09"], 50).coalesce(1).write.mode("append").parquet(arrivals)
    assert run() == 5
    assert run() == 5


# --- sums in the state store ---------------------------------------------------------

EVENTS = "ts timestamp, kind string, value double"


def deliver(spark, folder, rows):
    stamped = [(pd.Timestamp(t).to_pydatetime() if t else None, k, v) for t, k, v in rows]
    spark.createDataFrame(stamped, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_sums_from_the_state_store(spark):
    arrivals, folder = staging_path(spark, "arrivals"), staging_path(spark, "sums")
    every = []

    def run(rows):
        every.extend(rows)
        deliver(spark, arrivals, rows)
        # a new object each time: all it knows comes from the folder
        follower = sums.DailySums(spark, "ts", ["kind"], "value", "1 day", folder)
        again = follower.run(spark.readStream.schema(EVENTS).parquet(arrivals))
        whole = spark.createDataFrame([(pd.Timestamp(t).date(), k, v) for t, k, v in every if t], "date date, kind string, value double")
        want = whole.groupBy("date", "kind").agg(F.count("*").alias("row_count"), F.sum("value").alias("total"))
        key = lambda r: (r[0], str(r[1]))
        columns = ["date", "kind", "row_count", "total"]
        got = sorted(map(tuple, follower.table().select(*columns).collect()), key=key)
        assert got == sorted(map(tuple, want.select(*columns).collect()), key=key)
        return again

    assert run([("2020-01-01 10:00", "a", 1.0), ("2020-01-01 23:59:59", "b", 2.0), (None, "a", 9.0)]) == []
    # the day is still open: its state comes back from the checkpoint, nothing is computed again
    assert run([("2020-01-01 11:00", "a", 4.0), ("2020-01-02 00:00", "a", 8.0), ("2020-01-02 01:00", None, 16.0)]) == []
    assert run([("2020-01-09 00:00", "a", 32.0)]) == []
    # the first two days are closed by now: their late events are found by counting
    late = run([("2020-01-01 12:00", "c", 64.0), ("2020-01-09 05:00", "a", 128.0), ("2020-01-02 12:00", "a", 256.0)])
    assert late == [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    assert run([("2020-01-01 13:00", "c", 512.0)]) == [dt.date(2020, 1, 1)]
    assert sums.DailySums(spark, "ts", ["kind"], "value", "1 day", folder).run(spark.readStream.schema(EVENTS).parquet(arrivals)) == []


def test_books_left_open_are_closed_by_the_next_run(spark, monkeypatch):
    arrivals, folder = staging_path(spark, "arrivals"), staging_path(spark, "sums")
    deliver(spark, arrivals, [("2020-01-01 10:00", "a", 1.0), ("2020-01-03 10:00", "a", 2.0)])
    follower = sums.DailySums(spark, "ts", ["kind"], "value", "1 hour", folder)
    monkeypatch.setattr(sums.DailySums, "_close", lambda *_: [])
    follower.run(spark.readStream.schema(EVENTS).parquet(arrivals))
    monkeypatch.undo()
    follower.run(spark.readStream.schema(EVENTS).parquet(arrivals))
    assert sorted((str(r.date), r.total) for r in follower.table().collect()) == [("2020-01-01", 1.0), ("2020-01-03", 2.0)]
