"""Raw facts that arrive in any order, against the table built from all of them at once."""

import datetime as dt

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from panelcast.functions.calendar import MONTH, Bounds
from panelcast.plans.period_tables import monthly_table
from panelcast.session import staging_path
from panelcast.sources.facts import Facts
from panelcast.streaming.raw_facts import LINES, MonthlyFollower, tagged

KINDS = {
    "orders": "order_id string, customer_id string, order_purchase_timestamp string",
    "payments": "order_id string, payment_value double, payment_installments int",
    "reviews": "order_id string, review_score int",
    "items": "order_id string, order_item_id int, product_id string, seller_id string, freight_value double",
    "customers": "customer_id string, customer_unique_id string, region string",
    "products": "product_id string, product_category_name string",
}
CUSTOMERS = [("c1", "u1", "north"), ("c2", "u1", "south"), ("c3", "u2", "north")]
PRODUCTS = [("p1", "toys"), ("p2", "books"), ("p3", None)]

# (table, row) in the order of arrival, a list per delivery
DELIVERIES = [
    [
        ("payments", ("o1", 10.5, 1)),  # before its order
        ("items", ("o4", 1, "p1", "s1", 2.0)),  # before its order
        ("orders", ("o2", "c2", "2020-01-09 10:00:00")),
        ("items", ("o2", 1, "p2", "s2", 1.0)),
        ("payments", ("o9", 1e6, 1)),  # its order never comes
        ("orders", ("o8", "c3", "not a date")),
        ("payments", (None, 5.0, 1)),
    ],
    [
        ("orders", ("o1", "c1", "2020-01-05 10:00:00")),
        ("orders", ("o3", "c3", "2020-03-05 10:00:00")),
        ("orders", ("o4", "c1", "2020-02-05 10:00:00")),
        ("items", ("o3", 1, "p1", "s1", 2.0)),
        ("items", ("o3", 2, "p1", "s3", 2.0)),
        ("reviews", ("o3", 4)),
        ("payments", ("o3", 7.0, 3)),
    ],
    [
        # late: January's top category turns, and sellers s1 and s3 were first seen earlier than thought
        ("items", ("o1", 1, "p1", "s1", 1.0)),
        ("items", ("o1", 2, "p1", "s3", 1.0)),
        ("payments", ("o1", 4.5, 2)),
        ("reviews", ("o2", 2)),
        ("orders", ("o1", "c1", "2020-01-05 10:00:00")),  # sent again
    ],
]


def frames(spark, rows):
    return {n: spark.createDataFrame([r for t, r in rows if t == n], KINDS[n]) for n in ("orders", *LINES)}


def facts_of(spark, rows):
    dims = {"customers": spark.createDataFrame(CUSTOMERS, KINDS["customers"]), "products": spark.createDataFrame(PRODUCTS, KINDS["products"])}
    return Facts(**frames(spark, rows), **dims)


def once(rows):
    return list(dict.fromkeys(rows))


def same(got, want):
    columns = want.columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


@pytest.mark.parametrize("keys", [[], ["region"]])
def test_every_delivery_gives_the_table_of_all_facts(spark, keys):
    follower = MonthlyFollower(facts_of(spark, []), keys, staging_path(spark, "follower"))
    seen = []
    changed = []
    for number, rows in enumerate(DELIVERIES):
        seen += rows
        changed.append(follower.absorb(tagged(frames(spark, rows)), number))
        if number == 2:
            follower.absorb(tagged(frames(spark, rows)), number)  # replayed
        same(follower.table(), monthly_table(facts_of(spark, once(seen)), None, keys))
    # the last delivery has lines of January alone; sellers leave February and March
    assert changed[2] == [dt.date(2020, m, 1) for m in (1, 2, 3)]
    january = follower.table().where("month = '2020-01-01'").agg(F.max("top_category"), F.sum("new_sellers")).first()
    assert january[0] == "toys" and january[1] >= 3
    same(
        follower.table(Bounds(before=dt.date(2020, 3, 1))),
        monthly_table(facts_of(spark, once(seen)), Bounds(before=dt.date(2020, 3, 1)), keys),
    )


def test_replay_after_a_crash_between_steps(spark, monkeypatch):
    """The sightings are replaced, then the batch dies; the months that sellers left are still brought up to date."""
    follower = MonthlyFollower(facts_of(spark, []), [], staging_path(spark, "follower"))
    for number, rows in enumerate(DELIVERIES[:2]):
        follower.absorb(tagged(frames(spark, rows)), number)

    def die(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(MonthlyFollower, "_count_new_sellers", die)
    with pytest.raises(RuntimeError):
        follower.absorb(tagged(frames(spark, DELIVERIES[2])), 2)
    monkeypatch.undo()
    follower.absorb(tagged(frames(spark, DELIVERIES[2])), 2)
    same(follower.table(), monthly_table(facts_of(spark, once(sum(DELIVERIES, []))), None, []))


def test_only_touched_months_are_read_again(spark):
    follower = MonthlyFollower(facts_of(spark, []), [], staging_path(spark, "follower"))
    for number, rows in enumerate(DELIVERIES):
        follower.absorb(tagged(frames(spark, rows)), number)
    assert follower.absorb(tagged(frames(spark, [("payments", ("o3", 1.0, 1))])), 3) == [dt.date(2020, 3, 1)]
    lines = follower._filed("lines", follower.lines).where(F.col(MONTH.period).isin([dt.date(2020, 3, 1)]))
    assert "PartitionFilters: [isnotnull(month" in lines._jdf.queryExecution().executedPlan().toString()
    assert follower.absorb(tagged(frames(spark, [])), 4) == []


def test_series_by_product_are_refused(spark):
    with pytest.raises(ValueError):
        MonthlyFollower(facts_of(spark, []), ["product_category_name"], "nowhere")


def test_a_batch_reads_sightings_twice_and_writes_nothing_twice(spark, monkeypatch):
    """Top categories and new sellers each read the sightings once; lines meet their orders in one pass."""
    follower = MonthlyFollower(facts_of(spark, []), ["region"], staging_path(spark, "follower"))
    follower.absorb(tagged(frames(spark, DELIVERIES[0])), 0)
    follower.absorb(tagged(frames(spark, DELIVERIES[1])), 1)
    written, scans = [], 0
    write = DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        nonlocal scans
        written.append(path.removeprefix(follower.folder + "/"))
        plan = self._df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n")
        files = [f for f in self._df.inputFiles() if "/seen" in f]
        scans += plan.count("first_ts") if files else 0
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    follower.absorb(tagged(frames(spark, DELIVERIES[2])), 2)
    assert written == ["orders", "lines", "core", "seen", "tops", "fresh-2", "moved/2", "fresh"]
    assert scans == 2


def test_lines_of_unknown_orders_wait_in_the_newest_batch_alone(spark):
    follower = MonthlyFollower(facts_of(spark, []), [], staging_path(spark, "follower"))
    for number, rows in enumerate(DELIVERIES):
        follower.absorb(tagged(frames(spark, rows)), number)
    waiting = follower._filed("lines", follower.lines).where("month is null")
    assert sorted(r[0] for r in waiting.where("_batch = 2").select("order_id").collect()) == ["o9"]
    assert waiting.where("_batch = 0").count() == 0
    follower.absorb(tagged(frames(spark, [("orders", ("o9", "c3", "2020-01-20 10:00:00"))])), 3)
    same(
        follower.table(),
        monthly_table(facts_of(spark, once([*sum(DELIVERIES, []), ("orders", ("o9", "c3", "2020-01-20 10:00:00"))])), None, []),
    )


def test_lines_that_an_earlier_version_left_waiting_are_met(spark):
    follower = MonthlyFollower(facts_of(spark, []), [], staging_path(spark, "follower"))
    follower.absorb(tagged(frames(spark, DELIVERIES[0])), 0)
    more = [("payments", ("o3", 2.5, 1))]
    tagged(frames(spark, more)).where("_table <> 'orders'").select(*follower.lines.names).write.parquet(f"{follower.folder}/waiting/0")
    follower.absorb(tagged(frames(spark, DELIVERIES[1])), 1)
    same(follower.table(), monthly_table(facts_of(spark, once([*more, *DELIVERIES[0], *DELIVERIES[1]])), None, []))
