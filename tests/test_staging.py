"""What is staged leaves no shuffle files; metrics written part by part equal those of one plan."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from panelcast.functions.calendar import MONTH, Bounds
from panelcast.operators import baselines
from panelcast.plans import forecast
from panelcast.plans.period_tables import monthly_metrics, staged_metrics
from panelcast.session import shared_folder, stage, staged
from panelcast.sources.facts import Facts
from panelcast.sources.storage import exists

ORDERS = [
    ("o1", "c1", "2020-01-05 10:00:00"), ("o2", "c2", "2020-01-09 23:59:59"), ("o3", "c3", "2020-02-20 00:00:00"),
    ("o3", "c3", "2020-02-20 00:00:00"),  # twice
    ("o4", "c1", "2020-03-01 08:00:00"), ("o5", "c2", "not a date"), ("o6", "c9", "2020-03-04 08:00:00"), (None, "c1", "2020-03-05 08:00:00"),
    ("o7", None, "2020-02-02 08:00:00"), ("o8", "c4", "2020-04-02 08:00:00"),
]
LINES = [
    ("o1", 10.5, 1, 5, 1, "p1", "s1", 1.0), ("o1", 2.5, 3, None, 2, "p2", "s2", 1.5), ("o2", 4.0, 2, 1, 1, "p2", "s1", 0.5),
    ("o3", 7.0, None, 3, 1, "p3", "s1", 2.0), ("o3", 7.0, None, 3, 1, "p3", "s1", 2.0), ("o4", 9.0, 1, 2, 1, None, "s3", 0.0),
    ("o5", 50.0, 1, 1, 1, "p1", "s9", 1.0), ("o7", None, 2, None, None, "p1", None, None), (None, 8.0, 1, 1, 1, "p1", "s1", 1.0),
    ("o8", 3.0, 1, 4, 1, "p1", "s4", 1.0),
]


@pytest.fixture
def facts(spark):
    lines = spark.createDataFrame(
        LINES,
        "order_id string, payment_value double, payment_installments int, review_score int, "
        "order_item_id int, product_id string, seller_id string, freight_value double",
    )
    return Facts(
        orders=spark.createDataFrame(ORDERS, "order_id string, customer_id string, order_purchase_timestamp string"),
        payments=lines.select("order_id", "payment_value", "payment_installments"),
        reviews=lines.select("order_id", "review_score"),
        items=lines.select("order_id", "order_item_id", "product_id", "seller_id", "freight_value"),
        customers=spark.createDataFrame(
            [("c1", "u1", "north"), ("c2", "u1", None), ("c3", "u2", "north"), ("c4", "u3", "south")],
            "customer_id string, customer_unique_id string, region string",
        ),
        products=spark.createDataFrame(
            [("p1", "toys", "x"), ("p2", "books", "y"), ("p3", None, "x")], "product_id string, product_category_name string, brand string"
        ),
        lines=lines,
    )


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_")}


def left(spark, before):
    """Shuffle files that came after ``before`` and stay; they are removed in the background."""
    until = time.time() + 10
    while (new := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return new


@pytest.mark.parametrize("keys", [[], ["region"], ["brand"]])
@pytest.mark.parametrize("bounds", [None, Bounds(dt.date(2020, 2, 1), dt.date(2020, 4, 1))])
def test_parts_written_one_by_one_give_the_metrics_of_one_plan(facts, keys, bounds):
    one, parts = monthly_metrics(facts, bounds, keys), staged_metrics(facts, bounds, keys)
    assert dict(one.dtypes) == dict(parts.dtypes)
    assert rows(parts) == rows(one) != []


def test_staging_leaves_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffle_files(spark)
    df.write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) - before
    before = shuffle_files(spark)
    copy = stage(df, "counts")
    assert left(spark, before) == set()
    assert rows(copy) == rows(df)


def test_a_simulation_leaves_neither_shuffles_nor_sightings(spark, facts):
    stage(spark.range(1), "first")
    folder = f"{shared_folder(spark).rstrip('/').removeprefix('file:')}/panelcast"
    earlier, before = set(os.listdir(folder)), shuffle_files(spark)
    naive = lambda table, keys: baselines.naive_ahead(table, MONTH, keys, 1)
    out = forecast.simulate_cutoffs(facts, [dt.date(2020, 3, 1)], ["region"], naive)
    assert left(spark, before) == set()
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - earlier} == {"core", "tops", "fresh", "metrics"}
    assert out.count() == 2


def test_a_staged_copy_goes_with_its_block_even_after_a_fault(spark):
    with staged(spark.range(3), "short") as copy:
        assert copy.count() == 3
        path = copy.inputFiles()[0].rsplit("/", 1)[0]
        assert exists(spark, path)
    assert not exists(spark, path)
    with pytest.raises(RuntimeError), staged(spark.range(3), "short") as copy:
        path = copy.inputFiles()[0].rsplit("/", 1)[0]
        raise RuntimeError("fault")
    assert not exists(spark, path)
