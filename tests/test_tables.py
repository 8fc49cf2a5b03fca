"""Period tables from raw files against plain pandas; skewed facts; plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAY, MONTH, Bounds
from panelcast.operators import order_level, rollup
from panelcast.plans.period_tables import daily_table, monthly_table
from panelcast.session import staging_path
from panelcast.sources import storage
from panelcast.sources.facts import RAW_SCHEMAS, Facts, read_raw_csv, table_sizes
from panelcast.sources.star_schema import retail_facts

SF = "/root/testdata/sf0.001"


def raw_frames():
    orders = [
        ("o1", "c1", "2020-01-05 10:00:00"),
        ("o2", "c2", "2020-01-05 23:59:59"),
        ("o3", "c3", "2020-01-20 00:00:00"),
        ("o4", "c1", "2020-03-01 08:00:00"),  # no February
        ("o5", "c4", "not a date"),
        ("o6", "c4", None),
        ("o7", "c9", "2020-03-04 08:00:00"),  # unknown customer, no payment, no review, no item
        ("o8", "c2", "2020-04-01 00:00:00"),  # incomplete month
    ]
    payments = [("o1", 1, 10.5), ("o1", 3, 20.25), ("o2", 2, 5.0), ("o3", 4, 7.75), ("o4", 1, 100.0),
                ("o5", 1, 50.0), ("o8", 1, 999.0), (None, 9, 1e6)]
    reviews = [("o1", 5), ("o1", 2), ("o3", 1), ("o4", 4), ("o5", 1), (None, 1)]
    items = [("o1", 1, "p1", "s1", 1.5), ("o1", 2, "p2", "s2", 2.5), ("o2", 1, "p2", "s1", 1.0),
             ("o3", 1, "p1", "s3", 0.5), ("o4", 1, "p3", "s1", 9.0), ("o5", 1, "p1", "s9", 3.0),
             ("o8", 1, "p1", "s4", 1.0), ("o4", 2, "p9", "s5", 1.0)]
    return {
        "orders": pd.DataFrame(orders, columns=["order_id", "customer_id", "order_purchase_timestamp"]),
        "payments": pd.DataFrame(payments, columns=["order_id", "payment_installments", "payment_value"]),
        "reviews": pd.DataFrame(reviews, columns=["order_id", "review_score"]),
        "items": pd.DataFrame(items, columns=["order_id", "order_item_id", "product_id", "seller_id", "freight_value"]),
        "customers": pd.DataFrame(
            [("c1", "u1"), ("c2", "u1"), ("c3", "u2"), ("c4", "u3")], columns=["customer_id", "customer_unique_id"]
        ),
        "products": pd.DataFrame(
            [("p1", "toys"), ("p2", "books"), ("p3", None)], columns=["product_id", "product_category_name"]
        ),
    }


@pytest.fixture
def raw(spark, tmp_path):
    for name, pdf in raw_frames().items():
        fields = RAW_SCHEMAS[name].fieldNames()
        pdf.reindex(columns=fields).to_csv(tmp_path / f"{name}.csv", index=False)
    return read_raw_csv(spark, str(tmp_path), {n: f"{n}.csv" for n in raw_frames()})


def test_monthly_from_csv(raw):
    out = monthly_table(Facts.from_raw(raw), Bounds(before=dt.date(2020, 4, 1))).orderBy("month").toPandas()
    assert [str(m) for m in out["month"]] == ["2020-01-01", "2020-03-01"]
    assert list(out["monthly_revenue"]) == [43.5, 100.0]
    assert list(out["total_orders"]) == [3, 2]
    assert list(out["avg_review_score"]) == [(3.5 + 1) / 2, 4.0]
    assert list(out["active_days"]) == [2, 2]
    assert list(out["total_items"]) == [4, 2]
    assert list(out["total_freight"]) == [5.5, 10.0]
    assert list(out["unique_customers"]) == [2, 1]  # c1 and c2 are one person, c9 is unknown
    assert list(out["avg_installments"]) == [(2 + 2 + 4) / 3, 1.0]
    assert out["top_category"][0] == "books" and out["top_category"][1] is None  # tie; no known category
    assert list(out["new_sellers"]) == [3, 1]
    assert list(out["month_num"]) == [1, 3]


def test_daily_from_csv(raw):
    out = daily_table(Facts.from_raw(raw), Bounds.through(None, dt.date(2020, 3, 31))).orderBy("date").toPandas()
    assert len(out) == (dt.date(2020, 3, 4) - dt.date(2020, 1, 5)).days + 1
    assert out["daily_revenue"].sum() == 143.5 and (out["daily_revenue"] == 0).sum() == len(out) - 3
    assert out["avg_review_score"].notna().all()
    assert out["avg_review_score"].iloc[1] == 3.5 and out["avg_review_score"].iloc[-1] == 4.0
    assert out["day_of_week"].iloc[0] == 6


def test_sizes(raw):
    sizes = {r.table_name: r.row_count for r in table_sizes(raw).collect()}
    assert sizes["orders"] == 8 and sizes["items"] == 8


def test_median_fills_a_month_without_reviews(spark, raw):
    kept = raw | {"reviews": raw["reviews"].where("order_id <> 'o4'")}
    out = monthly_table(Facts.from_raw(kept), Bounds(before=dt.date(2020, 4, 1))).orderBy("month").toPandas()
    assert list(out["avg_review_score"]) == [2.25, 2.25]


def test_bounds_must_be_months(raw):
    with pytest.raises(ValueError):
        monthly_table(Facts.from_raw(raw), Bounds(before=dt.date(2020, 4, 2)))


def test_lower_bound_keeps_first_sightings(raw):
    out = monthly_table(Facts.from_raw(raw), Bounds(dt.date(2020, 3, 1), dt.date(2020, 4, 1))).toPandas()
    assert list(out["new_sellers"]) == [1]  # s1 was seen in January


def test_series_by_product_needs_lines(raw):
    facts = Facts.from_raw(raw | {"products": raw["products"].withColumn("brand", F.lit("b"))})
    with pytest.raises(ValueError):
        monthly_table(facts, None, ["brand"])
    with pytest.raises(ValueError):
        monthly_table(Facts.from_raw(raw), None, ["nope"])


def test_series_add_up(spark):
    facts, bounds = retail_facts(spark, SF), Bounds(before=dt.date(2001, 8, 1))
    whole = monthly_table(facts, bounds).agg(F.sum("monthly_revenue"), F.sum("total_orders")).first()
    by_nation = monthly_table(facts, bounds, ["nation"]).agg(F.sum("monthly_revenue"), F.sum("total_orders")).first()
    by_brand = monthly_table(facts, bounds, ["brand"]).agg(F.sum("monthly_revenue")).first()
    assert whole[0] == pytest.approx(by_nation[0]) == pytest.approx(by_brand[0])
    assert whole[1] == by_nation[1]


def test_hot_keys(spark):
    """One order, one customer, one product and one period hold most rows."""
    rng = np.random.default_rng(3)
    n = 30_000
    hot = rng.random(n) < 0.4
    lines = pd.DataFrame(
        {
            "order_id": np.where(hot, 0, rng.integers(1, 4000, n)),
            "order_item_id": 1,
            "product_id": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 300, n)),
            "seller_id": rng.integers(0, 50, n),
            "payment_value": rng.integers(1, 1000, n).astype(float),
            "payment_installments": rng.integers(1, 9, n).astype(float),
            "review_score": rng.integers(1, 6, n),
            "freight_value": rng.integers(1, 50, n).astype(float),
        }
    )
    orders = pd.DataFrame({"order_id": np.arange(4000)})
    orders["customer_id"] = np.where(rng.random(4000) < 0.4, -1, rng.integers(0, 500, 4000))
    day = np.where(rng.random(4000) < 0.4, 3, rng.integers(0, 300, 4000))
    orders["order_purchase_timestamp"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(day, unit="D")
    customers = pd.DataFrame({"customer_id": np.arange(-1, 500)})
    customers["customer_unique_id"] = "u" + (customers["customer_id"] // 2).astype(str)
    products = pd.DataFrame({"product_id": np.arange(300)})
    products["product_category_name"] = "cat" + (products["product_id"] % 7).astype(str)

    def frame(p):
        return spark.createDataFrame(p)

    wide = frame(lines)
    facts = Facts(
        frame(orders),
        wide.select("order_id", "payment_value", "payment_installments"),
        wide.select("order_id", "review_score"),
        wide.select("order_id", "order_item_id", "product_id", "seller_id", "freight_value"),
        frame(customers),
        frame(products),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ours = monthly_table(facts).orderBy("month").toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    per_order = lines.groupby("order_id").agg(
        pv=("payment_value", "sum"), pi=("payment_installments", "mean"), rs=("review_score", "mean"),
        ti=("order_item_id", "count"), tf=("freight_value", "sum"),
    )
    o = orders.join(per_order, on="order_id").merge(customers, on="customer_id")
    o["month"] = o["order_purchase_timestamp"].dt.to_period("M").dt.to_timestamp()
    want = o.groupby("month").agg(
        r=("pv", "sum"), n=("order_id", "count"), s=("rs", "mean"),
        d=("order_purchase_timestamp", "nunique"), c=("customer_unique_id", "nunique"), i=("pi", "mean"),
    )
    np.testing.assert_allclose(ours["monthly_revenue"], want["r"])
    np.testing.assert_allclose(ours["avg_review_score"], want["s"])
    np.testing.assert_allclose(ours["avg_installments"], want["i"])
    assert list(ours["total_orders"]) == list(want["n"])
    assert list(ours["active_days"]) == list(want["d"])
    assert list(ours["unique_customers"]) == list(want["c"])
    m = lines.merge(o[["order_id", "month"]], on="order_id").merge(products, on="product_id")
    counts = m.groupby(["month", "product_category_name"]).size().reset_index(name="k")
    top = counts.sort_values(["month", "k"], ascending=[True, False], kind="stable").drop_duplicates("month")
    assert list(ours["top_category"]) == list(top["product_category_name"])
    first = m.merge(o[["order_id", "order_purchase_timestamp"]], on="order_id").groupby("seller_id")["month"].min()
    assert ours["new_sellers"].sum() == 50 and ours["new_sellers"].iloc[0] == (first == first.min()).sum()


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_customer_is_split_at_run_time(spark):
    """A customer with most orders, and no broadcast: the join splits its partition."""
    n = 60_000
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 3000, n))
    orders = spark.createDataFrame(
        pd.DataFrame(
            {
                "order_id": np.arange(n),
                "customer_id": ids,
                "order_purchase_timestamp": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n) % 300, unit="D"),
            }
        )
    ).repartition(16)
    customers = spark.createDataFrame(
        pd.DataFrame({"customer_id": np.arange(3000), "customer_unique_id": [f"u{i // 2}" for i in range(3000)]})
    )
    empty = orders.limit(0)
    facts = Facts(orders, empty, empty, empty, customers, empty)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = order_level.with_customers(order_level.dated_orders(facts, MONTH), facts, [])
        counts = joined.groupBy("customer_unique_id").agg(
            F.count("order_id").alias("count"), F.max(order_level.ORDER_TS), F.sum("order_id")
        )
        got = {r.customer_unique_id: r["count"] for r in counts.collect()}
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "skew=true" in plan
    want = pd.Series(ids // 2).map(lambda i: f"u{i}").value_counts().to_dict()
    assert got == want


def test_plans(spark):
    facts, bounds = retail_facts(spark, SF), Bounds(before=dt.date(2001, 8, 1))
    plan = executed(monthly_table(facts, bounds, ["nation"]))
    assert "LessThan(o_orderdate,2001-08-01" in plan
    assert "ReusedExchange" in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF"):
        assert bad not in plan
    daily = executed(daily_table(facts, bounds, ["nation"]))
    assert daily.count("lineitem.parquet") <= 2  # one scan, named at most twice by adaptive plans


def test_order_measures_scan_once(spark):
    facts = retail_facts(spark, SF)
    plan = order_level.order_measures(facts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_distinct_counts_are_exact(spark):
    orders = order_level.dated_orders(retail_facts(spark, SF), DAY)
    ours = rollup.distinct_per_group(orders, ["date"], "customer_id", "n")
    want = orders.groupBy("date").agg(F.countDistinct("customer_id").alias("n"))
    assert ours.exceptAll(want).isEmpty() and want.exceptAll(ours).isEmpty()


def test_grain_labels():
    assert MONTH.period == "month" and DAY.revenue == "daily_revenue"


def test_stored_periods_are_pruned_by_year(spark):
    path = staging_path(spark, "periods")
    days = spark.sql("SELECT explode(sequence(DATE '2019-01-01', DATE '2021-12-31')) AS date, 1.0 AS daily_revenue")
    storage.write_periods(days, path, "date")
    table, name = storage.read_periods(spark, path, Bounds(dt.date(2020, 3, 1), dt.date(2020, 4, 1)))
    assert name == "date" and table.count() == 31 and table.columns == ["date", "daily_revenue"]
    plan = executed(table)
    assert "(period_year#" in plan and ">= 2020)" in plan.split("PartitionFilters")[1].split("]")[0]
    assert storage.read_periods(spark, path)[0].count() == days.count()


def test_newest_version_reads_its_folder_only(spark):
    path = staging_path(spark, "versions")
    for cutoff in ("2020-01-01", "2020-02-01"):
        storage.write_cutoff(spark.range(3).withColumn("v", F.lit(cutoff)), path, cutoff)
    newest = storage.read_cutoff(spark, path)
    assert {r.v for r in newest.collect()} == {"2020-02-01"}
    assert "= 2020-02-01)" in executed(newest).split("PartitionFilters")[1].split("]")[0]


def test_a_write_that_died_is_done_again(spark):
    folder = staging_path(spark, "raw")
    spark.range(2).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(f"{folder}/t")
    assert not storage.is_complete(spark, f"{folder}/t")
    for _ in range(2):
        assert storage.materialise_once({"t": spark.range(5)}, folder)["t"].count() == 5
    assert storage.materialise_once({"t": spark.range(9)}, folder)["t"].count() == 5
