"""Plans of bucketed facts and of tables with a lower bound."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from panelcast.functions.calendar import MONTH, Bounds
from panelcast.operators import order_level
from panelcast.plans.period_tables import monthly_table
from panelcast.sources.layout import bucketed
from panelcast.sources.star_schema import retail_facts

SF = "/root/testdata/sf0.001"
ONE_MONTH = Bounds(dt.date(2001, 3, 1), dt.date(2001, 4, 1))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_order(plan):
    return re.findall(r"Exchange hashpartitioning\(order_id#", plan) + re.findall(r"Exchange hashpartitioning\([lo]_orderkey#", plan)


def test_bucketed_facts_are_never_shuffled_by_order(spark, no_broadcast):
    plain = retail_facts(spark, SF)
    stored = bucketed(plain, 8)
    rows = order_level.order_rows(stored, MONTH, [])
    assert len(by_order(plan_of(order_level.order_rows(plain, MONTH, [])))) == 2
    assert not by_order(plan_of(rows)) and "Bucketed: true" in plan_of(rows)
    # the whole monthly table: measures, categories and sightings
    table = monthly_table(stored, Bounds(before=dt.date(2001, 8, 1)))
    assert not by_order(plan_of(table))
    key = lambda r: r.month
    want = monthly_table(plain, Bounds(before=dt.date(2001, 8, 1)))
    assert sorted(table.collect(), key=key) == sorted(want.collect(), key=key)


def test_tables_without_a_wide_one_are_bucketed_each(spark, no_broadcast):
    plain = retail_facts(spark, SF)
    apart = type(plain)(plain.orders, plain.payments, plain.reviews, plain.items, plain.customers, plain.products)
    stored = bucketed(apart, 4)
    assert stored.lines is None
    got = order_level.payments_per_order(stored.payments)
    assert "Exchange" not in plan_of(got)
    assert got.agg(F.sum("payment_value")).first() == order_level.payments_per_order(plain.payments).agg(F.sum("payment_value")).first()


@pytest.mark.parametrize("keys", [[], ["nation"], ["brand"]])
def test_a_lower_bound_reaches_the_lines_before_they_are_grouped(spark, keys):
    facts = retail_facts(spark, SF)
    got = order_level.order_rows(facts, MONTH, keys, ONE_MONTH)
    plan = plan_of(got)
    # the first grouping of lines reads the semi-join, not the scan
    grouped = plan[plan.index("partial_sum(payment_value"):]
    assert "LeftSemi" in grouped.split("Exchange hashpartitioning")[0]
    kept = order_level.within(facts, order_level.dated_orders(facts, MONTH, ONE_MONTH))
    month = facts.orders.where("order_purchase_timestamp >= '2001-03-01' AND order_purchase_timestamp < '2001-04-01'")
    assert kept.lines.count() == facts.lines.join(month, "order_id").count() < facts.lines.count() / 20
    whole = order_level.order_rows(facts, MONTH, keys).where("month = '2001-03-01'")
    assert sorted(map(str, got.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_more_keys_than_may_be_sent_leave_the_lines_alone(spark, monkeypatch):
    facts = retail_facts(spark, SF)
    monkeypatch.setattr(order_level, "KEYS_SENT", 3)
    assert order_level.within(facts, facts.orders) is facts
