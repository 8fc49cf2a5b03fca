"""Registered queries against their SQL on the smallest tables."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# One or two queries of each section; ``python -m tests.oracle`` runs all of them.
SAMPLE = [
    "a03_period_round_trip", "b13_clean_trailing", "c01_orders_with_three_tables", "c07_compare_totals_by_nation",
    "d11_monthly_table", "d11_monthly_table_by_brand", "d12_daily_table_by_nation", "d17_correlation_with_target",
    "e08_ema_monthly_by_nation", "e13_feature_frame_monthly", "f03_day_flags", "g06_leaderboard_by_nation",
    "h01_append_forecast", "i05_folds_by_nation", "j02_correlation_filter", "k03_ridge_backtest_by_nation",
    "k09_best_penalty_by_nation", "k14_recursive_by_nation", "l09_all_measures", "m02_summary_by_nation",
    "n03_bias_runs_by_nation", "n06_population_drift", "o01_arriving_events",
]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_inventory_is_covered():
    sections = {"a": 8, "b": 13, "c": 8, "d": 18, "e": 14, "f": 9, "g": 6, "h": 3, "i": 6, "j": 8, "k": 15,
                "l": 9, "m": 3, "n": 6, "o": 1}
    have = {m[0] for q in QUERIES if (m := re.match(r"[a-z]\d\d", q))}
    # G01 (order) is part of every window query, G02 (top per group) is D06.
    want = {f"{s}{i:02d}" for s, n in sections.items() for i in range(1, n + 1)} - {"g01", "g02"}
    assert want <= have, sorted(want - have)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], SQL[name], SF) == ""


def test_python_workers_do_not_need_the_package(tmp_path):
    """Loaded by path from another folder, queries with Python tasks still run."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    script = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("given", {root!r} + "/__spark_entry__.py")
given = importlib.util.module_from_spec(spec)
spec.loader.exec_module(given)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("k03_ridge_coefficients", "k14_recursive"):
    assert given.queries()[name](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, timeout=240)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
