"""Compare registered queries with their SQL on the driver's tables.

``python -m tests.oracle [prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return float(v) + 0.0
    return str(v)[:10] if hasattr(v, "year") else v


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def same(x, y) -> bool:
    """Equal; beyond the range where four decimals fit into a double, equal to 14 digits."""
    if isinstance(x, float) and isinstance(y, float) and abs(x) > 1e11:
        return math.isclose(x, y, rel_tol=1e-14)
    return x == y


def compare(spark, con, query, sql: str, folder: str) -> str:
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    if len(ours) != len(theirs):
        return f"rows differ: {len(ours)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(map(same, a, b))]
    if bad:
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if not same(x, y)]
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {cells[:4]} in {a[:3]}"
    return ""


def main(prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    stray = set(sqls) - set(queries)
    failed = [f"sql without query: {s}" for s in stray]
    for name, query in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, query, sqls[name], folder)
                kind = "sql"
            else:
                kind, problem = "rows", "" if query(spark, folder).count() else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            kind, problem = "error", f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{time.time() - start:6.1f}s {kind:5} {name} {problem or 'ok'}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
