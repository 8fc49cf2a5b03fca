"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour to the smallest neighbour: all larger ones, or the node and all smaller ones."""
    if large:
        rows = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = rows.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        rows = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = rows.groupBy("a").agg(F.min("b").alias("m"))
        met = rows.join(least, "a")
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's smallest node.

    Each round writes its edges below the shared folder, so no plan grows with the
    rounds and a lost executor repeats one round at most.  It ends when a round
    changes nothing, told by the count and a sum of hashes of the edges.
    """
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before, after = None, mark(now)
    while before != after and after[0]:
        now = stage(_stars(_stars(now, large=True), large=False), "edges")
        before, after = after, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
