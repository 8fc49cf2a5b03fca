"""Exact top-k by integer inner product: a Voronoi kNN join.

A vector's components become floor(64 * x).  With M the largest norm, adding the
component sqrt(M^2 - |s|^2) to every candidate s and 0 to every query q makes
|q - s|^2 = |q|^2 + M^2 - 2 q.s, so the nearest candidates are those of highest score.

Pivots cut the space into cells.  Of each cell the summary holds the k + 1 smallest
distances to its pivot; through the triangle inequality they bound, for every query, how
far its k-th neighbour can be (one more, as the query's own row is among the rows).
Queries are put into blocks cell by cell.  A candidate at distance d from its pivot p can
matter to a query q only if | |q p| - d | is within q's bound, and only if the plane half
way between p and q's own pivot is; so each block gets, per cell, only the ring of
distances that some query of it needs, or nothing.  Blocks are solved on
their own, against chunks of their candidates, by whole-number arithmetic; the chunks'
results are merged.  Distances only prune, with a margin for rounding.

Blocks and chunks have bounded size whatever the data: a vector that a third of the rows
repeat is one point of one cell, but its rows spread over chunks by id.

Vectors that are null or hold null or non-finite components, and rows without vec_id,
take no part.  Of rows that share a vec_id the smallest vector counts.  A shorter vector
counts as padded with zeros.  Scores beyond a long are cut to its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.session import stage

K = 20
EVERY = 20  # a vec_id divisible by this is a query
PIVOTS = 64
BLOCK = 512  # queries solved together, about
CHUNK = 1 << 16  # candidates met at a time, about
SLACK = 1e-9  # of the distances involved, for rounding
RESULT = "query_id long, vec_id long, score long"


def whole_vectors(table: DataFrame, ids: str = "vec_id", vectors: str = "embedding") -> DataFrame:
    """(vec_id, v): one whole-number vector per id."""
    x = F.col(vectors).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.filter(F.col(ids).isNotNull() & F.col(vectors).isNotNull() & ~bad)
    whole = F.transform(x, lambda c: F.floor(64 * c).cast("long"))
    return rows.select(F.col(ids).cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as whole numbers, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), np.int64)
    flat, length = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


class Space:
    """Distances to the pivots after the added component."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.width, self.largest = pivots.shape[1], largest
        self.pivots = self.lifted(pivots.astype(float), True)
        self.square = (self.pivots**2).sum(1)

    def lifted(self, x: np.ndarray, candidate: bool) -> np.ndarray:
        more = np.sqrt(np.maximum(self.largest - (x**2).sum(1), 0)) if candidate else np.zeros(len(x))
        return np.c_[x, more]

    def distances(self, x: np.ndarray, candidate: bool) -> np.ndarray:
        y = self.lifted(x.astype(float), candidate)
        return np.sqrt(np.maximum((y**2).sum(1)[:, None] + self.square - 2 * y @ self.pivots.T, 0))

    def to_planes(self, d: np.ndarray) -> np.ndarray:
        """How far each query is from the plane between its own pivot and each other one; 0 where they fall together."""
        own = d.argmin(1) if len(d) else np.empty(0, np.int64)
        apart = np.sqrt(np.maximum(self.square[own][:, None] + self.square - 2 * self.pivots[own] @ self.pivots.T, 0))
        return np.where(apart > 0, (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / np.where(apart > 0, 2 * apart, 1), 0)

    def slack(self) -> float:
        """The rounding that a square root of a difference of squares can show."""
        return SLACK * np.sqrt(self.largest + 1) + 1e-6 * np.sqrt(np.sqrt(self.largest + 1))


def bounds(space: Space, distances: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """How far each query's k-th neighbour is at most; ``nearest`` has k + 1 distances a cell, inf where fewer."""
    out = np.empty(len(distances))
    for a in range(0, len(distances), 256):
        ways = (distances[a : a + 256, :, None] + nearest[None]).reshape(len(distances[a : a + 256]), -1)
        out[a : a + 256] = np.partition(ways, nearest.shape[1] - 1, axis=1)[:, nearest.shape[1] - 1]
    return out


def chain_of(pivots: np.ndarray) -> list[int]:
    """Pivots in an order in which neighbours are near."""
    left, order = set(range(1, len(pivots))), [0]
    while left:
        order.append(min(left, key=lambda j: (float(((pivots[j] - pivots[order[-1]]) ** 2).sum()), j)))
        left.remove(order[-1])
    return order


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ``ids`` ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")][:k]


def solve(queries: pa.Table, rows: pa.Table, width: int, exact: bool, k: int) -> pa.Table:
    """The best of these rows for each of these queries, by whole numbers."""
    found: list[list] = [[], [], []]
    if len(queries) and len(rows):
        rows = rows.sort_by("vec_id")
        ids = rows["vec_id"].to_numpy()
        kind = np.float64 if exact else object  # below 2 ** 53 products and sums of doubles are exact
        q, s = matrix(queries["v"], width).astype(kind), matrix(rows["v"], width).astype(kind)
        for a in range(0, len(q), 64):
            scores = q[a : a + 64] @ s.T
            for query, own in zip(queries["query_id"][a : a + 64].to_pylist(), scores):
                keep = np.flatnonzero(ids != query) if (ids == query).any() else np.arange(len(ids))
                top = keep[best(ids[keep], own[keep], k)]
                found[0].append(np.full(len(top), query, np.int64))
                found[1].append(ids[top])
                found[2].append(np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in own[top]], np.int64))
    arrays = [pa.array(np.concatenate([np.empty(0, np.int64), *f])) for f in found]
    return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])


def search(table: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query."""
    spark = table.sparkSession
    vecs = stage(whole_vectors(table), "whole-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, width, largest = vecs.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, largest = max(width, 1), float(largest)
    # the first ``pivots`` different vectors in the order of a hash
    chosen = vecs.select(F.xxhash64("v").alias("h"), "v").distinct().orderBy("h", "v").limit(pivots).toArrow()
    space = Space(matrix(chosen["v"], width), largest)
    cells = len(space.pivots)

    def assign(candidate: bool, name: str):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = space.distances(matrix(batch.column(1), width), candidate)
                cell = d.argmin(1) if len(d) else np.empty(0, np.int64)
                near = d[np.arange(len(d)), cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(near)], names=[name, "v", "cell", "dist"])

        return task

    data = stage(vecs.mapInArrow(assign(True, "vec_id"), "vec_id long, v array<long>, cell long, dist double"), "voronoi-rows")
    asked = vecs.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    asked = stage(asked.mapInArrow(assign(False, "query_id"), "query_id long, v array<long>, cell long, dist double"), "voronoi-queries")

    def smallest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            kept = pd.concat([kept, frame]).sort_values(["cell", "dist"]).groupby("cell").head(k + 1)
        if kept is not None:
            yield kept

    # at most k + 1 rows a task and cell
    few = data.select("cell", "dist").mapInPandas(smallest, "cell long, dist double")
    summary = few.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("dist")), 1, k + 1).alias("dists")).collect()
    nearest = np.full((cells, k + 1), np.inf)
    for r in summary:
        nearest[r.cell, : len(r.dists)] = r.dists
    sizes = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    before, start = 0, np.zeros(cells)
    for c in chain_of(space.pivots):
        start[c], before = before, before + sizes.get(c, 0)
    share = F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) / float(1 << 20)
    place = F.element_at(F.array(*[F.lit(float(s)) for s in start]), (F.col("cell") + 1).cast("int")) + share * F.element_at(
        F.array(*[F.lit(float(sizes.get(c, 0))) for c in range(cells)]), (F.col("cell") + 1).cast("int")
    )
    asked = asked.select("query_id", "v", F.floor(place / block).cast("long").alias("block"))

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = space.distances(matrix(batch.column(1), width), False)
            reach = bounds(space, d, nearest)[:, None] + space.slack()
            blocks, row = np.unique(batch.column(2).to_numpy(), return_inverse=True)
            low, high = np.full((len(blocks), cells), np.inf), np.full((len(blocks), cells), -np.inf)
            near = space.to_planes(d) <= reach
            np.minimum.at(low, row, np.where(near, d - reach, np.inf))
            np.maximum.at(high, row, np.where(near, d + reach, -np.inf))
            arrays = [np.repeat(blocks, cells), np.tile(np.arange(cells), len(blocks)), low.ravel(), high.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["block", "cell", "low", "high"])

    rings = asked.mapInArrow(ring, "block long, cell long, low double, high double")
    # one row per block and cell: queries / BLOCK * PIVOTS
    rings = rings.groupBy("block", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by("block")
    names, at = np.unique(rings["block"].to_numpy(), return_inverse=True)
    low, high = np.full((cells, len(names)), np.inf), np.full((cells, len(names)), -np.inf)
    low[rings["cell"].to_numpy(), at], high[rings["cell"].to_numpy(), at] = rings["low"].to_numpy(), rings["high"].to_numpy()
    chunks = max(1, -(-count // chunk))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for b, name in enumerate(names.tolist()):
                need = np.flatnonzero((low[cell, b] <= dist) & (dist <= high[cell, b]))
                if len(need):
                    part = batch.take(pa.array(need))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), name)), part.column(0), part.column(1)], names=["block", "vec_id", "v"])

    sent = data.mapInArrow(replicate, "block long, vec_id long, v array<long>")
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    exact = largest < 2**53

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return solve(left, right, width, exact, k)

    met = asked.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
