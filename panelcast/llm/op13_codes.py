"""Codes for vectors: each part of a vector is replaced by the number of its nearest codebook entry.

Components become floor(1024 * x) and a vector is cut into equal consecutive parts.  Each
part position has its codebook, which starts with that part of the vectors of the smallest
ids; a round assigns every part to the nearest entry and moves each entry to the floor of
the mean of its parts.

The parts of a position are sorted along a Hilbert curve and cut into flat blocks of at
most ``BLOCK`` parts, written once.  A block stores the box of its parts (least and largest
component of each dimension) and their sums.  In a round, the least and largest distance of
the box to each entry leave a short list: an entry whose least distance is beyond the
smallest largest distance is the nearest of no part.  A short list of one takes the whole
block by its stored sums; otherwise a small kernel compares the parts with the listed
entries.  Everything is whole numbers: float64 products where they stay below 2^53, else
int64, else Python's integers.

A round sends back one row per entry, dimension and task.  A vector that a third of the rows
repeat fills many blocks, as blocks follow (position on the curve, row).

Vectors that are null or hold null or non-finite components take no part; a shorter vector
counts as padded with zeros, and the width is rounded up to a multiple of the parts.  Null
ids take part but seed no entry; of rows that share an id the smallest vector seeds.  Fewer
ids than entries give smaller codebooks, and rows without any id give no result.  Repeated
rows come back as often as they came.  A component or an error beyond a long is cut to its
range, or null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.frames import tasks
from panelcast.llm.op1_voronoi import matrix
from panelcast.session import stage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 256
KEY_BITS = 62  # of a place on the curve
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def whole_rows(table: DataFrame, scale: int, ids: str, vectors: str, label: str) -> DataFrame:
    """(rid, vec_id, label, v): the rows that take part, numbered and written once."""
    x = F.col(vectors).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = table.filter(F.col(vectors).isNotNull() & ~bad)
    whole = F.transform(x, lambda c: F.floor(scale * c).cast("long"))
    group = F.col(label) if label in table.columns else F.lit(None).cast("int")
    rows = kept.select(F.col(ids).cast("long").alias("vec_id"), group.alias("label"), whole.alias("v"))
    return stage(rows.withColumn("rid", F.monotonically_increasing_id()), "whole-vectors")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells``, numbers of ``bits`` bits (Skilling's transform)."""
    x = cells.T.astype(np.uint64)
    dims, zero = len(x), np.uint64(0)
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        low = level - np.uint64(1)
        for i in range(dims):
            on = (x[i] & level) != 0
            swap = np.where(on, zero, (x[0] ^ x[i]) & low)
            x[i] ^= swap
            x[0] ^= np.where(on, low, swap)
        level >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, level = np.zeros(x.shape[1], np.uint64), np.uint64(1 << (bits - 1))
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - np.uint64(1), zero)
        level >>= np.uint64(1)
    x ^= turn
    out = np.zeros(x.shape[1], np.uint64)
    for bit in reversed(range(bits)):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return out.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def blocks_of(rows: DataFrame, parts: int, width: int, block: int) -> DataFrame:
    """(part, rids, points, low, high, sums): the flat blocks of every part position."""
    dims = width // parts
    used = min(dims, KEY_BITS)
    bits = max(1, min(16, KEY_BITS // used))
    centre, spread = rows.select(F.explode("v").alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    low, step = centre - 2 * spread, max(4 * spread / (1 << bits), 1e-9)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            for p in range(parts):
                own = x[:, p * dims : (p + 1) * dims]
                cells = np.clip((own[:, :used] - low) / step, 0, (1 << bits) - 1).astype(np.uint64)
                kinds = [pa.array(np.full(len(x), p, np.int32)), pa.array(hilbert(cells, bits)), batch.column(0), _binary(own)]
                yield pa.RecordBatch.from_arrays(kinds, names=["part", "place", "rid", "point"])

    placed = rows.select("rid", "v").mapInArrow(place, "part int, place long, rid long, point binary")
    order = ["part", "place", "rid"]
    sorted_rows = placed.repartitionByRange(tasks(rows), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, rid = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            points = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, dims)
            change = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[change[1:], len(part)]
            starts = np.concatenate([np.arange(a, b, block) for a, b in zip(change, ends)])
            stops = np.r_[starts[1:], len(part)]
            lists = pa.ListArray.from_arrays(np.r_[starts, len(part)].astype(np.int32), pa.array(rid))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[starts]), lists, pa.array([points[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
                    _binary(np.minimum.reduceat(points, starts)), _binary(np.maximum.reduceat(points, starts)), _binary(np.add.reduceat(points, starts)),
                ],
                names=["part", "rids", "points", "low", "high", "sums"],
            )

    schema = "part int, rids array<long>, points binary, low binary, high binary, sums binary"
    return stage(sorted_rows.mapInArrow(cut, schema), "hilbert-blocks")


def kind_for(largest: int, dims: int) -> type:
    """The fastest number type in which squared distances of such components are exact."""
    bound = 4 * dims * largest * largest
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def short_list(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries, in order, that may be the nearest of some point of the box."""
    below, above = low - entries, entries - high
    outside = np.maximum(np.maximum(below, above), 0)
    across = np.maximum(entries - low, high - entries)
    return np.flatnonzero((outside * outside).sum(1) <= (across * across).sum(1).min())


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point, the lowest of equals, and the squared distance."""
    far = (entries * entries).sum(1)[None, :] - 2 * (points @ entries.T)
    at = far.argmin(1)
    return at, far[np.arange(len(points)), at] + (points * points).sum(1)


def _each(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Part, rids, points, sums and short list of each block of a batch."""
    dims = books.shape[2]
    for part, rids, points, low, high, sums in zip(*(batch.column(i) for i in range(6))):
        p = part.as_py()
        box = [np.frombuffer(v.as_buffer(), np.int64).astype(books.dtype) for v in (low, high)]
        values = np.frombuffer(points.as_buffer(), np.int64).reshape(-1, dims).astype(books.dtype)
        yield p, rids.values, values, np.frombuffer(sums.as_buffer(), np.int64), short_list(*box, books[p])


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its parts."""
    parts, entries, dims = books.shape
    wide = books.dtype == object

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, dims + 1), object if wide else np.int64)
        for batch in batches:
            for p, _, points, sums, listed in _each(batch, books):
                if len(listed) == 1:
                    total[p, listed[0], :dims] += sums.astype(total.dtype)
                    total[p, listed[0], dims] += len(points)
                    continue
                at, _ = nearest(points, books[p][listed])
                order = np.argsort(at, kind="stable")
                used, first, count = np.unique(at[order], return_index=True, return_counts=True)
                own = points[order].astype(total.dtype)
                total[p, listed[used], :dims] += np.add.reduceat(own, first)
                total[p, listed[used], dims] += count
        p, entry = np.nonzero(total[:, :, dims])
        values = total[p, entry].ravel()
        number = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)) if wide else pa.array(values)
        cell = ((p * entries + entry)[:, None] * (dims + 1) + np.arange(dims + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell), number], names=["cell", "value"])

    partial = blocks.mapInArrow(add, f"cell long, value {'decimal(38,0)' if wide else 'long'}")
    # one row per part, entry and dimension
    sums = partial.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(parts * entries * (dims + 1), object)
    total[sums["cell"].to_numpy()] = [int(v) for v in sums["value"].to_pylist()]
    total = total.reshape(parts, entries, dims + 1)
    out = books.astype(object)
    for p, e in np.argwhere(total[:, :, dims] != 0):
        out[p, e] = [int(s) // int(total[p, e, dims]) for s in total[p, e, :dims]]
    return out.astype(books.dtype)


def compress(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
    ids: str = "vec_id", vectors: str = "embedding", label: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that takes part."""
    rows = whole_rows(table, scale, ids, vectors, label)
    largest = F.greatest(F.abs(F.array_min("v").cast("decimal(20,0)")), F.abs(F.array_max("v").cast("decimal(20,0)")))
    width, largest, count = rows.agg(F.max(F.size("v")), F.max(largest), F.count("*")).first()
    first = rows.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    seeds = rows.join(F.broadcast(first), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").toArrow()
    if not width or not seeds.num_rows:
        return table.sparkSession.createDataFrame([], RESULT)
    width = -(-width // parts) * parts
    dims, largest = width // parts, int(largest)
    kind = kind_for(largest, dims)
    start = matrix(seeds["v"], width).astype(kind)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims).transpose(1, 0, 2))
    # the sums of a block fit a long
    blocks = blocks_of(rows, parts, width, max(1, min(block, ((1 << 63) - 1) // max(largest, 1))))
    for _ in range(rounds):
        books = moved(blocks, books)
    final = books

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, rids, points, _, listed in _each(batch, final):
                at, far = nearest(points, final[p][listed])
                error = pa.array([Decimal(int(v)) for v in far], pa.decimal128(38, 0)) if kind is object else pa.array(far.astype(np.int64))
                columns = [rids, pa.array(np.full(len(at), p, np.int32)), pa.array(listed[at]), error]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "part", "entry", "error"])

    coded = blocks.mapInArrow(assign, f"rid long, part int, entry long, error {'decimal(38,0)' if kind is object else 'long'}")
    digits = max(2, -(-(len(start) - 1).bit_length() // 4))
    place = [F.lower(F.lpad(F.hex(F.max(F.when(F.col("part") == p, F.col("entry")))), digits, "0")) for p in range(parts)]
    codes = coded.groupBy("rid").agg(F.concat(*place).alias("code"), F.sum(F.col("error").cast("decimal(38,0)")).alias("_error"))
    known = stage(rows.select("rid", "vec_id", "label").join(codes, "rid"), "codes")
    by_label = known.groupBy(F.col("label").alias("_label")).agg(F.sum("_error").alias("_sum"))
    numbers = ",".join(str(int(v)) for v in final.ravel())
    joined = known.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(
        "vec_id", "code", F.expr("try_cast(_error AS bigint)").alias("error"), F.expr("try_cast(_sum AS bigint)").alias("label_error"),
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _sql() -> str:
    """The rounds one after the other; for vectors of 64 components."""
    dims = 64 // PARTS
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT rid, vec_id, g.range AS part, e[g.range * {dims} + 1 : g.range * {dims} + {dims}] AS x FROM v CROSS JOIN range({PARTS}) g)",
        f"""c0 AS MATERIALIZED (
  SELECT part, rank - 1 AS entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p)
  WHERE rank <= {ENTRIES})""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, part, any_value(p.x) AS x, min({ENTRIES} * CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) + entry) AS best
  FROM p JOIN c{r} c USING (part) GROUP BY rid, part)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS (
  SELECT part, entry, list(mean ORDER BY i) AS x FROM (
    SELECT part, best % {ENTRIES} AS entry, i.range AS i, floor(sum(x[i.range]) / count(*)) AS mean FROM a{r} CROSS JOIN range(1, {dims + 1}) i GROUP BY ALL)
  GROUP BY part, entry)"""
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))")
    last = f"a{ROUNDS}"
    steps.append(
        f"""o AS (
  SELECT rid, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM {last} GROUP BY rid)"""
    )
    steps.append(
        f"""h AS (
  SELECT sha256(string_agg(CAST(CAST(x[i.range] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i.range)) AS codebooks_sha256
  FROM c{ROUNDS} CROSS JOIN range(1, {dims + 1}) i)"""
    )
    return f"""
WITH {', '.join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN o USING (rid) CROSS JOIN h
"""


SQL = _sql()
