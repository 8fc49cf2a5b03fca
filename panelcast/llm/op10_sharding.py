"""Shards of bounded size by extendible hashing.

The directory is indexed by the first bits of a 60-bit hash of doc_id.  It starts as one
bucket; a bucket over the byte limit, and only such a one, splits on its next bit, until
every bucket fits.  So a bucket's depth is the smallest at which the rows that share its
prefix fit, which the byte sums of all prefixes tell without any row moving: rows are
summed into cells some bits finer than the shards should need, cells into prefixes.
Cells that still do not fit are opened further, eight bits at a time.

A bucket of one row is not split, whatever its size.  Rows that agree in all bits, such
as repeated doc_ids and nulls (which hash as ''), cannot be told apart by more bits:
their bucket gets overflow pages, filled in order up to the limit.  A null text has no
bytes.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.frames import orderable, packed, running_total, text_or_empty, total
from panelcast.session import stage

LIMIT = 1 << 20  # bytes of text in a shard
BITS = 60
FINER = 4  # bits by which the first cells are finer than evenly filled shards
MORE = 8


def hash_of(key: str = "doc_id") -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def prefix(depth: Column | int, bits: Column | str = "hash", width: int = BITS) -> Column:
    """The first ``depth`` of the ``width`` bits."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    column = F.col(bits) if isinstance(bits, str) else bits
    return F.call_function("shiftright", column, F.lit(width) - depth)


def directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, bytes): the bucket of each prefix of ``high`` bits; null where none fits.

    ``rows`` (hash, n_bytes) agree with no fitting bucket of fewer than ``low`` bits.
    """
    cells = rows.groupBy(prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
    cells = stage(cells, "shard-cells")
    depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    ways = cells.select("cell", "bytes", "rows", depths).withColumn("prefix", prefix(F.col("depth"), "cell", high))
    sums = ways.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    fitting = sums.filter((F.col("bytes") <= limit) | (F.col("rows") == 1)).select("depth", "prefix", F.col("bytes").alias("sum"))
    found = ways.select("cell", "depth", "prefix").join(fitting, ["depth", "prefix"], "left")
    first = F.min(F.when(F.col("sum").isNotNull(), F.struct("depth", "prefix", "sum"))).alias("b")
    return found.groupBy("cell").agg(first).select("cell", "b.depth", "b.prefix", F.col("b.sum").alias("bytes"))


def assign(docs: DataFrame, limit: int = LIMIT, keep: list[Column] | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (its prefix bits), depth, shard_bytes of every row, and the columns ``keep``."""
    extra = keep or []
    rows = docs.select("doc_id", F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), hash_of().alias("hash"), *extra)
    rows = stage(rows, "shard-rows")
    names = rows.columns
    size = total(rows, F.col("n_bytes"))
    low, high = 0, min(BITS, max(1, ceil(log2(max(2, size / limit)))) + FINER)
    done = []
    while True:
        # settled once: the next round needs only the rows that are still open
        met = rows.join(directory(rows, low, high, limit), prefix(high) == F.col("cell"))
        met = stage(met, "shard-round")
        digits = F.lpad(F.conv("prefix", 10, 2), F.col("depth"), "0")
        closed = met.filter("depth is not null").select(
            *names, F.when(F.col("depth") == 0, "").otherwise(digits).alias("shard"), "depth", F.col("bytes").alias("shard_bytes")
        )
        done.append(closed)
        rows = met.filter("depth is null").select(*names)
        if rows.isEmpty():
            break
        if high == BITS:
            done.append(overflow(rows, limit))
            break
        low, high = high + 1, min(BITS, high + MORE)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.drop("hash")


def overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of buckets whose rows agree in all bits.

    A row over half the limit has a page of its own; the others fill a page up to half
    the limit, and the one that crosses it is the last, so no page passes the limit.
    """
    marked = rows.withColumn("_large", (2 * F.col("n_bytes") > limit).cast("int"))
    marked = marked.withColumn("_bucket", F.concat_ws("-", "hash", "_large")).withColumn("_one", F.lit(1).cast("long"))
    order = ["n_bytes", *(c for c in rows.columns if c.startswith("_row"))]
    counted = running_total(marked, order, "_one", "_place", key="_bucket")
    filled = running_total(counted, order, "n_bytes", "_sum", key="_bucket")
    page = F.when(F.col("_large") == 1, F.col("_place") - 1).otherwise(
        F.floor((F.col("_sum") - F.col("n_bytes")) / F.lit(max(1, limit // 2)))
    )
    digits = F.lpad(F.conv("hash", 10, 2), BITS, "0")
    name = F.concat(digits, F.when(F.col("_large") == 1, "-l").otherwise("-p"), page.cast("string"))
    named = stage(filled.select(*rows.columns, name.alias("shard"), F.lit(BITS).alias("depth")), "overflow-pages")
    sums = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return named.join(sums, "shard").select(*rows.columns, "shard", "depth", "shard_bytes")


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` with shard, depth and shard_bytes, which replace columns of these names.

    Rows alike in every column take their places one by one, whichever is which.
    """
    to = ["shard", "depth", "shard_bytes"]
    own = [c for c in docs.columns if c.lower() not in to]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    rows = packed(docs, "doc_id", "text")
    row = F.xxhash64(orderable("_doc", docs))
    placed = assign(rows, limit, [row.alias("_row")])
    spot = F.struct(*to)
    spots = placed.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_key")).agg(F.min(spot).alias("_spot"), F.max(spot).alias("_last"))
    spots = stage(spots, "shard-places")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (row == F.col("_key"))
    once = rows.join(spots.filter("_spot = _last"), same).select("_doc.*", "_spot.*")
    # rows that repeat a key and lie on several pages
    several = spots.filter("_spot <> _last").select("_id", "_key")
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key"))
    pages = placed.join(several, key, "left_semi").groupBy("doc_id", "_row", *to).agg(F.count("*").alias("_times"))
    head = rows.join(several, same).groupBy("_id", "_key").agg(F.min_by("_doc", orderable("_doc", docs)).alias("_doc"))
    again = pages.join(head, key).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return once.unionByName(again.select("_doc.*", *to))


def write(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """One folder of Parquet per shard below ``folder``."""
    rows = sharded(docs, limit)
    rows.repartition("shard").write.partitionBy("shard").parquet(folder)


SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h
  FROM documents),
w AS (SELECT d.*, g.range AS depth, h >> CAST({BITS} - g.range AS INT) AS prefix FROM d CROSS JOIN range(0, {BITS + 1}) g),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM w GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT} OR count(*) = 1)
SELECT doc_id, any_value(n_bytes) AS n_bytes, min_by(CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END, depth) AS shard,
       CAST(min(depth) AS INT) AS depth, min_by(bytes, depth) AS shard_bytes
FROM w JOIN s USING (depth, prefix) GROUP BY doc_id
"""
