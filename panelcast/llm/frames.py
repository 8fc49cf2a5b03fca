"""DataFrame helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import stage

WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def label_split(key: Column) -> Column:
    """crc32 of the key's decimal text modulo 4; remainder 2 is held out. A null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def total(df: DataFrame, value: Column) -> int:
    """Sum of a whole-number column; 0 for no rows."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long")).first()[0]


def tasks(df: DataFrame) -> int:
    """Partitions for an explicit range shuffle: what the session uses for the others."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` columns beside ``_doc``, the whole row; so no column of ``docs`` can clash with an operator's own.

    ``select("_doc.*")`` gives the rows back.
    """
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def orderable(row: str, docs: DataFrame) -> Column:
    """The packed row ``row`` of ``docs`` in a form that can be hashed and ordered: a map is replaced by its JSON."""
    fields = [
        F.to_json(F.struct(F.col(f"{row}.`{f.name}`"))) if _holds_map(f.dataType) else F.col(f"{row}.`{f.name}`")
        for f in docs.schema.fields
    ]
    return F.struct(*[f.alias(f"c{i}") for i, f in enumerate(fields)])


def running_total(df: DataFrame, order: list[str], value: str, out: str, key: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows up to this one, per ``key`` if given.

    Rows are dealt in ranges of (key, order), so a key that holds most of the rows is
    spread over many tasks.  Each task adds up its own range; the ranges before it come
    from a table of one row per range and key.  The dealt rows are written once, since a
    range partitioning drawn again need not cut at the same places.  ``order`` must hold
    no nulls; rows equal in it may come in any order.
    """
    names = df.columns
    by = [key] if key else []
    n = tasks(df)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, so_far = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(values)
            if key:
                codes = pa.chunked_array([batch.column(names.index(key))]).dictionary_encode(null_encoding="encode")
                codes = codes.combine_chunks()
                codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
                ids = codes.indices.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                first, final = codes.dictionary[int(ids[0])].as_py(), codes.dictionary[int(ids[-1])].as_py()
            else:
                starts, first, final = np.array([0]), None, None
            before = np.r_[0, sums][starts]
            if so_far is not None and first == last:
                before[0] -= so_far
            sums = sums - np.repeat(before, np.diff(np.r_[starts, len(sums)]))
            last, so_far = final, int(sums[-1])
            columns = [*batch.columns, pa.array(np.full(len(sums), part, np.int64)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_sum"])

    cut = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_sum", T.LongType())])
    dealt = stage(cut.mapInArrow(add, schema), f"running-{out}")
    ends = dealt.groupBy("_part", *by).agg(F.max("_sum").alias("_end"))
    window = "PARTITION BY " + (f"`{key}`" if key else "1") + " ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = ends.selectExpr(
        "_part AS _p", *[f"`{k}` AS _k" for k in by], f"coalesce(sum(_end) OVER ({window}), 0L) AS _offset"
    )
    same = F.col("_part") == F.col("_p")
    if key:
        same = same & F.col(key).eqNullSafe(F.col("_k"))
    joined = dealt.join(offsets, same, "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], (F.col("_sum") + F.col("_offset")).alias(out))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text") -> DataFrame:
    """(doc_id, label 0/1, text) of at most ``rows`` labelled documents that are not held out.

    Chosen by a hash of the doc_id, so a rerun takes the same.  A doc_id labelled twice
    counts by its larger label, one with several texts by the smallest.  Null labels and
    null doc_ids are left out.  The chosen ids, at most ``rows``, are broadcast.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (label_split(F.col("doc_id")) != 2))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    met = known.join(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi")
    chosen = met.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(rows)
    texts = docs.select("doc_id", text_or_empty(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))


def with_python(df: DataFrame, columns: list[str], out: str, kind: T.DataType, function: Callable[[list[pa.Array]], pa.Array]) -> DataFrame:
    """``df`` and one more column, made of ``columns`` by an Arrow function in the tasks."""
    names = df.columns
    at = [names.index(c) for c in columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = function([batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*names, out])

    return df.mapInArrow(task, T.StructType([*df.schema.fields, T.StructField(out, kind)]))
