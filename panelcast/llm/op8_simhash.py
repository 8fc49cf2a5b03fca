"""SimHash near-duplicates, candidates filtered by the pigeonring principle.

A fingerprint of 64 bits is cut into ``segments`` boxes on a ring.  If two fingerprints
differ in at most ``max_bits`` bits, some box starts a chain all of whose prefixes stay
within their share: the first l boxes from there differ in at most floor(l * max_bits /
segments) bits together.  With 5 boxes and 4 bits the first box must be equal, so equal
boxes are the join key, and each further box of the chain (0, 1, 2, 3, 4 bits) prunes
pairs before the full count.

Copies collapse to distinct fingerprints first.  A bucket (box number, box value) is
searched by its next box as well, whose value may differ in one bit.  Buckets over
``bucket_rows`` fingerprints are dealt again by that next box, each fingerprint also
going to the values one bit away.  A bucket gives a spanning forest of its links, never
all pairs.

Nulls and blank texts have fingerprint 0 and are linked like any other.  Null doc_ids
take part; a component's id is the smallest doc_id that is not null (null if there is
none).  Repeated rows come back as often as they came.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import components, words
from panelcast.llm.frames import orderable, packed, with_python
from panelcast.session import stage

BITS = 64
BUCKET_ROWS = 1 << 16
_BLOCK = 1 << 16  # shingles hashed at a time


def fingerprints_of(column: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """Unsigned fingerprint of each text, from the XXH64 of its word shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = words.split(column)
    # the words again, each followed by one space if another of the same text follows
    lengths, count = w.ends - w.starts, np.diff(w.bounds)
    more = np.ones(len(lengths), np.int64)
    more[w.bounds[1:][count > 0] - 1] = 0
    kept = np.zeros(len(w.data), bool)
    for x, y in words.slices(w.data):
        kept[x:y] = ~words._SPACE[w.data[x:y]]
    kept[w.ends[more > 0]] = True
    joined = w.data[kept]
    start = np.cumsum(lengths + more) - lengths - more
    end = start + lengths
    joined[end[more > 0]] = 0x20
    body = joined.tobytes()
    shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    first = np.repeat(w.bounds[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    final = np.minimum(first + shingle, np.repeat(w.bounds[1:], shingles)) - 1
    h = np.empty(len(first), np.uint64)
    for x in range(0, len(first), _BLOCK):
        spans = zip(start[first[x : x + _BLOCK]].tolist(), end[final[x : x + _BLOCK]].tolist())
        h[x : x + _BLOCK] = [digest(body[i:j], seed) for i, j in spans]
    return majority(h, np.r_[0, np.cumsum(shingles)])


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For the hashes of each text, the bits set in more than half of them.

    Eight bits are counted at a time, each in a byte of its own, over runs of up to 255.
    """
    out = np.zeros(len(bounds) - 1, np.uint64)
    count = np.diff(bounds)
    texts = np.flatnonzero(count)
    if not len(texts):
        return out
    runs = -(-count[texts] // 255)
    first = np.cumsum(runs) - runs
    run = np.repeat(bounds[:-1][texts] - 255 * first, runs) + 255 * np.arange(runs.sum())
    lanes = np.uint64(0x0101010101010101)
    for low in range(8):
        part = np.add.reduceat((h >> np.uint64(low)) & lanes, run)
        ones = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * ones > count[texts][:, None]).astype(np.uint64)
        out[texts] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(low))).sum(1, dtype=np.uint64)
    return out


def fingerprint(docs: DataFrame, shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, ``digest`` (a hash of the text) and ``fp``, the fingerprint as a signed long."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("digest"), F.col(text).alias("_text"))

    def task(columns: list[pa.Array]) -> pa.Array:
        parts = [fingerprints_of(columns[0].slice(a, b - a), shingle, seed) for a, b in words.batches_of(columns[0])]
        return pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))

    return with_python(rows, ["_text"], "fp", T.LongType(), task).drop("_text")


def boxes(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each box."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain(x: np.ndarray, at: int, layout: list[tuple[int, int]], max_bits: int) -> np.ndarray:
    """Which of the differences ``x`` pass every prefix of the chain from box ``at``."""
    left, so_far = np.arange(len(x)), np.zeros(len(x), np.int64)
    for length in range(1, len(layout) + 1):
        shift, width = layout[(at + length - 1) % len(layout)]
        part = (x[left] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        so_far = so_far[left] if length == 1 else so_far
        so_far = so_far + np.bitwise_count(part)
        fits = so_far <= length * max_bits // len(layout)
        left, so_far = left[fits], so_far[fits]
    return left


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _near(
    fps: np.ndarray, at: int, layout: list[tuple[int, int]], max_bits: int, parent: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one bucket that pass the whole chain from box ``at``, in blocks of bounded size.

    In a large bucket, members are grouped by the box after ``at``, and only groups whose
    values fit the first two steps of the chain meet.  Pairs that the links found so far
    connect already (equal in ``parent``) are passed over.
    """
    if len(fps) <= 512:
        a, b = np.triu_indices(len(fps), 1)
        hit = chain(fps[a] ^ fps[b], at, layout, max_bits)
        yield a[hit], b[hit]
        return
    shift, width = layout[(at + 1) % len(layout)]
    value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    order = np.argsort(value, kind="stable")
    kinds, first = np.unique(value[order], return_index=True)
    last = np.r_[first[1:], len(fps)]
    for i, v in enumerate(kinds.tolist()):
        fits = np.flatnonzero(np.bitwise_count(kinds ^ np.uint64(v)) <= 2 * max_bits // len(layout))
        right = np.concatenate([order[first[j] : last[j]] for j in fits if j >= i])
        left = order[first[i] : last[i]]
        step = max(1, (1 << 18) // len(right))
        for block in range(0, len(left), step):
            rows = left[block : block + step]
            open_pairs = np.flatnonzero(parent[rows][:, None] != parent[right][None, :])
            if len(open_pairs):
                a, b = rows[open_pairs // len(right)], right[open_pairs % len(right)]
                hit = chain(fps[a] ^ fps[b], at, layout, max_bits)
                yield a[hit], b[hit]


def forest(fps: np.ndarray, at: int, layout: list[tuple[int, int]], max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among the fingerprints of one bucket: fewer than these."""
    parent, out = np.arange(len(fps)), []
    for a, b in _near(fps, at, layout, max_bits, parent):
        apart = parent[a] != parent[b]
        while apart.any():
            # one link per root of either side at a time; flat labels then tell which are still apart
            a, b = a[apart], b[apart]
            for i in np.concatenate([np.unique(parent[x], return_index=True)[1] for x in (a, b)]).tolist():
                p, q = _root(parent, int(a[i])), _root(parent, int(b[i]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(fps[a[i]]), int(fps[b[i]])))
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
            apart = parent[a] != parent[b]
    return out


def links(fps: DataFrame, max_bits: int = 4, segments: int = 5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp``, enough to connect all that are linked."""
    layout = boxes(segments)
    if max_bits >= segments:
        raise ValueError("the first box must have no bit to spare: take more segments than bits")
    value = lambda i: F.expr(f"shiftrightunsigned(fp, {layout[i][0]}) & {(1 << layout[i][1]) - 1}L")
    rows = fps.select(
        "fp", F.posexplode(F.array(*[value(i) for i in range(segments)])).alias("box", "value")
    )
    rows = rows.withColumn("value", F.col("value").cast("long"))
    large = rows.groupBy("box", "value").count().filter(F.col("count") > bucket_rows)
    large = stage(large.select("box", "value", F.lit(True).alias("_large")), "large-buckets")
    # few buckets can be large: their number is at most segments x rows / bucket_rows
    if large.isEmpty():
        dealt = rows.select("box", "value", F.lit(0).cast("long").alias("next"), F.lit(True).alias("own"), "fp")
    else:
        marked = rows.join(large, ["box", "value"], "left")
        after = F.element_at(F.array(*[value((i + 1) % segments) for i in range(segments)]), F.col("box") + 1)
        flips = F.element_at(
            F.array(*[F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(layout[(i + 1) % segments][1]))]]) for i in range(segments)]),
            F.col("box") + 1,
        )
        small = marked.filter(F.col("_large").isNull()).select(
            "box", "value", F.lit(0).cast("long").alias("next"), F.lit(True).alias("own"), "fp"
        )
        split = marked.filter(F.col("_large")).select("box", "value", "fp", after.alias("after"), F.explode(flips).alias("flip"))
        split = split.select(
            "box", "value", (F.col("after").bitwiseXOR(F.col("flip")) + 1).alias("next"), (F.col("flip") == 0).alias("own"), "fp"
        )
        dealt = small.unionByName(split)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 5), np.int64)
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            rows = np.concatenate([rest, rows])
            starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]) if len(rows) else np.zeros(1, np.int64)
            yield solved(rows[: starts[-1]], starts)
            rest = rows[starts[-1] :]  # the last bucket may go on
        yield solved(rest, np.zeros(1, np.int64))

    def solved(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        ends = np.r_[starts[starts > 0], len(rows)][: len(starts)]
        for x, y in zip(starts.tolist(), ends.tolist()):
            if y - x > 1 and rows[x:y, 3].any():
                fps = words.distinct(np.ascontiguousarray(rows[x:y, 4]).view(np.uint64))
                if len(fps) > 1:
                    found += forest(fps, int(rows[x, 0]), layout, max_bits)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys = ["box", "value", "next"]
    buckets = dealt.select(*keys, F.col("own").cast("long").alias("own"), "fp").repartition(*keys).sortWithinPartitions(*keys)
    return buckets.mapInArrow(task, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 4, seed: int = 42, max_bits: int = 4, segments: int = 5, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    prints = stage(fingerprint(docs, shingle, seed), "fingerprints")
    return label(prints, links(prints.select("fp").distinct(), max_bits, segments, bucket_rows))


def label(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components of ``pairs`` brought to the rows of ``prints``."""
    roots = components.connected(pairs)
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    grouped = smallest.join(roots, F.col("fp") == F.col("node"), "left")
    # fingerprints that stand alone need no second look
    least = grouped.filter("root is not null").groupBy("root").agg(F.min("_least").alias("_all"))
    named = grouped.join(least, "root", "left").select(
        F.col("fp").alias("_fp"), F.when(F.col("root").isNull(), F.col("_least")).otherwise(F.col("_all")).alias("component_id")
    )
    return prints.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(
    docs: DataFrame, shingle: int = 4, seed: int = 42, max_bits: int = 4, segments: int = 5, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The rows of ``docs``, one of each component of ``near_duplicates``: that of the smallest doc_id.

    A null doc_id counts as larger than any other; of rows that repeat both doc_id and text,
    one stays.  Null and blank texts are copies of each other, so one of them stays.
    """
    prints = stage(fingerprint(docs, shingle, seed), "fingerprints")
    pairs = links(prints.select("fp").distinct(), max_bits, segments, bucket_rows)
    roots = components.connected(pairs).withColumnRenamed("node", "_node")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), (F.col("count") > 1).alias("_more"))
    heads = prints.groupBy("fp", "doc_id", "digest").count().groupBy("fp").agg(F.min(rank).alias("head"))
    heads = heads.join(roots, F.col("fp") == F.col("_node"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("head").alias("head"))
    heads = stage(heads.select("head._id", "head._digest", "head._more"), "group-heads")
    rows = packed(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest"))
    once = rows.join(heads.filter("not _more"), same, "left_semi")
    alike = rows.join(heads.filter("_more"), same).groupBy("_id", "_digest").agg(F.min_by("_doc", orderable("_doc", docs)).alias("_doc"))
    return once.select("_doc.*").unionByName(alike.select("_doc.*"))
