"""Benchmark decontamination by spaced seeds.

Words are longest runs of ASCII letters and digits and of anything beyond ASCII, in
lower case.  A mask is laid over every eleven words and only the words at its ones are
hashed, so a substituted word under a zero does not matter.  Hashes of the benchmark
are joined with those of the documents; a hit fixes an alignment.  A document is reported
if any stretch along it holds at least ``LEAST`` matches (or, in a shorter item, 80 % of
its words) and at least 80 % of its words match.  The stretch with the best score (a match
counts ``MATCH``, a mismatch ``MISS``) is given if it does, else the one with most matches.

A filter of fixed size, built from all benchmark hashes, drops most document hashes in
the task that makes them; what passes is joined exactly, so the filter only saves work
whatever the size of the benchmark.  Documents send on the words around their hits, not
their texts.  Hits are salted by document, so a passage that a third of them quote
spreads over many tasks.

Items shorter than ``LONG`` words have masks of four words in up to five, which hit every
quote that keeps the rule; items under ``SHORTEST`` words are not sought, since clean text
holds them by chance.  Nulls count
as empty texts.  Rows that repeat doc_id and text are reported once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words
from panelcast.llm.frames import packed
from panelcast.session import stage

# The seeds. Six of eleven words count; the first and last always do.
MASKS = ("11010010101", "10110100011", "11001001101", "10011101001", "11100010011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
LONG = 15  # items from this length on have the long masks
SHORTEST = 5
LEAST = 10
SIMILARITY = 0.8
MATCH, MISS = 1, -3
AROUND = 32  # words kept on either side of a hit, or those of the longest item if it has more
FILTER_BITS = 24  # each of the two filters has 2 ** 24 bits
SALTS = 16

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def seeds(short: bool) -> list[tuple[int, ...]]:
    """Offsets of each seed: the masks, then those of short items if there are any."""
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in (*MASKS, *(SHORT_MASKS if short else ()))]


def seed_hashes(h: np.ndarray, offsets: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the seed laid at each word; the last words may be too few."""
    count = max(0, len(h) - offsets[-1])
    out = np.full(count, np.uint64(number + 1))
    for o in offsets:
        out *= words._BASE
        out += h[o : o + count]
    return words.mix(out)


def filter_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << FILTER_BITS) - 1)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & low).astype(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *parts]), kind))


def items(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, words): hashed words of each item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words.split(words.folded(batch.column(1)), classes=_CLASSES)
            h = words.hashes(w).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.LargeListArray.from_arrays(w.bounds, pa.array(h)).cast(pa.list_(pa.int64()))], names=["item_id", "words"]
            )

    return benchmark.select(F.col("item_id").cast("long"), text).mapInArrow(task, "item_id long, words array<long>").distinct()


def item_seeds(tests: DataFrame) -> DataFrame:
    """(item_id, hash, place) of every seed; of a seed that an item repeats, the first place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, w in zip(batch.column(0), batch.column(1)):
                h = w.values.to_numpy().view(np.uint64)
                if len(h) < SHORTEST:
                    continue
                own = list(enumerate(seeds(short=True)))
                own = own[: len(MASKS)] if len(h) >= LONG else own[len(MASKS) :]
                found = [seed_hashes(h, offsets, n) for n, offsets in own]
                hashes = np.concatenate(found).view(np.int64)
                place = np.concatenate([np.arange(len(f)) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(place), pa.int64()), pa.array(hashes), pa.array(place)], names=["item_id", "hash", "place"]
                )

    every = tests.mapInArrow(task, "item_id long, hash long, place long")
    return every.groupBy("item_id", "hash").agg(F.min("place").alias("place"))


def bloom(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bit sets of fixed size that hold the hashes' high and low bits."""
    out = []
    low = (1 << FILTER_BITS) - 1
    for bits in (f"shiftrightunsigned(hash, {64 - FILTER_BITS})", f"hash & {low}L"):
        cells = known.selectExpr(f"{bits} AS b").selectExpr("shiftright(b, 5) AS cell", "shiftleft(1L, cast(b & 31 AS int)) AS bit")
        # 2 ** 19 rows at most, whatever the benchmark's size
        rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        table[rows["cell"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
        out.append(table)
    return out[0], out[1]


def regions(
    docs: DataFrame, filters: tuple[np.ndarray, np.ndarray], short: bool, text: str = "text", around: int = AROUND
) -> DataFrame:
    """(doc_id, digest, start, words, at, hash): words around the hits of the filter, and the hits."""
    shapes = seeds(short)
    longest = max(s[-1] + 1 for s in shapes)
    high, low = filters

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.batches_of(batch.column(2)):
                part = batch.slice(a, b - a)
                w = words.split(words.folded(part.column(2)), classes=_CLASSES)
                h, owner = words.hashes(w), w.text_of()
                at, hashes = [], []
                for number, offsets in enumerate(shapes):
                    s = seed_hashes(h, offsets, number)
                    i, j = filter_bits(s)
                    hit = np.flatnonzero((high[i >> 5] >> (i & 31).astype(np.uint32)) & (low[j >> 5] >> (j & 31).astype(np.uint32)) & 1)
                    hit = hit[owner[hit] == owner[hit + offsets[-1]]]
                    at.append(hit)
                    hashes.append(s[hit])
                at, hashes = np.concatenate(at), np.concatenate(hashes)
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                if not len(at):
                    continue
                new = np.flatnonzero(np.r_[True, (owner[at[1:]] != owner[at[:-1]]) | (at[1:] - at[:-1] > longest + 2 * around)])
                ends = np.r_[new[1:], len(at)]
                rows: list[list] = [[], [], [], [], []]
                for x, y in zip(new.tolist(), ends.tolist()):
                    # of a hash that a stretch repeats, the first place; long stretches are cut
                    for p in range(x, y, 4096):
                        q = min(p + 4096, y)
                        doc = owner[at[p]]
                        first = max(int(w.bounds[doc]), int(at[p]) - around)
                        last = min(int(w.bounds[doc + 1]), int(at[q - 1]) + longest + around)
                        once = np.sort(np.unique(hashes[p:q], return_index=True)[1]) + p
                        for r, v in zip(rows, (int(doc), first - int(w.bounds[doc]), h[first:last].view(np.int64), at[once] - first, hashes[once].view(np.int64))):
                            r.append(v)
                docs_of = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(docs_of), part.column(1).take(docs_of), pa.array(rows[1], pa.int64()), *(_lists(r, pa.int64()) for r in rows[2:])],
                    names=["doc_id", "digest", "start", "words", "at", "hash"],
                )

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    return source.mapInArrow(task, "doc_id long, digest long, start long, words array<long>, at array<long>, hash array<long>")


def best_stretch(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matches, first, end) of the best stretch of b laid on a at ``diagonal``, in words of a."""
    first, end = max(0, diagonal), min(len(a), diagonal + len(b))
    if end <= first:
        return 0, 0, 0
    same = a[first:end] == b[first - diagonal : end - diagonal]
    sums = np.r_[0, np.cumsum(np.where(same, MATCH, MISS))]
    gain = sums[1:] - np.minimum.accumulate(sums[:-1])
    stop = int(np.argmax(gain)) + 1
    start = int(np.argmin(sums[:stop]))
    return int(same[start:stop].sum()), first + start, first + stop


def longest_alike(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matches, first, end) of the stretch with most matches of which 80 % match; the shortest such."""
    first, end = max(0, diagonal), min(len(a), diagonal + len(b))
    if end <= first:
        return 0, 0, 0
    same = a[first:end] == b[first - diagonal : end - diagonal]
    # a stretch holds if the sum over it is not negative: it may start at any place whose sum is no larger
    sums = np.r_[0, np.cumsum(np.where(same, 1, -4))]
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    count = np.r_[0, np.cumsum(same)]
    matched = count - count[start]
    stop = int(np.lexsort((np.arange(len(sums)) - start, -matched))[0])
    begin = int(start[stop])
    begin += int(np.argmax(same[begin:stop])) if stop > begin else 0
    return int(matched[stop]), first + begin, first + stop


def quote(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(matches, first, end) of a stretch that makes a document reported, if there is one."""
    for found in (best_stretch, longest_alike):
        matched, first, end = found(a, b, diagonal)
        if matched >= min(LEAST, SIMILARITY * len(b)) and matched >= SIMILARITY * (end - first):
            return matched, first, end
    return None


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, digest, item_id, matched, length, start of each document that quotes an item."""
    tests = stage(items(benchmark), "benchmark-words")
    short = not tests.filter(F.size("words").between(SHORTEST, LONG - 1)).isEmpty()
    known = stage(item_seeds(tests), "benchmark-seeds")
    around = max(AROUND, tests.agg(F.max(F.size("words"))).first()[0] or 0)
    found = stage(regions(docs, bloom(known), short, text, around).distinct(), "hit-regions")
    # the regions' words stay where they are; hits travel under a number made of their content
    found = found.withColumn("region", F.xxhash64("doc_id", "digest", "start", "words"))
    hits = found.select("region", F.explode(F.arrays_zip("at", "hash")).alias("h")).select("region", "h.*")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = hits.withColumn("salt", F.pmod("region", F.lit(SALTS)).cast("int"))
    lines = hits.join(salted, ["hash", "salt"]).select("region", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    pairs = found.select("region", "doc_id", "digest", "start", "words").join(lines, "region")
    pairs = pairs.join(tests.withColumnRenamed("words", "item"), "item_id")
    names = ["doc_id", "digest", "item_id", "start", "diagonal", "words", "item"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            where, item = batch.column(5), batch.column(6)
            for i, (start, diagonal) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                b = item[i].values.to_numpy()
                stretch = quote(where[i].values.to_numpy(), b, diagonal)
                if stretch:
                    matched, first, end = stretch
                    for r, v in zip(rows, (i, matched, end - first, start + first)):
                        r.append(v)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(3)), *(pa.array(r, pa.int64()) for r in rows[1:])],
                names=[*names[:3], "matched", "length", "start"],
            )

    schema = "doc_id long, digest long, item_id long, matched long, length long, start long"
    verified = pairs.select(*names).mapInArrow(verify, schema)
    best = F.max(F.struct("matched", (-F.col("length")).alias("l"), (-F.col("start")).alias("s"))).alias("best")
    return verified.groupBy("doc_id", "digest", "item_id").agg(best).select(
        "doc_id", "digest", "item_id", "best.matched", (-F.col("best.l")).alias("length"), (-F.col("best.s")).alias("start")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, length: one row per document and benchmark item it quotes."""
    found = matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "length")).alias("best"))
    return found.select("doc_id", "item_id", "best.matched", "best.length")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quote no benchmark item."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    bad = stage(bad, "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest"))
    return packed(docs, "doc_id", "text").join(bad, same, "left_anti").select("_doc.*")
