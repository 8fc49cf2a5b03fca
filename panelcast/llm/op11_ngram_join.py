"""N-gram Jaccard join with set-relation skipping: texts whose sets of word shingles are alike.

Equal sets are one node.  Shingles are ordered by how often they occur, read from a count
sketch of fixed size, then by hash; two alike sets share a shingle among the first
|x| - ceil(t * |x|) + 1 of each.  So a node goes to the list of each of these, with its
position, and lists of one node are dropped.

*Lists are skipped by position.*  For x at position i and y at position j of a list, what
follows bounds the overlap by 1 + min(|x| - i - 1, |y| - j - 1); a list is ordered by size
and position, so of each block of one size only the run of positions that can still reach
the overlap is looked at, and sizes out of reach not at all.  Pairs whose profiles (counts of
shingles by class) are too far apart are ruled out before any set is sent.

*Answers follow from those of a similar set.*  The smallest node of a list leads it.  Leaders
are compared with the members that can be similar to them on the whole sets, once; a member
keeps its difference to the leader.  From then on a member's answers come from the leader's: |x ^ y| is |dx| + |dy| -
2 |dx & dy| of the differences d, so most pairs are decided by the sizes of the differences
alone and the rest by the few shingles in them.  Pairs that links connect already are passed
over.  Pairs of a list that no leader covers are compared on the sets afterwards.

Components come from links that connect what is linked: never all pairs of a group.  Sets
go to leaders in chunks of ``CHUNK`` members; large groups and long lists are dealt out as
pairs of chunks.

Nulls and texts without words have the empty set and link with nothing.  Null doc_ids take
part; a component's id is the smallest doc_id that is not null (null if there is none).
Repeated rows come back as often as they came.  Shingles and sets are told apart by 58-
and 64-bit hashes.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import components, words
from panelcast.llm.frames import tasks, total
from panelcast.session import stage

SHINGLE = 3
ALIKE = (9, 10)  # least Jaccard similarity, as a fraction
SKETCH_BITS = 22  # counters of the sketch: 2 ** 22, one byte each when it is used
SKETCH_PARTS = 64
BINS = 256  # classes of a set's profile
BRIEF = 64  # classes of its short form, which goes with the entries of lists
RELATED = (8, 10)  # a member may be this far from its leader for its answers to be derived
PIECE = 1 << 19  # bytes of text looked at in one go
FILTER_BITS = 23  # of the bit set that picks the texts whose sets are needed
LIST_BITS = 25  # of the bit set that picks the shingles whose lists hold several sets
TOKEN_BITS = 58
CHUNK = 512  # members compared with one copy of their leader's set
GROUP = 2048  # members, or entries of a list, on either side of a task

_TOKEN = np.uint64((1 << TOKEN_BITS) - 1)


def shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of each text, with repeats, and where each text's begin."""
    w = words.split(column)
    h, count = words.hashes(w), np.diff(w.bounds)
    many = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    bounds = np.r_[0, np.cumsum(many)]
    first = np.repeat(w.bounds[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    final = np.minimum(first + shingle, np.repeat(w.bounds[1:], many))
    out = np.ones(len(first), np.uint64)
    for k in range(shingle):
        at = np.minimum(first + k, final - 1)
        out = np.where(first + k < final, out * words._BASE + h[at], out)
    return words.mix(out) & _TOKEN, bounds


def distinct_sets(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values in order, every one once; sorts ``tokens`` in place."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return tokens[new], np.r_[0, np.cumsum(new)][bounds]


def nodes_of(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on the order; 0 for the empty set."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = words.mix(np.add.reduceat(words.mix(tokens ^ words._BASE), bounds[:-1][some]))
    return out.view(np.int64)


def profiles(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many shingles of each set fall into each of ``BINS`` classes, modulo 256: one row of bytes a set.

    Two sets differ in at least as many shingles as their profiles are apart, class by
    class, so profiles rule pairs out without the sets.
    """
    n = len(bounds) - 1
    cell = np.repeat(np.arange(n), np.diff(bounds)) * BINS + (tokens % np.uint64(BINS)).astype(np.int64)
    return np.bincount(cell, minlength=n * BINS).reshape(n, BINS).astype(np.uint8)


def briefs(profile: np.ndarray) -> np.ndarray:
    """Profiles of ``BRIEF`` classes, which bound the difference as well."""
    return profile.reshape(len(profile), -1, BRIEF).sum(1).astype(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def prints(docs: DataFrame, shingle: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, node, size, profile, brief) of every row, and (part, counts): each task's counts for the sketch."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("digest"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "digest", "node", "size", "profile", "brief", "part", "counts"]
    id_type = pa.int64() if kind == "bigint" else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        ids = id_type
        for batch in batches:
            ids = batch.column(0).type
            for a, b in words.batches_of(batch.column(2), PIECE):
                part = batch.slice(a, b - a)
                tokens, bounds = distinct_sets(*shingles(part.column(2), shingle))
                cells, times = np.unique((tokens >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64), return_counts=True)
                counts[cells] += times.astype(np.uint32)
                profile = profiles(tokens, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(nodes_of(tokens, bounds)), pa.array(np.diff(bounds)),
                        _binary(profile), _binary(briefs(profile)), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()),
                    ],
                    names=names,
                )
        if ids is not None:
            empty = [pa.nulls(1, t) for t in (ids, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            for number, part in enumerate(np.split(counts, SKETCH_PARTS)):
                # the four bytes of the counters apart, so that the empty ones pack to nothing
                planes = part.view(np.uint8).reshape(-1, 4).T.tobytes()
                yield pa.RecordBatch.from_arrays([*empty, pa.array([number], pa.int32()), pa.array([planes], pa.binary())], names=names)

    made = stage(rows.mapInArrow(task, f"doc_id {kind}, digest long, node long, size long, profile binary, brief binary, part int, counts binary"), "shingle-sets")
    return made.filter("part is null").select(*names[:6]), made.filter("part is not null").select(*names[6:])


def level_of(counts: np.ndarray, mean: float) -> np.ndarray:
    """Place of a counter in the order of shingles, 0 to 63: by how far it lies above what chance fills it with.

    A counter holds about ``mean`` rare shingles and its root more or less; from there on a
    frequent shingle shows.  Steps are fine about the mean and grow with the distance.
    """
    above = (counts - mean) / np.sqrt(mean + 1)
    fine = np.clip(8 + 4 * above, 0, 32)
    return np.minimum(fine + np.maximum(0, 4 * np.log2(np.maximum(above, 6) / 6)), 63).astype(np.uint8)


def sketch(counts: DataFrame, mean: float) -> np.ndarray:
    """The level of each counter: 2 ** SKETCH_BITS bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, planes in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                sums[part] = sums.get(part, 0) + own.astype(np.uint64)
        levels = [level_of(s.astype(float), mean).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["part", "levels"])

    rows = counts.repartition(min(SKETCH_PARTS, tasks(counts)), "part").mapInArrow(add, "part int, levels binary").toArrow()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for part, levels in zip(rows["part"].to_pylist(), rows["levels"].to_pylist()):
        out[part] = np.frombuffer(levels, np.uint8)
    return out.ravel()


def entries(docs: DataFrame, levels: np.ndarray, shingle: int, text: str, only: np.ndarray | None = None) -> DataFrame:
    """(token, node, size, pos) for the first shingles of every set; a task gives a set once.

    With ``only``, a bit set of shingles, those it rules out are left away.
    """
    p, q = ALIKE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in words.batches_of(batch.column(0), PIECE):
                tokens, bounds = shingles(batch.column(0).slice(a, b - a), shingle)
                level = levels[(tokens >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)]
                keyed, bounds = distinct_sets(tokens | (level.astype(np.uint64) << np.uint64(TOKEN_BITS)), bounds)
                tokens = keyed & _TOKEN
                node, size = nodes_of(tokens, bounds), np.diff(bounds)
                fresh = np.zeros(len(node), bool)
                for i, n in enumerate(node.tolist()):
                    if size[i] and n not in seen:
                        seen.add(n)
                        fresh[i] = True
                length = np.where(fresh, size - (p * size + q - 1) // q + 1, 0)
                owner = np.repeat(np.arange(len(node)), length)
                pos = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
                taken = tokens[bounds[:-1][owner] + pos].view(np.int64)
                if only is not None:
                    kept = np.flatnonzero(in_bit_set(only, taken))
                    taken, owner, pos = taken[kept], owner[kept], pos[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(taken), pa.array(node[owner]), pa.array(size[owner].astype(np.int32)), pa.array(pos.astype(np.int32))],
                    names=["token", "node", "size", "pos"],
                )

    return docs.select(F.col(text).alias("_text")).mapInArrow(task, "token long, node long, size int, pos int")


def bit_set(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit set of 2 ** bits with the low bits of the long column ``key``."""
    cells = keys.selectExpr(f"key & {(1 << bits) - 1}L AS b").selectExpr("shiftright(b, 5) AS cell", "shiftleft(1L, cast(b & 31 AS int)) AS bit")
    # 2 ** (bits - 5) rows at most
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[rows["cell"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return table


def in_bit_set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (32 * len(table) - 1)
    return (table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)


def reach(size: str, pos: str, other: str, other_pos: str) -> str:
    """SQL: sizes and positions in a list still allow the similarity."""
    p, q = ALIKE
    return (
        f"{q} * least({size}, {other}) >= {p} * greatest({size}, {other}) AND "
        f"{p + q} * least({size} - {pos}, {other} - {other_pos}) >= {p} * ({size} + {other})"
    )


def lists_of(docs: DataFrame, levels: np.ndarray, shingle: int, text: str) -> DataFrame:
    """(token, node, size, pos, lead, lead_size, lead_pos): lists of several nodes, and the node that leads each.

    Most first shingles stand in one set only.  So a first pass finds the lists, and a second
    sends the entries of these alone, as far as a bit set of fixed size tells.
    """
    heads = entries(docs, levels, shingle, text).groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("_last"))
    heads = stage(heads.filter("lead <> _last").drop("_last"), "list-heads")
    found = entries(docs, levels, shingle, text, bit_set(heads.select(F.col("token").alias("key")), LIST_BITS))
    shared = stage(found.join(heads, "token").distinct(), "shared-lists")
    leads = shared.filter("node = lead").select("token", F.col("size").alias("lead_size"), F.col("pos").alias("lead_pos"))
    return stage(shared.join(leads, "token"), "led-lists")


def sets_of(docs: DataFrame, digests: DataFrame, shingle: int, text: str) -> DataFrame:
    """(digest, tokens) of the texts of these digests; each task gives a text once."""
    bits = bit_set(digests.select(F.col("digest").alias("key")), FILTER_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            digests = batch.column(0).to_numpy()
            new = []
            for i in np.flatnonzero(in_bit_set(bits, digests)).tolist():
                if int(digests[i]) not in seen:
                    seen.add(int(digests[i]))
                    new.append(i)
            part = batch.take(pa.array(new, pa.int64()))
            for a, b in words.batches_of(part.column(1), PIECE):
                tokens, bounds = distinct_sets(*shingles(part.column(1).slice(a, b - a), shingle))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), lists], names=["digest", "tokens"])

    rows = docs.select(F.xxhash64(text).alias("digest"), F.col(text).alias("_text"))
    return rows.mapInArrow(task, "digest long, tokens array<long>")


def relations(docs: DataFrame, known: DataFrame, pairs: DataFrame, shingle: int, text: str) -> DataFrame:
    """(lead, node, lead_size, size, diff, linked) of the pairs (lead, node), from the whole sets.

    Sets are made from one text of each node and go straight to the chunks of members they
    are needed for: a leader's to each of its chunks, a member's to each of its leaders.
    """
    p, q = ALIKE
    chunks = F.ceil(F.count("*") / CHUNK)
    many = stage(pairs.groupBy("lead").agg(chunks.alias("_chunks")), "leaders")
    members = pairs.join(many, "lead").select("lead", F.pmod(F.xxhash64("node"), "_chunks").alias("chunk"), F.lit(1).alias("role"), "node")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))
    leads = many.select("lead", every.alias("chunk"), F.lit(0).alias("role"), F.col("lead").alias("node"))
    chosen = known.groupBy("node").agg(F.min("digest").alias("digest"))
    places = stage(members.unionByName(leads).join(chosen, "node"), "set-places")
    order = ["lead", "chunk", "role", "node"]
    rows = sets_of(docs, places.select("digest").distinct(), shingle, text).join(places, "digest").select(*order, "tokens")
    rows = rows.repartition("lead", "chunk").sortWithinPartitions(*order)
    out = ["lead", "node", "lead_size", "size", "diff", "linked"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = np.empty(0, np.int64), None
        for batch in batches:
            found: list[list] = [[] for _ in out]
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if key == last:
                    continue  # a copy of the text from another task
                last = key
                lead, _, role, node = key
                tokens = batch.column(4)[i].values.to_numpy()
                if role == 0:
                    first = tokens
                    continue
                diff = np.setxor1d(first, tokens, assume_unique=True)
                total = len(first) + len(tokens)
                row = (lead, node, len(first), len(tokens), diff, (p + q) * len(diff) <= (q - p) * total)
                for column, value in zip(found, row):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(dict(zip(out, found)), schema=kinds)

    kinds = pa.schema(list(zip(out, [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.bool_()])))
    return stage(rows.mapInArrow(task, "lead long, node long, lead_size long, size long, diff array<long>, linked boolean"), "set-relations")


def derived(nodes: np.ndarray, sizes: np.ndarray, diffs: list[np.ndarray], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the members of one leader, found from their differences to it alone."""
    p, q = ALIKE
    k = len(nodes)
    label = np.where(linked, 0, np.arange(1, k + 1))
    width = np.array([len(d) for d in diffs])
    bounds = np.r_[0, np.cumsum(width)]
    values, token = np.unique(np.concatenate([*diffs, np.empty(0, np.int64)]), return_inverse=True)
    holder = np.repeat(np.arange(k), width)
    order = np.argsort(token, kind="stable")
    holders, starts = holder[order], np.searchsorted(token[order], np.arange(len(values) + 1))
    out = []
    for u in range(k):
        others = np.flatnonzero(label != label[u])
        others = others[others > u]
        if not len(others):
            continue
        total, wide = sizes[u] + sizes[others], width[u] + width[others]
        # the sizes of the differences bound the answer from either side
        open_ones = (p + q) * np.abs(width[u] - width[others]) <= (q - p) * total
        sure = open_ones & ((p + q) * wide <= (q - p) * total)
        if (open_ones & ~sure).any():
            own = token[bounds[u] : bounds[u + 1]]
            met = np.concatenate([holders[starts[t] : starts[t + 1]] for t in own.tolist()]) if len(own) else np.empty(0, np.int64)
            common = np.bincount(met, minlength=k)[others]
            sure = (p + q) * (wide - 2 * common) <= (q - p) * total
        hits = others[sure]
        if len(hits):
            _, one = np.unique(label[hits], return_index=True)
            for z in hits[one].tolist():
                out.append((int(nodes[u]), int(nodes[z])))
            joined = np.r_[label[u], label[hits[one]]]
            label[np.isin(label, joined)] = joined.min()
    return out


def answers(related: DataFrame) -> DataFrame:
    """Links (a, b) among the members of each leader that has a member it is not linked with."""
    groups = related.groupBy("lead").agg(F.count("*").alias("_many"), F.min("linked").alias("_all")).filter("_many > 1 AND NOT _all")
    chunks = F.ceil(F.col("_many") / GROUP)
    mine = F.pmod(F.xxhash64("node"), chunks)
    dealt = related.join(groups.select("lead", "_many"), "lead").withColumn("_mine", mine)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    keys = ["lead", "x", "y"]
    rows = dealt.select(
        "lead", F.least("_mine", "_other").alias("x"), F.greatest("_mine", "_other").alias("y"), "node", "size", "diff", "linked"
    )

    def solve(rows: pa.Table) -> list[tuple[int, int]]:
        rows = rows.sort_by("node")
        lists = rows["diff"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        return derived(
            rows["node"].to_numpy(), rows["size"].to_numpy(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])],
            rows["linked"].to_numpy(zero_copy_only=False),
        )

    return _by_key(rows, keys, solve)


def _by_key(rows: DataFrame, keys: list[str], solve) -> DataFrame:
    """(a, b) pairs that ``solve`` finds in each group of ``keys``; a group is read when the task comes to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            found = solve(pa.Table.from_batches(rest)) if rest else []
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))], 1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                if last is not None and (key[a] != last).any():
                    yield done()
                    rest = []
                rest.append(batch.slice(a, b - a))
                last = key[a]
        yield done()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, "a long, b long").distinct()


def run_of(size: np.ndarray, pos: np.ndarray, i: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Entries before ``i`` of an ordered list that sizes and positions let it reach, block by block.

    ``starts`` and ``ends`` are the blocks of one size; within a block positions rise, so
    the entries that can still reach the overlap are a run at its beginning.
    """
    p, q = ALIKE
    used = np.flatnonzero((starts < i) & (q * size[starts] >= p * size[i]))
    if not len(used):
        return np.empty(0, np.int64)
    need = (p * (size[i] + size[starts[used]]) + p + q - 1) // (p + q)
    open_blocks = size[i] - pos[i] >= need
    used, need = used[open_blocks], need[open_blocks]
    place = size * (1 << 32) + pos
    # size - pos >= need
    stop = np.searchsorted(place, size[starts[used]] * (1 << 32) + size[starts[used]] - need, "right")
    stop = np.minimum(np.minimum(stop, ends[used]), i)
    length = np.maximum(stop - starts[used], 0)
    return np.repeat(starts[used] - (np.cumsum(length) - length), length) + np.arange(length.sum())


def far_apart(profile: np.ndarray, others: np.ndarray) -> np.ndarray:
    """At least so many shingles lie in one of the two sets only."""
    return np.abs((others - profile).view(np.int8).astype(np.int16)).sum(1)


def possible(pairs: DataFrame, known: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (lead, node) whose profiles do not rule out a similarity of ``alike``."""
    p, q = alike
    profile = known.groupBy("node").agg(F.first("size").alias("size"), F.first("profile").alias("profile"))
    lead = profile.select(F.col("node").alias("lead"), F.col("size").alias("_size"), F.col("profile").alias("_profile"))
    met = pairs.join(profile, "node").join(lead, "lead").select("lead", "node", "size", "profile", "_size", "_profile")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in (3, 5))
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            kept = pa.array(np.flatnonzero((p + q) * far_apart(one, other) <= (q - p) * total))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["lead", "node"])

    return met.mapInArrow(task, "lead long, node long")


def rest_of_lists(lists: DataFrame, led: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list that lie in different components and are not both covered by its leader.

    A leader covers itself and the nodes that ``led`` pairs it with.  Sizes, positions and
    short profiles of either allow the similarity.
    """
    p, q = ALIKE
    held = lists.join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
    held = stage(held.select("token", "node", "size", "pos", "lead", F.coalesce("root", "node").alias("root")), "rooted-lists")
    still = held.groupBy("token").agg(F.count("*").alias("_many"), F.min("root").alias("x"), F.max("root").alias("y"))
    # of two nodes one leads, and the pair is decided
    still = still.filter("_many > 2 AND x <> y").select("token", "_many")
    held = held.join(still, "token").join(led.withColumn("_led", F.lit(True)), ["lead", "node"], "left")
    covered = (F.col("node") == F.col("lead")) | F.col("_led").isNotNull()
    chunks = F.ceil(F.col("_many") / GROUP)
    dealt = held.withColumn("_mine", F.pmod(F.xxhash64("node"), chunks))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    rows = dealt.select(
        "token", F.least("_mine", "_other").alias("x"), F.greatest("_mine", "_other").alias("y"),
        "node", "root", F.col("size").cast("long").alias("size"), F.col("pos").cast("long").alias("pos"), covered.alias("covered"),
    )
    brief = known.groupBy("node").agg(F.first("brief").alias("brief"))
    rows = rows.join(brief, "node").select(*rows.columns, "brief")

    def solve(rows: pa.Table) -> list[tuple[int, int]]:
        rows = rows.sort_by([("size", "ascending"), ("pos", "ascending"), ("node", "ascending")])
        node, root, size, pos = (rows[c].to_numpy() for c in ("node", "root", "size", "pos"))
        led = rows["covered"].to_numpy()
        brief = np.frombuffer(b"".join(rows["brief"].to_pylist()), np.uint8).reshape(-1, BRIEF)
        starts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
        ends = np.r_[starts[1:], len(size)]
        out: list[tuple[int, int]] = []
        for i in range(1, len(node)):
            at = run_of(size, pos, i, starts, ends)
            at = at[(root[at] != root[i]) & ~(led[at] & led[i])]
            at = at[(p + q) * far_apart(brief[i], brief[at]) <= (q - p) * (size[at] + size[i])]
            out += [(min(int(node[i]), n), max(int(node[i]), n)) for n in node[at].tolist()]
        return out

    return _by_key(rows, ["token", "x", "y"], solve)


def join(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    known, counts = prints(docs, shingle, text)
    some = known.filter("size > 0")
    lists = lists_of(docs, sketch(counts, total(known, F.col("size")) / (1 << SKETCH_BITS)), shingle, text)
    close = reach("size", "pos", "lead_size", "lead_pos")
    led = lists.filter(f"node <> lead AND {close}").select("lead", "node").distinct()
    pairs = stage(possible(led, some, RELATED), "led-pairs")
    related = relations(docs, some, pairs, shingle, text)
    links = related.filter("linked").select(F.col("lead").alias("a"), F.col("node").alias("b")).union(answers(related))
    roots = stage(components.connected(links), "led-components")
    rest = rest_of_lists(lists, pairs, roots, some).select(F.col("a").alias("lead"), F.col("b").alias("node"))
    rest = stage(possible(rest, some, ALIKE), "other-pairs")
    more = relations(docs, some, rest, shingle, text).filter("linked").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return label(known, components.connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))


def label(known: DataFrame, roots: DataFrame) -> DataFrame:
    """Components brought to the rows; the empty set stays alone."""
    smallest = known.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("_least"))
    grouped = smallest.join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
    least = grouped.filter("root is not null").groupBy("root").agg(F.min("_least").alias("_all"))
    named = grouped.join(least, "root", "left").select(
        F.col("node").alias("_named"), F.when(F.col("root").isNull(), F.col("_least")).otherwise(F.col("_all")).alias("component_id")
    )
    full = known.filter("size > 0").join(named, F.col("node") == F.col("_named")).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    empty = known.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(t[i.i : i.i + {SHINGLE - 1}], ' ') AS g FROM w, unnest(range(1, 1 + greatest(1, len(t) - {SHINGLE - 1}))) i(i)
  WHERE len(t) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION
  SELECT r.doc_id, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.other = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
