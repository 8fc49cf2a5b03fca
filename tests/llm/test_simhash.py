"""SimHash near-duplicates against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from panelcast.llm import components, op8_simhash

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, bits):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i in range(len(fps)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(fps))]


def near_copies(count, rng, size=120):
    base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    out = []
    for _ in range(count):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        out.append(" ".join(w))
    return out


ODD = [None, "", " \t\n", "One", "one", "A b C", "a\x0bb\x0cc d", "é É ß", "x " * 5000, "\x1f odd   space"]


def test_fingerprints_follow_the_definition():
    rng = random.Random(1)
    texts = ODD + near_copies(20, rng) + [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(n)) for n in (3, 4, 5, 254, 258, 259, 600)]
    got = op8_simhash.fingerprints_of(pa.array(texts, pa.string()), 4, 42)
    assert got.tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("bucket_rows,bits,segments", [(1 << 16, 4, 5), (6, 4, 5), (6, 8, 9)])
def test_components_against_all_pairs(spark, bucket_rows, bits, segments):
    rng = random.Random(2)
    texts = ODD + near_copies(60, rng) + near_copies(30, rng) + ["same text here now"] * 9 + [f"alone {i} " * 9 for i in range(30)]
    ids = [None if i % 17 == 3 else 1000 - i for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, 1, "z") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, component_id string")
    got = op8_simhash.near_duplicates(rows, max_bits=bits, segments=segments, bucket_rows=bucket_rows).collect()
    fps = [fingerprint(t) for t in texts]
    want = collections.Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, groups(fps, ids, bits)))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_forest_connects_a_large_bucket():
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 12, 700, dtype=np.uint64) << np.uint64(20)
    far = rng.integers(0, 1 << 50, 600, dtype=np.uint64) << np.uint64(13)
    fps = np.unique(np.concatenate([near, far]))
    layout = op8_simhash.boxes(5)
    links = op8_simhash.forest(fps, 0, layout, 4)
    place = {int(f): i for i, f in enumerate(fps)}
    got = groups_of(len(fps), [(place[a], place[b]) for a, b in links])
    pairs = []
    for i in range(len(fps)):
        x = fps[i + 1 :] ^ fps[i]
        for j in op8_simhash.chain(x, 0, layout, 4).tolist():
            pairs.append((i, i + 1 + j))
    assert len(links) < len(fps) and got == groups_of(len(fps), pairs)


def groups_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_every_close_pair_passes_some_chain():
    rng = np.random.default_rng(4)
    for bits, segments in ((4, 5), (8, 9)):
        layout = op8_simhash.boxes(segments)
        for _ in range(200):
            x = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, bits + 1), replace=False)))
            assert any(len(op8_simhash.chain(np.array([x]), at, layout, bits)) for at in range(segments))


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplication_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    copies = near_copies(12, rng, 600)
    rows = [(5, copies[0]), (3, copies[0]), (3, copies[0]), (9, copies[1]), (None, copies[2])]
    rows += [(None, "only null ids " * 20)] * 4 + [(20, "another text " * 30), (21, None), (22, "")]
    docs = spark.createDataFrame([(i, t, "d", i) for i, t in rows], "doc_id long, text string, digest string, _id long")
    kept = op8_simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    prints = [fingerprint(t) for _, t in rows]
    parts = groups(prints, list(range(len(rows))), 4)
    first = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(min(first(r) for r, p in zip(rows, parts) if p == part) for part in set(parts))
    assert sorted(first(r) for r in kept.collect()) == want and (False, 3) in want and (True, 0) in want
    assert op8_simhash.deduplicate(docs.limit(0)).count() == 0


def test_deduplication_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    want = {c for c in groups(prints, [r.doc_id for r in rows], 4)}
    assert {r.doc_id for r in op8_simhash.deduplicate(docs).collect()} == want
    assert op8_simhash.near_duplicates(docs.limit(0)).count() == 0
