"""Whitening and vector codes against plain versions of their definitions."""

import collections
import hashlib
import random
from decimal import Decimal

import numpy as np
import pytest

from panelcast.llm import op12_whitening, op13_codes

SF = "/root/testdata/sf0.001"


def rows_with_oddities(rng, count=90, width=8):
    rows = [(i, [float(rng.choice([-1, 1]) * rng.random() * (1 + j)) for j in range(width)], i % 3) for i in range(count)]
    rows += [(7, rows[0][1], None), (None, rows[1][1], 1), (rows[5]), (rows[5]), (900, [], 2), (901, [0.5], None)]
    rows += [(902, None, 1), (903, [1.0, None] + [0.0] * (width - 2), 1), (904, [float("nan")] * width, 0), (905, [float("inf")] + [0.0] * (width - 1), 0)]
    return rows


def table(spark, rows):
    packed = [(i, v, g, "x", {"k": 1}) for i, v, g in rows]
    return spark.createDataFrame(packed, "vec_id long, embedding array<float>, label int, rid string, component map<string,int>")


def kept(rows, scale, width):
    out = []
    for i, v, g in rows:
        if v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = np.floor(scale * np.array(v, np.float32).astype(float))
        out.append((i, np.r_[x, np.zeros(width - len(x))].astype(np.int64), g))
    return out


# --- whitening ---------------------------------------------------------------


def against_definition(rows, got, width, k):
    good = kept(rows, 64, width)
    x = np.array([v for _, v, _ in good]) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    centred = fit - mean
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    white = (x - mean) @ u / np.sqrt(e)
    deviation = ((n * x - fit.sum(0)) ** 2).sum(1)
    assert {r.n for r in got} == {n}
    signs = {}
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert collections.Counter(r.vec_id for r in got) == {i: m * k for i, m in collections.Counter(i for i, _, _ in good).items()}
    for (i, _, _), row, far in zip(good, white, deviation):
        for r in by_id[i]:
            assert abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-12
            if len({q.deviation for q in by_id[i]}) == 1:
                assert r.deviation == far
                sign = signs.setdefault(r.component, np.sign(r.whitened * row[r.component - 1]))
                assert abs(r.whitened - sign * row[r.component - 1]) < 1e-7
    assert all(0 <= r.identity_error < 1e-6 for r in got)


def test_whitening_follows_the_definition(spark):
    rows = rows_with_oddities(random.Random(1))
    against_definition(rows, op12_whitening.whiten(table(spark, rows)).collect(), 8, 8)
    against_definition(rows, op12_whitening.whiten(table(spark, rows), components=3).collect(), 8, 3)


def test_whitening_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in docs.collect()]
    against_definition(rows, op12_whitening.whiten(docs).collect(), 64, 16)


def test_whitening_without_variance(spark):
    assert op12_whitening.whiten(table(spark, [])).count() == 0
    assert op12_whitening.whiten(table(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    assert op12_whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    # a flat table has as many components as its rank
    flat = [(i, [float(i), float(2 * i), 1.0], 0) for i in range(5)]
    got = op12_whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and {round(r.explained, 12) for r in got} == {1.0}
    # a deviation that fits no long
    far = op12_whitening.whiten(table(spark, [(1, [1e30], 0), (2, [0.0], 0)])).collect()
    assert [r.deviation for r in far] == [None, None]


def test_polynomial_roots_and_multiplicity(spark):
    rng = np.random.default_rng(2)
    b = rng.integers(-9, 9, (7, 5)).astype(object)
    a = b @ b.T  # rank 5
    poly = op12_whitening.characteristic(spark, a)
    for x in (0, 1, -3, 11):
        m = [[Decimal(int(v)) for v in row] for row in np.eye(7, dtype=int).astype(object) * x - a]
        det, size = Decimal(1), 7
        for k in range(size):
            pivot = next((i for i in range(k, size) if m[i][k]), None)
            if pivot is None:
                det = Decimal(0)
                break
            if pivot != k:
                m[k], m[pivot], det = m[pivot], m[k], -det
            det *= m[k][k]
            for i in range(k + 1, size):
                f = m[i][k] / m[k][k]
                m[i] = [p - f * q for p, q in zip(m[i], m[k])]
        assert op12_whitening.value_at(poly, x) == int(det.to_integral_value())
    roots, found = op12_whitening.largest_roots(poly, int(np.trace(a)), 7)
    assert found == 5 and np.allclose([float(r) for r, _ in roots], np.linalg.eigvalsh(a.astype(float))[::-1][:5])
    # 3, 3, 3, 8: a threefold root and a whole one
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]], object)
    m = q.T @ np.diag(np.array([12, 12, 12, 32], object)) @ q
    roots, _ = op12_whitening.largest_roots(op12_whitening.characteristic(spark, m), int(np.trace(m)), 4)
    assert [(float(r), n) for r, n in roots] == [(128.0, 1), (48.0, 3)]
    vectors = [v for r, n in roots for v in op12_whitening.null_vectors(m, r, n)]
    u = np.array([[float(c) for c in v] for v in vectors])
    assert np.abs(u @ u.T - np.eye(4)).max() < 1e-15
    assert np.abs(u @ m.astype(float) @ u.T - np.diag([128, 48, 48, 48])).max() < 1e-12


# --- codes -------------------------------------------------------------------


def coded(rows, parts, entries, rounds, width):
    good = kept(rows, 1024, width)
    width = -(-width // parts) * parts
    dims = width // parts
    x = [[list(map(int, v)) + [0] * (width - len(v))][0] for _, v, _ in good]
    first = {}
    for (i, _, _), v in zip(good, x):
        if i is not None:
            first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first)[:entries]]
    cut = lambda v, p: v[p * dims : (p + 1) * dims]
    books = [[cut(s, p) for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((y - z) ** 2 for y, z in zip(a, b))

    def assign():
        return [[min((far(cut(v, p), e), n) for n, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            own = collections.defaultdict(list)
            for v, a in zip(x, at):
                own[a[p][1]].append(cut(v, p))
            for n, group in own.items():
                books[p][n] = [sum(c) // len(group) for c in zip(*group)]
    at = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in a) for a in at]
    label = collections.Counter()
    for (_, _, g), e in zip(good, error):
        label[g] += e
    code = ["".join(f"{n:02x}" for _, n in a) for a in at]
    whole = lambda e: e if e < 1 << 63 else None
    return collections.Counter((i, c, whole(e), whole(label[g]), digest) for (i, _, g), c, e in zip(good, code, error))


@pytest.mark.parametrize("block,entries,width", [(256, 256, 8), (3, 7, 8), (5, 16, 6)])
def test_codes_follow_the_definition(spark, block, entries, width):
    rows = rows_with_oddities(random.Random(4), 80, width)
    got = op13_codes.compress(table(spark, rows), entries=entries, block=block)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == coded(rows, 4, entries, 4, width)


def test_codes_of_large_and_missing_values(spark):
    rows = [(i, [float(i * 1e12), float(-i), 3.0, 1e4], 0) for i in range(12)]
    got = op13_codes.compress(table(spark, rows), entries=4)
    assert collections.Counter(tuple(r) for r in got.collect()) == coded(rows, 4, 4, 4, 4)
    assert op13_codes.compress(table(spark, [])).count() == 0
    assert op13_codes.compress(table(spark, [(None, [1.0], 0)])).count() == 0
    assert op13_codes.compress(table(spark, [(1, None, 0), (2, [], 0)])).count() == 0


def test_short_lists_hold_the_nearest_entry():
    rng = np.random.default_rng(7)
    for _ in range(50):
        entries = rng.integers(-40, 40, (30, 3)).astype(float)
        points = (rng.integers(-40, 40, 3) + rng.integers(-6, 6, (20, 3))).astype(float)
        listed = op13_codes.short_list(points.min(0), points.max(0), entries)
        whole, far = op13_codes.nearest(points, entries)
        part, same = op13_codes.nearest(points, entries[listed])
        assert (listed[part] == whole).all() and (far == same).all()


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T.astype(np.uint64)
    place = op13_codes.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    walk = cells[np.argsort(place)].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
