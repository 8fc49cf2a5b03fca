"""The Voronoi kNN join against all pairs."""

import random

import numpy as np
import pyarrow as pa

from panelcast.llm import op1_voronoi

NAN, INF = float("nan"), float("inf")


def brute(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(64 * float(x))) for x in v]
        whole[i] = min(whole.get(i, w), w)
    out = set()
    for q, a in whole.items():
        if q % every == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(ranked[:k], 1)}
    return out


def check(spark, rows, **settings):
    table = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], "vec_id long, embedding array<double>, cell int, block string")
    got = op1_voronoi.search(table, **settings)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, settings.get("k", 20), settings.get("every", 20))


def test_clusters_in_many_blocks_and_chunks(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8))
    rows = [(int(i), (centers[i % 12] + 0.1 * rng.normal(size=8)).tolist()) for i in rng.permutation(600)]
    check(spark, rows, k=5, every=7, pivots=20, block=10, chunk=100)


def test_one_vector_that_a_third_of_the_rows_repeat(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, -0.5] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(400)]
    check(spark, rows, k=6, every=4, pivots=8, block=16, chunk=64)


def test_odd_rows(spark):
    rows = [(0, [0.5, 1.0]), (20, [0.1]), (40, []), (60, None), (80, [1.0, None]), (100, [NAN]), (120, [INF, 1.0]), (None, [1.0, 1.0])]
    rows += [(0, [0.5, 1.0]), (7, [3.0, 3.0]), (7, [-3.0, 3.0]), (-20, [2.0, 2.0]), (3, [0.0, 0.0]), (5, [1e300, 0.0])][:-1]
    check(spark, rows)
    check(spark, rows[:0])
    check(spark, rows[:1])
    check(spark, [(1, [1.0]), (2, [2.0])])


def test_scores_beyond_a_double(spark):
    rows = [(i, [float((1 << 24) + i), float(3 * i - 7), 1.0]) for i in range(60)]
    check(spark, rows, k=4, every=10, pivots=6, block=3, chunk=20)


def test_rings_send_far_fewer_rows_than_all_when_clusters_are_apart():
    rng = np.random.default_rng(3)
    centers = 200 * rng.normal(size=(16, 6))
    x = np.floor(centers[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 6)))
    space = op1_voronoi.Space(np.floor(centers), float((x**2).sum(1).max()))
    d = space.distances(x, True)
    cell, dist = d.argmin(1), d.min(1)
    nearest = np.stack([np.sort(dist[cell == c])[:21] for c in range(16)])
    q = space.distances(x[:200], False)
    reach = op1_voronoi.bounds(space, q, nearest)[:, None] + space.slack()
    rings = (np.abs(q[:, cell] - dist) <= reach) & (space.to_planes(q)[:, cell] <= reach)
    need = rings.sum(1)
    scores = x[:200] @ x.T
    for i in range(200):
        top = np.argsort(-scores[i], kind="stable")[:21]
        assert rings[i, top].all()
    assert need.mean() < 0.3 * len(x)


def test_best_keeps_the_smaller_id_among_ties():
    rng = random.Random(4)
    scores = np.array([rng.randint(0, 5) for _ in range(200)])
    got = op1_voronoi.best(np.arange(200), scores, 20)
    assert got.tolist() == sorted(range(200), key=lambda i: (-scores[i], i))[:20]


def test_matrix_pads_short_rows():
    got = op1_voronoi.matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 3)
    assert got.tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
