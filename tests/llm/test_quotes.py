"""Quotes with substitutions: any stretch that keeps the rule is reported."""

import random

import numpy as np

from panelcast.llm import op4_decontam

from .test_decontam import prose


def holds(same, least):
    """Most matches of a stretch with at least ``least`` of them and 80 %, by all stretches."""
    sums = [0]
    for x in same:
        sums.append(sums[-1] + bool(x))
    every = [(sums[e] - sums[s], s, e) for s in range(len(same)) for e in range(s + 1, len(same) + 1)]
    return max((m for m, s, e in every if m >= least and 5 * m >= 4 * (e - s)), default=None)


def test_a_quote_is_found_wherever_all_stretches_find_one():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(5, 40))
        b = np.arange(n)
        a = np.where(rng.random(n) < rng.choice([0.1, 0.2, 0.3]), -1, b)
        least = min(10, 0.8 * n)
        want, got = holds(a == b, least), op4_decontam.quote(a, b, 0)
        assert (want is None) == (got is None)
        if want:
            assert got[0] >= least and got[0] == (a == b)[got[1] : got[2]].sum() and 5 * got[0] >= 4 * (got[2] - got[1])
            assert op4_decontam.longest_alike(a, b, 0)[0] == want


def test_substitutions_past_the_best_stretch(spark):
    rng = random.Random(3)
    item, long = prose(rng, 15), prose(rng, 150)
    tests = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], "item_id long, text string")
    rows = []
    for i, places in enumerate([(9, 11), (7, 12), (4, 9, 14), (3, 7, 11, 13)]):
        w = prose(rng, 40)
        w[20:20] = ["other" if k in places else x for k, x in enumerate(item)]
        rows.append((i, " ".join(w)))
    got = {(r.doc_id, r.item_id): (r.matched, r.length) for r in op4_decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()}
    assert got == {(0, 1): (13, 15), (1, 1): (11, 12), (2, 1): (12, 14)}


def test_short_items_keep_their_tolerance(spark):
    rng = random.Random(4)
    tests = {n: prose(rng, n) for n in range(4, 15)}
    rows, want = [], set()
    for n, item in tests.items():
        for place in range(n):
            w = prose(rng, 30)
            w[15:15] = [*item[:place], "other", *item[place + 1 :]]
            rows.append((100 * n + place, " ".join(w)))
            if n >= 5:
                want.add((100 * n + place, n))
    benchmark = spark.createDataFrame([(n, " ".join(t)) for n, t in tests.items()], "item_id long, text string")
    got = op4_decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_short_masks_hit_every_quote_that_keeps_the_rule():
    masks = op4_decontam.seeds(short=True)[len(op4_decontam.MASKS) :]
    for n in range(op4_decontam.SHORTEST, op4_decontam.LONG):
        b = np.arange(n)
        for bits in range(1 << n):
            same = (bits >> b & 1).astype(bool)
            if same.sum() < min(10, 0.8 * n) or op4_decontam.quote(np.where(same, b, -1), b, 0) is None:
                continue
            assert any(same[x + np.array(m)].all() for m in masks for x in range(n - m[-1]))
