"""Benchmark passages are found, with substitutions, and clean text is left alone."""

import random

import numpy as np
import pytest

from panelcast.llm import op4_decontam
from panelcast.llm.queries import QUERIES

WORDS = [a + b for a in "ka lo mi nu re sa ti vo".split() for b in "bel dor fin gam hux jil".split()]


def prose(rng, n):
    return [rng.choice(WORDS) + rng.choice("abcdefghij") for _ in range(n)]


def build(rng, items=30):
    return [prose(rng, rng.randint(15, 50)) for _ in range(items)]


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.1, 0.95)])
def test_planted_passages(spark, share, least):
    rng = random.Random(1)
    tests = build(rng)
    docs, planted = [], {}
    for i in range(200):
        w = prose(rng, rng.randint(0, 400))
        if i % 2:
            item = rng.randrange(len(tests))
            quote = [x if rng.random() >= share else "other" for x in tests[item]]
            at = rng.randint(0, len(w))
            w = w[:at] + quote + w[at:]
            planted[i] = item
        docs.append((i, ("  " if i % 3 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(tests)], "item_id long, text string")
    got = op4_decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= set(planted.items())
    assert len(found) >= least * len(planted)
    if not share:
        assert all(r.matched == r.length == len(tests[r.item_id]) or r.matched > len(tests[r.item_id]) for r in got)


def test_odd_rows(spark):
    rng = random.Random(2)
    item = prose(rng, 20)
    quote = " ".join(item)
    short = prose(rng, 7)
    tests = [(1, quote), (1, quote), (2, None), (3, ""), (4, "too few words"), (5, " ".join(short)), (None, " ".join(prose(rng, 20)))]
    benchmark = spark.createDataFrame(tests, "item_id long, text string")
    filler = " ".join(prose(rng, 30000))
    rows = [(1, quote), (1, quote), (1, "clean " * 50), (None, quote), (2, None), (3, ""), (4, filler + " " + quote), (5, "too few words " * 9)]
    rows += [(6, filler), (7, "x " + " ".join(short) + " y"), (8, (quote + ". ") * 300)]
    docs = spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc_id long, text string, digest int, region string")
    got = {(r.doc_id, r.item_id) for r in op4_decontam.contaminated(docs, benchmark).collect()}
    assert got == {(1, 1), (None, 1), (4, 1), (7, 5), (8, 1)}
    kept = op4_decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6]
    assert op4_decontam.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert op4_decontam.decontaminate(docs.limit(0), benchmark).count() == 0


def test_best_stretch_against_all_stretches():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b, d = rng.integers(0, 2, 20), rng.integers(0, 2, 12), int(rng.integers(-6, 14))
        matched, first, end = op4_decontam.best_stretch(a, b, d)
        score = lambda s, e: sum(1 if a[i] == b[i - d] else op4_decontam.MISS for i in range(s, e))
        low, high = max(0, d), min(20, d + 12)
        assert score(first, end) == max(score(s, e) for s in range(low, high) for e in range(s + 1, high + 1))
        assert matched == sum(a[i] == b[i - d] for i in range(first, end))


def test_query_finds_every_quoted_item(spark):
    """All documents of the table that hold a whole item word for word."""
    import re

    folder = "/root/testdata/sf0.001"
    flat = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    items = {r.item_id: flat(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = {r.doc_id: flat(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_benchmark_decontamination"](spark, folder).collect()}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}
