"""The pipeline's stages, and its run against the same decisions made without Spark."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from panelcast.llm import op4_decontam, op7_quality, op8_simhash

from .test_simhash import fingerprint, groups

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "extendible_sharding",
    ]


def test_run_follows_each_stage_by_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.score for r in op7_quality.classify(table, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = sorted(i for i in docs if scores[i] >= 0.7)
    import pyarrow as pa

    fps = op8_simhash.fingerprints_of(pa.array([docs[i].text for i in left]), 4, 42).tolist()
    left = [i for i, c in zip(left, groups(fps, left, 4)) if i == c]
    found = op4_decontam.contaminated(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    left = [i for i in left if i not in {r.doc_id for r in found}]
    size = {i: len(docs[i].text.split()) for i in left}  # these texts hold no other white space
    sources = sorted({docs[i].source for i in left})
    total = {s: sum(size[i] for i in left if docs[i].source == s) for s in sources}
    line = []
    for n, s in enumerate(sources):
        so_far, weight = 0, (5, 2, 1)[n % 3]
        for i in sorted((i for i in left if docs[i].source == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            so_far += size[i]
            line += [((so_far + p * total[s]) / weight, n, p, i) for p in (0, 1)]
    taken, words = collections.Counter(), 0
    for *_, i in sorted(line):
        words += size[i]
        if 2 * words > 3 * sum(total.values()):
            break
        taken[i] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in got) == taken
    shards = collections.defaultdict(int)
    for r in got:
        shards[r.shard] += len(r.text.encode())
    assert all(shards[r.shard] == r.shard_bytes <= 1 << 20 for r in got)


def odd_rows():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("red green blue old new tree".split()) for _ in range(rng.randint(0, 50))), "en", f"s{i % 4}", i) for i in range(60)]
    rows += [(None, None, None, None, None)] * 3 + [(3, "x " * 40000, "en", None, 1), (rows[5])] + [(100, "", "", "", 0)] * 2
    return rows


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage(spark, docs, SF).columns[:5] == own
    wide = docs.selectExpr("*", "1 AS _id", "'q' AS _digest", "2 AS score", "3 AS _doc", "4 AS depth2", "5 AS `a.b`", "map('k', doc_id) AS m")
    out = stage(spark, wide, SF)
    assert out.count() > 0 and set(wide.columns) <= set(out.columns)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_odd_rows_that_stay(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: collections.Counter(tuple(r)[:5] for r in stages[name](spark, docs, SF).collect())
    scores = op7_quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r.doc_id for r in scores if r.predicted}
    if len({(r.doc_id, r.predicted) for r in scores}) == len({r.doc_id for r in scores}):  # copies of an id judged alike
        assert kept("quality_classifier") == collections.Counter(r for r in rows if r[0] in good)
    ids = [r[0] for r in rows]
    prints = [fingerprint(r[1]) for r in rows]
    heads = set()
    for f, i, r in zip(prints, groups(prints, list(range(len(rows))), 4), rows):
        heads.add(min((x for x, g in zip(rows, groups(prints, list(range(len(rows))), 4)) if g == i), key=lambda x: (x[0] is None, x[0] or 0))[0])
    got = kept("simhash_near_dedup")
    assert {r[0] for r in got} == heads and sum(got.values()) == len(set(groups(prints, list(range(len(rows))), 4)))
    assert kept("benchmark_decontamination") == collections.Counter(rows)  # none quotes an item
    assert kept("extendible_sharding") == collections.Counter(rows)
    mixed = kept("source_mixing")
    assert set(mixed) <= set(rows) and all(n <= 2 * collections.Counter(rows)[r] for r, n in mixed.items())
    assert None in ids
