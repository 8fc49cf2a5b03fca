"""Whole results of the classifiers and of decontamination against plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import op4_decontam, op5_toxicity, op7_quality
from panelcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, {r.doc_id: r.text or "" for r in docs.collect()}


def sigmoid(x):
    return 1 / (1 + math.exp(-min(max(x, -500), 500)))


def test_quality_scores_of_every_text(spark):
    docs, labels, texts = tables(spark)
    model = op7_quality.fit(docs, labels)
    rows = QUERIES["op7_quality_nbsvm"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids, _ = op7_quality.indicators(pa.array([texts[r.doc_id]]))
        assert len(set(ids.tolist())) == len(ids)  # indicators, not counts
        norm = math.sqrt(sum(float(model.square[i]) for i in ids)) or 1.0
        margin = sum(float(model.scaled[i]) for i in ids) / norm + model.intercept
        want = sigmoid(model.slope * margin + model.shift)
        assert r.score == pytest.approx(want, abs=1e-9) and (r.predicted == int(want >= 0.7) or abs(want - 0.7) < 1e-9)


def plain_margin(text, lex):
    """Clauses begin at a stop or the text; each match adds its weight times what the grammar gives its place."""
    clause, total = [], 0.0

    def close():
        return op5_toxicity.clause_weight([s for s, _ in clause], [w for _, w in clause])

    for token in re.findall(r"[a-z\x80-\U0010FFFF]+|[.!?;:\n]+", text.lower()):
        if token[0] in ".!?;:\n":
            total += close()
            clause = [(op5_toxicity.OTHER, 0.0)]
            continue
        meaning = lex.exact.get(op5_toxicity.hash_of(token))
        for n in sorted(lex.stems, reverse=True):
            if meaning is None and len(token) >= n:
                meaning = lex.stems[n].get(op5_toxicity.hash_of(token[:n]))
        clause.append(meaning or (op5_toxicity.OTHER, 0.0))
    return math.log1p(total + close())


def test_toxicity_scores_of_every_text(spark):
    docs, labels, texts = tables(spark)
    lex = op5_toxicity.learn(docs, labels)
    rows = QUERIES["op5_toxicity_grammar"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert lex.stems or len(lex.exact) > 100  # something was learned beyond the starting vocabulary
    for r in rows:
        want = sigmoid(lex.slope * plain_margin(texts[r.doc_id], lex) + lex.shift)
        assert r.score == pytest.approx(want, abs=1e-9) and (r.predicted == int(want >= 0.3) or abs(want - 0.3) < 1e-9)


def test_a_text_labelled_in_two_ways_counts_as_toxic(spark):
    good = [(i, f"green river house number {i} walks under light", 0) for i in range(40)]
    bad = [(100 + i, f"zorblax green river house {i}", 1) for i in range(40)]
    both = [(200 + i, bad[i][1], 0) for i in range(10)]  # copies with the other label
    rows = good + bad + both
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    first = {r.doc_id: (r.score, r.predicted) for r in op5_toxicity.classify(docs, labels).collect()}
    again = {r.doc_id: (r.score, r.predicted) for r in op5_toxicity.classify(docs.repartition(7), labels.repartition(3)).collect()}
    assert first == again and all(first[i][1] == 1 for i in (100, 139, 200)) and first[3][1] == 0


def test_decontamination_against_all_alignments(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 800)}"
    items = []
    for i in range(14):
        w = [word() for _ in range(rng.randint(15, 40))]
        if i % 3 == 0:  # the item repeats a passage of its own
            w += w[3:15] + [word()]
        items.append((i, w))
    items += [(90, [word() for _ in range(9)]), (91, [word() for _ in range(4)])]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.randint(5, 50))]
        for _ in range(rng.randint(0, 2)):
            _, w = rng.choice(items)
            cut = rng.randint(0, max(0, len(w) - 12)) if rng.random() < 0.3 else 0
            quoted = [word() if rng.random() < rng.choice([0, 0.1, 0.15, 0.35]) else x for x in w[cut:]]
            at = rng.randint(0, len(body))
            body[at:at] = quoted
        docs.append((d, body))
    number = {w: i for i, w in enumerate(sorted({x for _, b in docs + items for x in b}))}
    code = lambda b: np.array([number[x] for x in b])
    want = set()
    for d, body in docs:
        a = code(body)
        for i, w in items:
            b = code(w)
            if len(b) < op4_decontam.SHORTEST:
                continue
            if any(op4_decontam.quote(a, b, g) for g in range(-len(b) + 1, len(a)) if (a[max(g, 0) : g + len(b)] == b[max(-g, 0) : len(a) - g]).sum() >= 4):
                want.add((d, i))
    text = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in op4_decontam.contaminated(text(docs, "doc_id"), text(items, "item_id")).collect()}
    assert not got - want
    # the five masks leave about one quote in a hundred without a seed
    assert len(want) > 60 and len(got) >= 0.97 * len(want)
