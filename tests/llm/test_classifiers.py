"""The quality classifier and the toxicity grammar: exact pieces, held-out accuracy, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import op5_toxicity, op7_quality, words
from panelcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, label int"


def made(count, seed=1):
    """Good texts and junk, harmless and toxic ones."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(count):
        w = [rng.choice("the of and river house walks green under seven light".split()) for _ in range(rng.randint(20, 60))]
        junk, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["zorblax", "grumfle" + rng.choice(["a", "os", "ito"])]))
        if junk:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


@pytest.mark.parametrize("operator,column,query", [(op7_quality, "quality", "op7_quality_nbsvm"), (op5_toxicity, "toxic", "op5_toxicity_grammar")])
def test_held_out_accuracy(spark, operator, column, query):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[query](spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    assert len(rows) == 1000 and right > 0.92 and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("operator,at", [(op7_quality, 1), (op5_toxicity, 2)])
def test_learns_and_reruns_alike_whatever_the_rows_are(spark, operator, at):
    rows, marks = made(400)
    odd = [(None, None, None, None), (None, "", "", 0), (7, rows[7][1], "s", 1), (90001, "zorblax " * 30000, "s", 1), (90002, "the of and " * 20000, None, 2)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, None), marks[5]], "doc_id long, quality int, toxic int")
    got = operator.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    again = operator.classify(docs.repartition(5), labels).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert sorted(got, key=key) == sorted(again, key=key)
    held = [(r.predicted, marks[r.doc_id][at]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    if operator is op5_toxicity:
        assert next(r for r in got if r.doc_id == 90001).predicted == 1
        assert next(r for r in got if r.doc_id == 90002).predicted == 0


@pytest.mark.parametrize("operator", [op7_quality, op5_toxicity])
def test_without_labels_or_rows(spark, operator):
    rows, marks = made(30)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert operator.classify(docs, labels.limit(0)).count() == 30
    assert operator.classify(docs, labels.filter("quality = 1 and toxic = 0")).count() == 30
    assert operator.classify(docs.limit(0), labels).count() == 0


def test_rejected_documents_go_and_clean_ones_stay(spark):
    rows, marks = made(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string, ids int")
    kept = op7_quality.keep_good(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, q, _ in marks if q}


def test_labels_of_held_out_rows_are_never_read(spark):
    rows, marks = made(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    frame = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    from panelcast.llm.frames import label_split

    flipped = frame.withColumns({c: F.when(label_split(F.col("doc_id")) == 2, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for operator in (op7_quality, op5_toxicity):
        a, b = (sorted(operator.classify(docs, x).select("doc_id", "score").collect()) for x in (frame, flipped))
        assert a == b


def test_indicators_are_those_of_each_text_alone():
    texts = ["a b a b a b", "", None, "THE! the... x", "one", "word " * 3000, "é漢 😀"]
    ids, bounds = op7_quality.indicators(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own, _ = op7_quality.indicators(pa.array([t], pa.string()))
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.tolist()


def test_indicators_do_not_depend_on_blocks(monkeypatch):
    column = pa.array(["alpha beta, gamma delta epsilon! " * 40, "zeta eta " * 30], pa.string())
    whole = op7_quality.indicators(column)
    monkeypatch.setattr(op7_quality, "_TOKENS", 7)
    monkeypatch.setattr(words, "SLICE", 16)
    small = op7_quality.indicators(column)
    assert all((a == b).all() for a, b in zip(whole, small))


def test_dual_descent_reaches_the_hinge_loss_optimum():
    """The primal value meets the dual bound on a small problem."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    y = np.array([int((r < 15).sum() >= 4) for r in rows])
    ids, bounds = np.concatenate(rows), np.arange(0, 481, 8)
    ratio = np.zeros(1 << op7_quality.BITS)
    ratio[:40] = rng.normal(size=40)
    w, b = op7_quality.dual_descent(ids, bounds, y, ratio, rounds=2000)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, 40] = 1
    sign, v = 2 * y - 1, np.r_[w[:40], b]
    primal = v @ v / 2 + np.maximum(0, 1 - sign * (x @ v)).sum()
    best = min(_subgradient(x, sign), primal)
    assert primal <= best * 1.01 + 1e-6


def _subgradient(x, sign):
    v, best = np.zeros(x.shape[1]), np.inf
    for t in range(1, 20000):
        miss = sign * (x @ v) < 1
        best = min(best, v @ v / 2 + np.maximum(0, 1 - sign * (x @ v)).sum())
        v = v - (v - (sign * miss) @ x) / t
    return best


def test_grammar_weighs_clauses():
    g = op5_toxicity
    weigh = lambda *symbols: g.clause_weight(list(symbols), [1.0] * len(symbols))
    assert weigh(g.OTHER, g.TARGET, g.NEGATION) == 0
    plain = weigh(g.INSULT)
    assert weigh(g.TARGET, g.INSULT) > plain > weigh(g.NEGATION, g.INSULT) > 0
    assert weigh(g.REPORT, *[g.OTHER] * 9, g.INSULT) < plain
    assert weigh(g.THREAT) < weigh(g.TARGET, g.OTHER, g.THREAT)
    assert weigh(g.NEGATION, *[g.OTHER] * 5, g.INSULT) == plain


def test_composition_equals_running_the_parts_side_by_side():
    g, rng = op5_toxicity, random.Random(1)
    parts = [g.accepts({g.INSULT: 1.0}), g.window(g.TARGET, 3, {g.INSULT: 2.0}), g.window(g.REPORT, 1, {g.INSULT: 0.5}, stays=True)]
    both = g.compose(*parts)
    for _ in range(200):
        symbols = [rng.randrange(g.SYMBOLS) for _ in range(12)]
        states, total = [0] * 3, 0.0
        for x in symbols:
            total += np.prod([p.weight[s][x] for p, s in zip(parts, states)])
            states = [p.step[s][x] for p, s in zip(parts, states)]
        assert total == pytest.approx(g.clause_weight(symbols, [1.0] * 12, both))


def test_terms_are_picked_by_what_they_explain():
    texts = {"bad": {1, 2, 3, 4}, "chance": {1, 2, 3}, "wor*": {5, 6, 7}, "worst": {5, 6}, "common": {1, 5}}
    got = op5_toxicity.pick(texts, dict.fromkeys(texts, 0), 7, 50)
    assert [t for t, _ in got] == ["bad", "wor*"] and all(w > 0 for _, w in got)


def test_beginnings_match_by_characters_not_bytes():
    lex = op5_toxicity.lexicon([("réeux*", 4.0), ("zut", 3.0)])
    got = op5_toxicity.margins(pa.array(["la RÉEUXpa est", "réeu", "zut!", "zutt", None, ""], pa.string()), lex)
    assert (got > 0).tolist() == [True, False, True, False, False, False]
