"""Toxicity by a weighted finite-state grammar over clauses.

Words map to symbols (insult, threat, target, negation, reported speech, other).  Five
small transducers read the symbols of a clause, each with a state of its own and a
weight on every step; their composition, the reachable part of the product, is one
table.  A clause that holds an insult or a threat is run through it, and its weight is
the lexicon weight of each match times the weights of the steps: more where a target
stands near, less under a negation or in reported speech.  A text's margin is the log
of one plus the weights of its matched clauses; a sigmoid turns it into a score.

The lexicon has fixed words of four languages and terms learned from labels: words and
word beginnings that cover toxic texts and hardly occur in others, picked one after the
other by how many texts still unexplained they cover, so that chance words of copied
texts are not taken.  Learning reads at most ``FIT_ROWS`` labelled documents, chosen by
a hash; scoring reads every text in full.

Nulls and empty texts have margin 0 and get the score the sigmoid gives to that.
Without labels of both classes the sigmoid is a fixed one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import words
from panelcast.llm.frames import label_split, labelled_sample, with_python
from panelcast.llm.op7_quality import sigmoid
from panelcast.session import stage

FIT_ROWS = 20_000  # labelled documents the lexicon may be learned from
THRESHOLD = 0.3
LEAST_TEXTS = 2  # toxic texts a learned term must newly explain
PURITY = 0.8  # share of toxic texts among those that hold a learned term
STEMS = range(4, 9)  # characters of a word's beginning

# The starting vocabulary.
INSULTS = "idiot moron imbecile scumbag bastard asshole trottel vollidiot arschloch connard salaud abruti imbécil cabrón gilipollas"
THREATS = "kill murder strangle stab töten umbringen erwürgen tuer égorger étrangler matar apuñalar estrangular"
TARGETS = "you your yourself they them he she him her du dich dir ihr euch sie tu toi te vous il elle tú ti usted ustedes él ella"
NEGATIONS = "not no never none nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún"
REPORTS = "said says called wrote quoted claimed sagte sagt nannte schrieb dit disait écrit dijo dice escribió llamó"
PRIOR = 3.0  # weight of a term of the starting vocabulary

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6

#: 0 separators, 1 letters (and all beyond ASCII), 2 ends of clauses
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASSES[[ord(c) for c in ".!?;:\n"]] = 2


@dataclass(frozen=True)
class Transducer:
    """``step[state][symbol]`` is the next state, ``weight[state][symbol]`` what the step multiplies."""

    step: tuple[tuple[int, ...], ...]
    weight: tuple[tuple[float, ...], ...]


def window(opens: int, length: int, on: dict[int, float], stays: bool = False) -> Transducer:
    """After the symbol ``opens`` the next ``length`` steps multiply the symbols of ``on``.

    State s > 0 means s steps are left; with ``stays`` the window lasts to the clause's end.
    """
    states = range(length + 1)
    step = tuple(
        tuple(length if x == opens else (s if stays else max(s - 1, 0)) for x in range(SYMBOLS)) for s in states
    )
    weight = tuple(tuple(on.get(x, 1.0) if s else 1.0 for x in range(SYMBOLS)) for s in states)
    return Transducer(step, weight)


def accepts(kinds: dict[int, float]) -> Transducer:
    """One state; the symbols of ``kinds`` score, all others score nothing."""
    return Transducer(((0,) * SYMBOLS,), (tuple(kinds.get(x, 0.0) for x in range(SYMBOLS)),))


def compose(*parts: Transducer) -> Transducer:
    """All parts reading the same symbols at once: states are the tuples that can be reached."""
    start = (0,) * len(parts)
    number, todo, step, weight = {start: 0}, [start], [], []
    for state in todo:
        to, by = [], []
        for x in range(SYMBOLS):
            after = tuple(p.step[s][x] for p, s in zip(parts, state))
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            to.append(number[after])
            by.append(float(np.prod([p.weight[s][x] for p, s in zip(parts, state)])))
        step.append(tuple(to))
        weight.append(tuple(by))
    return Transducer(tuple(step), tuple(weight))


GRAMMAR = compose(
    accepts({INSULT: 1.0, THREAT: 0.6}),
    window(TARGET, 4, {INSULT: 1.4, THREAT: 2.0}),
    window(THREAT, 3, {INSULT: 1.5}),
    window(NEGATION, 2, {INSULT: 0.6, THREAT: 0.4}),
    window(REPORT, 1, {INSULT: 0.7, THREAT: 0.7}, stays=True),
)


def clause_weight(symbols: list[int], weights: list[float], grammar: Transducer = GRAMMAR) -> float:
    """Sum over the clause of each match's lexicon weight times its step's weight."""
    state, total = 0, 0.0
    for x, w in zip(symbols, weights):
        total += w * grammar.weight[state][x]
        state = grammar.step[state][x]
    return total


@dataclass
class Lexicon:
    """Symbol and weight by the hash of a word, and of a word's first characters by length."""

    exact: dict[int, tuple[int, float]]
    stems: dict[int, dict[int, tuple[int, float]]]
    slope: float = 4.0
    shift: float = -3.0


def hash_of(term: str) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    return int(words.hashes(words.Words(data, np.array([0]), np.array([len(data)]), np.array([0, 1])))[0])


def lexicon(learned: list[tuple[str, float]]) -> Lexicon:
    """``learned``: terms with their weights; a beginning of words ends in ``*``."""
    exact, stems = {}, {}
    for text, symbol in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT)):
        exact |= {hash_of(t): (symbol, PRIOR if symbol in (INSULT, THREAT) else 0.0) for t in text.split()}
    for term, weight in learned:
        stem = term.removesuffix("*")
        table = exact if stem == term else stems.setdefault(len(stem), {})
        table[hash_of(stem)] = (INSULT, weight)
    return Lexicon(exact, stems)


def prefix_ends(w: words.Words, length: int) -> np.ndarray:
    """Where the first ``length`` characters of each word end; -1 for shorter words."""
    chars = np.flatnonzero((w.data & 0xC0) != 0x80)
    at = np.searchsorted(chars, w.starts) + length
    end = np.r_[chars, np.full(length + 1, len(w.data))][np.minimum(at, len(chars))]
    return np.where((end <= w.ends) & (at <= len(chars)), end, -1)


def lookup(table: dict[int, tuple[int, float]], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, symbols, weights) for each hash."""
    keys = np.array(sorted(table), np.uint64)
    if not len(keys) or not len(h):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h))
    values = [table[int(k)] for k in keys]
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, np.array([v[0] for v in values])[at], np.array([v[1] for v in values])[at]


def margins(column: pa.Array, lex: Lexicon) -> np.ndarray:
    """Margin of each text; 0 where nothing matches."""
    w = words.split(words.folded(column), classes=_CLASSES)
    out = np.zeros(len(column))
    if not len(w.starts):
        return out
    symbol, weight = np.zeros(len(w.starts), np.int64), np.zeros(len(w.starts))
    for length, table in sorted(lex.stems.items()):
        ends = prefix_ends(w, length)
        some = np.flatnonzero(ends > 0)
        found, s, v = lookup(table, words.hashes(w, w.starts[some], ends[some]))
        symbol[some[found]], weight[some[found]] = s[found], v[found]
    found, s, v = lookup(lex.exact, words.hashes(w))
    symbol[found], weight[found] = s[found], v[found]
    text = w.text_of()
    stop = _CLASSES[w.data[w.starts]] == 2
    edges = np.flatnonzero(stop | np.r_[True, text[1:] != text[:-1]])
    matches = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    clauses = words.distinct(np.searchsorted(edges, matches, "right") - 1)
    totals = np.zeros(len(column))
    for c in clauses.tolist():
        a, b = int(edges[c]), int(edges[c + 1]) if c + 1 < len(edges) else len(text)
        totals[text[a]] += clause_weight(symbol[a:b].tolist(), weight[a:b].tolist())
    return np.log1p(totals)


def terms(text: str) -> set[str]:
    """Words of a text and their beginnings (with ``*``), in lower case."""
    found = set(re.findall(r"[a-z\x80-\U0010FFFF]+", text.lower()))
    return found | {t[:n] + "*" for t in found for n in STEMS if len(t) >= n}


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Lexicon:
    """Terms and sigmoid from at most ``rows`` labelled documents."""
    sample = labelled_sample(docs, labels, label, rows)
    # copies tell nothing new; a text labelled in two ways counts as toxic
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    sample = stage(sample, "toxicity-sample")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(own), pa.int64()), pa.array(own, pa.string())], names=["doc", "term"])

    toxic = sample.filter("label = 1").select(F.col("doc_id").cast("long"), "text").mapInArrow(spell, "doc long, term string")
    toxic = stage(toxic, "toxic-terms")
    frequent = toxic.groupBy("term").agg(F.count("*").alias("ones")).filter(F.col("ones") >= LEAST_TEXTS)
    candidates = stage(frequent, "candidate-terms")
    # bounded by the sample: terms of at most ``rows`` documents
    keys = {t: hash_of(t.removesuffix("*")) for (t,) in candidates.select("term").collect()}
    wanted: dict[int, np.ndarray] = {}
    for size, group in itertools.groupby(sorted(keys, key=lambda t: (t.endswith("*"), len(t))), lambda t: len(t) - 1 if t.endswith("*") else 0):
        wanted[size] = np.sort(np.concatenate([wanted.get(size, np.empty(0, np.uint64)), np.array([keys[t] for t in group], np.uint64)]))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.batches_of(batch.column(0)):
                w = words.split(words.folded(batch.column(0).slice(a, b - a)), classes=_CLASSES)
                text = w.text_of()
                for size, known in wanted.items():
                    ends = prefix_ends(w, size) if size else w.ends
                    some = np.flatnonzero(ends > 0)
                    h = words.hashes(w, w.starts[some], ends[some])
                    hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    place = np.searchsorted(known, h[hit])
                    pair = words.distinct(text[some][hit] * len(known) + place)
                    at, count = np.unique(pair % len(known), return_counts=True)
                    arrays = [pa.array(np.full(len(at), size)), pa.array(known[at].view(np.int64)), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["size", "hash", "zeros"])

    clean = sample.filter("label = 0").select("text").mapInArrow(occurrences, "size long, hash long, zeros long")
    against = {(r["size"], r["hash"]): r["zeros"] for r in clean.groupBy("size", "hash").agg(F.sum("zeros").alias("zeros")).collect()}
    zeros = lambda t: against.get((len(t) - 1 if t.endswith("*") else 0, int(np.uint64(keys[t]).view(np.int64))), 0)
    pure = {r.term: zeros(r.term) for r in candidates.collect() if r.ones >= PURITY * (r.ones + zeros(r.term))}
    n1, n0 = (sample.filter(F.col("label") == k).count() for k in (1, 0))

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = [f for f in frames if len(f)]
        rows = pd.concat(given) if given else pd.DataFrame({"doc": [], "term": []})
        yield pd.DataFrame(pick(rows.groupby("term").doc.agg(set).to_dict(), pure, n1, n0), columns=["term", "weight"])

    rows_left = toxic.filter(F.col("term").isin([])) if not pure else toxic.mapInPandas(
        lambda frames: (f[f.term.isin(pure)] for f in frames), "doc long, term string"
    )
    picked = rows_left.coalesce(1).mapInPandas(cover, "term string, weight double").collect()
    lex = lexicon([(r.term, r.weight) for r in picked])
    if n1 and n0:
        found = with_python(sample, ["text"], "margin", T.DoubleType(), lambda c: pa.array(margins(c[0], lex)))
        rows = found.select("margin", "label").toPandas()  # two numbers a row of the bounded sample
        lex.slope, lex.shift = sigmoid(rows.margin.to_numpy(), rows.label.to_numpy())
    return lex


def pick(texts: dict[str, set], zeros: dict[str, int], n1: int, n0: int) -> list[tuple[str, float]]:
    """Terms in the order in which they explain most toxic texts that none before explains.

    Of terms that explain the same, the purer, then the longer, then the first by letters.
    """
    left, out = {t: set(d) for t, d in texts.items()}, []
    while left:
        best = min(left, key=lambda t: (-len(left[t]), zeros[t], -len(t), t))
        new = left.pop(best)
        if len(new) < LEAST_TEXTS:
            break
        ones = len(texts[best])
        out.append((best, float(np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros[best] + 0.5) / (n0 + 1)))))
        left = {t: rest for t, d in left.items() if len(rest := d - new) >= LEAST_TEXTS}
    return [(t, w) for t, w in out if w > 0]


def score(docs: DataFrame, lex: Lexicon, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text."""

    def task(columns: list[pa.Array]) -> pa.Array:
        parts = [np.empty(0), *(margins(columns[0].slice(a, b - a), lex) for a, b in words.batches_of(columns[0]))]
        return pa.array(1 / (1 + np.exp(-np.clip(lex.slope * np.concatenate(parts) + lex.shift, -500, 500))))

    return with_python(docs, [text], out, T.DoubleType(), task)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, label))
    return scored.select(
        "doc_id",
        (label_split(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
