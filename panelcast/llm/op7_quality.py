"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are hashed indicators of n-grams of tokens (runs of letters and digits, runs of
punctuation), of n-grams of token shapes, and of how much a text repeats its bigrams.
Each indicator is scaled by the log ratio of its smoothed counts in the two classes; a
linear hinge-loss model is fitted on the scaled, length-normalised rows by dual
coordinate descent; a sigmoid on rows left out of that fit turns margins into scores.

The fit reads at most ``FIT_ROWS`` labelled documents, chosen by a hash; scoring reads
every text in full.  Nulls count as empty texts, whose score comes from the intercept.
Without labels of both classes every score is the share of class 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import words
from panelcast.llm.frames import label_split, labelled_sample, packed, with_python
from panelcast.session import stage

FIT_ROWS = 12_000  # labelled documents the fit may read
BITS = 18  # features: 2 ** BITS
THRESHOLD = 0.7
_TOKENS = 1 << 20  # n-grams made at a time

#: 0 white space, 1 letters and digits (and all beyond ASCII), 2 punctuation
_CLASSES = np.full(256, 2, np.uint8)
_CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
_CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def shapes(w: words.Words) -> np.ndarray:
    """A small number for each token: class, capitals, digits and length."""
    if not len(w.starts):
        return np.empty(0, np.uint64)
    spans = np.stack([w.starts, w.ends], 1).ravel()
    count = lambda flags: np.add.reduceat(np.r_[flags, np.uint8(0)], spans, dtype=np.int64)[::2]
    upper = count(((w.data >= 65) & (w.data <= 90)).astype(np.uint8))
    digit = count(((w.data >= 48) & (w.data <= 57)).astype(np.uint8))
    length = w.ends - w.starts
    first = w.data[w.starts]
    capital = np.where(upper == length, 2, ((first >= 65) & (first <= 90)).astype(np.int64))
    long = np.minimum(np.log2(length + 1).astype(np.int64), 7)
    return (((_CLASSES[first].astype(np.int64) * 3 + capital) * 2 + (digit > 0)) * 8 + long).astype(np.uint64)


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the distinct feature ids of each text, in order."""
    w = words.split(column, lower=False, classes=_CLASSES)
    text, top, low = w.text_of(), np.uint64(64 - BITS), np.uint64(BITS)
    surface, shape = words.hashes(w), words.mix(shapes(w) + np.uint64(1))
    texts, keys, bigrams = len(column), [], []

    def add(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        found = words.distinct((owner.astype(np.uint64) << low) | (words.mix(h) >> top))
        keys.append(found)
        return found

    for a in range(0, len(text), _TOKENS):
        b = min(a + _TOKENS, len(text))
        for stream, longest in ((surface, 2), (shape, 3)):
            gram = np.full(b - a, np.uint64(longest))
            for n in range(1, longest + 1):
                end = min(b + n - 1, len(text))  # an n-gram may reach into the next block
                gram = gram[: end - a - n + 1] * words._BASE + stream[a + n - 1 : end]
                inside = text[a : a + len(gram)] == text[a + n - 1 : a + n - 1 + len(gram)]
                found = add(gram[inside] + np.uint64(n), text[a : a + len(gram)][inside])
                if n == 2 and stream is surface:
                    bigrams.append(found)
    pairs = words.distinct(np.concatenate([np.empty(0, np.uint64), *bigrams]))
    distinct = np.bincount((pairs >> low).astype(np.int64), minlength=texts)
    count = np.diff(w.bounds)
    share = (10 * distinct / np.maximum(count - 1, 1)).astype(np.int64)
    size = np.log2(count + 1).astype(np.int64)
    add((1 << 40) + (share * 64 + size).astype(np.uint64), np.arange(texts))
    add((1 << 41) + share.astype(np.uint64), np.arange(texts))
    every = words.distinct(np.concatenate(keys))
    owner = (every >> low).astype(np.int64)
    return (every & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(texts + 1))


@dataclass
class Model:
    """``scaled``: weight times ratio of each feature; ``square``: the ratio squared."""

    scaled: np.ndarray
    square: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margins(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        n = len(bounds) - 1
        norm = np.sqrt(np.bincount(owner, self.square[ids], n))
        return np.bincount(owner, self.scaled[ids], n) / np.where(norm > 0, norm, 1) + self.intercept

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(ids, bounds) + self.shift, -500, 500)))


def ratios(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's smoothed share in class 1 and class 0."""
    owner = np.repeat(y, np.diff(bounds))
    count = [1.0 + np.bincount(ids[owner == c], minlength=1 << BITS) for c in (0, 1)]
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def dual_descent(
    ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear hinge-loss model, one dual variable at a time.

    The intercept is the weight of one more feature that is 1 everywhere.  Ends early
    when no variable's projected gradient is over 0.01.
    """
    rng, sign = np.random.default_rng(seed), np.where(y > 0, 1.0, -1.0)
    rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    values = [ratio[r] for r in rows]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    square = [v @ v + 1 for v in values]
    weight, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = sign[i] * (weight[r] @ v + bias) - 1
            if alpha[i] <= 0:
                gradient = min(gradient, 0)
            elif alpha[i] >= cost:
                gradient = max(gradient, 0)
            if gradient:
                new = min(max(alpha[i] - gradient / square[i], 0), cost)
                step, alpha[i] = (new - alpha[i]) * sign[i], new
                weight[r] += step * v
                bias += step
                worst = max(worst, abs(gradient))
        if worst < 0.01:
            break
    return weight, bias


def sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that map margins to probabilities, by Newton steps on smoothed targets."""
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit_rows(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> Model:
    """The model of labelled rows in a fixed order; each fifth row serves the sigmoid only."""
    size = 1 << BITS
    hold = np.arange(len(y)) % 5 == 4
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(set(y)) == 2 or not len(y) else float(y[0])
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))

    def part(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.diff(bounds)
        return ids[np.repeat(pick, length)], np.r_[0, np.cumsum(length[pick])], y[pick]

    train, rest = part(~hold), part(hold)
    ratio = ratios(*train)
    weight, bias = dual_descent(*train, ratio)
    model = Model(weight * ratio, ratio * ratio, bias, 1.0, 0.0)
    model.slope, model.shift = sigmoid(model.margins(*rest[:2]), rest[2])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents; one task fits, on that bounded sample."""
    sample = labelled_sample(docs, labels, label, rows)

    def featurise(columns: list[pa.Array]) -> pa.Array:
        ids, bounds = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
        for a, b in words.batches_of(columns[0]):
            i, p = indicators(columns[0].slice(a, b - a))
            ids.append(i)
            bounds.append(p[1:] + bounds[-1][-1])
        return pa.ListArray.from_arrays(np.concatenate(bounds).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32)))

    features = with_python(sample, ["text"], "ids", T.ArrayType(T.IntegerType()), featurise).select("doc_id", "label", "ids")
    features = stage(features, "quality-features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        if not given:
            return
        table = pa.Table.from_batches(given).combine_chunks()
        lists = table["ids"].chunk(0)
        length = lists.value_lengths().to_numpy(zero_copy_only=False)
        ids = lists.flatten().to_numpy().astype(np.int64)
        model = fit_rows(ids, np.r_[0, np.cumsum(length)].astype(np.int64), table["label"].to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_pydict(
            {
                "scaled": [model.scaled.astype(np.float32).tobytes()],
                "square": [model.square.astype(np.float32).tobytes()],
                "rest": [[model.intercept, model.slope, model.shift]],
            }
        )

    one = features.orderBy(F.xxhash64("doc_id"), "doc_id").coalesce(1)
    found = one.mapInArrow(learn, "scaled binary, square binary, rest array<double>").collect()
    if not found:
        return fit_rows(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64))
    row = found[0]
    table = lambda x: np.frombuffer(x, np.float32).astype(np.float64)
    return Model(table(row["scaled"]), table(row["square"]), *row["rest"])


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text."""

    def task(columns: list[pa.Array]) -> pa.Array:
        parts = [np.empty(0)]
        for a, b in words.batches_of(columns[0]):
            parts.append(model.scores(*indicators(columns[0].slice(a, b - a))))
        return pa.array(np.concatenate(parts))

    return with_python(docs, [text], out, T.DoubleType(), task)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, label))
    return scored.select(
        "doc_id",
        (label_split(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    rows = packed(docs, "text")
    return score(rows, fit(docs, labels), "_score").filter(F.col("_score") >= threshold).select("_doc.*")
