"""Token counts of whole texts; huge texts in overlapping pieces that are spliced.

A text longer than one piece is cut into pieces that overlap.  Each piece is encoded on
its own, anywhere on the cluster, and reports where pre-tokens end inside its overlaps
and how many tokens it has up to there.  Two neighbours are spliced at a position where
both have such a boundary.

Why that is exact.  A byte-level pre-tokenizer reads from left to right, keeps nothing
but its position, and looks at most three characters past a match.  So (a) a boundary of
a piece, read from a true boundary on, is a boundary of the whole text unless it lies
within ``margin`` characters of the piece's end, margin being the longest special string
plus four; and (b) from a boundary that two pieces share, both read on alike.  A token
boundary inside a pre-token proves nothing and is not used.  By induction over the
pieces every splice is a true boundary.  Where two neighbours share none, the text is
cut anew with overlaps four times as wide, until it is one piece.

Words come back, so the library encodes a word once and its count is kept.  Texts and
pieces are cut into words only where a pre-token ends whatever stands around: before
white space that follows something else, after a letter or digit that an ASCII character
of another class follows.  No match of the pre-tokenizer goes on there, none looks back,
and white space stays whole with what follows it, so a text's tokens are the sum over its
words.  Special strings might span such a place, and U+001C to U+001F are white space to
Python alone: a text that holds one is a single word.  Of a piece, only what lies in the
overlaps is encoded with its positions.

Tokenizers of another kind (normalizers, pre-tokenizers that look back) get whole texts.
Nulls and empty texts have no bytes and no tokens.  Repeated rows are counted each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import words
from panelcast.llm.frames import text_or_empty, with_python
from panelcast.session import stage

STRIDE = 1 << 14  # characters from the start of one piece to that of the next
OVERLAP = 256
LIMIT = 512  # tokens beyond which a text is marked
KEPT = 1 << 19  # words whose counts a Python worker keeps, of up to LONGEST characters each
LONGEST = 64
_BATCH = 1 << 20  # bytes encoded at a time
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORD = re.compile(rf"\s*+[{_LETTERS}]++(?=[!-@\[-`{{-~\s]|$)|\s*+[0-9]++(?=[!-/:-~])|\s*+\S++|\s++")


def tokenizer(vocabulary: str):
    """The library's tokenizer of a .json text, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(vocabulary)
    made.no_truncation()
    made.no_padding()
    return made


def special_strings(vocabulary: str) -> list[str]:
    return [t["content"] for t in json.loads(vocabulary).get("added_tokens") or []]


def margin_of(vocabulary: str) -> int | None:
    """Characters before a piece's end whose boundaries prove nothing; None if pieces cannot be spliced."""
    spec = json.loads(vocabulary)
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or not plain:
        return None
    if before.get("add_prefix_space"):
        return None
    if (spec.get("model") or {}).get("dropout"):
        return None
    return max([0, *(len(t["content"]) for t in added)]) + 4


class TokenCounter:
    """Tokens of texts, each word encoded by the library once as long as its count is kept."""

    def __init__(self, vocabulary: str):
        self.made = tokenizer(vocabulary)
        self.spliced = margin_of(vocabulary) is not None
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, special_strings(vocabulary))]))
        self.kept: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """Stretches of the text, in order, whose tokens add up to its own."""
        return _WORD.findall(text) if self.spliced and not self.whole.search(text) else [text]

    def totals(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each list of words."""
        new = list(set().union(*texts) - self.kept.keys())
        self.kept.update(zip(new, map(len, self.made.encode_batch_fast(new, add_special_tokens=False))))
        out = [sum(map(self.kept.__getitem__, own)) for own in texts]
        for word in new:
            if len(word) > LONGEST:
                del self.kept[word]
        if len(self.kept) > KEPT:
            self.kept.clear()
        return out


@lru_cache(maxsize=1)
def counter(vocabulary: str) -> TokenCounter:
    """A Python worker's own, for all its tasks."""
    return TokenCounter(vocabulary)


def counts(column: pa.Array, count: TokenCounter) -> np.ndarray:
    """Tokens of each text of the column."""
    out = [np.empty(0, np.int64)]
    for a, b in words.batches_of(column, _BATCH):
        texts = [count.words(t or "") for t in column.slice(a, b - a).to_pylist()]
        out.append(np.array(count.totals(texts), np.int64))
    return np.concatenate(out)


def boundaries(encoding, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens end, from the piece's start on, and the tokens up to there."""
    word = np.array(encoding.word_ids, np.int64)
    if not len(word):
        return np.array([start]), np.array([0])
    ends = np.array(encoding.offsets, np.int64)[:, 1]
    last = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
    return start + np.r_[0, ends[last]], np.r_[0, last + 1]


def ends_of(
    texts: list[str], starts: list[int], heads: list[int], tails: list[int], count: TokenCounter
) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each piece: its boundaries up to ``heads`` and from ``tails`` on, the tokens up to each, and all its tokens.

    Between the two, places inside the piece, its words are only counted.
    """
    ends, middles = [], []
    cuts = []
    for text, head, tail in zip(texts, heads, tails):
        own = count.words(text)
        at = np.r_[0, np.cumsum([len(w) for w in own], dtype=np.int64)]
        i, j = int(np.searchsorted(at, head)), int(np.searchsorted(at, tail, "right")) - 1
        if i > j:  # one word covers both places
            i = j = len(own)
        cuts.append(int(at[j]))
        ends += [text[: at[i]], text[at[j] :]]
        middles.append(own[i:j])
    read = iter(count.made.encode_batch(ends, add_special_tokens=False))
    for start, cut, middle in zip(starts, cuts, count.totals(middles)):
        first, second = next(read), next(read)
        (at, before), (at2, before2) = boundaries(first, start), boundaries(second, start + cut)
        so_far = len(first) + middle
        yield np.r_[at, at2], np.r_[before, so_far + before2], so_far + len(second)


def pieces(texts: DataFrame, stride: int, overlap: int) -> DataFrame:
    """(uid, piece, start, last, text): overlapping pieces of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                count = max(1, -(-(len(text) - overlap) // stride))
                for a in range(0, count, 64):
                    own = list(range(a, min(a + 64, count)))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "uid": pa.array([uid] * len(own), pa.int64()),
                            "piece": pa.array(own, pa.int64()),
                            "start": pa.array([k * stride for k in own], pa.int64()),
                            "last": pa.array([k == count - 1 for k in own]),
                            "text": pa.array(
                                [text[k * stride : None if k == count - 1 else (k + 1) * stride + overlap] for k in own], pa.string()
                            ),
                        }
                    )

    return texts.select("uid", "text").mapInArrow(cut, "uid long, piece long, start long, last boolean, text string")


def splice(texts: DataFrame, vocabulary: str, margin: int, stride: int, overlap: int) -> DataFrame:
    """(uid, n_tokens) of each text; null where two neighbours share no boundary."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                uid, piece, start, last, text = (c.to_pylist() for c in part.columns)
                rows = {"uid": [], "junction": [], "tokens": [], "head": [], "head_at": [], "tail": [], "tail_at": []}

                def add(u, junction, tokens, head, tail, rows=rows):
                    for name, value in zip(rows, (u, junction, tokens, *head, *tail)):
                        rows[name].append(value)

                heads = [overlap if k > 0 else 0 for k in piece]
                tails = [len(t) if final else stride for t, final in zip(text, last)]
                read = ends_of(text, start, heads, tails, known)
                for u, k, s, final, t, (at, before, n) in zip(uid, piece, start, last, text, read):
                    if k > 0:
                        near = at <= s + overlap
                        add(u, k - 1, None, (before[near].tolist(), at[near].tolist()), (None, None))
                    if final:
                        add(u, k, n, (None, None), (None, None))
                    else:
                        near = (at >= s + stride) & (at <= s + len(t) - margin)
                        add(u, k, None, (None, None), (before[near].tolist(), at[near].tolist()))
                lists = pa.list_(pa.int64())
                kinds = [pa.int64()] * 3 + [lists] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    schema = "uid long, junction long, tokens long, head array<long>, head_at array<long>, tail array<long>, tail_at array<long>"
    # spread by piece: one huge text is encoded by many tasks
    reports = pieces(texts, stride, overlap).repartition("uid", "piece").mapInArrow(encode, schema)
    names = ("tokens", "head", "head_at", "tail", "tail_at")
    met = reports.groupBy("uid", "junction").agg(*[F.max(c).alias(c) for c in names])
    common = F.element_at(F.array_intersect("tail_at", "head_at"), 1)
    count = lambda side: F.element_at(side, F.array_position(f"{side}_at", F.col("common")).cast("int"))
    met = met.withColumn("common", F.when(F.size(F.array_intersect("tail_at", "head_at")) > 0, common))
    # all pieces up to here add (tokens before the splice) - (tokens the next piece has before it)
    share = F.coalesce("tokens", F.when(F.col("common").isNotNull(), count("tail") - count("head")))
    totals = met.select("uid", share.alias("share")).groupBy("uid").agg(
        F.sum("share").alias("n"), F.count(F.when(F.col("share").isNull(), 1)).alias("open")
    )
    return totals.select("uid", F.when(F.col("open") == 0, F.col("n")).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = LIMIT, stride: int = STRIDE, overlap: int = OVERLAP, text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``vocabulary`` is the path of a tokenizer's .json."""
    with open(vocabulary, encoding="utf-8") as file:
        vocabulary = file.read()
    margin = margin_of(vocabulary)
    rows = docs.select("doc_id", F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("text"))
    fits = F.lit(True) if margin is None else F.length("text") <= stride + overlap

    def whole(columns: list[pa.Array]) -> pa.Array:
        return pa.array(counts(columns[0], counter(vocabulary)))

    done = [with_python(rows.filter(fits), ["text"], "n_tokens", T.LongType(), whole).drop("text")]
    if margin is not None:
        todo = stage(rows.filter(~fits).withColumn("uid", F.monotonically_increasing_id()), "long-texts")
        while not todo.isEmpty():
            found = stage(splice(todo, vocabulary, margin, stride, overlap), "spliced")
            done.append(todo.drop("text").join(found.filter("n_tokens is not null"), "uid").select("doc_id", "n_bytes", "n_tokens"))
            todo = todo.join(found.filter("n_tokens is null"), "uid", "left_semi")
            overlap *= 4
            stride = max(stride, overlap)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.withColumn("over_limit", F.col("n_tokens") > limit)
