"""Spliced token counts equal those of whole texts."""

import collections
import json
import random

import pytest

import public_tokenizers
from panelcast.llm import op2_tokens
from panelcast.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", " ", "  ", "\n", "é", "'ll", "'r", "e", "1", "<|endoftext|>", "<|endo", "!?", "\t", "漢", "😀", "abc", "\u00a0"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def noise(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("stride,overlap", [(48, 20), (64, 40)])
def test_pieces_splice_to_the_whole(spark, tokenizer, stride, overlap):
    rng = random.Random(overlap)
    rows = [(i, noise(rng, rng.randint(0, 900))) for i in range(120)]
    rows += [(1000, "a" * 5000), (1001, " " * 3000 + "b"), (1002, "<|endoftext|>" * 200), (1003, None), (1004, ""), (1005, "é" * 900 + " x" * 500)]
    rows += [(None, "the same " * 50)] * 3
    docs = spark.createDataFrame([(i, t, 5, "u") for i, t in rows], "doc_id long, text string, uid int, n_tokens string")
    got = op2_tokens.count_tokens(docs, PATH, limit=100, stride=stride, overlap=overlap).collect()
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False))
    want = collections.Counter((i, len((t or "").encode()), count(t), count(t) > 100) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_query_counts_every_document(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op2_token_counts"](spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False)) for i, t in texts.items()}


def test_tokenizers_that_cannot_be_spliced_get_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as file:
        assert op2_tokens.margin_of(file.read()) is None
    text = "Some WORDS and 1 more. " * 40
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = op2_tokens.count_tokens(docs, path, stride=30, overlap=10).first()
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    assert got.n_tokens == len(whole.encode(text, add_special_tokens=False))


def test_margin_covers_the_longest_special_string():
    with open(PATH) as file:
        text = file.read()
    assert op2_tokens.margin_of(text) == len("<|endoftext|>") + 4
    spec = json.loads(text)
    spec["added_tokens"][0]["lstrip"] = True
    assert op2_tokens.margin_of(json.dumps(spec)) is None


def test_no_rows(spark):
    assert op2_tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_add_up_to_their_text(tokenizer):
    with open(PATH, encoding="utf-8") as file:
        count = op2_tokens.TokenCounter(file.read())
    rng = random.Random(5)
    signs = [
        *PARTS, *"sStTdDzßéÿ×÷ɏɐ0129٣²'’.,|<>*-_@[`{~!/:", *"\x00\x0b\x0c\x1b\x1c\x1f\x7f\x85\u00a0\u00ad\u0301\u1680\u180e",
        *"\u2003\u200b\u2028\u202f\u205f\u2060\u3000\ufeff", "\r\n", "don't", "I'LL", "'ve", "word", "Wort.", "12.5", "a1b2",
    ]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    texts += [a + b + c for a in signs for b in signs for c in ("x", " ", "\n", "!", "é")]
    texts += ["", " ", "word\n", "  \n\n x  ", "漢字" * 500, "a" * 3000 + " " * 3000]
    cut = [count.words(t) for t in texts]
    assert ["".join(c) for c in cut] == texts
    assert count.totals(cut) == [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, count.kept)) <= op2_tokens.LONGEST


def test_the_library_gets_a_word_once():
    import pyarrow as pa

    with open(PATH, encoding="utf-8") as file:
        count = op2_tokens.TokenCounter(file.read())
    sent = []
    batch, fast = count.made.encode_batch, count.made.encode_batch_fast

    class Recorded:
        def encode_batch(self, texts, **options):
            sent.extend(texts)
            return batch(texts, **options)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return fast(texts, **options)

    count.made = Recorded()
    text = " ".join(f"Some words, and {i % 10} more." for i in range(500))
    assert len(set(op2_tokens.counts(pa.array([text] * 50), count).tolist())) == 1
    assert sum(map(len, sent)) < len(text) / 100
    # a piece is encoded in its overlaps alone
    sent.clear()
    whole = batch([text], add_special_tokens=False)[0]
    at, before, n = next(iter(op2_tokens.ends_of([text], [0], [100], [len(text) - 100], count)))
    assert sum(map(len, sent)) < 300 and n == len(whole)
    want = dict(zip(*(x.tolist() for x in op2_tokens.boundaries(whole, 0))))
    assert dict(zip(at.tolist(), before.tolist())).items() <= want.items()
    assert [p for p in want if p <= 100 or p >= len(text) - 100] == sorted({p for p in at.tolist() if p <= 100 or p >= len(text) - 100})


def test_kept_counts_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(op2_tokens, "KEPT", 50)
    with open(PATH, encoding="utf-8") as file:
        count = op2_tokens.TokenCounter(file.read())
    for a in range(0, 300, 20):
        texts = [f"word{i} and {i * i}" for i in range(a, a + 20)]
        assert count.totals([count.words(t) for t in texts]) == [len(tokenizer.encode(t)) for t in texts]
        assert len(count.kept) <= 50


def test_random_merges_are_not_spliced():
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["dropout"] = 0.1
    assert op2_tokens.margin_of(json.dumps(spec)) is None
