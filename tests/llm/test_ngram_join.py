"""The n-gram join against all pairs."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import op11_ngram_join

from .test_simhash import ODD, groups_of


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_force(ids, texts):
    sets = [shingle_set(t) for t in texts]
    pairs = []
    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                pairs.append((a, b))
    root = groups_of(len(sets), pairs)
    members = collections.defaultdict(list)
    for i, r in enumerate(root):
        members[r].append(ids[i])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return collections.Counter((i, len(s), least[r] if s else i) for i, s, r in zip(ids, sets, root)), pairs, root


def variants(rng, count, size, changes):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[f"x{rng.randint(0, 99)}"], [], [w[at], "more"]])
        out.append(" ".join(w))
    return out


def table(spark, ids, texts):
    rows = [(i, t, 1, "z", {"k": 1}) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, node long, token string, m map<string,int>")


@pytest.mark.parametrize("chunk", [op11_ngram_join.GROUP, 5])
def test_components_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(op11_ngram_join, "GROUP", chunk)
    monkeypatch.setattr(op11_ngram_join, "CHUNK", chunk)
    rng = random.Random(3)
    # chains of texts that are alike only through others, groups that a passage joins, copies
    texts = ODD + variants(rng, 60, 120, 8) + variants(rng, 30, 400, 14) + variants(rng, 20, 30, 2) + ["same text here now"] * 9
    passage = " ".join(f"common{i}" for i in range(60))
    texts += [f"{passage} own {i} words {i * 7} behind {i * 3} it" for i in range(40)]
    texts += [" ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    ids = [None if i % 19 == 3 else 1000 - i for i in range(len(texts))]
    ids[5] = ids[6]
    want, pairs, root = brute_force(ids, texts)
    assert len({root[a] for a, _ in pairs}) > 5 and any(root[a] != root[b] for a in range(70) for b in range(10, 70))
    got = op11_ngram_join.join(table(spark, ids, texts))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_empty_table(spark):
    assert op11_ngram_join.join(table(spark, [], [])).count() == 0
    only = op11_ngram_join.join(table(spark, [4, None], [None, " "])).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in only) == [(False, 0, 4), (True, 0, None)]


def test_members_links_follow_from_differences():
    rng = np.random.default_rng(5)
    lead = np.arange(100, dtype=np.int64)
    sets = []
    for _ in range(120):
        out = rng.choice(lead, 100 - rng.integers(0, 12), replace=False)
        sets.append(np.union1d(out, rng.integers(100, 130, rng.integers(0, 10))))
    diffs = [np.setxor1d(lead, s) for s in sets]
    linked = np.array([19 * len(d) <= 100 + len(s) for d, s in zip(diffs, sets)])
    links = op11_ngram_join.derived(np.arange(120), np.array([len(s) for s in sets]), diffs, linked)
    want = [(a, b) for a in range(120) for b in range(a) if 19 * len(np.intersect1d(sets[a], sets[b])) >= 9 * (len(sets[a]) + len(sets[b]))]
    through_lead = [(120, i) for i in np.flatnonzero(linked).tolist()]
    assert 0 < linked.sum() < 120
    assert groups_of(121, links + through_lead) == groups_of(121, want + through_lead)


def test_runs_of_a_list_hold_every_entry_in_reach():
    rng = np.random.default_rng(6)
    size = np.sort(rng.integers(1, 60, 300))
    pos = np.minimum(rng.integers(0, 8, 300), size - 1)
    order = np.lexsort((pos, size))
    size, pos = size[order], pos[order]
    starts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
    ends = np.r_[starts[1:], len(size)]
    for i in range(1, 300):
        j = np.arange(i)
        fits = (10 * size[j] >= 9 * size[i]) & (19 * np.minimum(size[i] - pos[i], size[j] - pos[j]) >= 9 * (size[i] + size[j]))
        got = op11_ngram_join.run_of(size, pos, i, starts, ends)
        assert got.tolist() == j[fits].tolist()


def test_shingles_tell_short_sequences_apart():
    tokens, bounds = op11_ngram_join.shingles(pa.array(["a b", "a b c", "A B", "a", "", None, "a b c a b c"]), 3)
    found = [tokens[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert found[0] == found[2] and [len(f) for f in found] == [1, 1, 1, 1, 0, 0, 4]
    assert len({found[0][0], found[1][0], found[3][0]}) == 3 and found[6][0] == found[6][3] == found[1][0]


def test_profiles_never_rule_out_more_than_the_sets_differ_in():
    rng = np.random.default_rng(8)
    for size in (3, 80, 30000):
        a = np.unique(rng.integers(0, 1 << 58, size, dtype=np.uint64))
        b = np.union1d(rng.choice(a, len(a) - len(a) // 5, replace=False), rng.integers(0, 1 << 58, size // 6, dtype=np.uint64))
        rows = op11_ngram_join.profiles(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        apart = op11_ngram_join.far_apart(rows[0], rows[1:])[0]
        brief = op11_ngram_join.briefs(rows)
        assert 0 <= op11_ngram_join.far_apart(brief[0], brief[1:])[0] <= apart <= len(np.setxor1d(a, b))
        assert op11_ngram_join.far_apart(rows[0], rows[:1])[0] == 0
