"""Mixing, URL rules, WARC archives and sharding: odd rows, bounds, and the SQL of all queries that have one."""

import collections
import glob
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelcast.llm import op3_mixing, op6_urls, op9_warc, op10_sharding
from panelcast.llm.frames import running_total
from panelcast.llm.queries import QUERIES, SQL
from panelcast.session import staging_path
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], SQL[name], SF) == ""


def test_every_operator_has_one_query():
    numbers = sorted(int(q[2:].split("_")[0]) for q in QUERIES)
    assert numbers == list(range(1, 14))


def test_running_total_of_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 9)) for i in range(3000)]
    got = running_total(spark.createDataFrame(rows, "k string, o long, v long").repartition(7), ["o"], "v", "t", key="k").collect()
    sums = collections.defaultdict(int)
    want = set()
    for k, o, v in rows:
        sums[k] += v
        want.add((k, o, v, sums[k]))
    assert {tuple(r) for r in got} == want


def doc_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, size int, rank string")


def targets(sizes):
    """Weights 5, 2, 1 in turn; what passes twice a source's size is shared out again until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_mixing_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["b", "a", "Z", "é", None, "a", "a"])) for i in range(900)]
    rows += [(None, "null id words", "a"), (None, "null id words", "a"), (5, "again", "b"), (5, "again", "b"), (901, None, None), (902, "", "empty")]
    docs = doc_rows(spark, rows)
    got = op3_mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets({s: n for s, n in sizes.items()})
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in want.values()})
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * sum(sizes.values())) <= 30
    by_source = collections.Counter()
    for r in op3_mixing.plan(docs).collect():
        by_source[r.source] += r["copies"] * r["size"]
    assert all(abs(by_source[s] - want[s]) <= 60 for s in want)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    again = op3_mixing.mix(docs.repartition(6)).collect()
    assert sorted(got, key=key) == sorted(again, key=key)
    mixed = op3_mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(op3_mixing.size_of())).first()[0] == sum(r.taken for r in got)


def test_mixing_nothing(spark):
    assert op3_mixing.mix(doc_rows(spark, [])).count() == 0
    assert op3_mixing.mixed(doc_rows(spark, [])).count() == 0
    empty = op3_mixing.mix(doc_rows(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in empty] == [(0, 0, 0.0, 0)] * 2


URLS = [
    (1, "http://example.org/es/x", "example.org/es/", "block"),
    (1, "http://example.org/es/x", "example.org/es/", "block"),
    (2, "https://A.B.Example.ORG/en/17?q#f", "example.org/en/1", "block"),
    (3, "http://example.org/en/2", "org/", "allow"),
    (4, "http://notexample.org/es/", "org/", "allow"),
    (5, "http://example.org", None, "allow"),
    (6, "http://example.org?/es/", None, "allow"),
    (7, "x.com/de/", None, "allow"),
    (8, "ftp://com/de/y", "com/de/", "block"),
    (9, "http://x.com/DE/y", None, "allow"),
    (10, "http://x.com:80/de/", None, "allow"),
    (11, None, None, "allow"),
    (12, "", None, "allow"),
    (None, "http://a.com/fr/" + "z" * 100000, "com/fr/", "allow"),
    (13, "http://é.org/ñ\n/x", "org/", "allow"),
]


@pytest.mark.parametrize("limit", [op6_urls.BROADCAST_RULES, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(op6_urls, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(i, u, "t", "h") for i, u, _, _ in URLS], "page_id long, url string, token string, host string")
    got = op6_urls.judge(pages, op6_urls.rule_table(spark)).collect()
    want = collections.Counter((i, r, v) for i, _, r, v in URLS)
    assert collections.Counter((r.page_id, r.rule, r.verdict) for r in got) == want
    assert {(r.host, r.path) for r in got if r.page_id == 2} == {("a.b.example.org", "/en/17")}


def test_rules_are_indexed_by_their_rarest_whole_token(spark):
    rules = spark.createDataFrame([("block", "a.com", "/x/rare"), ("block", "com", "/x/rare/"), ("allow", "", ""), ("block", "q.r", "/a\\E.b")], "verdict string, host string, path string")
    urls = spark.createDataFrame([("a.com", "/x/"), ("b.com", "/x/rare/"), ("c.com", "/y"), ("q.r", "/")], "host string, path string")
    got = {r.rule: r.token for r in op6_urls.index(rules, urls).collect()}
    assert got["a.com/x/rare"] == "h:a" and got["com/x/rare/"] == "p:rare" and got[""] == ""
    pages = spark.createDataFrame([(1, "s://q.r/a\\E.bz"), (2, "s://q.r/aE.b"), (3, "s://b.com/x/rare/1")], "page_id long, url string")
    judged = {r.page_id: (r.rule, r.verdict) for r in op6_urls.judge(pages, rules).collect()}
    assert judged == {1: ("q.r/a\\E.b", "block"), 2: ("", "allow"), 3: ("com/x/rare/", "block")}


def page_rows():
    same, twin = "same payload " * 20, "é" * 50
    rows = [(9, "http://a/1", same), (4, "http://a b/2\r\nX: y", same), (7, None, same), (4, "u", same), (None, "u", same)]
    rows += [(1, "u", "short"), (2, "u", "short"), (3, "u", ""), (5, "u", None), (6, "u", twin), (8, "u", twin)]
    rows += [(10, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 40), (11, "u", "x" * 3_000_000), (None, "u", "only null ids " * 20), (None, "u", "only null ids " * 20)]
    return rows


def expected(rows):
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 100 and i is not None:
            first[t] = min(first.get(t, i), i)
    out = collections.Counter()
    for i, _, t in rows:
        to = first.get(t)
        out[(i, len((t or "").encode()), digest(t), "response" if to in (None, i) else "revisit", None if to == i else to)] += 1
    return out


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, payload int")
    got = op9_warc.round_trip(pages).collect()
    assert collections.Counter(tuple(r) for r in got) == expected(rows)
    assert op9_warc.round_trip(pages.limit(0)).count() == 0


def test_members_stand_alone_and_the_sidecar_tells_where(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    raw, clean = staging_path(spark, "raw"), staging_path(spark, "clean")
    op9_warc.write(pages, raw)
    before = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{raw.removeprefix('file:')}/*.gz")))
    for f in glob.glob(f"{raw.removeprefix('file:')}/*.gz"):
        stream = zlib.decompressobj(31)
        with open(f, "rb") as file:
            stream.decompress(file.read())
        assert stream.eof and not stream.unused_data  # one member for the whole file
    assert op9_warc.normalise(spark, raw, clean).agg(F.sum("records")).first()[0] == len(rows)
    after = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{clean.removeprefix('file:')}/*.gz")))
    assert before == after
    seen = 0
    for r in op9_warc.offsets(spark, clean).collect():
        with open(r.archive.replace("file://", ""), "rb") as file:
            file.seek(r.offset)
            stream = zlib.decompressobj(31)
            text = stream.decompress(file.read(r.length))
        assert stream.eof and not stream.unused_data and text.startswith(b"WARC/1.1\r\n") and r.record.encode() in text
        seen += r.length
    assert seen == sum(len(open(f, "rb").read()) for f in glob.glob(f"{clean.removeprefix('file:')}/*.gz"))


def test_damaged_archives_are_refused():
    whole = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [b for _, _, b in op9_warc.records(iter([whole[:20], whole[20:] + whole]))] == [b"hello", b"hello"]
    for bad in (whole[:-3], whole[:25], whole.replace(b"5", b"4")):
        with pytest.raises(ValueError):
            list(op9_warc.records(iter([bad])))


def test_shards_fit_and_only_large_buckets_split(spark):
    rng = random.Random(3)
    rows = [(i, "y" * rng.randint(0, 300), "s") for i in range(1500)]
    rows += [(7, "dup" * 30, "s")] * 500 + [(None, "n" * 100, "s")] * 300 + [(2000, "long" * 5000, "s"), (2001, None, "s"), (2002, "", "s")]
    limit = 4000
    docs = doc_rows(spark, rows).withColumnRenamed("rank", "shard")
    got = op10_sharding.assign(docs, limit).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _, _ in rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    bits = lambda r: f"{int(hashlib.md5(str(r.doc_id if r.doc_id is not None else '').encode()).hexdigest()[:15], 16):060b}"
    everything = [(bits(r), r.n_bytes) for r in got]
    for name, own in shards.items():
        size = sum(r.n_bytes for r in own)
        assert {r.shard_bytes for r in own} == {size} and (size <= limit or len(own) == 1)
        prefix = name.split("-")[0]
        assert all(bits(r).startswith(prefix) and r.depth == len(prefix) for r in own)
        if prefix:
            assert sum(n for b, n in everything if b.startswith(prefix[:-1])) > limit
    whole = op10_sharding.sharded(docs, limit)
    assert whole.columns == [c for c in docs.columns if c != "shard"] + ["shard", "depth", "shard_bytes"]
    count = lambda rows: collections.Counter((r.doc_id, r.shard, r.shard_bytes) for r in rows)
    assert count(whole.collect()) == count(got)


def test_no_rows_make_no_shards(spark):
    assert op10_sharding.assign(doc_rows(spark, []), 100).count() == 0
    assert op10_sharding.sharded(doc_rows(spark, []), 100).count() == 0


def test_shards_are_written_by_folder(spark):
    folder = staging_path(spark, "shards")
    docs = doc_rows(spark, [(i, "t" * 50, "s") for i in range(100)])
    op10_sharding.write(docs, folder, 600)
    back = spark.read.parquet(folder)
    assert back.count() == 100 and back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).filter("b > 600").count() == 0
