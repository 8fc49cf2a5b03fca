"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, offered ``PASSES`` times.  A
copy's virtual finish time is the number of the source's words up to it, divided by the
source's weight.  All copies are sorted by that time over the whole corpus and the list
is cut where the words reach the budget.  A source that runs out leaves its share to the
others, so the cut gives what resharing the excess by weight until none is above its
limit gives: a source's target is the smaller of its limit and weight times the time at
the cut.

A word is ``[^\\x20\\x09-\\x0D]+``; a null text has none.  A null source is a source of its
own, the last.  Whole documents are taken; those without words are taken with the
document before them.  Rows that repeat doc_id stand next to each other in the queue.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.frames import WORD, orderable, packed, running_total, text_or_empty
from panelcast.session import stage

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
PASSES = 2  # how often a document may be taken
BUDGET = (3, 2)  # words to take, as a share of all words
SEED = "mix:"


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, rank, weight, target of each source of ``rows`` (source, size)."""
    per = lcm(*weights)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = stage(sums.withColumn("one", F.lit(1).cast("long")), "source-sizes")
    named = sums.select("*", F.col("source").isNull().cast("int").alias("_last"), F.coalesce("source", F.lit("")).alias("_name"))
    ranked = running_total(named, ["_last", "_name"], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    limits = ranked.withColumn("weight", weight).withColumn("limit", PASSES * F.col("source_size"))
    # the time at which a source runs out, times ``per``: a whole number
    limits = limits.withColumn("out", F.col("limit") * (F.lit(per) / F.col("weight")).cast("long"))
    filled = running_total(limits, ["out", "rank"], "limit", "limits")
    filled = stage(running_total(filled, ["out", "rank"], "weight", "weights"), "source-limits")
    words, open_weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = 0.0
    if words:
        num, den = BUDGET
        spent, still = F.col("limits") - F.col("limit"), F.lit(open_weight) - F.col("weights") + F.col("weight")
        wide = lambda c: c.cast("decimal(38,0)")
        # words taken by the time this source runs out, all before it having run out
        enough = wide(spent) * (den * per) + wide(F.col("out")) * den * wide(still) >= F.lit(num * per * words).cast("decimal(38,0)")
        at = filled.filter(enough).agg(F.min(F.struct("out", "rank", spent.alias("spent"), still.alias("still"))).alias("at")).first()["at"]
        level = float(num * words - den * at["spent"]) / float(den * at["still"])
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level))
    return stage(filled.select("source", "source_size", "rank", "weight", target.alias("target")), "source-targets")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, key: Column | None = None) -> DataFrame:
    """doc_id, _row, size, source_size, target and ``copies``, how often the mix takes the row."""
    rows = docs.select("doc_id", "source", (F.xxhash64("text") if key is None else key).alias("_row"), size_of().alias("size"))
    rows = rows.withColumn("_turn", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = stage(rows, "mix-sizes")
    known = sources(rows, weights)
    queued = rows.select("*", F.col("source").isNull().cast("int").alias("_last"), F.coalesce("source", F.lit("")).alias("_name"))
    queued = queued.withColumn("_queue", F.concat("_last", "_name"))
    queued = running_total(queued, ["_turn", "_row"], "size", "so_far", key="_queue")
    known = known.withColumnRenamed("source", "_source")
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_last", "_name", "_queue")
    queued = stage(queued, "mix-queues")
    words = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    time = lambda turn: (F.lit(turn).cast("long") * F.col("source_size") + F.col("so_far")).cast("double") / F.col("weight")
    order = ["time", "rank", "pass", "_turn", "_row"]
    copy = lambda turn: F.struct(time(turn).alias("time"), "rank", F.lit(turn).alias("pass"), "_turn", "_row")
    copies = queued.select("size", F.explode(F.array(*[copy(t) for t in range(PASSES)])).alias("c")).select("size", "c.*")
    lined = running_total(copies, order, "size", "words")
    num, den = BUDGET
    end = lined.filter(den * F.col("words") <= num * words).agg(F.max(F.struct(*order)).alias("end"))
    end = end.first()["end"]  # one row: the last copy within the budget
    if end is None:
        taken = F.lit(0)
    else:
        last = F.struct(
            F.lit(end["time"]).cast("double").alias("time"), F.lit(end["rank"]).cast("long").alias("rank"),
            F.lit(end["pass"]).cast("int").alias("pass"), F.lit(end["_turn"]).alias("_turn"), F.lit(end["_row"]).cast("long").alias("_row"),
        )
        taken = sum((F.when(copy(t) <= last, 1).otherwise(0) for t in range(PASSES)), F.lit(0))
    return queued.select("doc_id", "_row", "source", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken."""
    rows = packed(docs, "doc_id", "text", "source")
    row = F.xxhash64(orderable("_doc", docs))
    chosen = plan(rows, key=row).groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"))
    chosen = stage(chosen.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "mix-copies").filter("_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (row == F.col("_key"))
    once = rows.join(chosen.filter("_rows = 1"), same).select("_doc", "_copies")
    # repeated rows are alike in every column: one of them, as often as all are taken
    alike = rows.join(chosen.filter("_rows > 1"), same).groupBy("_id", "_key").agg(F.min_by("_doc", orderable("_doc", docs)).alias("_doc"), F.first("_copies").alias("_copies"))
    every = once.unionByName(alike.select("_doc", "_copies"))
    return every.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS lim FROM s),
f AS (
  SELECT *, lim * (10 // weight) AS out_at,
         sum(lim) OVER o - lim AS spent, sum(weight) OVER () - sum(weight) OVER o + weight AS still, sum(source_size) OVER () AS words
  FROM w WINDOW o AS (ORDER BY lim * (10 // weight), rank ROWS UNBOUNDED PRECEDING)),
v AS (
  SELECT CAST(3 * words - 2 * spent AS DOUBLE) / CAST(2 * still AS DOUBLE) AS level, words FROM f
  WHERE 20 * spent + 2 * out_at * still >= 30 * words ORDER BY out_at, rank LIMIT 1),
q AS (
  SELECT d.doc_id, d.size, d.turn, w.rank, w.weight, w.source_size, least(CAST(w.lim AS DOUBLE), w.weight * v.level) AS target, v.words,
         sum(d.size) OVER (PARTITION BY w.rank ORDER BY d.turn ROWS UNBOUNDED PRECEDING) AS so_far
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN v),
c AS (SELECT q.*, p.pass, CAST(p.pass * source_size + so_far AS DOUBLE) / weight AS finish FROM q CROSS JOIN (VALUES (0), (1)) p(pass)),
t AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, turn ROWS UNBOUNDED PRECEDING) AS line FROM c)
SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(CASE WHEN 2 * line <= 3 * words THEN size ELSE 0 END) AS BIGINT) AS taken
FROM t GROUP BY doc_id
"""
