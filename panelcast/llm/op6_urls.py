"""URL rules found by their rarest literal token.

A rule names a host (with all its subdomains) and the beginning of a path.  Literal
tokens that every URL it fits must hold are the labels of its host and those words of
its path that end inside the path.  The rule is indexed by the one of them that fewest
URLs hold, counted over the whole table.  A URL fetches the rules under its own tokens,
and only these run their regular expression.  The longest rule that fits decides, the
first by code point among equally long ones; without one the verdict is ``DEFAULT``.

Null URLs and those without ``://`` have an empty host and path, and no rule fits them.
Repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
BROADCAST_RULES = 50_000  # a larger index is joined by shuffle
SALTS = 16


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    found = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    lowered = F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, found(2)


def _tokens(host: Column, path: Column, word: str) -> Column:
    """Labels and words, told apart by a first letter; '' fetches rules without any token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    inside = F.transform(F.regexp_extract_all(path, F.lit(word), F.lit(1)), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, inside))


def url_tokens(host: str = "host", path: str = "path") -> Column:
    return F.when(F.col(host) == "", F.array(F.lit(""))).otherwise(_tokens(F.col(host), F.col(path), "([A-Za-z0-9]+)"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(verdict, host, path) of each rule; a path is empty or starts with a slash."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule, verdict, pattern): each rule under its rarest token among ``urls`` (host, path)."""
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    host = F.when(F.col("host") == "", r"[^/]*").otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), quoted(F.col("host"))))
    path = F.when(F.col("path") == "", r"(?:/|\z)").otherwise(quoted(F.col("path")))
    ruled = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", F.concat(F.lit(r"\A"), host, path).alias("pattern"),
        # a word counts only if the rule itself shows where it ends
        F.array_except(_tokens(F.col("host"), F.col("path"), r"([A-Za-z0-9]+)(?![A-Za-z0-9]|\z)"), F.array(F.lit("h:"))).alias("tokens"),
    ).distinct()
    held = ruled.select("rule", "verdict", "pattern", F.explode("tokens").alias("token"))
    counts = (
        urls.select(F.explode(url_tokens()).alias("token"))
        .groupBy("token").count()
        .join(held.select("token").distinct(), "token", "left_semi")
    )
    ranked = held.join(counts, "token", "left").select(
        "rule", "verdict", "pattern", F.struct((F.col("token") == "").alias("any"), F.coalesce("count", F.lit(0)).alias("n"), "token").alias("t")
    )
    return ranked.groupBy("rule", "verdict", "pattern").agg(F.min("t").alias("t")).select("t.token", "rule", "verdict", "pattern")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    host, path = parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    indexed = index(rules, urls)
    asked = urls.withColumn("_url", F.monotonically_increasing_id()).withColumn("token", F.explode(url_tokens()))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = asked.join(F.broadcast(indexed), "token", "left")
    else:
        salted = indexed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("_salt", (F.col("_url") % SALTS).cast("int")).join(salted, ["token", "_salt"], "left")
    fits = F.expr("rule is not null AND concat(host, path) RLIKE pattern")
    # least of: longer first, then by code point
    best = F.min(F.when(fits, F.struct((-F.length("rule")).alias("n"), "rule", "verdict"))).alias("best")
    judged = met.groupBy("_url").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), best)
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


SQL = f"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT page_id, n, translate(coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path
  FROM p),
r(verdict, rh, rp) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (
  SELECT n, min_by(rh || rp, -length(rh || rp)) AS rule, min_by(verdict, -length(rh || rp)) AS verdict
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(m.verdict, '{DEFAULT}') AS verdict FROM u LEFT JOIN m USING (n)
"""
