"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every URL is expanded into the expressions a rule could be written as: each suffix of its host at
a dot, with each prefix of its path whose length some rule has. Expressions and rules meet in an
equi-join on the first ``PREFIX_HEX`` hex digits of the SHA-256 digest; the full digest then
confirms the match, and the longest rule wins. All of it is built-in column functions.

Cases: a null URL, or one without ``://``, has empty host and path and fits no rule. Repeated
rows are returned as often as they came. An empty table of pages or of rules gives an empty
result, or one where no rule fits. Rules with null in a column are left out; of equal rules
with different verdicts ``block`` holds.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
SALTS = 8


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, as they stand in it."""
    parts = F.regexp_extract
    rest = r"(?s)^.*?://"
    host = F.coalesce(parts(url, rest + r"([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(parts(url, rest + r"[^/?#]*([^?#]*)", 1), F.lit(""))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), path


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) written down in code as a table."""
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r))) for r in rules]
    if not rows:
        return spark.range(0).selectExpr("'' AS verdict", "'' AS host", "'' AS path")
    return spark.range(1).select(F.inline(F.array(*rows)))


def _digest(host: Column, path: Column) -> Column:
    """Digest of an expression; hosts hold no slash, so that host and path can't run together."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    key: str = "page_id",
    default: str = "allow",
    salts: int = SALTS,
) -> DataFrame:
    """``key``, host, path, rule and verdict of each row of ``pages``.

    ``rules`` has the columns verdict, host and path. The expressions of a frequent host are
    salted and the rules repeated ``salts`` times; a table of rules small enough for Spark's own
    broadcast is joined without any shuffle. The distinct lengths of rule paths come to the
    driver: there are no more of them than characters in the longest path.
    """
    best = F.max(F.struct(F.col("verdict") == "block", "verdict")).alias("best")
    rules = (
        rules.select(*(F.col(c).cast("string").alias(c) for c in ("verdict", "host", "path")))
        .dropna()
        .groupBy("host", "path")
        .agg(best)
        .select("host", "path", F.col("best.verdict").alias("rule_verdict"))
    )
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = parse_url(F.col(url))
    once = (
        pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
        .groupBy("page_id", "url")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumns({"host": host, "path": path})
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))
    expressions = F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"))))
    )
    ours = once.withColumn("e", F.explode_outer(expressions))
    ours = ours.withColumn("digest", _digest(F.col("e.h"), F.col("e.p")))
    ours = ours.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    ours = ours.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    theirs = rules.select(
        F.concat("host", "path").alias("rule"),
        "rule_verdict",
        F.length("host").alias("host_length"),
        _digest(F.col("host"), F.col("path")).alias("full"),
    )
    theirs = theirs.withColumn("short", F.substring("full", 1, PREFIX_HEX))
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = ours.join(theirs, ["short", "salt"], "left")
    sure = F.col("digest") == F.col("full")
    fit = F.when(sure, F.struct(F.length("rule"), "host_length", "rule", "rule_verdict"))
    return (
        met.groupBy("page_id", "url")
        .agg(
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.first("times").alias("times"),
            F.max(fit).alias("fit"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce("fit.rule_verdict", F.lit(default)).alias("verdict"),
        )
    )
