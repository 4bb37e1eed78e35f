"""Counts over publication tables and over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import is_missing


def _pct(n: Column, total: Column) -> Column:
    """Share in per cent with one decimal, halves to even; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(n, total) * 100, 1), F.lit(0.0))


def papers_by_year(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Papers per year and their share of those with a year. ``by`` gives one table per value.

    The window runs over one row per year, not over papers.
    """
    by = by or []
    counts = (
        df.where(F.col("year").isNotNull())
        .groupBy(*by, F.col("year").cast("int").alias("year"))
        .agg(F.count("*").alias("count"))
    )
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("pct", _pct(F.col("count"), total)).orderBy(*by, F.desc("year"))


def breakdown(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long table of statistics: ``stat``, ``value``, ``count``, ``pct`` of all rows.

    One pass over the records: it counts by source and language together, keeping the other
    counts beside; the rest works on that small table.
    """
    by = by or []

    def has(c: str) -> Column:
        return F.count_if(~is_missing(c))

    cells = df.groupBy(
        *by,
        F.coalesce("entry_source", F.lit("")).alias("source"),
        F.col("language"),
    ).agg(
        F.count("*").alias("total"),
        F.count_if("isOpenAccess").alias("open_access"),
        F.count_if("pdf_downloaded").alias("pdf"),
        has("txt_filename").alias("txt"),
        has("markdown_filename").alias("md"),
    )

    def fact(stat: str, value: Column, count: Column) -> Column:
        return F.struct(
            F.lit(stat).alias("stat"), value.cast("string").alias("value"), count.alias("count")
        )

    total = F.col("total")
    facts = [
        fact("Total", F.lit("papers"), total),
        fact("Open Access", F.lit("True"), F.col("open_access")),
        fact("Entry Source", F.col("source"), total),
        fact("Language", F.col("language"), total),
    ]
    for stat, column in (("PDF", "pdf"), ("TXT", "txt"), ("Markdown", "md")):
        facts += [
            fact(stat, F.lit("existing"), F.col(column)),
            fact(stat, F.lit("missing"), total - F.col(column)),
        ]
    counts = (
        cells.select(*by, F.inline(F.array(*facts)))
        .where("value is not null")
        .groupBy(*by, "stat", "value")
        .agg(F.sum("count").alias("count"))
    )
    all_rows = F.max(F.when(F.col("stat") == "Total", F.col("count"))).over(Window.partitionBy(*by))
    return counts.withColumn("pct", _pct(F.col("count"), all_rows))


def by_frequency(counts: DataFrame, value: str = "value") -> DataFrame:
    """Most frequent first, then by value."""
    return counts.orderBy(F.desc("count"), value)


def _tokens() -> Column:
    return F.coalesce("total_tokens", "usage_tokens", F.lit(0)).cast("bigint")


def run_totals(runs: DataFrame) -> DataFrame:
    """One row over all runs: total, finished, running, errors, tokens."""
    return runs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("finished"),
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("status").ilike("Error%")).alias("errors"),
        F.coalesce(F.sum(_tokens()), F.lit(0)).alias("total_tokens"),
    )


def by_provider(runs: DataFrame) -> DataFrame:
    return runs.groupBy("provider").agg(F.count("*").alias("requests"))


def by_model_sums(runs: DataFrame, *keys: Column | str) -> DataFrame:
    """Sums per model over all providers, which add up over parts of a table."""
    done = F.col("status") == "success"
    seconds = F.coalesce("elapsed_seconds", F.lit(0.0))
    return runs.groupBy(*keys, "model_name").agg(
        F.count("*").alias("requests"),
        F.count_if(done).alias("finished"),
        F.count_if(F.col("status").isNull()).alias("open"),
        F.coalesce(F.sum(F.when(done, _tokens())), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(done, seconds)), F.lit(0.0)).alias("elapsed_seconds"),
    )


def _with_mean(sums: DataFrame) -> DataFrame:
    mean = F.coalesce(F.try_divide("elapsed_seconds", "finished"), F.lit(0.0))
    return sums.withColumn("avg_elapsed_seconds", mean)


def add_up(sums: DataFrame, *keys: str) -> DataFrame:
    """Totals from the sums of parts."""
    added = [F.sum(c).alias(c) for c in ("requests", "finished", "open", "tokens", "elapsed_seconds")]
    return _with_mean(sums.groupBy(*keys).agg(*added))


def by_model(runs: DataFrame, *keys: Column | str) -> DataFrame:
    """Per model over all providers; tokens and seconds count finished runs only."""
    return _with_mean(by_model_sums(runs, *keys))


def outcome_counts(df: DataFrame) -> DataFrame:
    """Rows per outcome of a download or extraction."""
    return df.groupBy("outcome").agg(F.count("*").alias("count"))


# Sums that follow changes: a row that goes counts -1, one that comes 1.
SIGNED_SUMS = ["requests", "finished", "running", "errors", "open", "all_tokens", "tokens", "elapsed_seconds"]
SIGNED_SCHEMA = "provider string, model_name string, " + ", ".join(
    f"{c} {'double' if c == 'elapsed_seconds' else 'bigint'}" for c in SIGNED_SUMS
)


def signed_sums(rows: DataFrame) -> DataFrame:
    """Sums per provider and model of rows with a ``sign``."""
    done, sign = F.col("status") == "success", F.col("sign").cast("bigint")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, sign)), F.lit(0))

    return rows.groupBy("provider", "model_name").agg(
        F.coalesce(F.sum(sign), F.lit(0)).alias("requests"),
        count(done).alias("finished"),
        count(F.col("state") == "running").alias("running"),
        count(F.col("status").ilike("Error%")).alias("errors"),
        count(F.col("status").isNull()).alias("open"),
        F.coalesce(F.sum(_tokens() * sign), F.lit(0)).alias("all_tokens"),
        F.coalesce(F.sum(F.when(done, _tokens() * sign)), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(done, F.coalesce("elapsed_seconds", F.lit(0.0)) * sign)), F.lit(0.0)).alias(
            "elapsed_seconds"
        ),
    )


def add_signed(sums: DataFrame) -> DataFrame:
    """Totals of signed sums; providers and models without rows are gone."""
    added = [F.sum(c).alias(c) for c in SIGNED_SUMS]
    return sums.groupBy("provider", "model_name").agg(*added).where("requests <> 0")


def totals_from_sums(sums: DataFrame) -> DataFrame:
    """:func:`run_totals` from sums."""
    return sums.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in
          {"requests": "total", "finished": "finished", "running": "running", "errors": "errors", "all_tokens": "total_tokens"}.items()]
    )


def by_provider_from_sums(sums: DataFrame) -> DataFrame:
    """:func:`by_provider` from sums."""
    return sums.groupBy("provider").agg(F.sum("requests").alias("requests"))


def by_model_from_sums(sums: DataFrame) -> DataFrame:
    """:func:`by_model` from sums."""
    return add_up(sums, "model_name")
