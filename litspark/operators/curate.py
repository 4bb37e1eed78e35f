"""Exclusion, combination and merging of searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions.text import dedup_key, is_missing
from litspark.schemas import RECORD_COLUMNS

# Searches whose membership fits one 64-bit number.
MASK_BITS = 62


def keep_masks(
    language: str | None = None,
    source: str | None = None,
    doi: str | None = None,
    downloaded: bool = False,
) -> list[tuple[str, Column]]:
    """Active exclusion steps in order: a description and what stays.

    Comparisons are null-safe: a row whose value is missing is not excluded.
    """
    steps = []
    for label, column, value in (
        ("language", "language", language),
        ("source", "entry_source", source),
        ("doi", "doi", doi),
    ):
        if value is not None:
            steps.append((f"{label}={value}", ~F.col(column).eqNullSafe(F.lit(value))))
    if downloaded:
        text = F.lower(F.trim(F.col("pdf_downloaded").cast("string")))
        steps.append(("downloaded", F.coalesce(text.isin("true", "1"), F.lit(False))))
    if not steps:
        raise ValueError("give at least one of language, source, doi, downloaded")
    return steps


def exclude(df: DataFrame, **criteria) -> DataFrame:
    """Rows left by all steps."""
    return reduce(DataFrame.where, (mask for _, mask in keep_masks(**criteria)), df)


def exclude_audit(df: DataFrame, by: str = "search_id", **criteria) -> DataFrame:
    """Rows in and out of each step per search, counted in one pass over the table."""
    steps = keep_masks(**criteria)
    counts = [F.count("*").alias("n0")]
    passed = F.lit(True)
    for i, (_, mask) in enumerate(steps, start=1):
        passed = passed & mask
        counts.append(F.count_if(passed).alias(f"n{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(label).alias("filter"),
            F.col(f"n{i - 1}").alias("rows_in"),
            F.col(f"n{i}").alias("rows_out"),
        )
        for i, (label, _) in enumerate(steps, start=1)
    ]
    return df.groupBy(by).agg(*counts).select(by, F.inline(F.array(*rows)))


def latest_rows(
    results: DataFrame, filtered: DataFrame | None, done: list[str] | None = None
) -> DataFrame:
    """Input of an exclusion run, per search: its filtered rows where it has any run so far.

    ``done`` names the searches that were filtered before. The rows alone don't tell: a search
    may have none left, and must not come back whole.
    """
    if filtered is None:
        return results
    if done is None:
        raise ValueError("name the searches that were filtered before")
    # The searches are a short list: a filter, where a join would shuffle whole searches.
    untouched = results.where(~F.col("search_id").isin(done))
    return filtered.unionByName(untouched, allowMissingColumns=True)


def usable_doi(df: DataFrame) -> DataFrame:
    """Rows a download can be looked up for."""
    return df.where(~is_missing("doi"))


def first_per_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key; ``key`` must not be null.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a
    frequent key never gathers in one task.
    """
    columns = df.columns
    return (
        df.select(key.alias("_key"), order.alias("_order"), F.struct(*columns).alias("_row"))
        .groupBy("_key")
        .agg(F.min_by("_row", "_order").alias("_row"))
        .select("_key", "_row.*")
    )


def combine_new(existing: DataFrame, new: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """All existing rows, and of the new ones the first per key that is not there yet.

    ``order`` names the columns that number the new rows; no two rows may be alike in them.
    Rows without DOI and title are always kept: they get a key of their own. ``is_new`` and
    the order columns give the order of the combined list.
    """
    keys = existing.select(dedup_key().alias("_key")).where(F.col("_key").isNotNull()).distinct()
    own_key = F.concat_ws(":", F.lit("row"), *[F.col(c).cast("string") for c in order])
    first = first_per_key(new, F.coalesce(dedup_key(), own_key), F.struct(*order))
    fresh = first.join(keys, "_key", "left_anti").drop("_key")
    return existing.withColumn("is_new", F.lit(False)).unionByName(
        fresh.withColumn("is_new", F.lit(True)), allowMissingColumns=True
    )


def list_searches_of(df: DataFrame) -> list[str]:
    """The searches present: a list as long as there are flag columns in the result."""
    return sorted(row[0] for row in df.select("search_id").distinct().collect())


def merge_searches(
    df: DataFrame,
    search_ids: list[str] | None = None,
    role: str = "results",
    order: str = "ord",
) -> DataFrame:
    """One row per publication over all searches, with a 0/1 column per search.

    Each column takes its first non-missing value by file name, then row order. One
    aggregation does it: membership is a bit per search, so the state per key stays small.
    ``first_file`` and ``first_row`` are the place of the key's first row; they settle ties.
    """
    ids = sorted(search_ids) if search_ids is not None else list_searches_of(df)
    # Files are read by name, in which the role follows the id: ``a1__...`` before ``a__...``.
    by_file = sorted(ids, key=lambda s: f"{s}__{role}.csv")
    place = F.array_position(F.lit(by_file), F.col("search_id")).cast("int") - 1
    own_key = F.concat_ws(":", F.lit("row"), "search_id", F.col(order).cast("string"))
    keyed = df.where(F.col("search_id").isin(ids)).select(
        F.coalesce(dedup_key(), own_key).alias("_key"),
        F.struct(place.alias("file"), F.col(order).alias("row")).alias("_at"),
        *RECORD_COLUMNS,
    )
    kinds = dict(df.dtypes)

    def first(c: str) -> Column:
        # Numbers and flags have one form of missing; only text is looked into.
        there = ~is_missing(c) if kinds[c] in ("string", "double", "float") else F.col(c).isNotNull()
        return F.min_by(c, F.when(there, F.col("_at"))).alias(c)

    firsts = [first(c) for c in RECORD_COLUMNS]
    words = range(0, len(ids), MASK_BITS)
    masks = [_membership(w).alias(f"_mask{w}") for w in words]
    merged = keyed.groupBy("_key").agg(*firsts, *masks, F.min("_at").alias("_first"))

    def flag(search: str) -> Column:
        i = by_file.index(search)
        w = i - i % MASK_BITS
        return F.shiftright(f"_mask{w}", i - w).bitwiseAND(F.lit(1)).cast("int").alias(search)

    found_in = reduce(Column.__add__, (F.bit_count(F.col(f"_mask{w}")) for w in words))
    return merged.select(
        *RECORD_COLUMNS,
        (found_in - 1).cast("int").alias("duplicates_counter"),
        *[flag(s) for s in ids],
        F.col("_first.file").alias("first_file"),
        F.col("_first.row").alias("first_row"),
    )


def _membership(first: int) -> Column:
    """Bits of the searches from number ``first`` on that a key was found in."""
    bit = F.col("_at.file") - first
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    inside = bit.between(0, MASK_BITS - 1)
    return F.bit_or(F.when(inside, one).otherwise(F.lit(0).cast("bigint")))


def newest_first(df: DataFrame, order: tuple[str, ...] = ("first_file", "first_row")) -> DataFrame:
    """By year, newest first, rows without a year last; ``order`` settles ties."""
    year = F.col("year").try_cast("int")
    return df.orderBy(year.desc_nulls_last(), *order)
