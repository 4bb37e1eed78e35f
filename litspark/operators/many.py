"""Merging any number of searches: membership as a table, and as a bitmap per search.

:func:`litspark.operators.curate.merge_searches` has a column per search, which suits some dozens. Here the
searches are numbered as a table, membership is a row per publication and search, and each search gets
bitmaps over the publications' numbers (32,768 to a bitmap), built and joined by Spark's bitmap
aggregates: what several searches found together, or any of them, is read from their bitmaps alone.
Neither the plan nor the driver grows with the number of searches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions.text import dedup_key, is_missing
from litspark.operators.ordering import with_dense_index
from litspark.operators.skew import lookup_join
from litspark.schemas import RECORD_COLUMNS
from litspark.session import materialize


def number_searches(df: DataFrame, role: str = "results") -> DataFrame:
    """``search_id`` and its number ``_n`` (from 1) in the order of the file names."""
    named = df.select("search_id").distinct().withColumn("_file", F.concat("search_id", F.lit(f"__{role}.csv")))
    return with_dense_index(named, ["_file"], start=1, name="_n").drop("_file")


def merge_many(df: DataFrame, searches: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """One row per publication, and its membership.

    The first table has ``merge_key``, a dense ``number``, the record's columns (each its first value that
    is not missing, by file name, then row) and ``duplicates_counter``; the second ``number, search_id``.
    ``searches`` is what :func:`number_searches` gives.
    """
    own_key = F.concat_ws(":", F.lit("row"), "search_id", F.col(order).cast("string"))
    keyed = lookup_join(df, searches, "search_id", how="inner").select(
        F.coalesce(dedup_key(), own_key).alias("merge_key"),
        "search_id",
        F.struct("_n", F.col(order).alias("row")).alias("_at"),
        *RECORD_COLUMNS,
    )
    kinds = dict(df.dtypes)
    firsts = []
    for c in RECORD_COLUMNS:
        there = ~is_missing(c) if kinds[c] in ("string", "double", "float") else F.col(c).isNotNull()
        firsts.append(F.min_by(c, F.when(there, F.col("_at"))).alias(c))
    met = materialize(keyed.select("merge_key", "search_id").distinct())
    times = met.groupBy("merge_key").agg((F.count("*") - 1).cast("int").alias("duplicates_counter"))
    numbered = with_dense_index(times, ["merge_key"], start=1, name="number")
    rows = keyed.groupBy("merge_key").agg(*firsts).join(numbered, "merge_key")
    membership = lookup_join(met, numbered.select("merge_key", "number"), "merge_key", how="inner")
    return rows, membership.select("number", "search_id")


def bitmaps(membership: DataFrame) -> DataFrame:
    """``search_id, bucket, bitmap``: the numbers of the publications that each search found."""
    placed = membership.select(
        "search_id", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit")
    )
    return placed.groupBy("search_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def add_bitmaps(*parts: DataFrame) -> DataFrame:
    """Bitmaps of parts of a membership as those of the whole."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("search_id", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def together(maps: DataFrame, groups: DataFrame) -> DataFrame:
    """Publications that any, and that all, of the searches of each group have found.

    ``groups`` has ``name, search_id``; the result ``name, found_by_any, found_by_all``.
    """
    sizes = groups.distinct().groupBy("name").agg(F.count("*").alias("size"))
    met = maps.join(groups.distinct(), "search_id").groupBy("name", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("some"),
        F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("every"),
        F.count("*").alias("maps"),
    )
    # A search without a bitmap in a bucket has found nothing there.
    counted = met.join(sizes, "name").groupBy("name").agg(
        F.sum("some").alias("found_by_any"),
        F.sum(F.when(F.col("maps") == F.col("size"), F.col("every")).otherwise(0)).alias("found_by_all"),
    )
    none = F.lit(0).cast("bigint")
    return sizes.join(counted, "name", "left").select(
        "name", F.coalesce("found_by_any", none).alias("found_by_any"), F.coalesce("found_by_all", none).alias("found_by_all")
    )
