"""First rows in an order without passing them through one task.

Ranges of the order are counted, the range that holds the n-th row is counted again in finer ranges,
and so on until its rows are few; then every row up to that one is kept by a plain filter. Only the
columns of the order are shuffled, and of each range its count and its ends come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

RANGES = 64
FEW = 1000


@dataclass(frozen=True)
class By:
    """A column of an order; missing values stand at the end."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        c = F.col(f"`{self.name}`")
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()

    def ahead(self, value) -> Column:
        """Whether a row stands before ``value`` by this column alone."""
        c = F.col(f"`{self.name}`")
        if value is None:
            return c.isNotNull()
        return F.coalesce(c > F.lit(value) if self.descending else c < F.lit(value), F.lit(False))

    def same(self, value) -> Column:
        return F.col(f"`{self.name}`").eqNullSafe(F.lit(value))


def _before(order: list[By], key: Row) -> Column:
    """Rows that stand before ``key``."""
    cases = []
    for i, by in enumerate(order):
        cases.append(reduce(Column.__and__, [b.same(key[b.name]) for b in order[:i]], by.ahead(key[by.name])))
    return reduce(Column.__or__, cases)


def _equal(order: list[By], key: Row) -> Column:
    return reduce(Column.__and__, [b.same(key[b.name]) for b in order])


def nth_key(keys: DataFrame, order: list[By], n: int, ranges: int = RANGES, few: int = FEW) -> tuple[Row, int] | None:
    """Key of the n-th row (from 1), and how many of the rows with that key are among the first n.

    None if there are no more than ``n`` rows.
    """
    names, sort = [b.name for b in order], [b.column() for b in order]
    keys, left, first_round = keys.select(*[f"`{c}`" for c in names]), n, True
    while True:
        placed = keys.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort).select(
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
            F.struct(*[f"`{c}`" for c in names]).alias("key"),
        )
        ends = placed.groupBy("part").agg(
            F.count("*").alias("n"), F.min_by("key", "at").alias("low"), F.max_by("key", "at").alias("high")
        )
        counted = sorted(ends.collect(), key=lambda r: r["part"])
        if first_round and sum(r["n"] for r in counted) <= n:
            return None
        first_round = False
        for found in counted:
            if found["n"] >= left:
                break
            left -= found["n"]
        if found["low"] == found["high"]:
            return found["low"], left
        inside = ~_before(order, found["low"]) & (_before(order, found["high"]) | _equal(order, found["high"]))
        keys = keys.where(inside)
        if found["n"] <= few:
            rows = keys.orderBy(*sort).limit(left).collect()
            key = rows[-1]
            return key, sum(tuple(r) == tuple(key) for r in rows)


def first_rows(df: DataFrame, order: list[By], n: int, ranges: int = RANGES) -> DataFrame:
    """The first ``n`` rows in order; of rows alike in all columns of the order any are taken.

    ``df`` is read a few times, so it should be a stored table.
    """
    if n <= 0:
        return df.limit(0)
    found = nth_key(df, order, n, ranges)
    if found is None:
        return df
    key, taken = found
    # Rows alike in all columns of the order: one, where the order is total.
    return df.where(_before(order, key)).unionAll(df.where(_equal(order, key)).limit(taken))


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, spread_by: str, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group and their ``rank`` from 1.

    A group is ranked in ``salts`` parts, by a hash of ``spread_by``, before what is left of it meets: no
    task holds a group as a whole, only ``salts * n`` rows of it. (Spark's own limit per task covers
    small ``n`` only.)
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    apart = Window.partitionBy(*groups, "_salt").orderBy(*order)
    near = salted.withColumn("_rank", F.row_number().over(apart)).where(F.col("_rank") <= n).drop("_salt", "_rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)
