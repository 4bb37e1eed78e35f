"""Gap-free row numbers without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.session import materialize


def with_dense_index(
    df: DataFrame, order_cols: list[str], start: int = 1, name: str = "idx"
) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of ``order_cols``.

    The order must be total (no two rows alike in it), so that a frequent value in the first
    column is still split over several ranges. The rows are range-partitioned and sorted,
    their place in the partition is written out with them, and the ids follow from the
    number of rows in earlier partitions: one shuffle, and per partition one count.
    """
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    # Upper 31 bits: partition; lower 33 bits: place in it.
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")
    counts = placed.groupBy(part.alias("part")).count().collect()
    sizes = {row["part"]: row["count"] for row in counts}
    offsets, total = [], start
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    if not offsets:
        return placed.withColumn(name, F.col("_place")).drop("_place")
    offset = F.get(F.lit(offsets).cast("array<bigint>"), part)
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, offset + place).drop("_place")
