"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows stand in ``P`` partitions; the result has ``C`` cells, some consecutive cells making a
shard. How many rows of partition ``p`` go to cell ``c`` under a uniform random permutation is a
multivariate hypergeometric draw. It is made by halving: a node of a binary tree over the
partitions splits the cell counts left to it between its two halves. The draws of a node depend on
the seed and the node alone, so each task walks down to its own partition's counts and the matrix
as a whole is never held anywhere. A task permutes its partition, deals the rows out by those
counts, and the rows of a cell are permuted again after the exchange. Every order of all rows is
equally likely, and every shard has its exact size.

Shard sizes differ by one row at most (law ``rows``): the first ``N mod S`` shards have one more.

Cases: nulls and long texts are carried like any value. Equal rows are different rows, so groups
of equal texts spread like all others. An empty table gives an empty result. There may be more
shards than rows; those without rows are empty. Columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.session import materialize

CELL_ROWS = 4096
MOST_CELLS = 4096
_NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` out of ``good + bad`` are good."""
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    share = good / (good + bad)
    mode = min(max(int((drawn + 1) * (good + 1) / (good + bad + 2)), low), high)
    reach = int(12 * (drawn * share * (1 - share)) ** 0.5) + 50
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    # Logarithms of p(k + 1) / p(k).
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def split_counts(rng: np.random.Generator, cells: np.ndarray, drawn: int) -> np.ndarray:
    """Multivariate hypergeometric draw: how the ``drawn`` rows spread over the cells."""
    if int(cells.sum()) < _NUMPY_MOST:
        return rng.multivariate_hypergeometric(cells, drawn, method="marginals")
    out, rest = np.zeros_like(cells), int(cells.sum())
    for i, n in enumerate(cells.tolist()):
        if not drawn:
            break
        rest -= n
        out[i] = hypergeometric(rng, n, rest, drawn)
        drawn -= int(out[i])
    return out


def matrix_row(sizes: np.ndarray, cells: np.ndarray, place: int, seed: int) -> np.ndarray:
    """Row ``place`` of the communication matrix: counts per cell of that partition."""
    low, high, left, ends = 0, len(sizes), cells, np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        first = split_counts(rng, left, int(ends[middle] - ends[low]))
        if place < middle:
            high, left = middle, first
        else:
            low, left = middle, left - first
    return left


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard) to every row.

    The rows with their partition and place are written once to the shared folder, so that the
    counts stay true when a task is repeated. One number per partition comes to the driver.
    Each cell holds about ``cell_rows`` rows, more only in shards of over ``MOST_CELLS`` such cells.
    """
    df = df.select([c for c in df.columns if c.lower() not in ("shard", "slot", "_place", "_cell")])
    placed = materialize(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    known = sorted((r["p"], r["n"]) for r in counts)
    ids, sizes = [p for p, _ in known], np.array([n for _, n in known], "i8")
    total = int(sizes.sum())
    shard_sizes = np.array([total // shards + (s < total % shards) for s in range(shards)], "i8")
    # Beyond so many cells a shard they grow with the table.
    per_shard = min(max(1, -(-int(shard_sizes.max(initial=0)) // cell_rows)), MOST_CELLS)
    # Cells of a shard split its rows evenly.
    j = np.arange(per_shard)
    cells = (shard_sizes[:, None] // per_shard + (j < shard_sizes[:, None] % per_shard)).reshape(-1)

    def deal(batches):
        ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            place = batch.column(batch.schema.get_field_index("_place")).to_numpy()
            parts, at = place >> 33, place & ((1 << 33) - 1)
            cell = np.zeros(len(place), "i8")
            for p in np.unique(parts).tolist():
                if p not in ready:
                    k = bisect.bisect_left(ids, p)
                    row = np.cumsum(matrix_row(sizes, cells, k, seed))
                    order = np.random.default_rng([seed, 1, p]).permutation(int(sizes[k]))
                    ready = {p: (row, order)}
                row, order = ready[p]
                mine = parts == p
                cell[mine] = np.searchsorted(row, order[at[mine]], "right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell)],
                schema=pa.schema([*batch.schema, pa.field("_cell", pa.int64())]),
            )

    dealt = placed.mapInArrow(deal, T.StructType([*placed.schema.fields, T.StructField("_cell", T.LongType())]))
    again = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed), "_cell", "_place"), "_place")
    shard = F.expr(f"_cell div {per_shard}")
    # The first slot of the j-th cell of a shard of n rows: those before it hold n div cells rows, or one more.
    inside = F.col("_cell") % per_shard
    rows_in = F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)
    offset = inside * F.floor(rows_in / per_shard) + F.least(inside, rows_in % per_shard)
    return (
        dealt.withColumn("slot", (F.row_number().over(again) - 1 + offset).cast("bigint"))
        .withColumn("shard", shard.cast("int"))
        .drop("_place", "_cell")
    )


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Writes the shuffled rows, a folder per shard, the rows of each file in slot order."""
    dealt = shuffle_to_shards(df, shards, seed)
    ordered = dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
