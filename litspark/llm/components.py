"""Connected components of a graph given as an edge table.

Each task first replaces its own edges by a spanning forest of them (union-find over one
partition), which leaves at most one edge per node. Then large-star and small-star steps
alternate: every node's larger, then smaller, neighbours are linked to its smallest one. Each
step is an aggregation and a join, the result is written to the shared folder, and the loop ends
when every edge points from a node to its component's smallest, which one aggregation tells. A node with very many
neighbours is met in salted joins, its minimum in a pre-aggregated one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.session import materialize

SALTS = 16
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        # Each root takes the smallest root it is linked to, then paths are halved to the end.
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(parent, high, low)
        while not np.array_equal(short := parent[parent], parent):
            parent = short
        x, y = parent[x], parent[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    return nodes, nodes[parent]


def forest(edges: DataFrame) -> DataFrame:
    """Per partition: an edge from each node to its smallest one there."""

    def run(batches):
        known: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed():
            a, b = (np.concatenate(x) for x in zip(*known))
            nodes, root = roots(a, b)
            far = nodes != root
            return nodes[far], root[far]

        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            known.append((a, b))
            size += len(a)
            if size > 1 << 20:
                known = [packed()]
                size = len(known[0][0])
        if known:
            a, b = packed()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGES)

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Joins rows to the one row of their key; a frequent key is spread over ``SALTS`` tasks."""
    other = next(c for c in left.columns if c != key)
    spread = left.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [key, "salt"]).drop("salt")


def _is_star(edges: DataFrame) -> bool:
    """Whether every edge leads from a node without other edges to its root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(
        edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1))
    )
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``: the smallest node reachable, for every node but the roots.

    ``edges`` has two bigint columns ``a`` and ``b``; direction, repeats and loops don't matter.
    """
    star = materialize(forest(edges.select("a", "b").where("a <> b")).distinct())
    # Edges lead from larger to smaller nodes throughout, so the root of a star is its smallest node.
    while not _is_star(star):
        # Large star: the larger neighbours of a node go to its smallest neighbour, or to itself.
        both = star.select("a", "b").unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = (
            both.groupBy("a")
            .agg(F.min("b").alias("least"))
            .select(F.col("a").alias("b"), F.least("a", "least").alias("least"))
        )
        large = _salted(star, least, "b").select("a", F.col("least").alias("b")).distinct()
        # Small star: the smaller neighbours of a node, and the node, go to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("least"))
        met = _salted(large, small_least, "a")
        ahead = met.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = ahead.unionAll(small_least.select("a", F.col("least").alias("b")))
        star = materialize(forest(small).distinct())
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
