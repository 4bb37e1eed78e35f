"""Embedding near-duplicates by product quantisation.

Vectors of one label (and length) are compared by cosine. Each is assigned to the nearest of a set
of coarse centroids, its inverted list, and what is left is coded by the nearest codeword of each
of ``SUBSPACES`` subspaces. A vector probes every list that could hold a vector near enough:
a list is left out only if the plane halfway between its centroid and the vector's own is
farther away than two linked vectors can be. In a list, distances come from lookup tables of
the codes; as the error of each code is stored, a candidate is left out only if it can't be near
enough. The rest is reranked by exact cosine in double precision. Both bounds are sufficient, so no
link is lost to the index.

Centroids and codewords are fitted on at most ``SAMPLE`` vectors, the first by a hash of their
id; every vector is indexed. Equal vectors of a label are one class, searched once. Lists are
dealt into blocks of stored vectors and blocks of probing ones, so a list that holds a third of
all vectors is many tasks, each holding one block and streaming the other. A block gives counts
and a spanning forest of its links, never its pairs.

Cases: vectors that are null, empty or zero, or hold a null, NaN or infinity, a null label or a
null id link with nothing; they come back with no links and their own id. Rows of one id count as
one node. Scaled copies have cosine 1 and link. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.components import components, roots
from litspark.session import materialize

THRESHOLD = 0.93
SAMPLE = 20_000
LIST_ROWS = 4096
SUBSPACES = 8
CODEWORDS = 64
STORED_BLOCK = 4096
PROBE_BLOCK = 4096
SALTS = 16
SLACK = 1e-6


class Index(NamedTuple):
    centroids: np.ndarray  # [list, dim]
    codewords: np.ndarray  # [subspace, word, dim of subspace]


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.argmin((to * to).sum(1)[None] - 2 * (x @ to.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(0)
    k = max(1, min(k, len(x)))
    centers = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        some = count > 0
        centers[some] = sums[some] / count[some, None]
    return centers


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))


def fit_index(sample: np.ndarray, total: int) -> Index:
    """Index for unit vectors of one length; ``total``, those of the largest label, sets the number of lists.

    A vector is sent to each list it probes, which may be all: so there are no more lists than blocks of
    ``LIST_ROWS`` vectors, until their square root is less, and as many as the sample can tell apart.
    """
    lists = int(np.clip(round(min(total**0.5, total / LIST_ROWS)), 1, max(1, len(sample) // 20)))
    centroids = _kmeans(sample, lists)
    rest = _padded(sample - centroids[_nearest(sample, centroids)])
    parts = np.split(rest, SUBSPACES, axis=1)
    words = [_kmeans(p, CODEWORDS) for p in parts]
    return Index(centroids, np.stack(words))


def encode(x: np.ndarray, own: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit vectors, and how far each is from what its code stands for."""
    rest = np.split(_padded(x - index.centroids[own]), SUBSPACES, axis=1)
    codes = np.stack([_nearest(p, w) for p, w in zip(rest, index.codewords)], axis=1)
    missed = [((p - w[c]) ** 2).sum(1) for p, w, c in zip(rest, index.codewords, codes.T)]
    return codes.astype("u1"), np.sqrt(sum(missed))


def probes(x: np.ndarray, own: np.ndarray, index: Index, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) of every list that could hold a vector within ``reach`` of a vector."""
    c = index.centroids
    far = ((c * c).sum(1)[None] - 2 * (x @ c.T)) + (x * x).sum(1)[:, None]
    apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (c @ c.T), 0))
    beyond = far - far[np.arange(len(x)), own][:, None]
    return np.nonzero(beyond <= 2 * (reach + SLACK) * apart[own] + SLACK)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Halves of the largest value keep squares of very large and very small numbers in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


_ENTRY = "dim int, label {label}, list int, probe boolean, id bigint, times bigint, vector array<double>, code binary, miss double"


def _entries(classes: DataFrame, index: dict[int, Index], reach: float) -> DataFrame:
    """A stored row and the probing rows of each class: its list, code and vector."""
    shared = classes.sparkSession.sparkContext.broadcast(index)
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                for at in range(0, rows.num_rows, 1024):
                    part = rows.slice(at, 1024)
                    own_index = shared.value[dim]
                    x = _unit(_vectors(part.column(4)))
                    own = np.argmin((own_index.centroids**2).sum(1)[None] - 2 * (x @ own_index.centroids.T), axis=1)
                    codes, miss = encode(x, own, own_index)
                    q, lists = probes(x, own, own_index, reach)
                    take = np.concatenate([np.arange(len(x)), q])
                    lists = np.concatenate([own, lists])
                    probe = np.arange(len(take)) >= len(x)
                    picked = pa.array(take)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(picked),
                            part.column(1).take(picked),
                            pa.array(lists, pa.int32()),
                            pa.array(probe),
                            part.column(2).take(picked),
                            part.column(3).take(picked),
                            pa.FixedSizeListArray.from_arrays(pa.array(x[take].reshape(-1)), dim).cast(pa.list_(pa.float64())),
                            pa.array([c.tobytes() for c in codes[take]], pa.binary()),
                            pa.array(miss[take]),
                        ],
                        names=["dim", "label", "list", "probe", "id", "times", "vector", "code", "miss"],
                    )

    rows = classes.select("dim", "label", "id", "times", "vector")
    return rows.mapInArrow(run, _ENTRY.format(label=kind))


def _salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins rows to the one row of their keys; frequent keys are spread over ``SALTS`` tasks."""
    spread = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [*keys, "salt"], how).drop("salt")


def _blocks(entries: DataFrame) -> DataFrame:
    """Deals the lists into blocks; a stored row goes to each block of probes and the reverse."""
    place = ["dim", "label", "list"]
    size = lambda probe, block: F.ceil(F.sum((F.col("probe") == probe).cast("bigint")) / block).cast("int")
    sizes = entries.groupBy(*place).agg(
        size(False, STORED_BLOCK).alias("stored"), size(True, PROBE_BLOCK).alias("probing")
    )
    # A list without stored rows, or without probing ones, has no links.
    rows = _salted(entries, sizes.where("stored > 0 AND probing > 0"), place)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("s", F.explode(F.when(F.col("probe"), every("stored")).otherwise(F.array(own("stored")))))
    rows = rows.withColumn("q", F.explode(F.when(F.col("probe"), F.array(own("probing"))).otherwise(every("probing"))))
    block = [*place, "s", "q"]
    return rows.repartition(*block).sortWithinPartitions(*block, "probe")


def linked(
    q: np.ndarray, x: np.ndarray, codes: np.ndarray, miss: np.ndarray, centroid: np.ndarray, index: Index, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """(probe, stored) of all pairs with a cosine of ``least`` or more."""
    reach = (2 - 2 * least) ** 0.5
    parts = np.split(_padded(q - centroid), SUBSPACES, axis=1)
    squared = np.zeros((len(q), len(x)))
    for m, (p, w) in enumerate(zip(parts, index.codewords)):
        lookup = ((p * p).sum(1)[:, None] - 2 * (p @ w.T)) + (w * w).sum(1)[None]
        squared += lookup[:, codes[:, m]]
    near = np.sqrt(np.maximum(squared, 0)) <= reach + miss[None] + SLACK
    a, b = np.nonzero(near)
    if len(a) > 0.05 * near.size:
        return np.nonzero(near & (q @ x.T >= least))
    exact = np.einsum("ij,ij->i", q[a], x[b]) >= least
    return a[exact], b[exact]


def _search(blocks: DataFrame, index: dict[int, Index], least: float) -> DataFrame:
    """``id`` and ``weight``: linked vectors of other classes; or ``id`` and ``root``: a forest edge."""
    shared = blocks.sparkSession.sparkContext.broadcast(index)
    names = ["dim", "label", "list", "s", "q", "probe", "id", "times", "vector", "code", "miss"]
    out = pa.schema([("id", pa.int64()), ("weight", pa.int64()), ("root", pa.int64())])

    def found(ids, weights, a, b):
        nodes, root = roots(a, b)
        far = nodes != root
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids, nodes[far]])),
                pa.concat_arrays([pa.array(weights), none(int(far.sum()))]),
                pa.concat_arrays([none(len(ids)), pa.array(root[far])]),
            ],
            schema=out,
        )

    def run(batches):
        block, held = None, None
        for batch in batches:
            place = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            starts = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(place)]):
                rows = batch.slice(a, b - a)
                if place[a] != block:
                    block, held = place[a], None
                probe = rows.column(5).to_numpy(zero_copy_only=False)
                stored, asking = rows.filter(pa.array(~probe)), rows.filter(pa.array(probe))
                if stored.num_rows:
                    codes = np.frombuffer(b"".join(stored.column(9).to_pylist()), "u1").reshape(-1, SUBSPACES)
                    new = (
                        stored.column(6).to_numpy(),
                        stored.column(7).to_numpy(),
                        _vectors(stored.column(8)),
                        codes,
                        stored.column(10).to_numpy(),
                    )
                    held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
                if not asking.num_rows or held is None:
                    continue
                ids, times, x, codes, miss = held
                own = shared.value[block[0]]
                for at in range(0, asking.num_rows, 256):
                    part = asking.slice(at, 256)
                    q_ids, q = part.column(6).to_numpy(), _vectors(part.column(8))
                    i, k = linked(q, x, codes, miss, own.centroids[block[2]], own, least)
                    other = q_ids[i] != ids[k]
                    i, k = i[other], k[other]
                    if len(i):
                        weight = np.bincount(i, times[k], len(q_ids)).astype("i8")
                        some = weight > 0
                        yield found(q_ids[some], weight[some], q_ids[i], ids[k])

    return blocks.select(*names).mapInArrow(run, "id bigint, weight bigint, root bigint")


def link(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = THRESHOLD,
    sample: int = SAMPLE,
) -> DataFrame:
    """Per vector: ``key``, ``n_links``, ``component_id`` and ``kept``."""
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(usable & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    classes = (
        rows.where(usable)
        .groupBy("label", "vector")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
        .withColumn("dim", F.size("vector"))
    )
    classes = materialize(classes)
    per_label = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["dim"]: r["n"] for r in per_label.groupBy("dim").agg(F.max("n").alias("n")).collect()}
    first = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("dim", "vector").collect()
    index = {
        dim: fit_index(_unit(np.array([r["vector"] for r in first if r["dim"] == dim] or [[1.0] * dim])), total)
        for dim, total in totals.items()
    }
    reach = (2 - 2 * least) ** 0.5
    entries = materialize(_entries(classes, index, reach))
    found = materialize(_search(_blocks(entries), index, least))
    weights = found.where("weight IS NOT NULL").groupBy("id").agg(F.sum("weight").alias("weight"))
    root = components(found.where("root IS NOT NULL").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        classes.join(weights, "id", "left")
        .join(root.select(F.col("node").alias("id"), "root"), "id", "left")
        .select(
            "id", "label", "vector", "times", F.coalesce("root", "id").alias("component_id"),
            (F.coalesce("weight", F.lit(0)) + F.col("times") - 1).cast("bigint").alias("n_links"),
        )
    )
    known = materialize(known)
    copied = known.where("times > 1").select("label", "vector", "n_links", "component_id")
    single = known.where("times = 1 AND (n_links > 0 OR component_id <> id)").select(
        "id", F.col("n_links").alias("own_links"), F.col("component_id").alias("own_component")
    )
    # Only rows with an id are looked up: a null label is in no class.
    named = rows.withColumn("label", F.when(F.col("id").isNotNull(), F.col("label")))
    met = _salted(named, copied, ["label", "vector"], "left").join(single, "id", "left")
    component = F.coalesce("component_id", "own_component", "id")
    return met.select(
        F.col("id").alias(key),
        F.coalesce("n_links", "own_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
