"""Positional inverted index over title and abstract, and searches that read only their own terms.

Rows get dense numbers, and ``SEGMENT`` of them in a row are a segment. Each task inverts whole
segments; a block holds the rows of one segment in which a word stands, with the places of the
word, as differences. So a frequent word has a block per segment, and no block grows with the
table. Blocks are stored by a hash of their word, sorted by word: a search reads the folders of its
words only, and of those files only the row groups that hold them.

A search brings the blocks of one segment together, at most one per word of the query. Each becomes
a bitmap over the segment, AND, OR and NOT combine bitmaps, and phrases compare places. The result
is the row numbers. Words are those of :func:`litspark.operators.search.searchable`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.operators.ordering import with_dense_index
from litspark.operators.search import query_terms, read_query, searchable
from litspark.sources.writers import write_mode

SEGMENT = 1 << 13
BUCKETS = 64
# The block of all rows of a segment: what NOT starts from.
EVERY = ""
BLOCK_SCHEMA = "word string, segment bigint, n_rows int, rows binary, counts binary, places binary"


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _deltas(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before; the values at ``first`` stay as they are."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def _undo(deltas: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.cumsum(deltas)
    base = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
    return total - np.repeat(base, np.diff(np.append(first, len(deltas))))


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u2" if not len(values) or values.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("i8")


def _invert(segment: int, rows: np.ndarray, words: pa.ListArray) -> pa.RecordBatch:
    """Blocks of one segment: ``rows`` are places in it, ascending, ``words`` their words in order."""
    n_words = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(rows, n_words)
    begin = np.cumsum(n_words) - n_words
    place = np.arange(len(code)) - np.repeat(begin, n_words)
    order = np.argsort(code, kind="stable")
    code, row, place = code[order], row[order], place[order]
    new_word = np.append(True, code[1:] != code[:-1])[: len(code)]
    new_row = new_word | np.append(True, row[1:] != row[:-1])[: len(code)]
    entry = np.flatnonzero(new_row)  # one per word and row
    counts = np.diff(np.append(entry, len(code)))
    entry_first = np.flatnonzero(new_word[entry])  # first entry of each word
    row_deltas = _deltas(row[entry], entry_first)
    place_deltas = _deltas(place, entry)
    ends, starts = np.append(entry_first[1:], len(entry)), entry_first
    at = np.append(entry, len(code))
    names = coded.dictionary.to_pylist()
    table = [
        (names[code[entry[a]]], segment, b - a, _packed(row_deltas[a:b]), _packed(counts[a:b]),
         _packed(place_deltas[at[a] : at[b]]))
        for a, b in zip(starts.tolist(), ends.tolist())
    ]
    table.append((EVERY, segment, len(rows), _packed(_deltas(rows, np.array([0]))), b"", b""))
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ["word", "segment", "n_rows", "rows", "counts", "places"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table), kinds)], names=names)


def build(
    df: DataFrame, path: str, row_id: str, columns: tuple[str, ...] = ("title", "abstract"), rewrite: bool = False
) -> None:
    """Write the index of ``df``: blocks under ``path/blocks``, row numbers under ``path/rows``.

    ``row_id`` names each row once. Rows without words can only be found by NOT.
    """
    text = searchable(*columns)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    numbered = with_dense_index(df.select(row_id, words.alias("_words")), [row_id], start=0, name="_number")
    numbered.select(row_id, "_number").write.mode(write_mode(rewrite)).parquet(f"{path}/rows")
    placed = numbered.select(
        F.expr(f"_number div {SEGMENT}").alias("segment"), F.expr(f"_number % {SEGMENT}").alias("place"), "_words"
    )

    def run(batches):
        held, now = [], None
        for batch in batches:
            segment = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(segment)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(segment)]):
                if a == b:
                    continue
                if held and segment[a] != now:
                    yield _invert(now, *_joined(held))
                    held = []
                now = int(segment[a])
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield _invert(now, *_joined(held))

    together = placed.repartition("segment").sortWithinPartitions("segment", "place")
    blocks = together.mapInArrow(run, BLOCK_SCHEMA).withColumn("bucket", bucket_of(F.col("word")))
    stored = blocks.repartition("bucket").sortWithinPartitions("bucket", "word", "segment")
    stored.write.mode(write_mode(rewrite)).partitionBy("bucket").parquet(f"{path}/blocks")


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.ListArray]:
    rows = np.concatenate([x.column(1).to_numpy() for x in held])
    return rows, pa.concat_arrays([x.column(2) for x in held])


def blocks_of(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Blocks of the given words; only their folders are read."""
    asked = spark.createDataFrame(pa.table({"word": pa.array(words)})).select(bucket_of(F.col("word")).alias("b"))
    buckets = sorted({r.b for r in asked.collect()})
    blocks = spark.read.schema(f"{BLOCK_SCHEMA}, bucket int").parquet(f"{path}/blocks")
    return blocks.where(F.col("bucket").isin(buckets) & F.col("word").isin(words))


def _decoded(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block, and of all its places the row and the place."""
    n = block["n_rows"]
    rows = np.cumsum(_unpacked(block["rows"], n))
    if not block["counts"]:
        return rows, np.zeros(0, "i8"), np.zeros(0, "i8")
    counts = _unpacked(block["counts"], n)
    places = _undo(_unpacked(block["places"], int(counts.sum())), np.cumsum(counts) - counts)
    return rows, np.repeat(rows, counts), places


def search_index(spark: SparkSession, path: str, queries: dict[str, str]) -> DataFrame:
    """``query`` (its name) and ``_number`` of every row that matches, for any number of queries."""
    words = sorted({w for q in queries.values() for t in query_terms(q) for w in t.split()} | {EVERY})
    for query in queries.values():
        read_query(query, lambda _: np.zeros(1, bool))  # what can't be read is told before any job

    def match(table: pa.Table) -> pa.Table:
        blocks = {b["word"]: _decoded(b) for b in table.to_pylist()}
        segment = table.column("segment")[0].as_py()
        every = np.zeros(SEGMENT, bool)
        every[blocks[EVERY][0]] = True

        def leaf(words: str) -> _Rows:
            parts, found = words.split(), np.zeros(SEGMENT, bool)
            if all(w in blocks for w in parts):
                if len(parts) == 1:
                    found[blocks[parts[0]][0]] = True
                else:
                    keys = None
                    for i, w in enumerate(parts):
                        _, rows, places = blocks[w]
                        begin = (rows << 32) + places - i
                        keys = begin if keys is None else np.intersect1d(keys, begin, assume_unique=True)
                    found[keys >> 32] = True
            return _Rows(found, every)

        names, numbers = [], []
        for name, query in queries.items():
            hit = np.flatnonzero(read_query(query, leaf).found)
            names += [name] * len(hit)
            numbers.append(hit + segment * SEGMENT)
        return pa.table({"query": pa.array(names, pa.string()), "_number": pa.array(np.concatenate(numbers), pa.int64())})

    blocks = blocks_of(spark, path, words).drop("bucket")
    return blocks.groupBy("segment").applyInArrow(match, "query string, _number bigint")


class _Rows:
    """Bitmap of a segment's rows; NOT stays within those that are there."""

    def __init__(self, found: np.ndarray, every: np.ndarray):
        self.found, self.every = found, every

    def __and__(self, other):
        return _Rows(self.found & other.found, self.every)

    def __or__(self, other):
        return _Rows(self.found | other.found, self.every)

    def __invert__(self):
        return _Rows(self.every & ~self.found, self.every)


def row_ids(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """Matches with the ids of their rows in place of numbers."""
    return found.join(spark.read.parquet(f"{path}/rows"), "_number").drop("_number")
