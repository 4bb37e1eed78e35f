"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole of a shorter item. Its
elements are its shingles of ``SHINGLE`` words. Containment must be complete, so the necessary
prefix is one shingle: the window's rarest over all documents. Documents meet windows on that
shingle; the shingle's place in the window gives the only start the window could have (positional
bound), the document's ends limit it (length bound), and the words are then compared one by one.

The benchmark is taken in blocks of ``BLOCK_BYTES`` of text: each block is the stated query set
that goes to all tasks, and all blocks are matched, so a benchmark of any size gives the same
result. Documents are never shuffled. Frequencies are counted over all documents, for the
shingles of the block.

Cases: null and empty texts have no words and no hits; items without words, or with a null id,
match nothing. Repeated rows are judged alike. Empty tables give an empty result, or no hits.
Columns named like those added are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.arrays import LOWER, MARKS, Texts, Words, ordered_hash, pieces, texts, words

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 2 << 20
FILTER_BITS = 22

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = {"n_words": T.LongType(), "spans": SPANS, "items": T.ArrayType(T.StringType())}
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = {"n_words": pa.int64(), "spans": _ARROW_SPANS, "items": pa.list_(pa.string())}


class Windows(NamedTuple):
    """Distinct windows: length, words, the items that have them, and all their shingles."""

    size: np.ndarray
    text: list[bytes]
    items: list[tuple[str, ...]]
    shingle: list[np.ndarray]  # hashes, by place


def _word_bytes(t: Texts, w: Words, start: int, end: int) -> bytes:
    low = LOWER[t.data[w.start[start] : w.end[end - 1]]].tobytes() if end > start else b""
    base = int(w.start[start]) if end > start else 0
    return b" ".join(low[a - base : b - base] for a, b in zip(w.start[start:end].tolist(), w.end[start:end].tolist()))


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words of one sequence."""
    at = np.arange(max(len(hashes) - size + 1, 0))
    return ordered_hash(hashes, at, at + size)


def windows_of(items: list[tuple[str, str]], window: int, shingle: int) -> Windows:
    t = texts(pa.array([x for _, x in items], pa.string()))
    w = words(t, MARKS)
    owners: dict[bytes, set[str]] = defaultdict(set)
    shingles: dict[bytes, np.ndarray] = {}
    sizes: dict[bytes, int] = {}
    for i, (item, _) in enumerate(items):
        first, last = int(w.first[i]), int(w.first[i + 1])
        size = min(window, last - first)
        if not size:
            continue
        runs = _runs(w.hash[first:last], min(shingle, size))
        for at in range(last - first - size + 1):
            text = _word_bytes(t, w, first + at, first + at + size)
            owners[text].add(item)
            sizes[text] = size
            shingles[text] = runs[at : at + size - min(shingle, size) + 1]
    return Windows(
        np.array(list(sizes.values()), "i8"),
        list(owners),
        [tuple(sorted(x)) for x in owners.values()],
        list(shingles.values()),
    )


class _Finder:
    """Finds which of a sorted set of hashes stand in long arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[keys >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes``, and in ``keys``, of what is in both."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        slot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[slot] == hashes[at] if len(self.keys) else np.zeros(0, bool)
        return at[same], slot[same]


def _shingle_runs(w: Words, sizes: list[int]):
    """For each shingle size: hashes of the runs that don't cross texts, and their first words."""
    n = len(w.hash)
    text_end = np.repeat(w.first[1:], np.diff(w.first))
    for size in sizes:
        at = np.arange(n)
        at = at[at + size <= text_end]
        yield size, at, ordered_hash(w.hash, at, at + size)


def _count(documents: DataFrame, text: str, keys: dict[int, np.ndarray]) -> dict[int, int]:
    """Occurrences in all documents of the block's shingles."""

    def run(batches):
        finders = {size: _Finder(k) for size, k in keys.items()}
        seen = {size: np.zeros(len(k), "i8") for size, k in keys.items()}
        for piece in pieces(batches, text):
            t = texts(piece.column(0))
            for size, _, hashes in _shingle_runs(words(t, MARKS), list(keys)):
                _, slot = finders[size].find(hashes)
                seen[size] += np.bincount(slot, minlength=len(seen[size]))
        for size, n in seen.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[size][found].view("i8")), pa.array(n[found])], names=["hash", "n"]
            )

    counts = documents.select(text).mapInArrow(run, "hash bigint, n bigint")
    return {r["hash"]: r["n"] for r in counts.groupBy("hash").agg(F.sum("n").alias("n")).collect()}


class _Matcher:
    """Windows of one block by their rarest shingle."""

    def __init__(self, block: Windows, counts: dict[int, int], shingle: int):
        self.block = block
        by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, own in enumerate(block.shingle):
            signed = own.view("i8").tolist()
            place = min(range(len(own)), key=lambda k: (counts.get(signed[k], 0), signed[k]))
            by_size[min(shingle, int(block.size[i]))].append((int(own[place]), i, place))
        self.prefix = {}
        for size, rows in by_size.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], "u8")
            keys, first = np.unique(hashes, return_index=True)
            ends = np.append(first[1:], len(rows))
            window, place = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            self.prefix[size] = (_Finder(keys), first, ends, window, place)

    def hits(self, t: Texts, w: Words) -> list[tuple[int, int]]:
        """(first word, window) of every occurrence in the texts."""
        text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        found: list[tuple[int, int]] = []
        for size, at, hashes in _shingle_runs(w, list(self.prefix)):
            finder, first, ends, window, place = self.prefix[size]
            where, slot = finder.find(hashes)
            n = ends[slot] - first[slot]
            which = np.repeat(first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            token = np.repeat(at[where], n)
            start = token - place[which]
            own = text_of[token] if len(token) else token
            fits = (start >= w.first[own]) & (start + self.block.size[window[which]] <= w.first[own + 1])
            for s, i in zip(start[fits].tolist(), window[which][fits].tolist()):
                if _word_bytes(t, w, s, s + int(self.block.size[i])) == self.block.text[i]:
                    found.append((s, i))
        return found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _match(documents: DataFrame, text: str, block: Windows, counts: dict[int, int], shingle: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((block, counts))

    def run(batches):
        matcher = _Matcher(*shared.value, shingle)
        for piece in pieces(batches, text):
            place = {f.name: i for i, f in enumerate(piece.schema)}
            t = texts(piece.column(place[text]))
            w = words(t, MARKS)
            spans, items = defaultdict(list), defaultdict(set)
            hits = matcher.hits(t, w)
            owner = np.searchsorted(w.first, [s for s, _ in hits], "right") - 1
            for (s, i), d in zip(hits, owner.tolist()):
                own = s - int(w.first[d])
                spans[d].append((own, own + int(matcher.block.size[i])))
                items[d].update(matcher.block.items[i])
            if "spans" in place:
                for d, known in enumerate(piece.column(place["spans"]).to_pylist()):
                    spans[d] += [(x["start"], x["end"]) for x in known]
                for d, known in enumerate(piece.column(place["items"]).to_pylist()):
                    items[d] |= set(known)
            flat, first, named, first_item = [], [0], [], [0]
            for d in range(piece.num_rows):
                flat += _merge(spans.get(d, []))
                named += sorted(items.get(d, ()))
                first.append(len(flat))
                first_item.append(len(named))
            struct = pa.array([{"start": a, "end": b} for a, b in flat], _ARROW_SPANS.value_type)
            new = {
                "n_words": pa.array(np.diff(w.first), pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(first, pa.int32()), struct),
                "items": pa.ListArray.from_arrays(pa.array(first_item, pa.int32()), pa.array(named, pa.string())),
            }
            keep = [(f, piece.column(i)) for i, f in enumerate(piece.schema) if f.name not in new]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in keep), *new.values()],
                schema=pa.schema([*(f for f, _ in keep), *(pa.field(n, _ARROW[n]) for n in new)]),
            )

    fields = [f for f in documents.schema.fields if f.name not in ADDED]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in ADDED.items())])
    return documents.mapInArrow(run, schema)


def mark(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds to each document ``n_words``, ``spans`` of hit words and ``items`` (ids, as strings)."""
    names = {n.lower() for n in ADDED}
    documents = documents.select([c for c in documents.columns if c.lower() not in names])
    # Counted over the table as it came: not over what earlier blocks have added to it.
    plain = documents.select(F.col(text))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).dropna()
    # Rows that repeat an item would all fall into one block.
    rows = rows.distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        block = windows_of([(r["item"], r["text"]) for r in own], window, shingle)
        keys: dict[int, list[np.ndarray]] = defaultdict(list)
        for n, x in zip(block.size.tolist(), block.shingle):
            keys[min(shingle, n)].append(x)
        known = {n: np.unique(np.concatenate(x)) for n, x in keys.items()}
        counts = _count(plain, text, known) if known else {}
        documents = _match(documents, text, block, counts, shingle)
    return documents


def n_hit(spans: str = "spans"):
    """Number of hit words."""
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any hit, with the columns they came with."""
    return mark(documents, benchmark).where(F.size("spans") == 0).select(documents.columns)
