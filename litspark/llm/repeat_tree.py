"""Exact removal of repeated byte strings by common-prefix intervals of a sparse suffix array.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller id, or same
document and earlier start) is removed. The suffix array is sparse: of each string of ``LENGTH``
bytes at least one place is an *anchor*, chosen by content alone (the smallest hash of ``GRAM``
bytes in it), so equal strings have equal anchors. A bucket holds the suffixes that begin with one
anchor's bytes.

1. Each anchor gives a row: hashes of its bytes and of its surroundings (all bytes that a string of
   ``LENGTH`` with this anchor can reach), document and place. Occurrences with the same
   surroundings but the first are repeats as they stand. This happens within a task before the
   shuffle already, so that a passage in very many documents sends few rows.
2. Buckets with different surroundings get their bytes and are sorted into an enhanced suffix
   array. A stack scan of the neighbours' common prefixes gives its interval tree; the members of an
   interval are parted where their left extensions differ, which gives the maximal repeat groups
   with all their occurrences. All but the first occurrence of a group of ``LENGTH`` bytes or more
   are repeats.
3. Buckets of more than ``MOST`` surroundings are not scanned in one task: their strings of
   ``LENGTH`` bytes are grouped one by one, with partial aggregation. The result is the same.

A document whose whole text has an earlier copy is a repeat as a whole. Cases: null and empty
texts have no bytes; a text below ``LENGTH`` bytes keeps all. Rows with a null id are left out. Ids are
taken as unique; rows of one id and equal texts are treated as one occurrence. Texts of any
length are taken in overlapping segments. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.arrays import Texts, mix, pieces, prefix_sums, range_hash, strong_hash, strong_sums, texts
from litspark.llm.spans import kept_bytes, union
from litspark.session import materialize

LENGTH = 100
GRAM = 32
MOST = 1 << 15
SEGMENT = 1 << 20
SALTS = 16


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over ``width`` values from each place on; the last ones see what is left."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step >= len(out):
            break
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def anchors(t: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``t.data`` of the anchors of every text, and the hash of their bytes."""
    n = len(t.data)
    if n < length:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    sums = prefix_sums(t.data)
    at = np.arange(n - gram + 1)
    hashes = range_hash(sums, at, at + gram)
    width = length - gram + 1
    least = _slide(hashes, width, np.minimum)
    # Only whole strings of ``length`` bytes within one text count.
    whole = np.zeros(n + 1, "i4")
    long_ = t.end - t.start >= length
    np.add.at(whole, t.start[long_], 1)
    np.add.at(whole, t.end[long_] - length + 1, -1)
    least = np.where(np.cumsum(whole)[: len(least)] > 0, least, 0)
    # A place is an anchor if it is the least of one string that holds it.
    most = _slide(least[::-1], width, np.maximum)[::-1]
    found = np.flatnonzero((most == hashes) & (most > 0))
    return found, hashes[found]


def _segments(t: Texts, length: int):
    """Texts in stretches of bounded size: texts, row and offset of each, and the places to give."""
    if len(t.data) <= 4 * SEGMENT:
        yield t, np.arange(len(t.start)), t.start, None
        return
    margin = 2 * length
    for row, (a, b) in enumerate(zip(t.start.tolist(), t.end.tolist())):
        for at in range(a, b, SEGMENT):
            low, high = max(a, at - margin), min(b, at + SEGMENT + margin)
            part = Texts(t.data[low:high], np.array([0]), np.array([high - low]))
            yield part, np.array([row]), np.array([a - low]), (at - low, at + SEGMENT - low)


ANCHOR = pa.schema(
    [("gram", pa.int64()), ("around", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("reach", pa.int64())]
)


def anchor_rows(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors with ``reach`` (bytes to the left << 32 | to the right), first ones per task.

    Other rows have a negative ``reach``: spans of that many bytes that are repeats already.
    """
    side = length - gram
    remember = 50_000

    def run(batches):
        seen: dict[bytes, int] = {}
        for piece in pieces(batches, "text", SEGMENT >> 1):
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            t = texts(piece.column(1))
            # A whole text met before in this task under a smaller id is known as a copy.
            fresh = np.ones(len(ids), bool)
            for i in range(len(ids)):
                digest = hashlib.blake2b(t.data[t.start[i] : t.end[i]], digest_size=16).digest()
                if seen.get(digest, ids[i]) < ids[i]:
                    fresh[i] = False
                else:
                    if len(seen) >= remember:
                        seen.clear()
                    seen[digest] = int(ids[i])
            t = Texts(t.data, t.start, np.where(fresh, t.end, t.start))
            for part, rows, offset, give in _segments(t, length):
                at, grams = anchors(part, length, gram)
                if give is not None:
                    inside = (at >= give[0]) & (at < give[1])
                    at, grams = at[inside], grams[inside]
                if not len(at):
                    continue
                full = np.flatnonzero(part.end > part.start)
                owner = full[np.searchsorted(part.start[full], at, "right") - 1]
                left = np.minimum(at - part.start[owner], side)
                right = np.minimum(part.end[owner] - at, length)
                around = strong_hash(strong_sums(part.data), at - left, at + right)
                around = mix(around + (left << 32 | right).astype("u8"))
                id_, place = ids[rows[owner]], at - offset[owner]
                order = np.lexsort((place, id_, around, grams))
                again = np.zeros(len(order), bool)
                again[1:] = (grams[order][1:] == grams[order][:-1]) & (around[order][1:] == around[order][:-1])
                first, other = order[~again], order[again]
                wide = other[(left + right)[other] >= length]
                spans = [np.zeros((0, 3), "i8")]
                if len(wide):
                    spans = [_merged(id_[wide], (place - left)[wide], (place + right)[wide])]
                s = np.concatenate(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([grams[first].view("i8"), mix(s[:, 0].astype("u8")).view("i8")])),
                        pa.array(np.concatenate([around[first].view("i8"), s[:, 1]])),
                        pa.array(np.concatenate([id_[first], s[:, 0]])),
                        pa.array(np.concatenate([place[first], s[:, 1]])),
                        pa.array(np.concatenate([(left << 32 | right)[first], s[:, 1] - s[:, 2]])),
                    ],
                    schema=ANCHOR,
                )

    return documents.mapInArrow(run, "gram bigint, around bigint, id bigint, place bigint, reach bigint")


def _merged(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (id, start, end) of the unions of overlapping or touching spans."""
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    cut = np.ones(len(ids), bool)
    reach = np.empty(len(ids), "i8")
    # The farthest end so far within an id: ends are lifted by id so that one maximum serves all.
    _, rank = np.unique(ids, return_inverse=True)
    lift = rank * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    cut[1:] = (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(ids)) - 1
    return np.stack([ids[at], start[at], reach[last] - lift[last]], axis=1)


def first_places(rows: DataFrame, length: int) -> DataFrame:
    """From anchors sorted by gram, surroundings and occurrence: repeats and what is undecided.

    A row with ``gram`` null is a repeated span (``place`` to ``reach``); the others are the first
    occurrence of each surroundings in buckets that have several.
    """

    def run(batches):
        gram = around = None
        several, waiting = False, None
        for batch in batches:
            g, a, i, p, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            done = r < 0
            spans = [(i[done], p[done], p[done] - r[done])]
            g, a, i, p, r = (x[~done] for x in (g, a, i, p, r))
            out: list = []
            if len(g):
                new_g = np.ones(len(g), bool)
                new_g[1:] = g[1:] != g[:-1]
                new_a = new_g.copy()
                new_a[1:] |= a[1:] != a[:-1]
                goes_on = g[0] == gram
                new_g[0] = not goes_on
                new_a[0] = not (goes_on and a[0] == around)
                left, right = r >> 32, r & 0xFFFFFFFF
                again = ~new_a & (left + right >= length)
                spans.append((i[again], (p - left)[again], (p + right)[again]))
                # Buckets are numbered from 0; number 0 is the one that goes on, if one does.
                bucket = np.cumsum(new_g) - (0 if goes_on else 1)
                n = np.bincount(bucket[new_a], minlength=int(bucket[-1]) + 1)
                if goes_on:
                    n[0] += 2 if several else 1
                take = new_a & (n[bucket] > 1)
                if waiting is not None and goes_on and n[0] > 1:
                    out.append(waiting)
                out.append(np.stack([g[take], i[take], p[take], r[take]]))
                last = int(bucket[-1])
                several = bool(n[last] > 1)
                if several:
                    waiting = None
                elif not (goes_on and last == 0):
                    k = int(np.flatnonzero(new_g)[-1])
                    waiting = np.stack([g[k : k + 1], i[k : k + 1], p[k : k + 1], r[k : k + 1]])
                gram, around = g[-1], a[-1]
            s = [np.concatenate(x) for x in zip(*spans)]
            s = _merged(*s) if len(s[0]) else np.zeros((0, 3), "i8")
            o = np.concatenate([np.zeros((4, 0), "i8"), *out], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(len(s), pa.int64()), pa.array(o[0])]),
                    pa.array(np.concatenate([s[:, 0], o[1]])),
                    pa.array(np.concatenate([s[:, 1], o[2]])),
                    pa.array(np.concatenate([s[:, 2], o[3]])),
                ],
                names=["gram", "id", "place", "reach"],
            )

    return rows.mapInArrow(run, "gram bigint, id bigint, place bigint, reach bigint")


def _with_bytes(undecided: DataFrame, documents: DataFrame, length: int, gram: int) -> DataFrame:
    """Left and right bytes of the undecided anchors, padded with zeros."""
    side = length - gram
    places = undecided.groupBy("id").agg(F.collect_list(F.struct("gram", "place", "reach")).alias("at"))

    def run(batches):
        for piece in pieces(batches, "text", SEGMENT):
            t = texts(piece.column(1))
            lists = piece.column(2)
            flat = lists.flatten()
            grams, place, reach = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = piece.column(0).to_numpy()[owner]
            for a in range(0, len(grams), 8192):
                cut = slice(a, a + 8192)
                at = t.start[owner[cut]] + place[cut]
                span = np.arange(-side, length)
                index = at[:, None] + span[None]
                held = (span[None] >= -(reach[cut] >> 32)[:, None]) & (span[None] < (reach[cut] & 0xFFFFFFFF)[:, None])
                around = np.where(held, t.data[np.where(held, index, 0)], 0).astype("u1")
                offsets = np.arange(len(at) + 1, dtype="i4") * (side + length)
                packed = pa.Array.from_buffers(
                    pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(around.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[cut]), pa.array(ids[cut]), pa.array(place[cut]), pa.array(reach[cut]), packed],
                    names=["gram", "id", "place", "reach", "bytes"],
                )

    joined = documents.join(places, "id").select("id", "text", "at")
    return joined.mapInArrow(run, "gram bigint, id bigint, place bigint, reach bigint, bytes binary")


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows, ``most`` at most."""
    differ = x != y
    first = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return np.minimum(first, most)


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of a suffix array, by a stack scan.

    ``lcp[i]`` is the common prefix of suffixes ``i`` and ``i + 1``.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, height in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > height:
            top, first = stack.pop()
            out.append((top, first, i))
        if height >= least and (not stack or stack[-1][0] < height):
            stack.append((height, first))
    return out


def _left_groups(members: list[int], left: list[bytes], at: int, need: int):
    """Groups of members by their left extension: (bytes in common, members), longest last.

    ``at`` bytes are known to be common. A group is given where its members differ in the byte
    before (left diversity), so it can't be extended as a whole.
    """
    todo = [(members, at)]
    while todo:
        group, depth = todo.pop()
        while True:
            by_next: dict[int, list[int]] = defaultdict(list)
            for m in group:
                # A text's begin differs from every byte, its own kind included.
                by_next[left[m][depth] if depth < len(left[m]) else -1 - m].append(m)
            if len(by_next) > 1:
                break
            depth += 1
        if depth >= need:
            yield depth, group
        todo += [(g, depth + 1) for g in by_next.values() if len(g) > 1]


def repeat_groups(
    left: list[bytes], order: list[int], lcp: list[int], length: int, gram: int, known: list[int] | None = None
):
    """Maximal repeat groups of one bucket: (bytes to the left, to the right, members).

    With ``known``, how far to the left each member is known to repeat, groups that tell nothing new
    are passed over.
    """
    for right, first, last in intervals(lcp, gram):
        members = sorted(order[first : last + 1])
        need = max(0, length - right)
        if known is not None:
            need = max(need, min(known[k] for k in members[1:]) + 1)
        for depth, group in _left_groups(members, left, 0, need):
            yield depth, right, group


def scan(buckets: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated spans in buckets, from rows partitioned and sorted by gram and occurrence."""
    side = length - gram

    def of(rows: pa.RecordBatch):
        g, ids, place, reach = (rows.column(k).to_numpy() for k in range(4))
        around = np.frombuffer(b"".join(rows.column(4).to_pylist()), "u1").reshape(len(g), side + length)
        left_n, right_n = reach >> 32, reach & 0xFFFFFFFF
        left, right = np.ascontiguousarray(around[:, :side][:, ::-1]), np.ascontiguousarray(around[:, side:])
        # Suffix array of every bucket: by gram, then by the bytes from the anchor on.
        width = -(-length // 8) * 8
        columns = np.pad(right, ((0, 0), (0, width - length))).view(">u8").T.astype("u8")
        # Of equal padded bytes the shorter suffix comes first.
        order = np.lexsort((np.arange(len(g)), right_n, *columns[::-1], g))
        a, b = order[:-1], order[1:]
        lcp = np.where(g[a] == g[b], _common(right[a], right[b], np.minimum(right_n[a], right_n[b])), 0)
        start = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
        size = np.diff(np.append(start, len(g)))
        # A bucket of two has one interval and one left group.
        two = start[size == 2]
        low, high = np.minimum(order[two], order[two + 1]), np.maximum(order[two], order[two + 1])
        back = _common(left[low], left[high], np.minimum(left_n[low], left_n[high]))
        ahead = lcp[two]
        wide = back + ahead >= length
        m = high[wide]
        found = [np.stack([ids[m], place[m] - back[wide], place[m] + ahead[wide]], axis=1)]
        many: list[tuple[int, int, int]] = []
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            own = order[s : s + n].tolist()
            base = min(own)
            lefts = [left[base + k, : left_n[base + k]].tobytes() for k in range(n)]
            # Intervals come with the longest common prefixes first: a later group tells something
            # new of a member only if it reaches farther to the left.
            reach_left = [-1] * n
            for depth, ahead_, group in repeat_groups(
                lefts, [k - base for k in own], lcp[s : s + n - 1].tolist(), length, gram, reach_left
            ):
                for k in group[1:]:
                    if depth > reach_left[k]:
                        reach_left[k] = depth
                        x = base + k
                        many.append((int(ids[x]), int(place[x]) - depth, int(place[x]) + ahead_))
        if many:
            found.append(np.array(many, "i8"))
        spans = np.concatenate(found)
        spans = _merged(*spans.T) if len(spans) else spans
        return pa.RecordBatch.from_arrays([pa.array(c) for c in spans.T], names=["id", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = rows.column(0).to_numpy()
            # The last bucket waits, since it may go on.
            cut = int(np.searchsorted(g, g[-1]))
            if cut and rows.num_rows > 4096:
                yield of(rows.slice(0, cut))
                held = [rows.slice(cut)]
            else:
                held = [rows]
        if held:
            yield of(held[0])

    return buckets.mapInArrow(run, "id bigint, start bigint, end bigint")


def _one_by_one(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated strings of large buckets, each string on its own."""
    side = length - gram
    before = F.shiftright("reach", 32)
    after = F.col("reach").bitwiseAND(F.lit(0xFFFFFFFF))
    each = rows.withColumn("back", F.explode(F.sequence(F.greatest(F.lit(0), length - after), before)))
    string = F.substring("bytes", (F.lit(side) - F.col("back") + 1).cast("int"), F.lit(length))
    each = each.select(F.md5(string).alias("string"), "id", (F.col("place") - F.col("back")).alias("start"))
    first = each.groupBy("string").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("times"))
    first = first.where("times > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    later = salted.join(first, ["string", "salt"]).where(F.struct("id", "start") != F.col("first"))
    return later.select("id", "start", (F.col("start") + length).alias("end"))


def repeats(
    documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST
) -> DataFrame:
    """``id`` and ``spans`` (bytes, sorted, apart) of every document with repeats in it."""
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where("id IS NOT NULL")
    # A whole text with an earlier copy.
    digests = rows.where(F.octet_length("text") >= length).select("id", F.sha2("text", 256).alias("d"), F.octet_length("text").alias("n"))
    first = digests.groupBy("d", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"))
    first = first.where("times > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = salted.join(first.drop("n"), ["d", "salt"]).where("id <> first")
    copies = copies.select("id", F.lit(0).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("end"))
    order = ["gram", "around", "id", "place"]
    placed = anchor_rows(rows, length, gram).repartition("gram").sortWithinPartitions(*order)
    found = materialize(first_places(placed, length))
    again = found.where("gram IS NULL").select("id", F.col("place").alias("start"), F.col("reach").alias("end"))
    undecided = materialize(_with_bytes(found.where("gram IS NOT NULL"), rows, length, gram))
    large = materialize(undecided.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("gram"))
    small = undecided.join(large, "gram", "left_anti")
    buckets = small.repartition("gram").sortWithinPartitions("gram", "id", "place")
    spans = copies.unionAll(again).unionAll(scan(buckets, length, gram))
    if not large.isEmpty():
        spans = spans.unionAll(_one_by_one(undecided.join(large, "gram", "left_semi"), length, gram))
    return spans.groupBy("id").agg(union(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("spans"))


def remove(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Adds ``spans`` to every document, and ``kept``: the bytes that stay."""
    found = repeats(documents, key, text, **how).withColumnRenamed("id", "_repeat_id")
    rest = documents.drop("spans", "kept")
    joined = rest.join(found, rest[key].cast("bigint") == F.col("_repeat_id"), "left").drop("_repeat_id")
    return joined.withColumn("kept", kept_bytes(F.col(text), F.col("spans")))
