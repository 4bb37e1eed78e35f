"""N-gram Jaccard join by parity sketches.

A document's set is that of its word n-grams, as 64-bit hashes. Two sets of sizes ``a <= b`` with
Jaccard similarity of at least ``t`` differ in at most ``d = (a + b) (1 - t) / (1 + t)`` elements,
and ``b <= a / t``. Sets are put into size bands; for a band, the hash space is cut into ``k > d``
parts, and the sketch of a set is the XOR of the hashes in each part. An element that only one of
two sets has flips bits of one part only, so the number of parts that differ never exceeds the
number of elements that differ: by the pigeonhole principle similar sets agree in a part. Parts
are the join keys, and a set enters its own band and those of smaller partners.

An empty part says nothing, so ``k`` has slack. A set whose empty parts could use up all that must
agree (a few short texts) also enters its ``(1 - t) size + 1`` smallest hashes as keys: similar
sets share one of those, so nothing is lost.

Documents with a key in common also compare a whole sketch: the parity of the hashes at each of
about as many bits as the set has elements. Its Hamming distance, too, is at most the number of
elements that differ, so a pair above ``d`` is no link and is dropped where it is met.

The rows of a key are never all paired with each other. In the first round the documents of a key
meet its first document, in each later one its next (``PIVOTS`` to ``MOST_PIVOTS``); pairs in different components that
pass the sketch are verified on the whole texts, and links become components. A key whose documents
are all in one component is done. Groups of equal sets are linked by the set's hash without any
pair, and only the first of each takes part in the rounds.

Cases: null and empty texts have an empty set and link with nothing. A text of fewer words than
``n`` has one element: all its words. Rows with a null id can't be named by a
link and are left out. Rows with one id are one document, linked by any of their texts, and come back as
often as they came. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.arrays import SPACES, list_array, mix, pieces, shingles, texts, words
from litspark.llm.components import EDGES, components
from litspark.session import materialize

SIZE = 5
THRESHOLD = Fraction(8, 10)
PIVOTS = 32
MOST_PIVOTS = 8192
BAND_RATIO = 1.4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def set_arrays(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, joined, and the first of each text."""
    hashes, first = shingles(words(texts(column), SPACES), size)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(first)))


class Bands:
    """Size bands: the first size of each, its number of parts, and the largest partner."""

    def __init__(self, threshold: Fraction, largest: int):
        self.threshold = threshold
        starts, at = [], 1
        while at <= max(largest, 1):
            starts.append(at)
            at = max(at + 1, int(at * BAND_RATIO))
        self.start = np.array([*starts, at], "i8")
        last = self.start[1:] - 1
        self.partner = np.array([int(x / threshold) for x in last.tolist()], "i8")
        most = np.array([self.differ(a, b) for a, b in zip(last.tolist(), self.partner.tolist())], "i8")
        self.parts = most + 4 + most // 40

    def differ(self, a: int, b: int) -> int:
        """Elements in which similar sets of these sizes differ, at most."""
        return int((a + b) * (1 - self.threshold) / (1 + self.threshold))


def keys_of(hashes: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all sets, and the number of each."""
    size = np.diff(first)
    n = len(size)
    own = np.searchsorted(bands.start, size, "right") - 1
    keys, owners = [], []
    unsafe = np.zeros(n, bool)
    step = 0
    share = float((1 - bands.threshold) / (1 + bands.threshold))
    while True:
        # As the smaller set in its own band, as the larger one in those below.
        band = own - step
        mine = (size > 0) & (band >= 0)
        mine[mine] = bands.partner[band[mine]] >= size[mine]
        if step and not mine.any():
            break
        which = np.repeat(np.arange(n), size)
        taken = mine[which]
        which, h = which[taken], hashes[taken]
        parts = bands.parts[np.maximum(band, 0)]
        part = ((h >> np.uint64(32)) * parts[which].astype("u8")) >> np.uint64(32)
        cut = np.ones(len(h), bool)
        cut[1:] = (which[1:] != which[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(cut)
        if len(at):
            folded = np.bitwise_xor.reduceat(h, at)
            who = which[at]
            label = mix((band[who].astype("u8") << np.uint64(40)) + part[at] + np.uint64(1))
            keys.append(mix(folded ^ label))
            owners.append(who)
            full = np.bincount(who, minlength=n)
            last = bands.start[np.maximum(band, 0) + 1] - 1
            other = last if step else (size / float(bands.threshold)).astype("i8") + 1
            differ = ((size + other) * share + 1).astype("i8")
            # All empty parts may agree with nothing in them; one full part must be left over.
            unsafe |= mine & (parts - differ <= parts - full)
        step += 1
    if unsafe.any():
        t = bands.threshold
        prefix = np.array([s - (-(-s * t.numerator // t.denominator)) + 1 for s in size[unsafe].tolist()], "i8")
        who = np.repeat(np.flatnonzero(unsafe), prefix)
        at = np.concatenate([np.arange(a, a + p) for a, p in zip(first[:-1][unsafe], prefix)])
        keys.append(mix(hashes[at] + _GOLD))
        owners.append(who)
    if not keys:
        return np.zeros(0, "u8"), np.zeros(n, "i8")
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.bincount(owners, minlength=n)


def parity_sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Bit sketch of each set: a power of two of bits, as many as elements or more, 64 at least."""
    size = np.diff(first)
    words = np.ones(len(size), "i8")
    some = size > 64
    words[some] = 1 << np.ceil(np.log2(size[some] / 64)).astype("i8")
    start = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(size)), size)
    # The word from bits 6 on, so that halving a sketch keeps the lower of them.
    at = start[owner] + ((hashes >> np.uint64(6)).astype("i8") & (words[owner] - 1))
    out = np.zeros(int(words.sum()), "u8")
    np.bitwise_xor.at(out, at, np.uint64(1) << (hashes & np.uint64(63)))
    return [out[a : a + n].tobytes() for a, n in zip(start.tolist(), words.tolist())]


def sketches(documents: DataFrame, key: str, text: str, size: int, threshold: Fraction) -> DataFrame:
    """Id, set size, set hash, and the join keys of each document.

    A copy of a set already met in the same partition (within a bounded memory of them) carries
    no keys, only the id it equals: large groups of copies shrink before they are shuffled.
    """
    remember = 50_000

    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        bands = Bands(threshold, 1 << 10)
        for piece in pieces(batches, "text"):
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            hashes, first = set_arrays(piece.column(1), size)
            n = np.diff(first)
            if n.max(initial=0) >= bands.start[-1]:
                bands = Bands(threshold, int(n.max()) * 2)
            sums = np.append(np.zeros(1, "u8"), np.cumsum(hashes * _GOLD, dtype="u8"))
            folded = np.append(np.zeros(1, "u8"), np.cumsum(mix(hashes), dtype="u8"))
            whole = np.stack([mix(sums[first[1:]] - sums[first[:-1]]), mix(folded[first[1:]] - folded[first[:-1]])])
            whole = whole.view("i8")
            same = [None] * len(ids)
            fresh = n > 0
            for i, (a, b) in enumerate(zip(*whole.tolist())):
                if not n[i]:
                    continue
                if (a, b) in seen:
                    same[i], fresh[i] = seen[a, b], False
                else:
                    if len(seen) >= remember:
                        seen.clear()
                    seen[a, b] = int(ids[i])
            taken = np.repeat(fresh, n)
            counts = np.where(fresh, n, 0)
            keys, times = keys_of(hashes[taken], np.concatenate([[0], np.cumsum(counts)]), bands)
            at = np.concatenate([[0], np.cumsum(times)])
            bits = parity_sketches(hashes[taken], np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(whole[0]),
                    pa.array(whole[1]),
                    pa.array(same, pa.int64()),
                    list_array(keys.view("i8"), at, pa.int64()),
                    pa.array(bits, pa.binary()),
                ],
                names=["id", "n", "set_a", "set_b", "same", "keys", "sketch"],
            )

    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.where("id IS NOT NULL").mapInArrow(
        run, "id bigint, n bigint, set_a bigint, set_b bigint, same bigint, keys array<bigint>, sketch binary"
    )


def _run_starts(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


class _Sketches:
    """Sketches of a batch, folded to a common length where two are compared."""

    def __init__(self, column: pa.Array):
        t = texts(column)
        self.data = np.frombuffer(t.data.tobytes(), "u8")
        self.start, self.words = t.start // 8, (t.end - t.start) // 8
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Matrix of all sketches of ``words`` or more, folded to that; row of each."""
        if words not in self.folded:
            own = np.flatnonzero(self.words >= words)
            rows = np.zeros((len(own), words), "u8")
            for n in np.unique(self.words[own]).tolist():
                mine = self.words[own] == n
                whole = self.data[self.start[own[mine]][:, None] + np.arange(n)[None]]
                rows[mine] = np.bitwise_xor.reduce(whole.reshape(len(whole), n // words, words), axis=1)
            place = np.full(len(self.words), -1)
            place[own] = np.arange(len(own))
            self.folded[words] = rows, place
        return self.folded[words]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        words = np.minimum(self.words[a], self.words[b])
        out = np.zeros(len(a), "i8")
        for n in np.unique(words).tolist():
            rows, place = self._of(n)
            for at in np.array_split(np.flatnonzero(words == n), 1 + (words == n).sum() * n // (1 << 19)):
                out[at] = np.bitwise_count(rows[place[a[at]]] ^ rows[place[b[at]]]).sum(1)
        return out


def pivot_pairs(grouped: DataFrame, low: int, high: int, threshold: Fraction) -> DataFrame:
    """Pairs of the documents of a key with its documents number ``low`` to ``high - 1``.

    ``grouped`` is partitioned by key and sorted by key and id: key, id, root, n, sketch. Pairs of a
    pivot and a later document in another component are given if size and sketch let them be a
    link. Only the pivots of the key at hand are held: a key of any size passes in a stream.
    """
    up, down = threshold.numerator, threshold.denominator

    def run(batches):
        key, rank, held = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            goes_on = keys[0] == key
            h = held.num_rows if goes_on and held is not None else 0
            if h:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                keys = np.append(np.full(h, key), keys)
            ids, comps, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            own = _Sketches(batch.column(4))
            new = _run_starts(keys)
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            ranks = np.arange(len(keys)) - start
            # Row of a key's document number 0, had all of them come in this batch.
            base = start.copy()
            if goes_on:
                head = start == 0
                base[head] = -low if rank > low else -rank
                ranks[head] = np.where(np.arange(int(head.sum())) < h, low, rank - h) + np.arange(int(head.sum()))
            pairs = [np.zeros((2, 0), "i8")]
            for r in range(low, min(high, int(ranks.max()))):
                at = np.flatnonzero((ranks > r) & (np.arange(len(keys)) >= h))
                pivot = base[at] + r
                a, b = pivot[pivot >= 0], at[pivot >= 0]
                ok = (comps[a] != comps[b]) & (down * np.minimum(n[a], n[b]) >= up * np.maximum(n[a], n[b]))
                a, b = a[ok], b[ok]
                near = own.distance(a, b) <= (n[a] + n[b]) * (down - up) // (down + up)
                pairs.append(np.stack([ids[a[near]], ids[b[near]]]))
            last = start == start[-1]
            chosen = last & (ranks >= low) & (ranks < high)
            held = batch.filter(pa.array(chosen))
            key, rank = keys[-1], int(ranks[-1]) + 1
            found = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], schema=EDGES)

    return grouped.select("key", "id", "root", "n", "sketch").mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, documents: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose sets reach the threshold, on their whole texts."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches):
        for piece in pieces(batches, "text_a", 1 << 20):
            a, b = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            # A document of many pairs is taken apart once for each slice of rows.
            _, at_a, of_a = np.unique(a, return_index=True, return_inverse=True)
            left, left_first = set_arrays(piece.column(2).take(pa.array(at_a)), size)
            right, right_first = set_arrays(piece.column(3), size)
            linked = np.zeros(len(a), bool)
            for i, k in enumerate(of_a.tolist()):
                x, y = left[left_first[k] : left_first[k + 1]], right[right_first[i] : right_first[i + 1]]
                if len(x) and len(y):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    shared = int((x[at] == y).sum())
                    linked[i] = down * shared >= up * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], schema=EDGES)

    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    # The ids grow with the data: they are never broadcast, so the join is the same at every size.
    chosen = materialize(documents.join(ids.hint("merge"), "id", "left_semi"))
    with_b = pairs.join(chosen.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(chosen.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def link(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    threshold: Fraction = THRESHOLD,
) -> DataFrame:
    """Per document: ``key``, ``n_shingles`` and ``component_id``, the smallest id reachable.

    A document without an id has no component: its ``component_id`` is null.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    made = sketches(rows, "id", "text", size, threshold)
    # Keys are many and looked at once: they are made again for their shuffle, and never written.
    sets = materialize(made.drop("keys"))
    full = sets.where("n > 0")
    # Equal sets: copies met in one task point to the one met first, those to the smallest id.
    copies = full.where("same IS NOT NULL").select(F.col("id").alias("a"), F.col("same").alias("b"))
    firsts = full.where("same IS NULL").select("set_a", "set_b", "id")
    least = firsts.groupBy("set_a", "set_b").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("times"))
    again = firsts.join(least.where("times > 1"), ["set_a", "set_b"]).where("id <> b").select(F.col("id").alias("a"), "b")
    again = materialize(again.distinct())
    root = components(copies.unionAll(again))
    keys = made.where("n > 0 AND same IS NULL").select(F.explode("keys").alias("key"), "id")
    grouped = _shared(keys.repartition("key").sortWithinPartitions("key", "id"))
    grouped = materialize(grouped.join(again.select(F.col("a").alias("id")), "id", "left_anti"))
    # Which of several copies in a task is the first may differ between the two times.
    bits = full.select("id", "n", "sketch")
    named = root.select(F.col("node").alias("id"), "root")
    low, high = 0, 1
    while True:
        rooted = grouped.join(named, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
        mine = rooted.join(bits, "id").repartition("key").sortWithinPartitions("key", "id")
        pairs = materialize(pivot_pairs(mine, low, high, threshold).distinct())
        if not pairs.isEmpty():
            links = verify(pairs, rows, size, threshold)
            stars = root.select(F.col("node").alias("a"), F.col("root").alias("b"))
            root = components(materialize(stars.unionAll(links)))
            named = root.select(F.col("node").alias("id"), "root")
        # A key stays open while it has two components, and documents beyond the pivots so far.
        rooted = grouped.join(named, "id", "left").select("key", F.coalesce("root", "id").alias("root"))
        per_key = rooted.groupBy("key").agg(
            F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")
        )
        still = per_key.where((F.col("least") < F.col("most")) & (F.col("n") > high + 1)).select("key")
        grouped = materialize(grouped.join(still, "key", "left_semi"))
        if grouped.isEmpty():
            bare = rows.where("id IS NULL").withColumn("id", F.monotonically_increasing_id())
            sizes = sketches(bare, "id", "text", size, threshold).select(
                F.lit(None).cast("bigint").alias(key), F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")
            )
            return _result(sets, root, key).unionAll(sizes)
        low, high = high, high + min(MOST_PIVOTS, max(PIVOTS, 8 * (high - low)))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of keys that have two rows at least; ``rows`` is sorted by key in each partition."""
    kind = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches):
        # The last row waits: the next batch tells whether its key goes on.
        keys, ids, known = np.zeros(0, "i8"), np.zeros(0, "i8"), False
        for batch in batches:
            keys = np.append(keys, batch.column(0).to_numpy(zero_copy_only=False))
            ids = np.append(ids, batch.column(1).to_numpy(zero_copy_only=False))
            if not len(keys):
                continue
            new = _run_starts(keys)
            shared = ~new
            shared[:-1] |= ~new[1:]
            shared[0] |= known
            out = shared[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][out]), pa.array(ids[:-1][out])], schema=kind)
            keys, ids, known = keys[-1:], ids[-1:], bool(shared[-1])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], schema=kind)

    return rows.select("key", "id").mapInArrow(run, "key bigint, id bigint")


def _result(sets: DataFrame, root: DataFrame, key: str) -> DataFrame:
    known = root.select(F.col("node").alias("id"), "root")
    return sets.join(known, "id", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Documents with the smallest id of their group stay, and those that link with nothing.

    Of rows that have one id and one text a single one stays. Rows without an id all stay: a group's
    document is told by its id.
    """
    found = materialize(link(documents, key, text, **how).where(F.col(key) == F.col("component_id")).select(key))
    kept = documents.join(found.distinct(), key, "left_semi").select(documents.columns)
    again = found.groupBy(key).count().where("count > 1").select(key)
    if not again.isEmpty():
        several = kept.join(again, key, "left_semi").select(documents.columns)
        first = several.dropDuplicates([key, text])
        kept = kept.join(again, key, "left_anti").select(documents.columns).unionAll(first)
    return kept.unionAll(documents.where(F.col(key).isNull()))
