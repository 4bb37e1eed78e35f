"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles. Under one hash function, the subsequences whose
least hash stands at place ``c`` are those that begin in ``[l, c]`` and end in ``[c, r]``: one compact
window ``(l, c, r)`` stands for all of them. The windows of a text are the nodes of the Cartesian
tree over its hashes; only those of ``WORDS`` words or more are kept, about ``2 n / WORDS`` a text.
Two passages with equal least hashes meet where their windows have the same value. A window
meets all earlier ones with its value: two bytes of each shingle near ``c`` tell whether there is a
similar stretch around it, of which equal surroundings are compared once, and what an earlier window
has told is not told again, so that a passage of very many documents gives few rows and no pairs.
The two windows then agree on an interval around ``c``. Where one of ``HASHES`` functions finds
such a pair, the passage is verified on both texts: a stretch of shingles of which eight in
nine are the other's, and a Jaccard similarity of 0.8 with the other's stretch.

A verified passage is a repeat of an earlier one (smaller id, or earlier in the same document), and
it is the later one that is removed. A whole text with an earlier copy is a repeat without search.

Cases: null, empty and short texts have no windows. Equal shingles in one window part at a random
one of them, so a text that says one thing over and over has as few windows as any. Rows with a
null id are left out of the search; ids are taken as unique. Texts of any length are taken whole.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.arrays import SPACES, Texts, Words, coded_shingles, mix, pieces, ragged, shingles, texts, words
from litspark.llm.spans import kept_bytes, union
from litspark.session import materialize

SIZE = 5
WORDS = 50
HASHES = 4
REACH = 12  # places beyond the least length that a window shows of its surroundings
SIMILAR = 0.8
SALTS = 16
TOGETHER = 1 << 16  # pairs of windows that wait to be met side by side
WIDE = 64  # earlier windows from which a window is compared with them block by block
BLOCK = 1 << 17  # pairs of a block, and pairs that are looked at in turns
PART, PART_MOST = 512, 8192  # earlier windows that a window meets at a time: the first, and at most
ROWS = 1024  # windows of a frequent key that meet a part together
_TIES = np.uint64((1 << 16) - 1)


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Windows ``(l, c, r)`` of at least ``least`` places: nodes of the Cartesian tree, from its root."""
    out, todo = [], [(0, len(values) - 1)] if len(values) >= least else []
    while todo:
        low, high = todo.pop()
        at = low + int(values[low : high + 1].argmin())
        out.append((low, at, high))
        if at - low >= least:
            todo.append((low, at - 1))
        if high - at >= least:
            todo.append((at + 1, high))
    return out


WINDOW = pa.schema([(n, pa.int64()) for n in ("key", "id", "at", "before", "after")])
_WINDOW = "key bigint, id bigint, at bigint, before bigint, after bigint"


def windows(documents: DataFrame, size: int = SIZE, n_words: int = WORDS, hashes: int = HASHES) -> DataFrame:
    """Compact windows of every text; the number of the hash function is in the last bits of the key."""
    least = n_words - size + 1
    seeds = mix(np.arange(1, hashes + 1, dtype="u8"))
    remember = 200_000

    def run(batches):
        seen: dict[bytes, int] = {}
        for piece in pieces(batches, "text", 1 << 20):
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            t = texts(piece.column(1))
            for i in range(len(ids)):
                # A whole text met in this task under a smaller id is known as a copy.
                digest = hashlib.blake2b(t.data[t.start[i] : t.end[i]], digest_size=16).digest()
                if seen.get(digest, ids[i]) < ids[i]:
                    t.end[i] = t.start[i]
                else:
                    if len(seen) >= remember:
                        seen.clear()
                    seen[digest] = int(ids[i])
            own, first = shingles(words(t, SPACES), size, whole=False)
            ties = mix(np.arange(len(own), dtype="u8")) & _TIES
            keys, found, owner = [], [], []
            for j, seed in enumerate(seeds):
                values = mix(own ^ seed)
                order = (values & ~_TIES) | ties
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    if b - a >= least:
                        nodes = compact_windows(order[a:b], least)
                        found += nodes
                        owner += [i] * len(nodes)
                        keys.append((mix(values[[a + c for _, c, _ in nodes]]) & ~np.uint64(7)) | np.uint64(j))
            if not found:
                continue
            w = np.array(found, "i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view("i8")),
                    pa.array(ids[np.array(owner)]),
                    pa.array(w[:, 1]),
                    pa.array(w[:, 1] - w[:, 0]),
                    pa.array(w[:, 2] - w[:, 1]),
                ],
                schema=WINDOW,
            )

    return documents.select("id", "text").mapInArrow(run, _WINDOW)


def _shared(placed: DataFrame) -> DataFrame:
    """Windows whose key another window has too; ``placed`` is sorted by key in each partition."""

    def run(batches):
        # The last row waits: the next batch tells whether its key goes on.
        held, known = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column(0).to_numpy()
            more = keys[1:] == keys[:-1]
            shared = np.append(False, more) | np.append(more, False)
            shared[0] |= known
            held, known = batch.slice(len(keys) - 1), bool(shared[-1])
            yield batch.slice(0, len(keys) - 1).filter(pa.array(shared[:-1]))
        if known:
            yield held

    return placed.mapInArrow(run, _WINDOW)


def surroundings(shared: DataFrame, rows: DataFrame, size: int, reach: int) -> DataFrame:
    """Adds to each window ``around``: two bytes of each shingle up to ``reach`` places from ``c``."""
    kind = pa.schema([*WINDOW, pa.field("around", pa.binary())])
    width = 2 * reach + 1

    def run(batches):
        for piece in pieces(batches, "text", 1 << 20):
            ids = piece.column(0).to_numpy()
            own, first = shingles(words(texts(piece.column(1)), SPACES), size, whole=False)
            short = np.concatenate([np.zeros(reach, "u2"), (mix(own) >> np.uint64(48)).astype("u2"), np.zeros(reach, "u2")])
            listed = piece.column(2)
            owner = np.repeat(np.arange(len(ids)), listed.value_lengths().to_numpy())
            key, at, before, after = (x.to_numpy(zero_copy_only=False) for x in listed.flatten().flatten())
            step = 1 << 14
            for x in range(0, len(key), step):
                y = slice(x, x + step)
                taken = short[(first[owner[y]] + at[y])[:, None] + np.arange(width)]
                offset = np.arange(width) - reach
                taken[(offset < -before[y][:, None]) | (offset > after[y][:, None])] = 0
                packed = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(2 * width), len(taken), [None, pa.py_buffer(np.ascontiguousarray(taken))]
                )
                columns = [key[y], ids[owner[y]], at[y], before[y], after[y]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), packed.cast(pa.binary())], schema=kind)

    place = F.struct("key", "at", "before", "after")
    listed = shared.groupBy("id").agg(F.collect_list(place).alias("places"))
    both = rows.join(listed.hint("merge"), "id").select("id", "text", "places")
    return both.mapInArrow(run, f"{_WINDOW}, around binary")


def dense_around(hit: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Of each row of hits the widest stretch around place ``reach``: first, end; zeros without one.

    Of its ``least`` places or more eight in nine are hits, as in any stretch of similarity 0.8.
    """
    kind = np.dtype("i2" if hit.shape[1] < 4096 else "i4")
    sums = np.zeros((len(hit), hit.shape[1] + 1), kind)
    np.cumsum(hit * kind.type(9) - kind.type(8), axis=1, dtype=kind, out=sums[:, 1:])
    best = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
    n = reach + 1
    # A stretch from place a ends behind the middle, and not before a + least.
    ends = np.maximum(np.arange(n) + least, n)
    inside = ends <= hit.shape[1]
    ok = (best[:, np.minimum(ends, hit.shape[1])] >= sums[:, :n]) & inside
    low = ok.argmax(1)
    found = ok[np.arange(len(hit)), low]
    reached = sums >= sums[np.arange(len(hit)), low][:, None]
    high = hit.shape[1] - reached[:, ::-1].argmax(1)
    return np.where(found, np.stack([low, high]), 0)


def dense_extent(hit: np.ndarray, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of hits first and end of all stretches of ``dense_around`` together; zeros without one.

    Fewer hits have no stretch outside.
    """
    kind = np.dtype("i2" if hit.shape[1] < 4096 else "i4")
    width, n = hit.shape[1], reach + 1
    sums = np.zeros((len(hit), width + 1), kind)
    np.cumsum(hit * kind.type(9) - kind.type(8), axis=1, dtype=kind, out=sums[:, 1:])
    best = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
    ends = np.maximum(np.arange(n) + least, n)
    ok = (best[:, np.minimum(ends, width)] >= sums[:, :n]) & (ends <= width)
    low = ok.argmax(1)
    found = ok[np.arange(len(hit)), low]
    lowest = np.minimum.accumulate(sums[:, :n], axis=1)
    ends = np.arange(max(n, least), width + 1)
    ok = sums[:, ends] >= lowest[:, np.minimum(ends - least, reach)]
    high = width - ok[:, ::-1].argmax(1) if len(ends) else low
    return np.where(found, low, 0), np.where(found, high, 0)


def place_before(codes: np.ndarray) -> np.ndarray:
    """Of each place of each row the one before it with the same code; -1 without."""
    order = np.argsort(codes, axis=1, kind="stable")
    ranked = np.take_along_axis(codes, order, axis=1)
    out = np.full(codes.shape, -1, "i2")
    last = np.where(ranked[:, 1:] == ranked[:, :-1], order[:, :-1], -1)
    np.put_along_axis(out, order[:, 1:], last.astype("i2"), axis=1)
    return out


def may_be_similar(before: np.ndarray, hit: np.ndarray, least: int) -> np.ndarray:
    """Whether each row has a stretch that may be similar to another text which has its hits only.

    Of its ``least`` places or more eight in nine are hits, and so are ``SIMILAR`` of its different codes:
    the other text can have no more of them in common. ``before`` is the ``place_before`` of the codes.
    """
    n, width = hit.shape
    sums = np.zeros((n, width + 1), "i2")
    np.cumsum(hit * np.int16(9) - np.int16(8), axis=1, dtype="i2", out=sums[:, 1:])
    best = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
    share = np.where(hit, np.int16(100 - 100 * SIMILAR), np.int16(-100 * SIMILAR))
    begins = hit[:, : width - least + 1] & (best[:, least:] >= sums[:, : width - least + 1])
    out = np.zeros(n, bool)
    for low in range(width - least + 1):
        k = np.flatnonzero(begins[:, low] & ~out)
        if len(k):
            # Each code counts once, where it comes first.
            first = np.where(before[k, low:] < low, share[k, low:], np.int16(0))
            enough = np.cumsum(first, axis=1, dtype="i2")[:, least - 1 :] >= 0
            out[k] = (enough & (sums[k, low + least :] >= sums[k, low][:, None])).any(1)
    return out


JOINED = ("id", "source", "low", "high", "shift", "seed_low", "seed_high")


class _Part:
    """Some windows of a key, and which of them have a shingle (two bytes of it)."""

    def __init__(self, first: int, around: np.ndarray, inside: np.ndarray):
        self.first, self.n = first, len(around)
        codes = np.sort(np.where(inside, around, np.int32(1 << 16)), axis=1)
        fresh = codes < 1 << 16
        fresh[:, 1:] &= codes[:, 1:] != codes[:, :-1]
        window, place = np.nonzero(fresh)
        codes = codes[window, place].astype("u2")
        self.window = window[np.argsort(codes, kind="stable")].astype("u2")
        self.count = np.bincount(codes, minlength=1 << 16).astype("i4")
        self.start = np.cumsum(self.count) - self.count

    def having(self, row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``n`` rows with some codes each the windows that have one of them: row and window, sorted."""
        count = self.count[code]
        met = np.zeros((n, self.n), bool)
        met[np.repeat(row, count), self.window[ragged(self.start[code], count)]] = True
        return np.nonzero(met)


class _Key:
    """Pairs of the windows of a batch with all earlier windows of their keys."""

    def __init__(self, rows: np.ndarray, around: np.ndarray, least: int):
        self.rows, self.around, self.least = rows, around, least
        self.reach = around.shape[1] // 2
        self.small = around & np.uint16(4095)
        self.inside = self._inside(rows)
        # 1024 bits of each window's shingles, and how many of its places share a bit.
        self.bits = self._bits(np.arange(len(around)), self.inside)
        self.slack = self.inside.sum(1) - np.bitwise_count(self.bits).sum(1, dtype="i8")
        # A byte holds how many bits two windows have in common, if they have no more places.
        self.narrow = around.shape[1] < 256
        self.out: list[np.ndarray] = []
        self.covered = np.zeros(around.shape, bool)
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_near = 0
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def _inside(self, rows: np.ndarray) -> np.ndarray:
        offset = np.arange(self.around.shape[1]) - self.reach
        return (offset >= -rows[3][:, None]) & (offset <= rows[4][:, None])

    def tell(self, i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Windows ``i`` meet ``j``: where they agree, and the stretch that is known to be similar."""
        rows = self.rows
        at = rows[2, i]
        back, ahead = np.minimum(rows[3, i], rows[3, j]), np.minimum(rows[4, i], rows[4, j])
        seed = np.where(high > 0, at - self.reach + np.stack([low, high]), 0)
        self.out.append(np.stack([rows[1, i], rows[1, j], at - back, at + ahead + 1, at - rows[2, j], *seed]))

    def agreed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places on which windows ``i`` and ``j`` agree, of those shown."""
        rows, offset = self.rows, np.arange(self.around.shape[1]) - self.reach
        back, ahead = np.minimum(rows[3, i], rows[3, j]), np.minimum(rows[4, i], rows[4, j])
        return (offset >= -back[:, None]) & (offset <= ahead[:, None])

    def hidden(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether windows ``i`` and ``j`` agree on places that are not shown."""
        rows = self.rows
        most = np.maximum(np.minimum(rows[3, i], rows[3, j]), np.minimum(rows[4, i], rows[4, j]))
        return most > self.reach

    def _bits(self, i: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A bit for each shingle at the given places of windows ``i``, in 1024 of them."""
        bits = np.zeros((len(i), 128), "u1")
        for at in range(0, len(i), 1 << 12):
            part = np.zeros((len(i[at : at + (1 << 12)]), 1024), bool)
            r, c = np.nonzero(places[at : at + (1 << 12)])
            part[r, self.small[i[at + r], c] & 1023] = True
            bits[at : at + len(part)] = np.packbits(part, axis=1)
        return bits.view("u8")

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether windows ``a`` and earlier ones ``b`` share places enough, and lie apart within one document."""
        rows = self.rows
        fit = np.minimum(rows[3][a], rows[3][b]) + np.minimum(rows[4][a], rows[4][b]) + 1 >= self.least
        return fit & ((rows[1][b] < rows[1][a]) | (rows[2][a] - rows[2][b] >= self.least))

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Windows ``i`` with earlier ones ``j``, sorted by ``i``."""
        near = self.like(i, j)
        self.turns(i[near], j[near])

    def like(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether windows ``i`` and ``j`` have bits enough in common."""
        # Of the least stretch eight places in nine are hits; fewer bits in common leave none.
        shared = np.bitwise_count(self.bits[i] & self.bits[j]).sum(1, dtype="i8")
        return 9 * (shared + self.slack[i]) >= 8 * self.least

    def compare_all(self, i: np.ndarray, j: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows ``i`` and those of ``j`` that stand before them, ``before`` many, the pairs that may agree.

        Rows meet columns as a whole, so that no pair is looked up by its numbers.
        """
        # Bits in common that a window needs at least.
        need = np.maximum(-(-8 * self.least // 9) - self.slack[i], 0)[:, None]
        a, b = np.ascontiguousarray(self.bits[i].T), np.ascontiguousarray(self.bits[j].T)
        shared = np.zeros((len(i), len(j)), "u1" if self.narrow else "u2")
        for x, y in zip(a, b):
            shared += np.bitwise_count(x[:, None] & y)
        near = shared >= need.astype(shared.dtype)
        near &= np.arange(len(j)) < before[:, None]
        r, c = np.nonzero(near)
        i, j = i[r], j[c]
        fit = self.fit(i, j)
        return i[fit], j[fit]

    def frequent(self, members: np.ndarray, n: int) -> None:
        """Windows of one key, from place ``n`` of its ``members`` on, with all that stand before them.

        A window meets them part by part in their order. What the first have told of it leaves little that
        a later one may add: of those to come it meets only the ones that share one of its ``probes``.
        """
        parts, size, at = [], PART, 0
        while at < len(members):
            own = members[at : at + size]
            parts.append(_Part(at, self.around[own], self.inside[own]))
            at += size
            size = min(at, PART_MOST)
        times = sum(part.count for part in parts)
        for at in range(n, len(members), ROWS):
            place = np.arange(at, min(at + ROWS, len(members)))
            own = members[place]
            codes, probes, covered = self.around[own], np.zeros(self.inside[own].shape, bool), np.full(len(own), -1)
            for part in parts:
                if part.first > place[-1]:
                    break
                there, before = members[part.first : part.first + part.n], place - part.first
                if not part.first:
                    every, some = np.arange(len(own)), np.zeros(0, "i8")
                else:
                    self.look()
                    now = self.covered[own].sum(1)
                    changed = np.flatnonzero(now != covered)
                    probes[changed], covered = self.probes(own[changed], times), now
                    met = (part.count[codes] * probes).sum(1)
                    # Where the shingles are those of many windows, all pairs are cheaper.
                    every, some = np.flatnonzero(4 * met >= part.n), np.flatnonzero((met > 0) & (4 * met < part.n))
                found = [(np.zeros(0, "i8"), np.zeros(0, "i8"))]
                step = max(1, BLOCK // part.n)
                for x in range(0, len(every), step):
                    k = every[x : x + step]
                    found.append(self.compare_all(own[k], there, before[k]))
                r, c = np.nonzero(probes[some])
                r, c = part.having(r, codes[some[r], c], len(some))
                earlier = c < before[some[r]]
                i, j = own[some[r[earlier]]], there[c[earlier]]
                for x in range(0, len(i), 1 << 14):
                    a, b = i[x : x + (1 << 14)], j[x : x + (1 << 14)]
                    ok = self.fit(a, b) & self.like(a, b)
                    found.append((a[ok], b[ok]))
                i, j = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(i, kind="stable")
                self.turns(i[order], j[order])

    def probes(self, i: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Places of windows ``i`` of which a source must have one to tell anything new; the rarest that do.

        A source without any of them has at most the other places, and those are not similar to anything
        around the middle, or are told already.
        """
        left = self.inside[i] & ~self.covered[i]
        n_times = times[self.around[i]]
        level = np.ceil(np.log2(np.maximum(n_times, 1)) / 2).astype("i1")
        out, todo = left.copy(), np.arange(len(i))
        for most in range(-1, int(level.max(initial=0))):
            rare = left[todo] & (level[todo] <= most)
            enough = ~self._tells(i[todo], rare)
            out[todo[enough]] = rare[enough]
            todo = todo[~enough]
        # Where nothing is told yet, the rarest of some neighbours may do.
        fresh = np.flatnonzero(~self.covered[i].any(1) & out.any(1))
        for side in (3, 6):
            width, n = out.shape[1], -(-out.shape[1] // side)
            padded = np.full((len(fresh), n * side), 1 << 31)
            padded[:, :width] = np.where(out[fresh], n_times[fresh], 1 << 31)
            rarest = padded.reshape(len(fresh), n, side).argmin(2)
            few = (np.arange(side) == rarest[:, :, None]).reshape(len(fresh), n * side)[:, :width] & out[fresh]
            enough = ~self._tells(i[fresh], few)
            out[fresh[enough]] = few[enough]
            fresh = fresh[enough]
        return out

    def _tells(self, i: np.ndarray, without: np.ndarray) -> np.ndarray:
        """Whether a source that has all places of windows ``i`` but those may tell anything new."""
        hit = self.inside[i] & ~without
        low, high = dense_extent(hit, self.reach, self.least)
        place = np.arange(hit.shape[1])
        tells = (hit & ~self.covered[i] & (place >= low[:, None]) & (place < high[:, None])).any(1)
        some = np.flatnonzero(tells)
        tells[some] = self.may_be_similar(i[some], hit[some])
        return tells

    def may_be_similar(self, i: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """``may_be_similar`` of windows ``i`` and their hits."""
        windows, of = np.unique(i, return_inverse=True)
        before = place_before(self.around[windows])
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 11):
            part = slice(at, at + (1 << 11))
            out[part] = may_be_similar(before[of[part]], hit[part], self.least)
        return out

    def turns(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs that may agree, all those of a window at once, sorted by ``i`` and ``j``."""
        self.near.append((i, j))
        self.n_near += len(i)
        if self.n_near >= BLOCK:
            self.look()

    def look(self) -> None:
        """Looks at each window's first sources, then at more for what of it none has repeated yet."""
        if not self.n_near:
            return
        i, j = (np.concatenate(x) for x in zip(*self.near))
        self.near, self.n_near = [], 0
        place = np.arange(len(i))
        turn = place - np.maximum.accumulate(np.where(np.append(True, i[1:] != i[:-1]), place, 0))
        upto, step = 2, 1 << 12
        while len(i):
            now = np.flatnonzero(turn < upto)
            for at in range(0, len(now), step):
                self._look(i[now[at : at + step]], j[now[at : at + step]])
            self.settle()
            later = turn >= upto
            i, j, turn = i[later], j[later], turn[later]
            # A source without a shingle of what is left tells nothing new.
            windows, of = np.unique(i, return_inverse=True)
            left = self._bits(windows, self.inside[windows] & ~self.covered[windows])
            some = np.zeros(len(i), bool)
            for at in range(0, len(i), step):
                part = slice(at, at + step)
                some[part] = (left[of[part]] & self.bits[j[part]]).any(1)
            i, j, turn = i[some], j[some], turn[some]
            upto *= 4

    def _look(self, i: np.ndarray, j: np.ndarray) -> None:
        pivots, of = np.unique(j, return_inverse=True)
        has = np.zeros((len(pivots), 4096), bool)
        r, c = np.nonzero(self.inside[pivots])
        has[r, self.small[pivots][r, c]] = True
        hit = has[of[:, None], self.small[i]] & self.inside[i]
        enough = 9 * np.count_nonzero(hit, axis=1) >= 8 * self.least
        i, j, hit = i[enough], j[enough], hit[enough]
        low, high = dense_extent(hit, self.reach, self.least)
        found = np.flatnonzero(high)
        i, j, hit = i[found], j[found], hit[found]
        place = np.arange(hit.shape[1])
        dense = hit & (place >= low[found, None]) & (place < high[found, None])
        left = dense & ~self.covered[i]
        n_left = np.count_nonzero(left, axis=1)
        # Of few places that seem new both bytes are compared: most of these are there by chance.
        r, c = np.nonzero(left & (n_left <= 8)[:, None])
        real = np.zeros(len(r), bool)
        for at in range(0, len(r), 1 << 14):
            x, y = r[at : at + (1 << 14)], c[at : at + (1 << 14)]
            real[at : at + len(x)] = ((self.around[j[x]] == self.around[i[x], y][:, None]) & self.inside[j[x]]).any(1)
        hit[r[~real], c[~real]] = dense[r[~real], c[~real]] = False
        found = np.flatnonzero((n_left > 8) | (np.bincount(r[real], minlength=len(i)) > 0))
        if not len(found):
            return
        self.waiting.append((i[found], j[found], hit[found], dense[found]))
        self.held += len(found)
        if self.held >= TOGETHER:
            self.settle()

    def settle(self) -> None:
        """Meets the pairs that wait: of each window first one source, then more and more of them at a time."""
        if not self.held:
            return
        i, j, hit, dense = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        most = 1
        while len(i):
            # What is known to repeat needs no second source.
            left = (dense & ~self.covered[i]).any(1)
            i, j, hit, dense = i[left], j[left], hit[left], dense[left]
            place = np.arange(len(i))
            now = place - np.maximum.accumulate(np.where(np.append(True, i[1:] != i[:-1])[: len(i)], place, 0)) < most
            rows = np.flatnonzero(now)
            # No window is parted: what its sources tell is taken in turn.
            cuts = np.searchsorted(i[rows], np.unique(i[rows])[:: max(1, 4096 // most)])
            for at in np.split(rows, cuts[1:]):
                self.take(i[at], j[at], *self.meet(i[at], j[at], hit[at]))
            i, j, hit, dense = i[~now], j[~now], hit[~now], dense[~now]
            most *= 2

    def take(self, i, j, dense, row, low, high, none) -> None:
        """Tells the stretches ``low`` to ``high`` of pairs ``row``, each unless those before tell all that is dense."""
        place = np.arange(dense.shape[1])
        pair, of = np.unique(np.concatenate([row, none]), return_inverse=True)
        of, of_none = of[: len(row)], of[len(row) :]
        inside = np.zeros((len(pair), dense.shape[1]), bool)
        np.logical_or.at(inside, of, (place >= low[:, None]) & (place < high[:, None]))
        taken, open_ = np.zeros(len(pair), bool), np.arange(len(pair))
        while len(open_):
            of_window = i[pair[open_]]
            left = (dense[pair[open_]] & ~self.covered[of_window]).any(1)
            open_, of_window = open_[left], of_window[left]
            turn = np.append(True, of_window[1:] != of_window[:-1])[: len(open_)]
            self.covered[of_window[turn]] |= inside[open_[turn]]
            taken[open_[turn]] = True
            open_ = open_[~turn]
        told = taken[of]
        self.tell(i[row[told]], j[row[told]], low[told], high[told])
        none = none[taken[of_none]]
        self.tell(i[none], j[none], np.zeros(len(none), "i8"), np.zeros(len(none), "i8"))

    def nearest(self, i: np.ndarray, j: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Of each place of windows ``i`` the nearest one of ``j`` with the same two bytes; -1 without."""
        a, b = self.around[i], self.around[j]
        place = np.arange(a.shape[1])
        there = self.inside[j]
        near = np.where((a == b) & self.inside[i] & there, place, -1)
        r, c = np.nonzero(hit & (near < 0))
        for at in np.array_split(np.arange(len(r)), 1 + len(r) // (1 << 14)):
            equal = (b[r[at]] == a[r[at], c[at]][:, None]) & there[r[at]]
            gap = np.where(equal, np.abs(place - c[at][:, None]).astype("i2"), np.int16(1 << 14))
            best = gap.argmin(1)
            near[r[at], c[at]] = np.where(equal[np.arange(len(at)), best], best, -1)
        return near

    def meet(self, i: np.ndarray, j: np.ndarray, hit: np.ndarray):
        """Similar stretches of pairs of windows that hit what none has told yet.

        Given are the hits of the widest stretch of each pair; pair, low and high of each similar stretch;
        and the pairs that have none where the windows agree on more than is shown: the texts tell.
        """
        given, place, dense = np.arange(len(i)), np.arange(hit.shape[1]), np.zeros(hit.shape, bool)
        if (i[1:] == i[:-1]).any():
            # Of many sources of a window most share one word said over and over, which is not similar.
            given = np.flatnonzero(self.may_be_similar(i, hit))
        near = self.nearest(i[given], j[given], hit[given])
        low, high = dense_around(near >= 0, self.reach, self.least)
        dense[given] = (near >= 0) & (place >= low[:, None]) & (place < high[:, None])
        found = np.flatnonzero((dense[given] & ~self.covered[i[given]]).any(1))
        some, near, low, high = given[found], near[found], low[found], high[found]
        i, j, met = i[some], j[some], dense[some]
        low, high = met.argmax(1), near.shape[1] - met[:, ::-1].argmax(1)
        whole = high - low >= self.least
        whole[whole] = similar_rows(self.around[i[whole]], self.around[j[whole]], near[whole], met[whole], low[whole], high[whole])
        found = [(np.flatnonzero(whole), low[whole], high[whole])]
        # Otherwise what is the same word by word stands on its own.
        rest = np.flatnonzero(~whole)
        goes_on = met[rest, 1:] & met[rest, :-1] & (near[rest, 1:] == near[rest, :-1] + 1)
        step = np.cumsum(goes_on, axis=1)
        length = step - np.maximum.accumulate(np.where(goes_on, 0, step), axis=1) + 1
        equal = length.max(1, initial=0) >= self.least
        for k in rest[equal].tolist():
            a = int(low[k])
            for x, y in equal_runs(near[k, a : high[k]], self.least):
                found.append((np.array([k]), np.array([a + x]), np.array([a + y])))
        # A stretch within the widest may be similar where that is not.
        rest = rest[~equal]
        row, x, y = dense_run_rows(self.agreed(i[rest], j[rest]) & (near[rest] >= 0), 2 * SIMILAR / (1 + SIMILAR), self.least)
        k = rest[row]
        met = (near[k] >= 0) & (place >= x[:, None]) & (place < y[:, None])
        ok = similar_rows(self.around[i[k]], self.around[j[k]], near[k], met, x, y)
        found.append((k[ok], x[ok], y[ok]))
        row, low, high = (np.concatenate(f) for f in zip(*found))
        order = np.lexsort((low, row))
        # Without codes enough in common there is nothing that the texts could tell.
        none = np.setdiff1d(rest, k[ok])
        none = none[self.hidden(i[none], j[none])]
        none = none[self.may_be_similar(i[none], near[none] >= 0)]
        return dense, some[row[order]], low[order], high[order], some[none]


def _n_distinct(values: np.ndarray) -> np.ndarray:
    """Different values of each row but the filler 65536."""
    values = np.sort(values, axis=1)
    return ((values[:, 1:] != values[:, :-1]) & (values[:, 1:] < 65536)).sum(1) + (values[:, 0] < 65536)


def similar_rows(
    a: np.ndarray, b: np.ndarray, near: np.ndarray, met: np.ndarray, low: np.ndarray, high: np.ndarray
) -> np.ndarray:
    """``similar`` of the stretch ``low`` to ``high`` of each row of ``a`` that meets ``b`` at ``near``."""
    place = np.arange(a.shape[1])
    shift = np.where(met, place - near, 1 << 20)
    ranked = np.sort(shift, axis=1)
    n, row = met.sum(1), np.arange(len(a))
    middle = (ranked[row, (n - 1) // 2] + ranked[row, n // 2]) / 2
    # Stray hits elsewhere in the other text don't widen its stretch.
    kept = met & (np.abs(shift - middle[:, None]) <= np.maximum(32, (high - low) // 4)[:, None])
    first = np.where(kept, near, 1 << 20).min(1)
    last = np.where(kept, near, -1).max(1)
    x = np.where((place >= low[:, None]) & (place < high[:, None]), a.astype("i4"), 65536)
    y = np.where((place >= first[:, None]) & (place <= last[:, None]), b.astype("i4"), 65536)
    n_x, n_y, both = _n_distinct(x), _n_distinct(y), _n_distinct(np.concatenate([x, y], axis=1))
    shared = n_x + n_y - both
    return (last >= 0) & (shared >= SIMILAR * both)


def join_windows(found: DataFrame, least: int) -> DataFrame:
    """Each window with the earlier ones of its value that repeat a part of it.

    ``found`` is partitioned by key and sorted by key, id and place. Every window meets all earlier
    windows of its key that have other surroundings; of equal surroundings the first stands for all.
    A pair is given where it holds a similar stretch around ``c`` that no pair before has told, so
    that a passage of very many documents gives few rows and no pairs. Of a key only its different
    surroundings are held.
    """

    def run(batches):
        held, held_around = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            t = texts(batch.column(5))
            around = np.frombuffer(t.data.tobytes(), "u2").reshape(rows.shape[1], -1)
            h = 0
            if held is not None and held[0, 0] == rows[0, 0]:
                h = held.shape[1]
                rows, around = np.concatenate([held, rows], axis=1), np.concatenate([held_around, around])
            n = rows.shape[1]
            pairs = _Key(rows, around, least)
            reach = pairs.reach
            # The numbers beside a 16-bit value tell its place, and those of a window its bounds.
            weights = mix(np.arange(1, around.shape[1] + 1, dtype="u8"))
            content = np.zeros(n, "u8")
            for at in range(0, n, 1 << 11):
                part = slice(at, at + (1 << 11))
                content[part] = (mix(around[part] + (weights[None] << np.uint64(16))) * pairs.inside[part]).sum(1, dtype="u8")
            content = mix(content + np.minimum(rows[3], reach).astype("u8") * np.uint64(4099) + np.minimum(rows[4], reach).astype("u8"))
            order = np.lexsort((np.arange(n), content, rows[0]))
            new = np.ones(n, bool)
            new[1:] = (rows[0][order][1:] != rows[0][order][:-1]) | (content[order][1:] != content[order][:-1])
            head = np.empty(n, "i8")
            head[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
            # Within one document a passage repeats another only if they are apart.
            apart = (rows[1][head] < rows[1]) | (rows[2] - rows[2][head] >= least)
            same = (head != np.arange(n)) & apart
            copies = np.flatnonzero(same)
            copies = copies[copies >= h]
            shown = np.maximum(0, reach - rows[3, copies]), reach + np.minimum(reach, rows[4, copies]) + 1
            pairs.tell(copies, head[copies], *shown)
            left = np.flatnonzero(~same)
            keys = rows[0][left]
            start = np.zeros(len(left), "i8")
            if len(left):
                fresh = np.append(True, keys[1:] != keys[:-1])
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(left)), 0))
            count = np.where(left >= h, np.arange(len(left)) - start, 0)
            at, step = 0, 1 << 14
            ends = np.cumsum(count)
            wide = np.append(np.flatnonzero(count >= WIDE), len(left))
            while at < len(left):
                next_wide = int(wide[np.searchsorted(wide, at)])
                if next_wide == at:
                    # The other windows of a key with all earlier ones.
                    first, at = int(start[at]), int(np.searchsorted(start, start[at], "right"))
                    pairs.frequent(left[first:at], next_wide - first)
                    continue
                # Some windows with all earlier ones, all told a step.
                done = int(ends[at - 1]) if at else 0
                to = min(max(int(np.searchsorted(ends, done + step, "right")), at + 1), next_wide)
                i = np.repeat(np.arange(at, to), count[at:to])
                j = ragged(start[at:to], count[at:to])
                a, b = left[i], left[j]
                fit = pairs.fit(a, b)
                if fit.any():
                    pairs.compare(a[fit], b[fit])
                at = to
            pairs.look()
            last = left[keys == rows[0, -1]]
            held, held_around = rows[:, last].copy(), around[last].copy()
            told = np.concatenate(pairs.out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in told.astype("i8")], names=list(JOINED))

    return found.mapInArrow(run, ", ".join(f"{c} bigint" for c in JOINED))


def stretches(low: np.ndarray, high: np.ndarray, shift: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(low, high, shift)`` of the union of intervals, of ``least`` places or more."""
    change = np.bincount(low, minlength=int(high.max()) + 1) - np.bincount(high, minlength=int(high.max()) + 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype("i1"), [0]])))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            shifts = np.sort(shift[(low < b) & (high > a)])
            out.append((a, b, int(shifts[len(shifts) // 2])))
    return out


def dense_runs(hit: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
    """Runs of hits joined from the left while ``share`` of the places are hits."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype("i1"), [0]])))
    out: list[list[int]] = []  # low, high, hits
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and out[-1][2] + b - a >= share * (b - out[-1][0]):
            out[-1][1:] = [b, out[-1][2] + b - a]
        else:
            out.append([a, b, b - a])
    return [(a, b) for a, b, _ in out if b - a >= least]


def dense_run_rows(hit: np.ndarray, share: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``dense_runs`` of each row of hits: row, low and high of each run."""
    n, width = hit.shape
    low, high, hits, begin = np.full(n, -1), np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "i8")
    step = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype("i1"), axis=1)
    out = []
    for at in range(width + 1):
        r = np.flatnonzero(step[:, at] < 0)
        if len(r):
            more = at - begin[r]
            joins = (low[r] >= 0) & (hits[r] + more >= share * (at - low[r]))
            fresh = r[~joins]
            ended = fresh[high[fresh] - low[fresh] >= least]
            out.append((ended, low[ended], high[ended]))
            low[fresh], hits[fresh] = begin[fresh], 0
            hits[r] += more
            high[r] = at
        begin[step[:, at] > 0] = at
    ended = np.flatnonzero(high - low >= least)
    out.append((ended, low[ended], high[ended]))
    row, low, high = (np.concatenate(x) for x in zip(*out))
    return row, low, high


def equal_runs(near: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of hits that follow each other in the other text too."""
    go_on = np.zeros(len(near) + 1, bool)
    go_on[1:-1] = (near[1:] == near[:-1] + 1) & (near[:-1] >= 0)
    start = np.flatnonzero(~go_on[:-1] & (near >= 0))
    end = np.flatnonzero(~go_on[1:] & (near >= 0)) + 1
    return [(a, b) for a, b in zip(start.tolist(), end.tolist()) if b - a >= least]


def _before(codes: np.ndarray, owner: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each place the one before it in its text with the same code; -1 without."""
    out = np.full(len(codes), -1)
    same = (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out[order[1:][same]] = order[:-1][same]
    return out


class _Places:
    """Shingles of the texts of a slice and of their sources, and where each stands in the sources."""

    def __init__(self, own: tuple[Texts, Words], other: tuple[Texts, Words], size: int):
        coded, n_distinct = coded_shingles([own, other], size)
        (self.own, own_first), (self.other, other_first) = coded
        self.own_first, self.other_first = own_first.tolist(), other_first.tolist()
        owner = np.repeat(np.arange(len(own_first) - 1), np.diff(own_first))
        self.own_before = _before(self.own, owner, np.argsort(self.own, kind="stable"))
        self.place = np.argsort(self.other, kind="stable")
        owner = np.repeat(np.arange(len(other_first) - 1), np.diff(other_first))
        self.other_before = _before(self.other, owner, self.place)
        self.code = self.other[self.place]
        # Code and place in one number: sorted, as places grow within a code.
        self.key = self.code * len(self.other) + self.place
        self.met = np.zeros(n_distinct, bool)

    def nearest(self, wanted: np.ndarray, source: int, target: np.ndarray, most: np.ndarray | None) -> np.ndarray:
        """Place in a source of each wanted code nearest to its target, ``most`` at most; -1 without one."""
        low, high = self.other_first[source], self.other_first[source + 1]
        if low == high:
            return np.full(len(wanted), -1)
        last = high - 1 if most is None else np.minimum(low + most, high - 1)
        target = np.maximum(np.minimum(target + low, last), low)
        up = np.searchsorted(self.key, wanted * len(self.other) + target)
        down = np.maximum(up - 1, 0)
        up = np.minimum(up, len(self.key) - 1)
        p_up, p_down = self.place[up], self.place[down]
        ahead = (self.code[up] == wanted) & (p_up >= target) & (p_up <= last)
        behind = (self.code[down] == wanted) & (p_down >= low) & (p_down < target) & (p_down <= last)
        nearer = ahead & (~behind | (p_up - target < target - p_down))
        return np.where(ahead | behind, np.where(nearer, p_up, p_down) - low, -1)

    def similar(self, low: int, high: int, source: int, near: np.ndarray) -> bool:
        """Whether a stretch has the Jaccard similarity with the stretch of the source it hits."""
        at = np.flatnonzero(near >= 0)
        there = near[at]
        shift = at - there
        ranked = np.sort(shift)
        middle = (ranked[(len(ranked) - 1) // 2] + ranked[len(ranked) // 2]) / 2
        # Stray hits elsewhere in the source don't widen its stretch.
        there = there[np.abs(shift - middle) <= max(32, len(near) // 4)]
        if not len(there):
            return False
        a = self.other_first[source] + int(there.min())
        b = self.other_first[source] + int(there.max()) + 1
        part = self.own[low:high]
        self.met[part] = True
        fresh = self.other_before[a:b] < a
        shared = np.count_nonzero(fresh & self.met[self.other[a:b]])
        self.met[part] = False
        n = np.count_nonzero(self.own_before[low:high] < low) + np.count_nonzero(fresh)
        return shared >= SIMILAR * (n - shared)


def verified(at: _Places, text: int, source: int, places: np.ndarray, least: int, same: bool) -> list[tuple[int, int]]:
    """Stretches of a text that are near-duplicates of stretches of its source.

    A place is an interval, its shift, and the stretch within it that the join told as similar.
    """
    first = at.own_first[text]
    out = []
    wide = stretches(*places[:3], least)
    # A told stretch stands on its own where the one around it was not similar as a whole.
    told = dict.fromkeys(zip(*(places[k].tolist() for k in (3, 4, 2))))
    for low, high, shift in [*wide, *told]:
        if high - low < least or any(a <= low and high <= b for a, b in out):
            continue
        place = np.arange(low, high)
        part = at.own[first + low : first + high]
        near = at.nearest(part, source, place - shift, place - least if same else None)
        for a, b in dense_runs(near >= 0, 2 * SIMILAR / (1 + SIMILAR), least):
            if at.similar(first + low + a, first + low + b, source, near[a:b]):
                out.append((low + a, low + b))
            else:
                # What is the same word by word within it stands on its own.
                out += [(low + a + x, low + a + y) for x, y in equal_runs(near[a:b], least)]
    return out


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each group with overlapping and touching ones joined; ``group`` counts up from 0."""
    order = np.lexsort((low, group))
    wide = int(high.max(initial=0)) + 2
    low, high = (group * wide + low)[order], (group * wide + high)[order]
    reach = np.maximum.accumulate(high)
    fresh = np.flatnonzero(np.append(True, low[1:] > reach[:-1])[: len(low)])
    last = np.append(fresh[1:], len(low))[: len(fresh)] - 1
    of = low[fresh] // wide
    return of, low[fresh] - of * wide, reach[last] - of * wide


def _sources(met: DataFrame) -> DataFrame:
    """One row for each text that repeats something: its sources, each with the places told of it.

    ``first`` tell all that any of the text's sources tells, those that tell most before others; ``rest``
    are the others. A source of which no window has told a similar stretch is left out: of what is
    similar around such a window, others have told every part that is so by itself.
    """
    fields = JOINED[2:]
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in fields]))
    sources = pa.list_(pa.struct([("source", pa.int64()), ("places", kind)]))
    schema = pa.schema([("id", pa.int64()), ("first", sources), ("rest", sources)])

    def nested(n, owner, source, places, counts):
        """Sources of each of ``n`` texts, ``counts`` places of each."""
        offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        struct = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in places], fields=list(kind.value_type))
        inner = pa.ListArray.from_arrays(offsets, struct).cast(kind)
        struct = pa.StructArray.from_arrays([pa.array(source, pa.int64()), inner], fields=list(sources.value_type))
        outer = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
        return pa.ListArray.from_arrays(outer, struct).cast(sources)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            source, *places = (x.to_numpy(zero_copy_only=False) for x in listed.flatten().flatten())
            order = np.lexsort((source, owner))
            owner, source, places = owner[order], source[order], [x[order] for x in places]
            fresh = np.append(True, (owner[1:] != owner[:-1]) | (source[1:] != source[:-1]))
            pair, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            low, high = (x.astype("i8") for x in places[3:])
            some = high > 0
            of, a, b = merged(pair[some], low[some], high[some])
            told = np.bincount(of, b - a, len(begin)).astype("i8")
            first = np.zeros(len(begin), bool)
            text = owner[begin]
            at = np.searchsorted(of, np.arange(len(begin) + 1))
            left, of_text = None, -1
            for k in np.lexsort((source[begin], -told, text)).tolist():
                if text[k] != of_text:
                    of_text = text[k]
                    ends = b[at[np.searchsorted(text, of_text)] : at[np.searchsorted(text, of_text, "right")]]
                    left = np.ones(int(ends.max(initial=0)), bool)
                for x, y in zip(a[at[k] : at[k + 1]].tolist(), b[at[k] : at[k + 1]].tolist()):
                    if left[x:y].any():
                        first[k] = True
                        left[x:y] = False
            counts = np.diff(np.append(begin, len(pair)))
            columns = [batch.column(0)]
            for keep in (first, (told > 0) & ~first):
                taken = keep[pair]
                columns.append(nested(batch.num_rows, text[keep], source[begin][keep], [x[taken] for x in places], counts[keep]))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    place = F.struct("source", *(F.col(c).cast("int").alias(c) for c in fields))
    listed = met.groupBy("id").agg(F.collect_list(place).alias("places"))
    struct = ", ".join(f"{c}: int" for c in fields)
    struct = f"array<struct<source: bigint, places: array<struct<{struct}>>>>"
    return listed.mapInArrow(run, f"id bigint, first {struct}, rest {struct}")


def _named(listed: DataFrame) -> DataFrame:
    """Ids of texts and sources, each about once a task: a family's sources are many times the same."""

    def run(batches):
        for batch in batches:
            ids = pa.concat_arrays([batch.column(0), batch.column(1).flatten(), batch.column(2).flatten()]).unique()
            yield pa.RecordBatch.from_arrays([ids], names=["id"])

    return listed.select("id", "first.source", "rest.source").toDF("id", "first", "rest").mapInArrow(run, "id bigint")


def _untold(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Of the other sources those that tell of places which no verified stretch of the text has."""
    spans = F.array_sort(F.collect_set(F.struct(F.col("low").alias("start"), F.col("high").alias("end"))))
    done = found.groupBy("id").agg(union(spans).alias("done"))
    told = lambda p: F.exists("done", lambda d: (d["start"] <= p["seed_low"]) & (p["seed_high"] <= d["end"]))
    untold = lambda p: (p["seed_high"] > 0) & ~F.coalesce(told(p), F.lit(False))
    left = F.filter("rest", lambda s: F.exists(s["places"], untold))
    both = listed.where(F.size("rest") > 0).join(done.hint("merge"), "id", "left")
    return both.select("id", F.inline(left))


def _verify(pairs: DataFrame, rows: DataFrame, size: int, least: int) -> DataFrame:
    """Byte spans of verified repeats, with the source and the places (shingles) of each."""

    def run(batches):
        for piece in pieces(batches, "text", 1 << 20):
            ids, sources = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            _, first_id, of_id = np.unique(ids, return_index=True, return_inverse=True)
            _, first_source, of_source = np.unique(sources, return_index=True, return_inverse=True)
            t = texts(piece.column(2).take(pa.array(first_id)))
            w = words(t, SPACES, hashed=False)
            s = texts(piece.column(3).take(pa.array(first_source)))
            index, out = _Places((t, w), (s, words(s, SPACES, hashed=False)), size), []
            listed = piece.column(4)
            places = np.stack([c.to_numpy(zero_copy_only=False) for c in listed.flatten().flatten()]).astype("i8")
            ends = np.cumsum(listed.value_lengths().to_numpy())
            for k, (low, high) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                d, e = int(of_id[k]), int(of_source[k])
                for a, b in verified(index, d, e, places[:, low:high], least, bool(ids[k] == sources[k])):
                    at = int(w.first[d])
                    start, end = int(w.start[at + a]), int(w.end[at + b + size - 2])
                    out.append((int(ids[k]), start - int(t.start[d]), end - int(t.start[d]), int(sources[k]), a, b))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["id", "start", "end", "source", "low", "high"]
            )

    # Texts are never broadcast either.
    source = rows.select(F.col("id").alias("source"), F.col("text").alias("other"))
    with_source = pairs.join(source.hint("merge"), "source")
    both = with_source.join(rows.select("id", "text").hint("merge"), "id").select("id", "source", "text", "other", "places")
    return both.mapInArrow(run, "id bigint, start bigint, end bigint, source bigint, low bigint, high bigint")


def repeats(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    n_words: int = WORDS,
    hashes: int = HASHES,
) -> DataFrame:
    """``id``, ``spans`` (bytes) and ``sources`` (ids) of every document that repeats an earlier passage."""
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where("id IS NOT NULL")
    least = n_words - size + 1
    # No more of a text is read than the words it needs.
    long_ = F.col("text").rlike(rf"^\s*+(?:\S++\s++){{{n_words - 1}}}\S")
    digests = rows.where(long_).select("id", F.sha2("text", 256).alias("d"), F.octet_length("text").alias("end"))
    digests = materialize(digests)
    first = digests.groupBy("d").agg(F.min("id").alias("source"), F.count(F.lit(1)).alias("times"))
    first = first.where("times > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = materialize(
        salted.join(first.drop("times"), ["d", "salt"])
        .where("id <> source")
        .select("id", F.lit(0).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "source")
    )
    placed = windows(rows, size, n_words, hashes).repartition("key").sortWithinPartitions("key", "id", "at")
    shared = _shared(placed).join(copies.select("id").distinct(), "id", "left_anti")
    # A copy has been told already and needs no search. Texts are read again for the windows that meet.
    around = surroundings(materialize(shared), rows, size, least - 1 + REACH)
    met = join_windows(around.repartition("key").sortWithinPartitions("key", "id", "at"), least)
    listed = materialize(_sources(met))
    pairs = listed.select("id", F.inline("first"))
    wanted = _named(listed).distinct()
    # The ids grow with the data: they are never broadcast, so the join is the same at every size.
    chosen = materialize(rows.join(wanted.hint("merge"), "id", "left_semi"))
    found = materialize(_verify(pairs, chosen, size, least))
    rest = materialize(_untold(listed, found))
    found = found.unionAll(_verify(rest, chosen, size, least)).drop("low", "high")
    spans = found.unionAll(copies)
    return spans.groupBy("id").agg(
        union(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def mark(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Adds ``spans`` and ``sources`` to every document; empty where it repeats nothing."""
    found = materialize(repeats(documents, key, text, **how).withColumnRenamed("id", "_repeat_id"))
    rest = documents.drop("spans", "sources")
    joined = rest.join(found, rest[key].cast("bigint") == F.col("_repeat_id"), "left").drop("_repeat_id")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return joined.withColumns(
        {"spans": F.coalesce("spans", none), "sources": F.coalesce("sources", F.array().cast("array<bigint>"))}
    )


def remove(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Documents without the passages that repeat earlier ones, columns as they came.

    Spans begin and end with words, so what is left is text; a document of which no word is left
    goes.
    """
    cut = mark(documents, key, text, **how)
    left = kept_bytes(F.col(text), F.col("spans")).cast("string")
    cut = cut.withColumn(text, F.when(F.size("spans") > 0, left).otherwise(F.col(text)))
    return cut.where((F.size("spans") == 0) | (F.length(F.trim(F.regexp_replace(text, r"[\s]+", " "))) > 0)).select(
        documents.columns
    )
