"""Periodic runs of words: stretches that repeat one period at least ``exponent`` times.

A run is a longest stretch of a text in which words ``q`` apart are identical, ``q`` its smallest
period. They are found on a harmonic grid: a run of period ``q`` that is ``exponent`` periods long
holds a place divisible by ``(exponent - 1) * q`` whose word stands again ``q`` later, so for each
``q`` only those places are looked at, and the run's ends follow from how far the text agrees with
itself from there, forward and backward (longest common extensions).

An extension compares a few words first. Pairs that still agree after ``V`` words are rare; for their
texts only, the suffixes that begin at places of a difference cover modulo ``V`` are sorted by
doubling, and a sparse table over their common prefixes answers any pair: within ``V`` words both
sides stand at cover places (``SHIFT``), and less than ``V`` words remain behind.

Words are numbered by their bytes. Each task works on slices of about a megabyte, one text at least;
memory follows the slice. A text without words has no runs; null is an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.arrays import SPACES, pieces, ragged
from litspark.llm.tokens import byte_array, coded, column_texts, packed, word_codes, word_spans

# A difference cover, every difference modulo V occurs between two of its members.
V = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
PAIRS = 1 << 20
_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def _shifts() -> np.ndarray:
    """``[i, j]``: steps after which places ``i`` and ``j`` (modulo ``V``) both lie in the cover."""
    inside = np.zeros(V, bool)
    inside[COVER] = True
    out = np.full((V, V), V)
    places = np.arange(V)
    for step in reversed(range(V)):
        both = inside[(places + step) % V]
        out[np.ix_(both, both)] = step
    return out


SHIFT = _shifts()


class Suffixes:
    """Sorted cover suffixes of a sequence, and their common prefixes in blocks of ``V`` words.

    ``x`` ends with ``V`` values that stand nowhere else.
    """

    def __init__(self, x: np.ndarray):
        n = len(x) - V
        columns = [np.arange(r, n, V) for r in COVER]
        at = np.concatenate(columns)
        ends = np.repeat(np.cumsum([len(c) for c in columns]), [len(c) for c in columns])
        self.slot = np.full(n + V, -1, "i8")
        self.slot[at] = np.arange(len(at))
        blocks = x[at[:, None] + np.arange(V)].astype("i4")
        names, _ = coded(byte_array(np.frombuffer(blocks.tobytes(), "u1"), np.full(len(at), 4 * V)))
        rank, step, levels = names.astype("i8"), 1, []
        while True:
            levels.append(rank)
            if not len(rank) or rank.max() == len(rank) - 1:
                break
            ahead = np.arange(len(at)) + step
            inside = ahead < ends
            second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            _, rank = np.unique(rank * (len(at) + 1) + second, return_inverse=True)
            step *= 2
            if step > 2 * len(at):
                break
        self.rank = rank
        order = np.argsort(rank, kind="stable")
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), "i8")
        for level, names in reversed(list(enumerate(levels))):
            p, q = a + common, b + common
            inside = (p < ends[a]) & (q < ends[b])
            same = inside & (names[np.where(inside, p, 0)] == names[np.where(inside, q, 0)])
            common[same] += 1 << level
        self.least = [common]
        width = 1
        while 2 * width <= len(common):
            low = self.least[-1]
            self.least.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whole blocks in which the suffixes at cover places ``i`` and ``j`` agree."""
        a, b = self.rank[self.slot[i]], self.rank[self.slot[j]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype("f8"))[1] - 1
        out = np.empty(len(a), "i8")
        for k in np.unique(level):
            of = level == k
            low = self.least[k]
            out[of] = np.minimum(low[a[of]], low[b[of] - (1 << int(k))])
        return out


def _agree(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that agree from ``i`` and ``j`` on, ``most`` at most."""
    out = np.zeros(len(i), "i8")
    live = np.flatnonzero(most > 0)
    step = 0
    while len(live):
        live = live[x[i[live] + step] == x[j[live] + step]]
        out[live] += 1
        step += 1
        live = live[most[live] > step]
    return out


def _far(x: np.ndarray, i: np.ndarray, j: np.ndarray, sorted_: Suffixes) -> np.ndarray:
    """Words that agree from ``i`` and ``j`` on, where ``V`` words do."""
    shift = SHIFT[i % V, j % V]
    done = shift + V * sorted_.blocks(i + shift, j + shift)
    return done + _agree(x, i + done, j + done, np.full(len(i), V))


def _both_ways(x: np.ndarray, i: np.ndarray, j: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """How far ``x`` agrees with itself after (``i``, ``j``) and before them.

    ``text`` is the number of the text of each pair, ``begin`` and ``end`` where texts stand.
    """
    full = np.full(len(i), V)
    turned = x[::-1]
    back_i, back_j = len(x) - i, len(x) - j  # the words before them, in the turned sequence
    ahead, behind = _agree(x, i, j, full), _agree(turned, back_i, back_j, full)
    long = (ahead == V) | (behind == V)
    if long.any():
        # Only texts with long agreements are sorted: they are laid out anew, one after another.
        texts, of = np.unique(text[long], return_inverse=True)
        size = end[texts] - begin[texts] + 1  # with the separator behind
        first = V + np.cumsum(size) - size
        middle = x[ragged(begin[texts], size)]
        _, middle = np.unique(middle, return_inverse=True)
        fence = np.arange(V)
        y = np.concatenate([-1 - fence, middle, -1 - V - fence])
        move = first[of] - begin[texts][of]
        a, b = i[long] + move, j[long] + move
        for out, z, p, q in ((ahead, y, a, b), (behind, y[::-1], len(y) - a, len(y) - b)):
            again = np.flatnonzero(out[long] == V)
            if len(again):
                out[np.flatnonzero(long)[again]] = _far(z, p[again], q[again], Suffixes(z))
    return ahead, behind


def find_runs(codes: np.ndarray, first: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of every run, by text, start and period.

    ``codes`` numbers the words of all texts, those of text ``d`` from ``first[d]`` to ``first[d + 1]``.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")  # longest first: a period looks at the texts it fits
    sizes = size[order]
    n_texts = len(size)
    if not n_texts or sizes[0] < max(shortest, exponent):
        return tuple(np.zeros((4, 0), "i8"))
    begin = V + np.cumsum(sizes + 1) - (sizes + 1)
    end = begin + sizes
    x = np.empty(V + int(sizes.sum()) + n_texts + V, "i8")
    x[:V], x[-V:] = -1 - np.arange(V), -1 - V - np.arange(V)
    x[end] = -1 - 2 * V - np.arange(n_texts)
    x[ragged(begin, sizes)] = codes[ragged(first[:-1][order], sizes)]
    periods = np.arange(1, int(sizes[0]) // exponent + 1)
    fits = np.searchsorted(-sizes, -np.maximum(exponent * periods, shortest), "right")
    periods = periods[fits > 0]
    reach = end[fits[fits > 0] - 1]
    grid = (exponent - 1) * periods
    looks = np.maximum(-(-(reach - periods) // grid), 0)
    upto = np.cumsum(looks)
    found = []
    at = 0
    while at < len(periods):
        to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        q = np.repeat(periods[at:to], looks[at:to])
        i = ragged(np.zeros(to - at, "i8"), looks[at:to]) * np.repeat(grid[at:to], looks[at:to])
        same = x[i] == x[i + q]
        i, q = i[same], q[same]
        text = np.searchsorted(begin, i, "right") - 1
        ahead, behind = _both_ways(x, i, i + q, text, begin, end)
        length = ahead + behind + q
        good = length >= np.maximum(exponent * q, shortest)
        found.append(np.stack([text, i - behind, length, q])[:, good])
        at = to
    text, start, length, q = np.concatenate(found, axis=1)
    keep = np.lexsort((q, length, start))
    text, start, length, q = text[keep], start[keep], length[keep], q[keep]
    # A stretch is met again with multiples of its period: the smallest counts.
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    text, start, length, q = text[new], start[new], length[new], q[new]
    start, text = start - begin[text], order[text]
    sort = np.lexsort((q, start, text))
    return text[sort], start[sort], length[sort], q[sort]


def mark(df: DataFrame, text: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """Adds ``runs`` (start word, length in words, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without those that a run holds behind its
    first period. ``shortest`` is the least length of a run in words. Columns of those names are
    replaced, all others pass through.
    """
    names = ("runs", "collapsed")
    own = [f for f in df.schema.fields if f.name.lower() not in names]
    out = T.StructType([*own, T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for slice_ in pieces(batches, text, 1 << 20):
            t = column_texts(slice_, text)
            words = word_spans(t, SPACES)
            codes, _ = word_codes(t.data, words)
            of, start, length, q = find_runs(codes, words.first, exponent, shortest)
            dropped = np.zeros(len(codes) + 1, "i8")
            np.add.at(dropped, words.first[of] + start + q, 1)
            np.add.at(dropped, words.first[of] + start + length, -1)
            kept = np.cumsum(dropped)[:-1] == 0
            values = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, q)], fields=list(_ARROW_RUN))
            firsts = np.searchsorted(of, np.arange(slice_.num_rows + 1)).astype("i4")
            runs = pa.ListArray.from_arrays(pa.array(firsts), values)
            collapsed = _joined(t.data, words, kept).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*slice_.select([f.name for f in own]).columns, runs, collapsed], names=out.names
            )

    return df.select([f"`{f.name}`" for f in own] + ([] if text in [f.name for f in own] else [f"`{text}`"])).mapInArrow(run, out)


def _joined(data: np.ndarray, words, kept: np.ndarray) -> pa.Array:
    """Kept words of each text joined by one space."""
    n_texts = len(words.first) - 1
    text = np.repeat(np.arange(n_texts), np.diff(words.first))[kept]
    start, end = words.start[kept], words.end[kept]
    follows = np.append(text[1:] == text[:-1], False)[: len(text)]
    # A word that another one follows has a gap behind it: its first byte becomes the space.
    edge = np.zeros(len(data) + 1, "i1")
    edge[start] += 1
    edge[end] -= 1
    take = np.cumsum(edge[:-1], dtype="i1").astype(bool)
    spaced = data.copy()
    spaced[end[follows]] = 0x20
    take[end[follows]] = True
    size = np.zeros(n_texts, "i8")
    np.add.at(size, text, end - start + follows)
    return packed(spaced[take], size)


def highest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equals the first. Null without runs."""

    def better(best: Column, r: Column) -> Column:
        ahead = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | ahead, r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(_RUN), better)
