"""Arrow text columns as numpy arrays: bytes, words and 64-bit hashes, without a loop per word.

All functions take and give whole texts. Work arrays that need several bytes per byte of text
are made block by block, so that memory follows the block and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = int(mix(np.array([12345], "u8"))[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype="u8") * _GOLD)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1), base, "u8")
        steps[0] = 1
        have = np.cumprod(steps, dtype="u8")
        if len(have) <= 4 * BLOCK:
            _POWERS[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hash`` takes the hash of any range of ``data`` (8 bytes a byte)."""
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Quick hash of the bytes of each range, the same for equal bytes wherever they stand.

    For choosing places only: some different ranges have the same.
    """
    moved = _powers(_INVERSE, len(sums))[start]
    return mix((sums[end] - sums[start]) * moved + (end - start).astype("u8") * _GOLD)


# Hashes that decide whether values are equal: polynomials modulo the prime 2**61 - 1 (those modulo
# 2**64 vanish on words like Thue and Morse's, whatever the base).
_PRIME = np.uint64((1 << 61) - 1)
_TOP, _LOW29, _LOW32 = np.uint64(61), np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1)
_B29, _B32, _B3 = np.uint64(29), np.uint64(32), np.uint64(3)
_ROOT = int(mix(np.array([987654321], "u8"))[0] & _PRIME)
_CHUNK = 1 << 21
_TABLES: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _TOP)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """``x * 2**32`` for ``x`` below the prime; less than 2**62."""
    return ((x & _LOW29) << _B32) + (x >> _B29)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime."""
    a1, a0, b1, b0 = a >> _B32, a & _LOW32, b >> _B32, b & _LOW32
    low = a0 * b0
    return _reduced(((a1 * b1) << _B3) + _shifted(_reduced(a1 * b0 + a0 * b1)) + (low & _PRIME) + (low >> _TOP))


def _table(root: int, n: int) -> np.ndarray:
    """``root ** i`` modulo the prime for ``i < n``."""
    have = _TABLES.get(root, np.ones(1, "u8"))
    while len(have) < n:
        step = pow(root, len(have), int(_PRIME))
        have = np.concatenate([have, _times(have, np.full(len(have), step, "u8"))])
        if len(have) <= 4 * BLOCK:
            _TABLES[root] = have
    return have[:n]


def _summed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sums of ``high * 2**32 + low`` modulo the prime over all beginnings; both parts below 2**42."""
    out = np.zeros(len(high) + 1, "u8")
    carry = np.uint64(0)
    for at in range(0, len(high), _CHUNK):
        part = slice(at, at + _CHUNK)
        h, lo = np.cumsum(high[part], dtype="u8"), np.cumsum(low[part], dtype="u8")
        sums = _reduced(_shifted(_reduced(h)) + _reduced(lo) + carry)
        out[at + 1 : at + 1 + len(sums)] = sums
        carry = sums[-1]
    return out


def strong_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``strong_hash`` takes the hash of any range of bytes."""
    power = _table(_ROOT, len(data))
    byte = data.astype("u8") + np.uint64(1)
    return _summed(byte * (power >> _B32), byte * (power & _LOW32))


def strong_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range, the same for equal ranges wherever they stand."""
    back = _table(pow(_ROOT, -1, int(_PRIME)), len(sums))[start]
    found = _times(_reduced(sums[end] + (_PRIME - sums[start])), back)
    return mix(found + (end - start).astype("u8") * _GOLD)


def ordered_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of a sequence of 64-bit values, in order."""
    terms = _times(_reduced(mix(values + _GOLD)), _table(_ROOT, len(values)))
    return strong_hash(_summed(terms >> _B32, terms & _LOW32), start, end)


class Texts(NamedTuple):
    """Bytes of all texts, and where each begins and ends; null texts are empty."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Texts of an Arrow string or binary column, sharing its memory."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return Texts(np.zeros(0, "u1"), np.zeros(n, "i8"), np.zeros(n, "i8"))
    offsets = np.frombuffer(offsets, "i8" if wide else "i4")
    offsets = offsets[column.offset : column.offset + n + 1].astype("i8")
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    start, end = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        end[null] = start[null]
    return Texts(data, start, end)


def pieces(batches, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        t = texts(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(t.end, t.start[at] + size, "right"))
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32

# Bytes that part words, as stated by the contracts of the queries.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Words(NamedTuple):
    """Words of all texts in order: hash, range of bytes, and the first word of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def words(t: Texts, gaps: np.ndarray = SPACES, hashed: bool = True) -> Words:
    """Words of each text: longest runs of bytes outside ``gaps``, A-Z lower-cased for the hash.

    Where only the places are wanted, ``hashed`` saves the hashes: there are none.
    """
    n = len(t.data)
    begins = np.zeros(n + 1, bool)
    full = t.end > t.start
    begins[t.start[full]] = True
    begins[t.end[full]] = True
    used = None
    if full.any() and int((t.end - t.start).sum()) < n:
        depth = np.zeros(n + 1, "i4")
        np.add.at(depth, t.start[full], 1)
        np.add.at(depth, t.end[full], -1)
        used = np.cumsum(depth)[:n] > 0
    hashes, starts, ends, at = [], [], [], 0
    while at < n:
        to = min(at + BLOCK, n)
        # A block ends at a gap or a text's end, so that no word is cut.
        while to < n and not (begins[to] or gaps[LOWER[t.data[to]]]):
            stop = min(to + BLOCK, n)
            ahead = np.flatnonzero(begins[to:stop] | gaps[LOWER[t.data[to:stop]]])
            to = to + int(ahead[0]) if len(ahead) else stop
        low = LOWER[t.data[at:to]]
        inside = ~gaps[low]
        if used is not None:
            inside &= used[at:to]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | begins[at + 1 : to]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begins[at + 1 : to]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(strong_hash(strong_sums(low), a, b) if hashed else np.zeros(0, "u8"))
        starts.append(a + at)
        ends.append(b + at)
        at = to
    if not hashes:
        none = np.zeros(0, "i8")
        return Words(np.zeros(0, "u8"), none, none, np.zeros(len(t.start) + 1, "i8"))
    start = np.concatenate(starts)
    first = np.searchsorted(start, np.append(t.start, n)).astype("i8")
    return Words(np.concatenate(hashes), start, np.concatenate(ends), first)


def shingles(w: Words, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and the first run of each text.

    With ``whole`` a text of fewer words, but not none, has one: all its words.
    """
    start, end, first = _runs(w.first, size, whole)
    return ordered_hash(w.hash, start, end), first


def _runs(first_word: np.ndarray, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and end of every run of ``size`` words, and the first run of each text."""
    n_words = np.diff(first_word)
    counts = np.maximum(n_words - size + 1, 0)
    if whole:
        counts = np.where((n_words > 0) & (counts == 0), 1, counts)
    first = np.concatenate([[0], np.cumsum(counts)]).astype("i8")
    text = np.repeat(np.arange(len(counts)), counts)
    start = first_word[:-1][text] + (np.arange(first[-1]) - first[:-1][text])
    return start, np.minimum(start + size, first_word[1:][text]), first


def coded_shingles(given: list[tuple[Texts, Words]], size: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Numbers of the shingles of several columns of texts and each text's first one; how many differ.

    Equal shingles, and no others, have the same number: words are told apart by their bytes (A-Z
    lower-cased), shingles by the numbers of their words. For slices of texts at a time.
    """
    base = np.cumsum([0, *(len(t.data) for t, _ in given)])
    n = sum(len(w.start) for _, w in given)
    # The bytes between words are entries too, so that the offsets go through the texts as they are.
    offsets = np.empty((n, 2), "i8")
    offsets[:, 0] = np.concatenate([w.start + b for (_, w), b in zip(given, base)])
    offsets[:, 1] = np.concatenate([w.end + b for (_, w), b in zip(given, base)])
    data = LOWER[np.concatenate([t.data for t, _ in given])]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    number = np.zeros(0, "i4")
    if n:
        entries = pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, buffers)
        number = entries.dictionary_encode().indices.to_numpy()[::2].astype("i4")
    runs, at = [], 0
    for _, w in given:
        start, _, first = _runs(w.first, size, False)
        runs.append((start + at, first))
        at += len(w.start)
    start = np.concatenate([r for r, _ in runs])
    if not len(start):
        return [(r, first) for r, first in runs], 0
    rows = np.ascontiguousarray(number[start[:, None] + np.arange(size)])
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), len(rows), [None, pa.py_buffer(rows)])
    coded = packed.dictionary_encode()
    codes, ends = coded.indices.to_numpy().astype("i8"), np.cumsum([0, *(len(r) for r, _ in runs)])
    return [(codes[a:b], first) for (_, first), a, b in zip(runs, ends, ends[1:])], len(coded.dictionary)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` (``count[i]`` of them) for all ``i``, joined."""
    ends = np.cumsum(count)
    out = np.ones(int(ends[-1]) if len(ends) else 0, "i8")
    if not len(out):
        return out
    keep = count > 0
    start, count, at = start[keep], count[keep], (ends - count)[keep]
    out[0] = start[0]
    out[at[1:]] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(out)


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
