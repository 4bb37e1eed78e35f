"""Words of Arrow texts told apart by their bytes: no hash decides which are equal."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from litspark.llm.arrays import SPACES, Texts, ragged, texts


def close(t: Texts) -> Texts:
    """The same texts side by side, without bytes that belong to none (a null may leave some)."""
    size = t.end - t.start
    if int(size.sum()) == len(t.data):
        return t
    ends = np.cumsum(size)
    return Texts(t.data[ragged(t.start, size)], ends - size, ends)


def column_texts(batch: pa.RecordBatch, name: str) -> Texts:
    return close(texts(batch.column(batch.schema.get_field_index(name))))


class Spans(NamedTuple):
    """Words of all texts in order: where they begin and end, the first word of each text (and one
    more entry: the number of words), and which bytes lie in words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    inside: np.ndarray


def word_spans(t: Texts, gaps: np.ndarray = SPACES, cut: np.ndarray | None = None) -> Spans:
    """Longest runs of bytes outside ``gaps`` within each text; ``t`` as ``close`` gives it.

    Where ``cut`` is true at a byte, a word begins there also without a gap before it.
    """
    n = len(t.data)
    inside = ~gaps[t.data]
    begins = np.zeros(n + 1, bool)
    begins[t.start] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | begins[1:n]
        last[:-1] &= ~inside[1:] | begins[1:n]
    if cut is not None and n:
        own = cut[1:] & inside[1:] & inside[:-1]
        first[1:] |= own
        last[:-1] |= own
    start = np.flatnonzero(first)
    at = np.searchsorted(start, np.append(t.start, n)).astype("i8")
    return Spans(start, np.flatnonzero(last) + 1, at, inside)


def byte_array(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``data`` cut into values of the given sizes."""
    offsets = np.zeros(len(sizes) + 1, "i8")
    np.cumsum(sizes, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers)


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value among the distinct ones, and those, in the order they are met."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def word_codes(data: np.ndarray, words: Spans) -> tuple[np.ndarray, pa.Array]:
    """``coded`` of the words of ``data`` (bytes that may have been lower-cased)."""
    return coded(byte_array(data[words.inside], words.end - words.start))


def packed(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary column of values of the given sizes in bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)
