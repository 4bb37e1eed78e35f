"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that stand inside no token of the vocabulary are parted in every encoding.
A text is cut at such pairs, distinct fragments are encoded once each, and the ids of the
fragments are joined in order. Two further conditions keep the word splitter that runs before the
merges from seeing a cut: the pair is either (a byte that surely ends a visible character, white
space) or (ASCII letter, one of a few marks), and the splitter ends a piece at both in any context.

Ids are carried as little-endian unsigned 32-bit integers in one binary value per text, as they are
stored for training.

Cases: null and empty texts have no ids and decode to an empty text. Texts of any length are taken
whole; a text without cuts is one fragment. Other columns pass through unchanged; a column of the
output's name is replaced.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.arrays import Texts, pieces, ragged, strong_hash, strong_sums, texts

CACHE_BYTES = 32 << 20
SPACE = (9, 10, 11, 12, 13, 32)
MARKS = b",.;:!?()\""


def token_bytes(model: dict) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; special tokens stand for their own text."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    known = {i: bytes(byte_of[c] for c in token) for token, i in model["model"]["vocab"].items()}
    known |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [known.get(i, b"") for i in range(max(known) + 1)]


def forced_pairs(model: dict) -> np.ndarray:
    """Table ``[left, right]`` of byte pairs where every text can be cut."""
    inside = np.zeros((256, 256), bool)
    for token in token_bytes(model):
        inside[list(token[:-1]), list(token[1:])] = True
    pairs = np.zeros((256, 256), bool)
    added = model["added_tokens"]
    plain = model["normalizer"] is None and not model["pre_tokenizer"]["add_prefix_space"]
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return pairs
    # Left of white space: ASCII bytes that are no white space by any rule, and bytes from 0x80
    # (the last of a character; ``cuts`` leaves out those whose character could be white space).
    left = [b for b in range(256) if b not in SPACE and not 0x1C <= b <= 0x1F and b != 0x7F]
    pairs[np.ix_(left, SPACE)] = True
    letters = [*range(65, 91), *range(97, 123)]
    pairs[np.ix_(letters, list(MARKS))] = True
    return pairs & ~inside


def cuts(t: Texts, pairs: np.ndarray) -> np.ndarray:
    """Places in ``t.data`` where a fragment begins, text starts included."""
    d = t.data
    cut = np.zeros(len(d) + 1, bool)
    if len(d) > 1:
        cut[1:-1] = pairs[d[:-1], d[1:]]
        # A byte from 0x80 is let through only as the second of two with lead C3 to DF:
        # those characters hold no white space.
        wide = np.flatnonzero(cut[:-1] & (np.concatenate([[0], d[:-1]]) >= 0x80))
        lead = np.where(wide >= 2, d[np.maximum(wide - 2, 0)], 0)
        cut[wide[(lead < 0xC3) | (lead > 0xDF)]] = False
    cut[t.start] = True
    return np.flatnonzero(cut[: len(d)])


class _Encoder:
    """Encodes slices of rows; keeps the ids of fragments seen before, up to a bound."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        model = json.loads(source)
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pairs = forced_pairs(model)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, "u8")  # sorted hashes of fragments
        self.slot = np.zeros(0, "i8")  # of each: its place in start and count
        self.start = np.zeros(0, "i8")
        self.count = np.zeros(0, "i8")
        self.ids = np.zeros(0, "u4")

    def _learn(self, keys: np.ndarray, fragments: list[bytes]) -> None:
        if self.ids.nbytes + 40 * len(self.keys) > CACHE_BYTES:
            self.forget()
        found = self.tokenizer.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)
        ids = [np.array(e.ids, "u4") for e in found]
        count = np.array([len(i) for i in ids], "i8")
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *ids])
        slot = len(self.start) + np.arange(len(keys))
        self.start, self.count = np.append(self.start, start), np.append(self.count, count)
        every, slots = np.append(self.keys, keys), np.append(self.slot, slot)
        order = np.argsort(every, kind="stable")
        self.keys, self.slot = every[order], slots[order]

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        start = cuts(t, self.pairs)
        if not len(start):
            return np.zeros(0, "u4"), np.zeros(len(t.start), "i8")
        end = np.append(start[1:], len(t.data))
        keys = strong_hash(strong_sums(t.data), start, end)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.keys, assume_unique=True)
        if self.ids.nbytes + 40 * (len(self.keys) + len(distinct)) > CACHE_BYTES:
            self.forget()
            new[:] = True
        if new.any():
            at = first[new]
            self._learn(distinct[new], [t.data[a:b].tobytes() for a, b in zip(start[at], end[at])])
        slot = self.slot[np.searchsorted(self.keys, distinct)][inverse]
        count = self.count[slot]
        ids = self.ids[ragged(self.start[slot], count)]
        of_fragment = np.concatenate([[0], np.cumsum(count)])
        at = of_fragment[np.searchsorted(start, np.append(t.start, len(t.data)))]
        return ids, np.diff(at)


def _replace(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, f in enumerate(batch.schema) if f.name.lower() != name.lower()]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in keep), column],
        schema=pa.schema([*(batch.schema.field(i) for i in keep), pa.field(name, column.type)]),
    )


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    return T.StructType([*fields, T.StructField(name, kind)])


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds the ids of each whole text as packed little-endian 32-bit integers.

    ``tokenizer`` is the path of a tokenizer file, read once by the driver; its size is that of
    a vocabulary and doesn't depend on the data.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _Encoder(source.value)
        for piece in pieces(batches, text, 1 << 20):
            t = texts(piece.column(piece.schema.get_field_index(text)))
            ids, counts = encoder.encode(_close(t))
            yield _replace(piece, out, _binary(ids.astype("<u4").tobytes(), counts * 4))

    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))


def _close(t: Texts) -> Texts:
    """The same texts without bytes that belong to none (a null may leave some)."""
    size = t.end - t.start
    if int(size.sum()) == len(t.data):
        return t
    ends = np.cumsum(size)
    return Texts(t.data[ragged(t.start, size)], ends - size, ends)


def decode(df: DataFrame, tokenizer: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; special tokens are written out, broken UTF-8 is replaced."""
    with open(tokenizer, encoding="utf-8") as f:
        tokens = token_bytes(json.load(f))
    sizes = np.array([len(x) for x in tokens], "i8")
    table = df.sparkSession.sparkContext.broadcast((b"".join(tokens), sizes, np.cumsum(sizes) - sizes))

    def run(batches):
        data, size, start = table.value
        data = np.frombuffer(data, "u1")
        for piece in pieces(batches, ids, 1 << 20):
            packed = _close(texts(piece.column(piece.schema.get_field_index(ids))))
            flat = np.frombuffer(packed.data.tobytes(), "<u4").astype("i8")
            # Ids outside the vocabulary stand for nothing, as in the library.
            flat = np.where(flat < len(size), flat, len(size))
            known = flat < len(size)
            n_bytes = np.where(known, size[np.where(known, flat, 0)], 0)
            out_bytes = data[ragged(start[np.where(known, flat, 0)], n_bytes)]
            ends = np.concatenate([[0], np.cumsum(n_bytes)])
            first = ends[np.append(packed.start, packed.end[-1:]) // 4]
            raw = _binary(out_bytes.tobytes(), np.diff(first))
            try:
                decoded = raw.cast(pa.string())
            except pa.ArrowInvalid:
                decoded = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
            yield _replace(piece, out, decoded)

    return df.mapInArrow(run, _schema(df, out, T.StringType()))


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")

