"""Best-fit packing of token sequences by bin completion.

Documents become token pieces of at most ``capacity`` tokens, and the pieces are packed into as
few sequences as can be found. How well pieces fit depends on their lengths alone, so the search
runs over the number of pieces of each length (at most ``capacity`` numbers, whatever the table):

1. best fit, longest first, gives the incumbent;
2. if it needs more sequences than the waste bound says, a branch and bound takes the longest
   piece left, enumerates the undominated fillings of the rest of its sequence (none leaves room
   for a piece at hand, or for a longer one in place of a chosen one), takes a filling as often as
   the pieces last, gives up a branch whose waste leaves no better solution, and completes nodes
   by best fit for new incumbents. ``work`` bounds the search (a node counts by the number of
   lengths it has left); the best solution found counts.

The solution is a list of patterns with multiplicities. The pieces of one length are numbered
within their task, tasks are put in order by one small table of counts, and number, pattern and
place follow by arithmetic: no piece meets another one in a task.

Cases: a null or empty text is the end token alone; a longer document is cut every ``capacity``
tokens; rows are packed one by one, repeated ids and null ids included; an empty table gives an
empty table. Columns of the input with the names of the output are replaced.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.arrays import LOWER, pieces, ragged
from litspark.llm.tokens import column_texts, packed, word_codes, word_spans
from litspark.session import materialize

CACHE_WORDS = 600_000
TOGETHER = 500  # words that are encoded in one call
_ENCODERS: dict = {}  # of a Python worker, which runs many tasks
WORK = 40_000
WIDTH = 24
_BITS = 40
# Alternatives of a word splitter that match no white space and look at none.
WORD_PATTERNS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
# Marks that such a splitter parts from an ASCII letter before or after them (no apostrophe: ``'s`` is one).
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how often, and (length, number) of its pieces


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Waste bound: no packing has fewer sequences (the best of the bounds by Martello and Toth)."""
    n = np.zeros(capacity + 2, object if max(counts.values(), default=0) > 1 << 40 else "i8")
    n[list(counts)] = list(counts.values())
    size = np.arange(capacity + 2)
    above = np.cumsum(n[::-1])[::-1]  # pieces of a length or more, and their tokens
    tokens = np.cumsum((n * size)[::-1])[::-1]
    half = capacity // 2
    k = np.arange(half + 1)
    middle = above[half + 1] - above[capacity - k + 1]
    room = middle * capacity - (tokens[half + 1] - tokens[capacity - k + 1])
    small = tokens[k] - tokens[half + 1]
    return int((above[half + 1] + np.maximum(-((room - small) // capacity), 0)).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest first, each into the fullest sequence that takes it; equal sequences go together."""
    rooms: dict[int, list[list]] = {}
    done: list[Pattern] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in rooms if r >= size):
            fit = room // size
            while left and rooms.get(room):
                often, items = rooms[room].pop()
                take = min(often, left // fit)
                rest = left - take * fit if take < often else 0
                if take:
                    rooms.setdefault(room - fit * size, []).append([take, items + ((size, fit),)])
                    left -= take * fit
                if take < often:
                    if rest:
                        rooms.setdefault(room - rest * size, []).append([1, items + ((size, rest),)])
                        left -= rest
                    if often - take - bool(rest):
                        rooms[room].append([often - take - bool(rest), items])
                    break
            if not left:
                break
        if left:
            fit = capacity // size
            if left // fit:
                rooms.setdefault(capacity - fit * size, []).append([left // fit, ((size, fit),)])
            if left % fit:
                rooms.setdefault(capacity - (left % fit) * size, []).append([1, ((size, left % fit),)])
        done += [tuple(p) for p in rooms.pop(0, [])]
    return done + [tuple(p) for group in rooms.values() for p in group]


def fillings(counts: dict[int, int], room: int, waste: int, width: int) -> list[tuple[tuple[int, int], ...]]:
    """Undominated ways to fill ``room`` that waste at most ``waste``, least waste first.

    Longer pieces are tried first; the search stops after ``width`` fillings without waste, or after
    a number of steps that follows from ``width``.
    """
    lengths = [s for s in sorted(counts, reverse=True) if s <= room and counts[s]]
    reach = np.cumsum([s * counts[s] for s in reversed(lengths)])[::-1].tolist() + [0]
    found: list[tuple[int, tuple]] = []
    exact = 0
    steps = 0
    stack = [(0, room, ())]
    while stack and exact < width and steps < 200 * width:
        at, left, items = stack.pop()
        steps += 1
        if left == 0 or at == len(lengths):
            if left <= waste and not _dominated(lengths, counts, items, left):
                found.append((left, items))
                exact += left == 0
            continue
        if left - reach[at] > waste:
            continue
        size = lengths[at]
        for n in range(min(counts[size], left // size) + 1):
            stack.append((at + 1, left - n * size, items + ((size, n),) if n else items))
    return [items for _, items in sorted(found, key=lambda x: x[0])[:width]]


def _dominated(lengths: list[int], counts: dict[int, int], items: tuple, left: int) -> bool:
    """Whether a piece at hand fits into what is left, by itself or in place of a shorter one."""
    if not left:
        return False
    used = dict(items)
    free = [s for s in lengths if counts[s] > used.get(s, 0)]
    if any(s <= left for s in free):
        return True
    return any(size < s <= size + left for size, _ in items for s in free)


def solve(counts: dict[int, int], capacity: int, work: int = WORK, width: int = WIDTH) -> list[Pattern]:
    """Patterns that hold every piece, with as few sequences as found within ``work`` steps."""
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    best = best_fit(counts, capacity)
    size = sum(n for n, _ in best)
    bound = least_bins(counts, capacity)
    stack: list[tuple[dict, int, list[Pattern]]] = [(counts, 0, [])]
    seen = 0
    while stack and size > bound and seen < work:
        left, bins, path = stack.pop()
        seen += len(left)
        rest = sum(s * n for s, n in left.items())
        # Waste that the open part may still have in a solution of size - 1 sequences.
        waste = (size - 1 - bins) * capacity - rest
        if waste < 0 or bins + least_bins(left, capacity) >= size:
            continue
        if path:
            tail = best_fit(left, capacity)
            whole = bins + sum(n for n, _ in tail)
            if whole < size:
                best, size = path + tail, whole
                continue
        top = max(left)
        after = dict(left)
        after[top] -= 1
        for items in reversed(fillings(after, capacity - top, waste, width)):
            chosen = Counter(dict(items))
            chosen[top] += 1
            idle = capacity - sum(s * n for s, n in chosen.items())
            often = min(left[s] // n for s, n in chosen.items())
            if idle:
                often = min(often, waste // idle)
            remain = {s: n - often * chosen.get(s, 0) for s, n in left.items()}
            remain = {s: n for s, n in remain.items() if n}
            pattern = (often, tuple(sorted(chosen.items(), reverse=True)))
            if remain:
                stack.append((remain, bins + often, [*path, pattern]))
            elif bins + often < size:
                best, size = [*path, pattern], bins + often
    return best


class _Places:
    """Arrays that lead from (length, number within the length) to sequence and offset."""

    def __init__(self, patterns: list[Pattern]):
        rows, taken, sequence = [], Counter(), 0
        for often, items in patterns:
            inner = 0
            for size, n in items:
                rows.append((size, taken[size], n, sequence, inner))
                taken[size] += often * n
                inner += size * n
            sequence += often
        rows.sort()
        table = np.array(rows, "i8").reshape(-1, 5)
        self.key = (table[:, 0] << _BITS) | table[:, 1]
        self.begin, self.fit, self.sequence, self.inner = table[:, 1:].T

    def find(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (size << _BITS) | number, "right") - 1
        over = number - self.begin[at]
        sequence = self.sequence[at] + over // self.fit[at]
        return sequence, self.inner[at] + over % self.fit[at] * size


def pack(df: DataFrame, capacity: int, length: str = "length", work: int = WORK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``length`` tokens (1 to ``capacity``, no nulls).

    Sequences are gapless from offset 0. Rows that agree in all columns get places of their own.
    """
    own = [f for f in df.schema.fields if f.name.lower() not in ("sequence_id", "offset")]
    plain = df.select([f"`{f.name}`" for f in own])
    kind = T.StructType([*own, T.StructField("_task", T.IntegerType()), T.StructField("_place", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, "i8")
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            order = np.argsort(size, kind="stable")
            ranked = size[order]
            fresh = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else order
            runs = np.diff(np.append(fresh, len(ranked)))
            place = np.empty(len(size), "i8")
            place[order] = np.arange(len(size)) - np.repeat(fresh, runs)
            place += seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(size), task, "i4")), pa.array(place)],
                names=[*batch.schema.names, "_task", "_place"],
            )

    placed = materialize(plain.mapInArrow(number, kind))
    per_task = materialize(placed.groupBy("_task", F.col(f"`{length}`").alias("_size")).agg(F.count("*").alias("_n")))
    totals = {r["_size"]: r["n"] for r in per_task.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}
    places = df.sparkSession.sparkContext.broadcast(_Places(solve(totals, capacity, work)))
    # One row per task and length; a window of a length has a row per task.
    earlier = Window.partitionBy("_size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_task.select("_task", "_size", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    numbered = placed.withColumn("_size", F.col(f"`{length}`")).join(begins, ["_task", "_size"])
    numbered = numbered.select(*[f"`{f.name}`" for f in own], (F.col("_begin") + F.col("_place")).alias("_number"))
    out = T.StructType([*own, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches):
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype("i8")
            found = places.value.find(size, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, found)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return numbered.mapInArrow(assign, out)


class _WordEncoder:
    """Ids of texts under a tokenizer whose pieces never cross ASCII white space.

    Texts are cut at white space, and every distinct word is encoded by the library once, as long
    as it is among the ``CACHE_WORDS`` last learnt. Where the tokenizer allows it (``finer``), words are
    also cut between ASCII letters and marks, and A-Z are lower-cased, so that fewer are distinct.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fence = self.tokenizer.encode("\0", add_special_tokens=False).ids
        model = json.loads(source)
        self.parts, self.lowers = finer(model)
        self.added = [t["content"].encode().lower() for t in model["added_tokens"]]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u4")

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one by one, and how many each has."""
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        ids = [e.ids for e in found]
        count = np.fromiter(map(len, ids), "i8", len(ids))
        return np.fromiter(chain.from_iterable(ids), "u4", int(count.sum())), count

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same in one call: words without NUL in one text, a NUL between any two of them."""
        joined = b" \0 ".join(words)
        if len(self.fence) != 1 or joined.count(b"\0") != len(words) - 1:
            return self._each(words)
        (found,) = self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)
        ids = np.array(found.ids, "u4")
        apart = ids == self.fence[0]
        if int(apart.sum()) != len(words) - 1:
            return self._each(words)
        ends = np.append(np.flatnonzero(apart), len(ids))
        return ids[~apart], np.diff(ends, prepend=-1) - 1

    def _learn(self, new: list[bytes]) -> None:
        found = [self._together(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
        count = np.concatenate([c for _, c in found])
        self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *(i for i, _ in found)])

    def encode(self, t) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        data, cut = t.data, None
        if self.parts and len(data):
            mark, letter = _MARK[data], _LETTER[data]
            cut = np.append(False, (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1]))
        words = word_spans(t, cut=cut)
        if self.lowers and len(data):
            low = LOWER[data]
            # Before another script's byte a letter stays: it may be composed with an accent.
            plain = np.append(data[1:] < 128, True)
            # Added tokens are told by their case.
            if not any(a in low.tobytes() for a in self.added):
                data = np.where(plain, low, data)
        codes, distinct = word_codes(data, words)
        keys = distinct.to_pylist()
        slots = list(map(self.slot.get, keys))
        new = [k for k, slot in zip(keys, slots) if slot is None]
        if new:
            if len(self.slot) + len(new) > CACHE_WORDS:
                self.forget()
                new = keys
            self._learn(new)
            slots = list(map(self.slot.get, keys))
        slots = np.array(slots, "i8")[codes]
        count = self.count[slots]
        of_word = np.concatenate([[0], np.cumsum(count)])
        return self.ids[ragged(self.begin[slots], count)], np.diff(of_word[words.first])


def white_space_free(model: dict) -> bool:
    """Whether a tokenizer file's words are parted by white space in every text: then encoding
    word by word gives the ids of the whole."""
    splits = model["pre_tokenizer"]["pretokenizers"]
    steps = [n["type"] for n in model["normalizer"]["normalizers"]]
    apart = splits[0]["type"] == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
    local = set(splits[0]["pattern"]["Regex"].split("|")) <= WORD_PATTERNS
    marks = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in model["added_tokens"])
    return apart and local and marks and set(steps) <= {"NFC", "Replace", "Lowercase"} and not any(
        set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in model["added_tokens"]
    )


def finer(model: dict) -> tuple[bool, bool]:
    """Whether words may be cut between ASCII letters and marks too, and whether A-Z may be lower-cased
    before: the ids of a text stay the same."""
    splits = set(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].split("|"))
    steps = model["normalizer"]["normalizers"]
    plain = all(n["pattern"] == {"Regex": r"\s+"} for n in steps if n["type"] == "Replace")
    whole = all(t["content"].isascii() and not set(t["content"]) & set(".,;:!?") for t in model["added_tokens"])
    parts = plain and whole and {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= splits
    return parts, plain and whole and any(n["type"] == "Lowercase" for n in steps)


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, end: int = 0, text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each row's text, ``end`` after the text included.

    ``text`` is replaced by ``piece`` (from 0), ``start`` (ids before it), ``length`` and ``ids``
    (little-endian, 2 bytes an id where the vocabulary allows, else 4). ``tokenizer`` is the path of
    a file, read once by the driver.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    model = json.loads(content)
    if not white_space_free(model):
        raise ValueError(f"{tokenizer}: words are not parted by white space")
    top = max([end, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    wide = "<u2" if top < 1 << 16 else "<u4"
    source = df.sparkSession.sparkContext.broadcast(content)
    names = ("piece", "start", "length", "ids", text.lower())
    own = [f for f in df.schema.fields if f.name.lower() not in names]
    more = "piece int, start bigint, length bigint, ids binary"
    kind = T.StructType([*own, *T.StructType.fromDDL(more).fields])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if source.value not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[source.value] = _WordEncoder(source.value)
        encoder = _ENCODERS[source.value]
        for slice_ in pieces(batches, text, 4 << 20):
            ids, count = encoder.encode(column_texts(slice_, text))
            with_end = np.full(len(ids) + len(count), end, wide)
            with_end[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
            count = count + 1
            n_pieces = -(-count // capacity)
            row = np.repeat(np.arange(len(count)), n_pieces)
            piece = ragged(np.zeros(len(count), "i8"), n_pieces)
            size = np.minimum(count[row] - piece * capacity, capacity)
            kept = slice_.select([f.name for f in own]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    *kept.columns,
                    pa.array(piece.astype("i4")),
                    pa.array(piece * capacity),
                    pa.array(size),
                    packed(with_end, size * with_end.itemsize),
                ],
                names=kind.names,
            )

    return df.select(*[f"`{f.name}`" for f in own], f"`{text}`").mapInArrow(run, kind)


def wide_ids(df: DataFrame, ids: str = "ids", length: str = "length") -> DataFrame:
    """Ids as little-endian unsigned 32-bit integers, whatever width they are kept in."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            t = column_texts(batch, ids)
            size = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            narrow = len(t.data) < 4 * int(size.sum())
            flat = t.data.view("<u2" if narrow else "<u4").astype("<u4")
            yield batch.set_column(at, batch.schema.field(at), packed(flat, size * 4))

    return df.mapInArrow(run, df.schema)
