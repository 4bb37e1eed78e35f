"""Phrases that occur often, counted exactly in quotient filters, and collocations among them.

Texts are laid out in blocks of one language, words numbered within the block. Then the lengths
1, 2, ... are counted one after another, and a phrase can only be frequent if the two phrases that
are left without its last and without its first word are:

1. words are counted by an aggregation; frequent ones get a number for the whole table;
2. a frequent phrase of ``k`` words and the one that begins a word later make a key of two numbers,
   which names the phrase of ``k + 1`` words. The key is permuted by an invertible Feistel network,
   and split into a quotient (which filter) and the full remainder (which entry), so nothing is lost
   and every filter gets an equal share, whatever words are frequent. A block's entries, sorted and
   counted, are its filter;
3. the filters of all blocks with one quotient meet in one task and are merged there. Frequent entries
   get a number; every block is told the numbers of its own frequent entries, and of no others.

The number of quotients grows with the table so that a merge holds about ``GROUP`` entries; keys are
read back from quotient and remainder. No dictionary, filter or count passes through the driver.

Cases: null texts are empty; null languages are ``und``; rows count each, repeated ones and null
ids included; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.arrays import LOWER, mix, pieces, texts
from litspark.llm.tokens import close, packed, word_codes, word_spans
from litspark.operators.ordering import with_dense_index
from litspark.operators.selection import top_per_group
from litspark.operators.skew import lookup_join
from litspark.session import materialize

BLOCK = 2 << 20  # bytes of text in a block
HELD = 12 << 20  # bytes of text a task holds, over all languages
GROUP = 1 << 20  # entries in a merge
PLACE = 22  # bits of an entry's number within its filter

# Bytes that end a piece, and bytes that part words.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAPS = ENDS.copy()
GAPS[[0x20, 0x09]] = True

_KEYS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], "u8")


def permute(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Three rounds of a Feistel network over pairs of ``bits``-bit numbers."""
    mask = np.uint64((1 << bits) - 1)
    a = a ^ (mix(b ^ _KEYS[0]) & mask)
    b = b ^ (mix(a ^ _KEYS[1]) & mask)
    return a ^ (mix(b ^ _KEYS[2]) & mask), b


def restore(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``permute``."""
    mask = np.uint64((1 << bits) - 1)
    a = a ^ (mix(b ^ _KEYS[2]) & mask)
    b = b ^ (mix(a ^ _KEYS[1]) & mask)
    return a ^ (mix(b ^ _KEYS[0]) & mask), b


def split_key(a: np.ndarray, b: np.ndarray, bits: int, quotient: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient (the upper ``quotient`` bits of the permuted key) and remainder (all others)."""
    a, b = permute(a, b, bits)
    low = np.uint64(bits - quotient)
    return a >> low, ((a & ((np.uint64(1) << low) - np.uint64(1))) << np.uint64(bits)) | b


def join_key(q: np.ndarray, r: np.ndarray, bits: int, quotient: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair of numbers from quotient and remainder."""
    a = (q << np.uint64(bits - quotient)) | (r >> np.uint64(bits))
    return restore(a, r & np.uint64((1 << bits) - 1), bits)


def _text_blocks(batches):
    """Blocks of (language, texts) of about ``BLOCK`` bytes; a longer text is a block."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def give(name):
        size.pop(name)
        return name, pa.concat_arrays(held.pop(name))

    for slice_ in pieces(batches, "text", 1 << 20):
        names = slice_.column(0)
        for name in names.unique().to_pylist():
            chosen = slice_.column(1).filter(pa.compute.equal(names, name))
            held.setdefault(name, []).append(chosen)
            size[name] = size.get(name, 0) + int(np.subtract(*texts(chosen)[:0:-1]).sum())
            if size[name] >= BLOCK:
                yield give(name)
        while sum(size.values()) > HELD:
            yield give(max(size, key=size.get))
    for name in list(held):
        yield give(name)


def _blocks(df: DataFrame, text: str, lang: str) -> DataFrame:
    """One row per block: distinct words, how often they stand there, and the words in order.

    ``tokens`` are places in ``words`` as 32-bit integers, -1 between pieces.
    """
    out = "block bigint, lang string, n_words bigint, words array<string>, counts array<bigint>, tokens binary"
    rows = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for name, column in _text_blocks(batches):
            t = close(texts(column))
            words = word_spans(t, GAPS)
            codes, distinct = word_codes(LOWER[t.data], words)
            n = len(codes)
            if not n:
                continue
            ends = np.concatenate([[0], np.cumsum(ENDS[t.data])])
            fresh = np.zeros(n, bool)
            fresh[1:] = ends[words.start[1:]] > ends[words.end[:-1]]
            fresh[words.first[:-1][np.diff(words.first) > 0]] = True
            fresh[0] = False
            tokens = np.full(n + int(fresh.sum()), -1, "i4")
            tokens[np.arange(n) + np.cumsum(fresh)] = codes
            counts = np.bincount(codes, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([name]),
                    pa.array([n]),
                    pa.array([distinct.cast(pa.large_string()).to_pylist()], pa.list_(pa.string())),
                    pa.array([counts], pa.list_(pa.int64())),
                    packed(tokens.view("u1"), np.array([tokens.nbytes])),
                ],
                names=["block", "lang", "n_words", "words", "counts", "tokens"],
            )
            number += 1

    return rows.mapInArrow(run, out)


_STATE = "block bigint, grams binary, ids binary, n_valid bigint"


def _arrays(batch: pa.RecordBatch, name: str, kind: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    return [np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.zeros(0, kind) for v in column]


def _one(names: list[str], **values) -> pa.RecordBatch:
    """A row; arrays become binary values."""
    cells = [values[n].tobytes() if isinstance(values[n], np.ndarray) else values[n] for n in names]
    kinds = [pa.binary() if isinstance(c, bytes) else pa.int64() for c in cells]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)


def _pairs(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys within a block of a phrase and the next one, and where they stand."""
    at = np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0))
    return (grams[at].astype("u8") << np.uint64(32)) | grams[at + 1].astype("u8"), at


def _renamed(block: int, grams: np.ndarray, local: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """State of a block of which the phrases ``local`` are frequent; only those keep a number."""
    top = max(int(grams.max(initial=-1)), int(local.max(initial=-1))) + 2
    order = np.full(top, -1, "i4")
    order[local] = np.arange(len(local))
    grams = order[grams]  # -1 takes the last entry, which is -1
    valid = int(((grams[:-1] >= 0) & (grams[1:] >= 0)).sum()) if len(grams) else 0
    return _one(["block", "grams", "ids", "n_valid"], block=block, grams=grams, ids=ids.astype("i8"), n_valid=valid)


def _first_state(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with the numbers of their frequent words."""
    spots = blocks.select("block", "lang", F.posexplode("words").alias("local", "word"))
    known = spots.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block")
    known = known.agg(F.collect_list(F.struct("local", "id")).alias("known"))

    def run(batches):
        for batch in batches:
            tokens = _arrays(batch, "tokens", "<i4")
            known = batch.column(batch.schema.get_field_index("known"))
            for i, block in enumerate(batch.column(0).to_pylist()):
                pairs = known[i].values
                local, ids = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                yield _renamed(block, tokens[i], local, ids)

    return blocks.select("block", "tokens").join(known, "block").mapInArrow(run, _STATE)


def _filters(state: DataFrame, bits: int, quotient: int) -> DataFrame:
    """Filters of each block: per quotient the sorted remainders, their counts and local places."""
    names = ["quotient", "block", "rest", "counts", "local"]

    def run(batches):
        for batch in batches:
            every, numbers = _arrays(batch, "grams", "<i4"), _arrays(batch, "ids", "<i8")
            for block, grams, ids in zip(batch.column(0).to_pylist(), every, numbers):
                keys, counts = np.unique(_pairs(grams)[0], return_counts=True)
                ids = ids.astype("u8")
                a, b = ids[(keys >> np.uint64(32)).astype("i8")], ids[(keys & np.uint64(0xFFFFFFFF)).astype("i8")]
                q, rest = split_key(a, b, bits, quotient)
                order = np.lexsort((rest, q))
                q, rest, counts = q[order], rest[order], counts[order].astype("u4")
                cut = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else []
                for x, y in zip(cut, [*cut[1:], len(q)]):
                    yield _one(names, quotient=int(q[x]), block=block, rest=rest[x:y], counts=counts[x:y],
                               local=order[x:y].astype("u4"))

    return state.mapInArrow(run, "quotient bigint, block bigint, rest binary, counts binary, local binary")


def _merged(filters: DataFrame, least: int, tell: bool) -> DataFrame:
    """Frequent entries of each quotient (``block`` is null), and for each block its own of them."""
    names = ["quotient", "block", "rest", "counts", "local", "ids"]

    def merge(q, rows):
        rest = np.concatenate([r[1] for r in rows])
        counts = np.concatenate([r[2] for r in rows]).astype("i8")
        order = np.argsort(rest, kind="stable")
        ranked = rest[order]
        begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        total = np.add.reduceat(counts[order], begin)
        often = total >= least
        found, total = ranked[begin][often], total[often]
        if not len(found):
            return
        if len(found) >> PLACE:
            raise OverflowError("a filter holds more entries than its numbers can tell apart")
        none = np.zeros(0, "i8")
        yield _one(names, quotient=q, block=None, rest=found, counts=total, local=none, ids=none)
        if tell:
            for block, rest, _, local in rows:
                at = np.minimum(np.searchsorted(found, rest), len(found) - 1)
                hit = found[at] == rest
                if hit.any():
                    ids = (np.int64(q) << PLACE) | at[hit]
                    yield _one(names, quotient=q, block=block, rest=none, counts=none, local=local[hit], ids=ids)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            columns = (_arrays(batch, n, k) for n, k in (("rest", "<u8"), ("counts", "<u4"), ("local", "<u4")))
            for q, *row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *columns):
                if q != now:
                    if rows:
                        yield from merge(now, rows)
                    now, rows = q, []
                rows.append(row)
        if rows:
            yield from merge(now, rows)

    sorted_ = filters.repartition("quotient").sortWithinPartitions("quotient")
    return sorted_.mapInArrow(
        run, "quotient bigint, block bigint, rest binary, counts binary, local binary, ids binary"
    )


def _next_state(state: DataFrame, merged: DataFrame) -> DataFrame:
    """Blocks with the numbers of their frequent phrases one word longer."""
    told = merged.where("block IS NOT NULL").groupBy("block")
    told = told.agg(F.collect_list("local").alias("local"), F.collect_list("ids").alias("new_ids"))

    def run(batches):
        for batch in batches:
            every = _arrays(batch, "grams", "<i4")
            lists = [batch.column(batch.schema.get_field_index(n)) for n in ("local", "new_ids")]
            for i, (block, grams) in enumerate(zip(batch.column(0).to_pylist(), every)):
                local, ids = (
                    np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in column[i].values])
                    for column, kind in zip(lists, ("<u4", "<i8"))
                )
                keys, at = _pairs(grams)
                _, place = np.unique(keys, return_inverse=True)
                longer = np.full(len(grams), -1, "i4")
                longer[at] = place
                yield _renamed(block, longer, local.astype("i8"), ids)

    return state.select("block", "grams").join(told, "block").mapInArrow(run, _STATE)


def _entries(merged: DataFrame, bits: int, quotient: int) -> DataFrame:
    """Frequent phrases as rows: number, numbers of the two shorter phrases, occurrences."""

    def run(batches):
        for batch in batches:
            for q, rest, n in zip(
                batch.column(0).to_pylist(), _arrays(batch, "rest", "<u8"), _arrays(batch, "counts", "<i8")
            ):
                a, b = join_key(np.full(len(rest), q, "u8"), rest, bits, quotient)
                ids = (np.int64(q) << PLACE) | np.arange(len(rest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype("i8")) for x in (ids, a, b, n)], names=["id", "a", "b", "n"]
                )

    whole = merged.where("block IS NULL").select("quotient", "rest", "counts")
    return whole.mapInArrow(run, "id bigint, a bigint, b bigint, n bigint")


def count_phrases(df: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang"):
    """Frequent words, a table of frequent phrases per length from 2 to ``longest``, and word totals.

    Words: ``lang, word, n, id``. Phrases: ``id``, the numbers ``a`` and ``b`` of the phrases without
    the last and without the first word, ``n``. Totals: ``lang, n``, all words.
    """
    blocks = materialize(_blocks(df, text, lang))
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    seen = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = seen.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    words = with_dense_index(counted.where(F.col("n") >= least), ["lang", "word"], start=0, name="id")
    state = materialize(_first_state(blocks, words))
    top = words.agg(F.max("id")).first()[0]
    bits = max(int(top or 0).bit_length(), 1)
    tables = []
    for size in range(2, longest + 1):
        valid = state.agg(F.sum("n_valid")).first()[0] or 0
        quotient = max(min((valid // GROUP).bit_length(), bits), 2 * bits - 64)
        merged = materialize(_merged(_filters(state, bits, quotient), least, tell=size < longest))
        tables.append(materialize(_entries(merged, bits, quotient)))
        if size < longest:
            state = materialize(_next_state(state, merged))
            bits = max(quotient + PLACE, 1)
    return words, tables, totals


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """``floor(2000000 * a / (l + r))``, exactly."""
    wide = [c.cast("decimal(20,0)") for c in (a, l, r)]
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide[0], wide[1] + wide[2])


def collocations(df: DataFrame, first: int = 2000, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``first`` phrases of 2 to 4 words of each language by score.

    A phrase of at least ``least`` occurrences ``a`` is scored at each cut into two parts of ``l`` and
    ``r`` occurrences by ``floor(2000000 * a / (l + r))``; the cut of the lowest score counts, the first
    of equals. It is dropped if a longer one that holds it has 80 of 100 of its occurrences. (That a
    phrase one word longer is looked at is enough: it occurs no less than any that holds it.)
    """
    words, (two, three, four), totals = count_phrases(df, 4, least, text, lang)

    def met(pairs, shorter, fields):
        """Fields of the two shorter phrases of each pair, as ``a_...`` and ``b_...``."""
        for side in ("a", "b"):
            right = shorter.select(F.col("id").alias(side), *[F.col(f).alias(f"{side}_{f}") for f in fields])
            pairs = lookup_join(pairs, right, side, how="inner")
        return pairs

    def cut(k, l, r):  # noqa: E741
        return F.struct(_score(F.col("n"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"),
                        F.col(l).alias("l"), F.col(r).alias("r"))

    def parts(of, *cuts, **more):
        best = F.array_min(F.array(*(cut(k, *c) for k, c in enumerate(cuts, 1))))
        last = "b_word" if of is two else "b_last"
        start = "a_word" if of is two else "a_phrase"
        return [F.col("id"), F.col("a_lang").alias("lang"), F.concat_ws(" ", start, last).alias("phrase"),
                F.col(last).alias("last"), F.col("n"), best.alias("best"),
                *(F.col(c).alias(n) for n, c in more.items())]

    g2 = met(two, words, ["lang", "word", "n"])
    g2 = materialize(g2.select(*parts(two, ("a_n", "b_n"), n_first="a_n", n_last="b_n")))
    g3 = met(three, g2, ["lang", "phrase", "last", "n", "n_first", "n_last"])
    g3 = materialize(
        g3.select(*parts(three, ("a_n_first", "b_n"), ("a_n", "b_n_last"),
                         n_first="a_n_first", n_last="b_n_last", n_head="a_n", n_tail="b_n"))
    )
    g4 = met(four, g3, ["lang", "phrase", "last", "n", "n_first", "n_last", "n_head", "n_tail"])
    g4 = g4.select(*parts(four, ("a_n_first", "b_n"), ("a_n_head", "b_n_tail"), ("a_n", "b_n_last")))

    def undropped(phrases, longer):
        above = longer.select(F.col("a").alias("id"), "n").unionAll(longer.select("b", "n"))
        above = above.groupBy("id").agg(F.max("n").alias("above"))
        share = F.col("above").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * 80
        return phrases.join(above, "id", "left").where(~F.coalesce(share, F.lit(False)))

    shown = ["lang", "phrase", "n", "best"]
    left = undropped(g2, three).select(shown).unionAll(undropped(g3, four).select(shown)).unionAll(g4.select(shown))
    order = [F.desc("best.score"), F.desc("n"), F.col("phrase")]
    top = top_per_group(left, ["lang"], order, first, spread_by="phrase")
    return top.withColumnRenamed("n", "a").join(totals, "lang").select(
        "lang",
        F.col("rank").cast("bigint").alias("rank"),
        "phrase",
        "a",
        F.col("best.l").alias("l"),
        F.col("best.r").alias("r"),
        "n",
        F.col("best.score").cast("bigint").alias("score"),
    )
