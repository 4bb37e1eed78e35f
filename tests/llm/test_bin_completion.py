import itertools
import random
import zlib

import numpy as np
import pytest

from litspark.llm import bin_completion as bc
from litspark.llm import queries

tokenizers = pytest.importorskip("tokenizers")
WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")


def counted(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


def check(patterns, counts, capacity):
    """All pieces are held once, no sequence is too long; gives the number of sequences."""
    held = {}
    for often, items in patterns:
        assert often > 0 and sum(s * n for s, n in items) <= capacity
        for s, n in items:
            held[s] = held.get(s, 0) + often * n
    assert held == {s: n for s, n in counts.items() if n}
    return sum(n for n, _ in patterns)


def fewest(sizes, capacity):
    """Fewest sequences by trying everything."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins.index(bins[b]) == b:
                place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_fewest_sequences_on_small_tables():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        patterns = bc.solve(counted(sizes), capacity)
        n = check(patterns, counted(sizes), capacity)
        assert n == fewest(sizes, capacity) >= bc.least_bins(counted(sizes), capacity)


def test_search_beats_best_fit():
    better = 0
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(20, 60) for _ in range(24)]
        counts = counted(sizes)
        a, b = (check(f(counts, 100), counts, 100) for f in (bc.best_fit, bc.solve))
        assert b <= a
        better += b < a
    assert better


def test_large_counts_stay_quick():
    rng = random.Random(6)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 2049)}
    patterns = bc.solve(counts, 2048)
    n = check(patterns, counts, 2048)
    assert n <= bc.least_bins(counts, 2048) * 1.002 and len(patterns) < 20_000


def test_undominated_fillings():
    found = bc.fillings({5: 1, 4: 2, 3: 2, 1: 1}, 8, 8, 100)
    sums = {sum(s * n for s, n in items) for items in found}
    assert sums == {8}
    every = {tuple(sorted(c)) for k in range(6) for c in itertools.combinations([5, 4, 4, 3, 3, 1], k) if sum(c) == 8}
    assert {tuple(sorted(s for s, n in items for _ in range(n))) for items in found} == every


def test_lengths_out_of_bounds():
    with pytest.raises(ValueError):
        bc.solve({11: 1}, 10)


def test_pack_odd_rows(spark):
    rows = [(i, s, None) for i, s in enumerate([5, 5, 5, 10, 1, 1, 9])] + [(None, 3, "x"), (None, 3, "x")]
    df = spark.createDataFrame(rows, "i long, length long, OFFSET string").repartition(3)
    found = bc.pack(df, 10).collect()
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(found) == len(rows) and len(places) == 5
    for group in places.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 10
    assert bc.pack(df.limit(0), 10).count() == 0


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["", None, "  ", "é<|endoftext|>x <|startoftext|>", "don't  we'll\n日本語 ̸x", "a b " * 6000, "a" * 5000]
    rows = [tuple(r) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, docs.schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in queries.QUERIES["op12_bin_completion"](spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append(r)
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    sequences = {}
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(found.pop(doc_id), key=lambda r: r.piece)
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [
            (i, i * 2048, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cut)
        ]
        for r in parts:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not found
    total = 0
    for group in sequences.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        total += at
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_words_are_cut_finer():
    """Marks beside ASCII letters and A-Z make no new words, and the ids stay the library's."""
    import pyarrow as pa

    from litspark.llm.tokens import close, texts

    with open(WORD_BPE, encoding="utf-8") as f:
        source = f.read()
    library, rng = tokenizers.Tokenizer.from_str(source), random.Random(8)
    parts = ["Word", "J̌", "H", "̱", "İ", "İ", ".", ",", "'s", "'S", "'", "!?", "3", "…", "̸", "\0", " ", " ", "Σ", "É"]
    for odd in ([], ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]):
        rows = ["".join(rng.choice(parts + odd) for _ in range(rng.randrange(12))) for _ in range(3000)]
        ids, count = bc._WordEncoder(source).encode(close(texts(pa.array(rows))))
        want = [library.encode(r, add_special_tokens=False).ids for r in rows]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    encoder = bc._WordEncoder(source)
    encoder.encode(close(texts(pa.array(["The the THE the. the, (the; the", ";The.The"]))))
    assert len(encoder.slot) == 5
