"""Hashes against plain arithmetic, and the words on which polynomials modulo 2**64 vanish."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from litspark.llm import arrays, bpe, jaccard_join, queries, repeat_tree


def thue_morse(bits, zero, one):
    return "".join((zero, one)[bin(i).count("1") % 2] for i in range(1 << bits))


def test_sums_modulo_the_prime(monkeypatch):
    monkeypatch.setattr(arrays, "_CHUNK", 7)
    rng = random.Random(1)
    prime = (1 << 61) - 1
    data = np.array([rng.randrange(256) for _ in range(40)], "u1")
    sums = arrays.strong_sums(data).tolist()
    want = [sum((int(b) + 1) * pow(arrays._ROOT, i, prime) for i, b in enumerate(data[:n])) % prime for n in range(41)]
    assert sums == want
    a, b = (np.array([rng.randrange(prime) for _ in range(200)] + [0, prime - 1], "u8") for _ in range(2))
    assert arrays._times(a, b).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b)]


def test_equal_ranges_have_equal_hashes():
    data = np.frombuffer(b"abcabcabc" * 50, "u1")
    start = np.array([0, 3, 6, 1])
    assert len(set(arrays.strong_hash(arrays.strong_sums(data), start, start + 100).tolist())) == 2
    values = data.astype("u8")
    assert len(set(arrays.ordered_hash(values, start, start + 100).tolist())) == 2


def test_thue_morse_words_differ():
    texts = [thue_morse(10, *x) for x in ("01", "10")]
    w = arrays.words(arrays.texts(pa.array(texts)))
    assert len(set(w.hash.tolist())) == 2
    values = np.array([1, 2], "u8")[np.array([bin(i).count("1") % 2 for i in range(1024)])]
    both = np.concatenate([values, values[::-1] if values[-1] != values[0] else 3 - values])
    assert len(set(arrays.ordered_hash(both, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2


def test_repeats_with_nothing_but_a_gap_in_common(spark, documents):
    word, other, gap = thue_morse(6, "#", "0"), thue_morse(6, "0", "#"), "abcdefghijklmnopqrstuvwxyzABCDEF"
    rows = repeat_tree.remove(documents([(1, word + gap + other), (2, other + gap + word)])).collect()
    assert all(not r.spans for r in rows)


def test_single_words_of_different_letters_are_not_linked(spark, documents):
    found = jaccard_join.link(documents([(1, thue_morse(8, "8", "9")), (2, thue_morse(8, "9", "8"))]), size=4, threshold=Fraction(85, 100))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2}


def test_fragments_of_one_batch_keep_their_ids(spark):
    tokenizer = queries.tokenizer_path()
    texts = [thue_morse(10, "a", "b"), thue_morse(10, "b", "a")]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    found = {r.i: r.decoded for r in bpe.decode(bpe.encode(df, tokenizer), tokenizer).collect()}
    assert found == dict(enumerate(texts))
    assert len({hashlib.sha256(t.encode()).hexdigest() for t in found.values()}) == 2


def test_coded_shingles_are_equal_where_their_words_are():
    """Numbers across two columns, with texts that are null, empty, short, of other case or of other gaps."""
    given = [["a b c a B c", None, "", "x", "é\tb  c", " lone "], ["A B C", "ab c a b c", None, "xé b c x", "\n"], []]
    columns = [arrays.texts(pa.array(texts, pa.string())) for texts in given]
    told = [(t, arrays.words(t, hashed=False)) for t in columns]
    coded, n = arrays.coded_shingles(told, 3)
    seen = {}
    for texts, (codes, first) in zip(given, coded):
        wanted = [text.lower().split() if text else [] for text in texts]
        assert np.array_equal(np.diff(first), [max(len(w) - 2, 0) for w in wanted])
        for words, a, b in zip(wanted, first, first[1:]):
            for k, code in enumerate(codes[a:b].tolist()):
                assert seen.setdefault(code, tuple(words[k : k + 3])) == tuple(words[k : k + 3])
    assert len(set(seen.values())) == len(seen) == n
    nothing = arrays.texts(pa.array([None, " "], pa.string()))
    empty, none = arrays.coded_shingles([(nothing, arrays.words(nothing, hashed=False))] * 2, 3)
    assert none == 0 and [len(codes) for codes, _ in empty] == [0, 0]
