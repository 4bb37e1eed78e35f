import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from litspark.llm import jaccard_join as j


def shingle_set(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else []))


def brute(rows, size, threshold):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and len(x & y) >= threshold * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, pool, n):
    words = list(words)
    for _ in range(n):
        k = random.randrange(len(words))
        words[k : k + random.choice([0, 1, 1])] = [random.choice(pool)]
    return words


def corpus():
    random.seed(5)
    pool = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(25):
        base = [random.choice(pool) for _ in range(random.choice([3, 4, 5, 8, 12, 20, 40, 100, 300]))]
        for _ in range(random.choice([1, 2, 10])):
            changes = random.choice([0, 0, 1, 2, len(base) // 50, len(base) // 30])
            rows.append((len(rows), random.choice([" ", "\n"]).join(edited(base, pool, changes))))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a " * 3000)]


@pytest.mark.parametrize("size, threshold", [(4, Fraction(85, 100)), (5, Fraction(8, 10))])
def test_against_brute_force(documents, size, threshold):
    rows = corpus()
    found = j.link(documents(rows, "1 AS component_id"), size=size, threshold=threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, size, threshold)


def test_many_rounds_of_pivots(documents, monkeypatch):
    """A family in which most pairs just miss the threshold."""
    random.seed(2)
    monkeypatch.setattr(j, "PIVOTS", 3)
    monkeypatch.setattr(j, "MOST_PIVOTS", 5)
    pool = [f"w{i}" for i in range(900)]
    base = [random.choice(pool) for _ in range(60)]
    rows = [(i, " ".join(edited(base, pool, 2))) for i in range(40)]
    found = j.link(documents(rows), size=4, threshold=Fraction(85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 4, Fraction(85, 100))


def test_similar_sets_share_a_key():
    """The pigeonhole bound, on random pairs at the threshold, small sets included."""
    rng = np.random.default_rng(1)
    for threshold in (Fraction(85, 100), Fraction(1, 2)):
        bands = j.Bands(threshold, 5000)
        for _ in range(300):
            n = int(rng.integers(1, 60) if rng.random() < 0.7 else rng.integers(60, 3000))
            a = rng.integers(0, 2**63, n).astype("u8")
            gone = int(rng.integers(0, n + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, n + 1))).astype("u8")])
            shared = n - gone
            if not len(b) or shared < threshold * (n + len(b) - shared):
                continue
            sets = [np.unique(a), np.unique(b)]
            first = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            keys, count = j.keys_of(np.concatenate(sets), first, bands)
            assert np.intersect1d(keys[: count[0]], keys[count[0] :]).size
            x, y = j.parity_sketches(np.concatenate(sets), first)
            differ = len(np.setxor1d(*sets))
            column = j._Sketches(pa.array([x, y], pa.binary()))
            assert column.distance(np.array([0]), np.array([1]))[0] <= differ


def test_repeated_rows_null_ids_and_empty_table(documents):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")]
    found = sorted((tuple(r) for r in j.link(documents(rows)).collect()), key=str)
    assert found == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, None)]
    assert j.link(documents(rows).limit(0)).count() == 0


def test_one_of_each_keeps_columns(documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (4, None)], "'en' AS lang")
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_rows_without_an_id_are_returned(spark, documents):
    rows = [(None, "a b c d e f"), (None, "x"), (4, "a b c d e f"), (9, "a b c d e f"), (7, None)]
    found = sorted(map(tuple, j.link(documents(rows), size=4).collect()), key=str)
    assert found == sorted([(None, 3, None), (None, 1, None), (4, 3, 4), (9, 3, 4), (7, 0, 7)], key=str)
