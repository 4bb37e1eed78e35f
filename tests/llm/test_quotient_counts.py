import re
from collections import Counter

import numpy as np
import pytest

from litspark.llm import quotient_counts as qc
from litspark.llm import queries


def slow_collocations(rows, first=2000, least=30):
    """(lang, rank, phrase, a, l, r, n, score) by dictionaries."""
    counts = {}
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        candidates = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        gone = set()
        for w, c in candidates.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    if 100 * c >= 80 * candidates[w[i : i + k]]:
                        gone.add(w[i : i + k])
        scored = []
        for w, a in candidates.items():
            if w not in gone:
                cuts = [(2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def test_keys_come_back():
    rng = np.random.default_rng(3)
    for bits, quotient in ((1, 0), (1, 1), (17, 5), (32, 0), (33, 3), (45, 26), (60, 56)):
        a, b = (rng.integers(0, 1 << bits, 500, dtype="u8") for _ in range(2))
        q, r = qc.split_key(a, b, bits, quotient)
        assert q.max() < 1 << quotient
        assert all(map(np.array_equal, qc.join_key(q, r, bits, quotient), (a, b)))
        assert len(set(zip(q.tolist(), r.tolist()))) == len(set(zip(a.tolist(), b.tolist())))


CASES = [
    ("en", "The cat sat. the Cat sat, the cat" * 3),
    (None, "a a a a a a a"),
    ("und", "a\ta  a\nb a a\x0bé É;é É"),
    ("en", None),
    ("de", ""),
    ("fr", " . ; "),
    (None, None),
]


@pytest.mark.parametrize("least,first", [(1, 2000), (2, 3), (30, 2000)])
def test_small_cases(spark, least, first):
    df = spark.createDataFrame(CASES, "lang string, text string").repartition(3).selectExpr("*", "1 AS n", "2 AS id")
    found = qc.collocations(df, first, least).collect()
    assert sorted(map(tuple, found)) == slow_collocations(CASES, first, least)


def test_empty_table(spark):
    assert qc.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("group", [qc.GROUP, 500])
def test_query(spark, monkeypatch, group):
    monkeypatch.setattr(qc, "GROUP", group)
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text")
    found = queries.QUERIES["op11_quotient_phrases"](spark, folder).collect()
    assert sorted(map(tuple, found)) == slow_collocations([tuple(r) for r in docs.collect()])
