import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import queries, word_runs


def slow_runs(words, exponent=4, shortest=6):
    """Every stretch and period by comparing words."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = 0
        for i, s in enumerate(same):
            if not s:
                length = i - start + q
                if i > start and length >= max(shortest, exponent * q):
                    found.setdefault((start, length), q)
                start = i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def random_text(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    words = [rng.choice(["x", "yy", "z"]) for _ in range(rng.randrange(10))]
    for _ in range(rng.randrange(1, 4)):
        block = [rng.choice(["x", "yy", "p", "Q"]) for _ in range(rng.randrange(1, 40))]
        words += (block * 12)[: rng.randrange(len(block) * 12)]
        words += [rng.choice(["x", "r", "s"]) for _ in range(rng.randrange(6))]
    return words


def test_every_difference_has_a_pair_in_the_cover():
    assert word_runs.SHIFT.max() < word_runs.V
    differences = {(a - b) % word_runs.V for a in word_runs.COVER.tolist() for b in word_runs.COVER.tolist()}
    assert differences == set(range(word_runs.V))


def test_extensions_over_many_blocks():
    rng = np.random.default_rng(5)
    body = np.concatenate([np.tile(rng.integers(0, 9, 50), 9), rng.integers(0, 2, 300), np.zeros(400, "i8")])
    fence = np.arange(word_runs.V)
    x = np.concatenate([-1 - fence, body, -100 - fence])
    sorted_ = word_runs.Suffixes(x)
    for _ in range(300):
        i, j = sorted(rng.integers(word_runs.V, len(body), 2))
        if i == j:
            continue
        n = 0
        while x[i + n] == x[j + n]:
            n += 1
        if n >= word_runs.V:
            assert word_runs._far(x, np.array([i]), np.array([j]), sorted_)[0] == n


def test_runs_and_collapsed_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(random_text(rng)) for _ in range(400)]
    texts += [None, "", " \n ", "a", "a " * 5, "a\ta a\na  a a ", " lead a a a a a a", "é é é é é é é", "a" * 9000]
    texts += ["w " * 4000, " ".join(f"{i % 700}" for i in range(4000)), " ".join(map(str, range(3000)))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    df = df.selectExpr("*", "1 AS RUNS", "i AS collapsed_")
    rows = word_runs.mark(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = slow_runs(words)
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == slow_collapsed(words, want)


def test_empty_table(spark):
    assert word_runs.mark(spark.createDataFrame([], "text string")).count() == 0


def test_highest_breaks_ties_by_start(spark):
    df = spark.sql("SELECT array(named_struct('start', 3L, 'length', 9L, 'period', 2L),"
                   " named_struct('start', 5L, 'length', 18L, 'period', 4L)) AS r")  # fmt: skip
    assert df.select(word_runs.highest(F.col("r")).alias("b")).first().b.start == 3


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(slow_collapsed(words, runs)))


@pytest.mark.parametrize("extra", [[], [(None, "a a a a a a"), (None, None)]])
def test_query(spark, tmp_path, extra):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(["", None, "b " * 30])] + extra
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op13_word_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((d, *slow_row(d, t))) for d, t in rows)
