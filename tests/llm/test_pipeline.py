import hashlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_decontaminate import brute as windows_brute
from tests.llm.test_jaccard_join import shingle_set

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage on the smallest tables."""
    from litspark.session import materialize

    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, FOLDER))
        assert name == corpus_pipeline.STAGES[-1][0] or after.columns == docs.columns
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_quality_keeps_clean_and_rejects_labelled(spark, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality and not r.toxic]
    assert kept <= {r.doc_id for r in before} and np.mean([i in kept for i in good]) > 0.95


def test_quality_rejects_toxic_documents(spark):
    """At sf0.01, where the word lists have something to learn from."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).select("doc_id").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    toxic = [r.doc_id for r in labels if r.toxic]
    clean = [r.doc_id for r in labels if r.quality and not r.toxic]
    assert len(toxic) > 20 and np.mean([i not in kept for i in toxic]) >= 0.8
    assert np.mean([i in kept for i in clean]) > 0.95


ODD_TEXT = " ".join(f"odd{i}" for i in range(70))


def test_stages_with_odd_rows(spark):
    """Null ids and texts, repeated rows, columns named like an operator's, no ``n_chars``; then no row."""
    rows = [(1, ODD_TEXT), (1, ODD_TEXT), (2, ODD_TEXT + " more"), (3, None), (None, ODD_TEXT), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'s' AS score", "1 AS keep", "2 AS spans", "3 AS items", "4 AS n_words", "5 AS sources", "6 AS Decoded"
    )
    # Each stage on these rows: only the second one drops any; the third cuts the second document.
    want = {"quality": 7, "near_duplicates": 5, "passages": 7, "benchmark": 7, "tokens": 7}
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, FOLDER)
            found = out.collect()
            assert out.columns[: len(docs.columns)] == docs.columns and len(found) == (want[name] if table is docs else 0), name
            assert all((r.score, r.keep, r.spans, r["items"], r.n_words, r.sources, r.Decoded) == ("s", 1, 2, 3, 4, 5, 6) for r in found)
            assert {r.doc_id for r in found} >= ({None, 1, 3, 5} if table is docs else set())
    taken = corpus_pipeline.tokens(spark, docs.selectExpr("*", "7 AS N_TOKENS", "8 AS round_trip"), FOLDER)
    assert sorted(map(str.lower, taken.columns)) == sorted([*map(str.lower, docs.columns), "token_ids", "n_tokens", "round_trip"])
    assert {r.round_trip for r in taken.collect()} == {True}


def test_near_duplicates_against_all_pairs(stages):
    before, after = stages[1]
    sets = [(r.doc_id, shingle_set(r.text, 5)) for r in sorted(before, key=lambda r: r.doc_id)]
    root = {i: i for i, _ in sets}
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and len(x & y) >= Fraction(8, 10) * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id for r in after} == {i for i, v in root.items() if i == v}


def test_passages_cut_every_exact_repeat(stages):
    before, after = stages[2]
    left, seen = {r.doc_id: r.text for r in after}, set()
    for r in sorted(before, key=lambda r: r.doc_id):
        words = r.text.lower().split()
        own = {tuple(words[i : i + 51]) for i in range(len(words) - 50)}
        kept = left.get(r.doc_id, "").lower().split()
        assert not {tuple(kept[i : i + 51]) for i in range(len(kept) - 50)} & seen
        assert own & seen or r.doc_id in left
        seen |= own


def test_benchmark_against_brute_force(spark, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = windows_brute([(r.doc_id, r.text) for r in before], items)
    assert {r.doc_id for r in after} == {i for i, (_, n, _) in hits.items() if not n}


def test_tokens_against_the_library(stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    before, after = stages[4]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    for r in after:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == ids and r.n_tokens == len(ids) and r.round_trip


def test_registered(spark, stages):
    rows = entry.queries()["pipeline"](spark, FOLDER).collect()
    want = {(r.doc_id, hashlib.sha256(bytes(r.token_ids)).digest()) for r in stages[-1][1]}
    assert {(r.doc_id, hashlib.sha256(bytes(r.token_ids)).digest()) for r in rows} == want
    assert "pipeline" not in entry.oracle_sql() and corpus_pipeline.ORACLE_SQL is None
