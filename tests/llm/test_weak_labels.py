import numpy as np
import pytest

from litspark.llm import weak_labels as w


@pytest.fixture(scope="module")
def judged(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS KEEP")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    # The lists come from the odd ids; the even ones are held out.
    out = w.classify(docs, labels.where("doc_id % 2 = 1")).select("doc_id", "keep", "score")
    return out.join(labels, "doc_id").collect()


def test_held_out_accuracy(judged):
    held = [r for r in judged if r.doc_id % 2 == 0]
    bad = [r for r in held if r.toxic or not r.quality]
    good = [r for r in held if not r.toxic and r.quality]
    assert len(bad) > 30 and len(good) > 100
    assert sum(r.keep for r in bad) <= 0.1 * len(bad)
    assert sum(not r.keep for r in good) <= 0.04 * len(good)


def test_expectation_maximisation_finds_the_better_labeller():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) for right in (0.95, 0.9, 0.65)], axis=1)
    votes = np.where(rng.random(votes.shape) < 0.1, w.NONE, votes).astype("i1")
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    posterior = {p.tobytes(): x for p, x in zip(patterns, w.accuracies(patterns, times.astype(float)))}
    guess = np.array([posterior[v.tobytes()] > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.93
    assert posterior[np.array([1, 1, 0], "i1").tobytes()] > 0.9


def test_odd_texts_and_no_labels(spark, documents):
    rows = [(1, None), (2, ""), (3, "word"), (4, "spam " * 5000), (4, "spam " * 5000), (None, "clean words stand here, again.")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = w.classify(documents(rows, "2 AS SCORE"), none)
    assert out.columns == ["doc_id", "text", "score", "keep"]
    assert sorted(((r.doc_id, r.keep) for r in out.collect()), key=str)[:2] == [(1, True), (2, True)]
    assert w.classify(documents(rows).limit(0), none).count() == 0
