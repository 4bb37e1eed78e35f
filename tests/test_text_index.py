import random

import pytest
from pyspark.sql import functions as F

from litspark.operators import search, text_index

WORDS = ["a", "b", "c", "dé", "e2"]


@pytest.fixture
def corpus(spark):
    rng = random.Random(8)
    rows = [(i * 7, " ".join(rng.choices(WORDS, k=rng.randrange(12))), rng.choice([None, "b-c a.", "A, a B"])) for i in range(90)]
    rows += [(10**9, None, None), (-5, "", "!"), (3, "x " * 70_000 + "y x", None)]
    return spark.createDataFrame(rows, "id long, title string, abstract string").repartition(4)


QUERIES = ["a", '"a b"', "a -b", "-a", '"b c a" | "dé e2"', "(a | c) -(b + e2)", '"a a"', "zz", "zz | y", '"x y x"', "a + -zz", '"A - b"']



def test_same_rows_as_the_scan(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    text_index.build(corpus, path, "id")
    queries = {str(i): q for i, q in enumerate(QUERIES)}
    rows = text_index.row_ids(spark, path, text_index.search_index(spark, path, queries)).collect()
    for name, query in queries.items():
        want = sorted(r.id for r in search.keyword_filter(corpus, query).collect())
        assert sorted(r.id for r in rows if r.query == name) == want, query


def test_only_the_words_asked_for_are_read(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    text_index.build(corpus, path, "id")
    blocks = text_index.blocks_of(spark, path, ["b"])
    files = {r.f.rsplit("/", 2)[-2] for r in blocks.select(F.input_file_name().alias("f")).collect()}
    bucket = spark.range(1).select(text_index.bucket_of(F.lit("b"))).first()[0]
    assert files == {f"bucket={bucket}"}
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or f"bucket#" in plan and f"= {bucket}" in plan


def test_errors_and_empty_tables(spark, corpus, tmp_path):
    with pytest.raises(ValueError, match="not closed"):
        text_index.search_index(spark, str(tmp_path), {"q": "(a"})
    text_index.build(corpus.limit(0), f"{tmp_path}/none", "id")
    found = text_index.search_index(spark, f"{tmp_path}/none", {"q": "-a"})
    assert text_index.row_ids(spark, f"{tmp_path}/none", found).count() == 0


def test_several_segments(spark, tmp_path):
    n = 2 * text_index.SEGMENT + 100
    df = spark.range(n).selectExpr("id", "concat('all w', id % 5, ' v', id % 7) AS title", "cast(NULL AS string) AS abstract")
    path = str(tmp_path / "index")
    text_index.build(df, path, "id")
    assert text_index.blocks_of(spark, path, ["all"]).count() == 3
    queries = {"p": '"w1 v2"', "n": "-w1 -v2", "o": "all + (w0 | v6)"}
    found = text_index.row_ids(spark, path, text_index.search_index(spark, path, queries))
    for name, query in queries.items():
        want = search.keyword_filter(df, query).select("id")
        got = found.where(f"query = '{name}'").select("id")
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
