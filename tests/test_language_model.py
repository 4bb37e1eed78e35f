import pytest
from pyspark.sql import functions as F

from litspark.functions import language_model as lm


def test_grams(spark, value):
    assert value(lm.grams_of(F.lit("ab"), 4)) == ["a", "b", " a", "ab", "b ", " ab", "ab ", " ab "]
    assert value(lm.grams_of(F.lit("é"), 4)) == ["é", " é", "é ", " é "]
    assert value(lm.words_of(F.lit("  It's 2É—x\n"))) == ["it", "s", "é", "x"]


def test_held_out_accuracy(spark):
    """Fitted on four fifths of the documents, judged on the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 100")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    detector = lm.Detector(lm.fit(docs.where(fold != 0), "text", "lang"))
    told = detector.detect(docs.where(fold == 0), "found", "text")
    right, n = told.agg(F.avg((F.col("found") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.98


def test_rows_with_odd_texts(spark):
    rows = [("en", "the cat and the dog"), ("fr", "le chat et la souris"), (None, "zzz"), ("en", None), ("xx", "")]
    model = lm.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3), "text", "lang", top=50)
    detector = lm.Detector(model)
    assert detector.langs == ["en", "fr"]
    asked = [("the dog", "the cat", "en"), ("the dog", "le chat", "unclear"), ("", "la souris", "fr"), (None, "the", "en"),
             (None, None, "unclear"), ("12", " ", "unclear"), ("12", "the cat", "unclear"), ("ж", None, "unclear")]
    df = spark.createDataFrame(asked, "t string, a string, want string").selectExpr("*", "'old' AS LANG")
    rows = detector.detect(df, "lang", "t", "a").collect()
    assert [r.lang for r in rows] == [r.want for r in rows] and rows[0].asDict().keys() == {"t", "a", "want", "lang"}


def test_size_of_the_model_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lm.fit(docs, "text", "lang", top=40)
    assert model.count() <= 4 * 4 * 40


@pytest.mark.parametrize("rows", [[], [("en", "a")]])
def test_tables_without_a_choice(spark, rows):
    detector = lm.Detector(lm.fit(spark.createDataFrame(rows, "lang string, text string"), "text", "lang"))
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [r.found for r in detector.detect(df, "found", "text").collect()] == (["en", "unclear"] if rows else ["unclear"] * 2)
