"""Corpus pipeline: from raw documents to tokens, each stage on all that the one before kept.

1. quality: what the weak-label classifier rejects (junk, abuse) goes;
2. near duplicates: of each group of similar documents the one with the smallest id stays;
3. passages: passages of 50 words or more that nearly repeat earlier ones are cut out, and
   documents of which nothing is left go;
4. benchmark: documents that hold a window of a benchmark item go;
5. tokens: what is left is encoded, and decoded again as a check.

The stages look at ``doc_id`` and ``text`` alone (and bring ``n_chars`` up to date, where there is one). All
other columns pass through under their names, also those named like a column of an operator; only the
three that the last stage adds take the place of columns of those names. A document without a text is an
empty one. Rows without an id are judged by the first and the fourth stage and encoded by the last; the
second and third leave them as they are, since what repeats is told by ids. An empty table stays empty.

Every stage is written as Parquet to the shared folder and read again. No stage can be expressed in
SQL as a whole; ``tests/llm/test_pipeline.py`` holds each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm import bpe, compact_windows, decontaminate, jaccard_join, weak_labels
from litspark.llm.queries import table, tokenizer_path
from litspark.session import materialize

ORACLE_SQL = None


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the documents with all columns but id and text under names of no operator."""
    hidden = {c: c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]))
    added = [c for c in done.columns if c not in hidden.values()]
    own = [F.col(h).alias(c) for c, h in hidden.items() if c.lower() not in added]
    return done.select(*own, *added)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return _apart(docs, lambda d: weak_labels.classify(d, labels).where("keep").select(d.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, lambda d: jaccard_join.one_of_each(d, size=5, threshold=Fraction(8, 10)))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = _apart(docs, compact_windows.remove)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return _apart(docs, lambda d: decontaminate.decontaminate(d, items))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path()

    def code(d: DataFrame) -> DataFrame:
        coded = bpe.decode(bpe.encode(d, path), path)
        return coded.select(
            *d.columns,
            "token_ids",
            bpe.n_ids(F.col("token_ids")).alias("n_tokens"),
            (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
        )

    return _apart(docs, code)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
