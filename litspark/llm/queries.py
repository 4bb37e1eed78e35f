"""Queries over the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm import (
    bin_completion,
    bpe,
    compact_windows,
    decontaminate,
    jaccard_join,
    pq_dedup,
    quotient_counts,
    repeat_tree,
    shards,
    url_filter,
    warc,
    weak_labels,
    word_runs,
)
from litspark.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The rules of the URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL judged by the longest rule that fits it; ``allow`` where none does."""
    rules = url_filter.rules_table(spark, URL_RULES)
    return url_filter.filter_urls(table(spark, folder, "pages"), rules)


SQL["op1_url_filter"] = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parsed AS (
  SELECT row_number() OVER () AS place, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ranked AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY place
      ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS n
  FROM parsed p LEFT JOIN rules r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""


@query
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = tokenizer_path()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return coded.select(
        "doc_id",
        bpe.n_ids(F.col("token_ids")).alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked by 85 of 100 shared four-word shingles, and their components."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.link(docs, size=4, threshold=Fraction(85, 100))


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, with their texts, shuffled into 40 shards whose row counts differ by one at most."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return shards.shuffle_to_shards(docs, 40).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_pq_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of one label linked by a cosine of 0.93, and their components."""
    return pq_dedup.link(table(spark, folder, "embeddings"))


SQL["op6_pq_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id
"""


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as a WARC record, and what the archives give back."""
    records = warc.plan_records(table(spark, folder, "pages"), "page_id", "html")
    manifest = warc.write_archives(warc.chunk_table(records), work_dir(spark))
    back = warc.records_of(warc.read_archives(manifest, with_bytes=False))
    return back.withColumnRenamed("id", "page_id")


@query
def op8_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that nearly repeat earlier ones, and where those stand."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes")
    # Texts are counted before they are marked, so that none goes through the last join.
    marked = compact_windows.mark(table(spark, folder, "documents").select("doc_id", "text", n_bytes))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        "n_bytes",
        n_removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.transform("spans", lambda s: s["start"]).alias("starts"),
        F.transform("spans", lambda s: s["end"]).alias("ends"),
        F.col("sources").alias("source_ids"),
    )


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score and whether it is kept."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = weak_labels.classify(docs, table(spark, folder, "labels"))
    return judged.select("doc_id", F.round("score", 6).alias("score"), "keep")


@query
def op10_repeat_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat 100 bytes seen earlier, removed."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = repeat_tree.remove(docs)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return cut.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op12_bin_completion(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens: where each piece stands."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = bin_completion.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), 2048)
    placed = bin_completion.wide_ids(bin_completion.pack(cut, 2048))
    return placed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def made_periodic(doc_id: Column, words: Column, text: Column) -> Column:
    """Of one in ten documents, chosen by its id, the words from one place on repeat a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    n = F.size(words)
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    copies = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(copies, F.lit(1), (n - a).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


@query
def op13_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, some of which are made periodic before."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("words", F.when(chosen, words))
    docs = docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("words"), F.col("text")).alias("text"))
    marked = word_runs.mark(docs)
    best = word_runs.highest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return marked.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op11_quotient_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Collocations of 2 to 4 words in each language of the documents."""
    return quotient_counts.collocations(table(spark, folder, "documents").select("text", "lang"))
