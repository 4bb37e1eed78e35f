from pyspark.sql import functions as F

from litspark.plans import bindings
from litspark.sources import listing, readers


def test_texts_of_listed_files(spark, tmp_path):
    """Names with odd signs, an empty file, bytes that are no text, and a table of files in folders."""
    base = tmp_path / "files"
    given = {"a.b.md": "# A\n\ntext\n", "c d%20#.txt": "größe {{ x }}\n", "e.TXT": "", "x.gz.md": "plain", "n.pdf": "no text"}
    files = spark.createDataFrame([(f"{i}/{n}", t) for i, (n, t) in enumerate(given.items())], "name string, content string")
    bindings.write_files(files, str(base))
    (base / "0" / "bad.md").write_bytes(b"\xffok")
    texts = listing.read_texts(listing.list_files(spark, [str(base)], recursive=True), per_task=2)
    assert texts.rdd.getNumPartitions() == 3
    docs = {r["file_name"]: r["content"] for r in readers.parsed_documents(texts).collect()}
    assert docs == {n: t for n, t in given.items() if n != "n.pdf"} | {"bad.md": "�ok"}
    assert [tuple(r) for r in readers.prompt_templates(texts).collect()] == [("c d%20#", "größe {{ x }}")]


def test_few_tasks_for_many_files(spark, tmp_path):
    """Files are read a thousand to a task; Spark's reader takes some 31 of them, however small they are."""
    rows = spark.range(2500).select(F.concat(F.col("id") % 3, F.lit("/t"), "id", F.lit(".txt")).alias("name"), F.lit("x").alias("content"))
    bindings.write_files(rows, str(tmp_path))
    texts = listing.read_texts(listing.list_files(spark, [str(tmp_path)], recursive=True), per_task=1000)
    assert texts.rdd.getNumPartitions() == 3
    assert texts.where("value = 'x'").select("file_name").distinct().count() == 2500
