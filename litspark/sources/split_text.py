"""``;``-separated text with line ends in quoted cells, read by many tasks.

Spark reads the files as lines, each split from its own byte range. Whether a line begins inside a
quoted cell follows from the number of quote marks before it: one pass counts them per range, sums
over the ranges before tell the state in which each begins, and the second pass puts lines together to
records. Only records that cross a range are shuffled. Per range a few numbers come to the driver.

Quote marks must be as writers of such files put them: around cells, and doubled within. A mark within
a cell that is not quoted counts like any other; the reader for whole files is more lenient there.
"""

from __future__ import annotations

import csv

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.functions import filenames
from litspark.sources.readers import ROLES, _headers, apply_record_schema

_PIECE = "file string, rec_block bigint, rec_line bigint, block bigint, text string, whole boolean"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _ranges(batches):
    """Lines range by range: file, start, and lists of lines as they come."""
    for batch in batches:
        files, blocks = batch.column(0), batch.column(1)
        n, at = batch.num_rows, 0
        changed = [0]
        if n > 1:
            same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(blocks[1:], blocks[:-1]))
            changed += [i + 1 for i, s in enumerate(same.to_pylist()) if not s]
        for at, to in zip(changed, [*changed[1:], n]):
            if at < to:
                yield files[at].as_py(), blocks[at].as_py(), batch.column(2)[at:to]


def _count(batches):
    """Per range: parity of its quote marks, and the last line that begins a record if the range begins
    outside (``last0``) or inside (``last1``) a quoted cell; -1 where none does."""
    now, parity, line, last = None, 0, 0, [-1, -1]

    def row():
        return pa.RecordBatch.from_pydict(
            {"file": [now[0]], "block": [now[1]], "parity": [parity], "last0": [last[0]], "last1": [last[1]]}
        )

    for file, block, lines in _ranges(batches):
        if (file, block) != now:
            if now:
                yield row()
            now, parity, line, last = (file, block), 0, 0, [-1, -1]
        for marks in pc.count_substring(lines, '"').to_pylist():
            last[parity] = line
            parity ^= marks & 1
            line += 1
    if now:
        yield row()


def records_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file``, ``ord`` (grows with a file's records) and ``text`` of every record, the header included."""
    lines = _lines(spark, paths)
    counted = lines.mapInArrow(_count, "file string, block bigint, parity bigint, last0 bigint, last1 bigint")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2
    begun = counted.withColumn("state", state).withColumn(
        "begins", F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    )
    place = F.when(F.col("begins") >= 0, F.struct("block", "begins"))
    carried = begun.withColumn("open", F.last(place, ignorenulls=True).over(before))
    # A row per range of a file, by default of 128 MB.
    found = {
        (r["file"], r["block"]): (r["state"], (r["open"]["block"], r["open"]["begins"]) if r["open"] else (0, 0))
        for r in carried.collect()
    }
    shared = spark.sparkContext.broadcast(found)

    def gather(batches):
        now, inside, line = None, 0, 0
        record, held = (0, 0), []
        out: list[tuple] = []

        def flush():
            rows, out[:] = list(zip(*out)), []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = ["file", "rec_block", "rec_line", "block", "text", "whole"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

        def close(ended):
            if held:
                whole = ended and record[0] == now[1]
                out.append((now[0], *record, now[1], "\n".join(held), whole))
                held.clear()

        for file, block, lines in _ranges(batches):
            if (file, block) != now:
                close(False)
                now, line = (file, block), 0
                inside, record = shared.value[now]
            for text, marks in zip(lines.to_pylist(), pc.count_substring(lines, '"').to_pylist()):
                if not inside:
                    record = (block, line)
                held.append(text)
                inside ^= marks & 1
                if not inside:
                    close(True)
                line += 1
                if len(out) >= 5000:
                    yield flush()
        close(False)
        if out:
            yield flush()

    pieces = lines.mapInArrow(gather, _PIECE)
    crossing = pieces.where("NOT whole").groupBy("file", "rec_block", "rec_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text")
    )
    names = ["file", (F.col("rec_block") + F.col("rec_line")).alias("ord"), "text"]
    return pieces.where("whole").select(names).unionAll(crossing.select(names))


def read_split(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All columns as text, taken by the names in each file's own header, with ``file_name`` and ``ord``."""
    tables = []
    for header, paths in _headers(spark, path, **options).items():
        names = [c.strip() for c in next(csv.reader([header.rstrip("\r")], delimiter=";"))]
        schema = ", ".join(f"`{c}` string" for c in names)
        rows = records_of(spark, paths).where("ord > 0")
        text = F.regexp_replace("text", r"\r\z", "")
        cells = F.from_csv(text, schema, {"sep": ";", "quote": '"', "escape": '"', "lineSep": "\u0001", "maxCharsPerColumn": "-1"})
        parsed = rows.where(text != "").select(
            F.element_at(F.split("file", "/"), -1).alias("file_name"), "ord", cells.alias("cells")
        )
        tables.append(parsed.select("cells.*", F.url_decode("file_name").alias("file_name"), "ord"))
    if not tables:
        return spark.createDataFrame([], "file_name string, ord bigint")
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def read_records_split(spark: SparkSession, path: str) -> DataFrame:
    """:func:`litspark.sources.readers.read_records` by many tasks a file."""
    return apply_record_schema(read_split(spark, path), "file_name", "ord")


def read_searches_split(spark: SparkSession, folder: str, role: str = "results") -> DataFrame:
    """:func:`litspark.sources.readers.read_searches` by many tasks a file."""
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    rows = read_split(spark, folder, pathGlobFilter=f"*__{role}.csv").where(~F.col("file_name").contains("__merged"))
    return apply_record_schema(rows, "file_name", "ord").withColumn("search_id", filenames.search_id("file_name"))
