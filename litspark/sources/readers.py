"""Readers: record files, search configs, file inventories, documents, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark import schemas
from litspark.functions import filenames
from litspark.functions.prompts import template_text
from litspark.functions.text import is_missing, present

ROLES = ("results", "filtered")


def _typed(name: str, kind: T.DataType):
    text = present(name)
    if isinstance(kind, T.IntegerType):
        # A column with blank cells is written as ``2021.0``.
        return text.try_cast("double").cast("int").alias(name)
    if isinstance(kind, T.BooleanType):
        lowered = F.lower(F.trim(text))
        return (
            F.when(lowered.isin("true", "1", "1.0"), F.lit(True))
            .when(lowered.isin("false", "0", "0.0"), F.lit(False))
            .alias(name)
        )
    return text.alias(name)


def apply_record_schema(df: DataFrame, *keep: str) -> DataFrame:
    """Text columns as records: missing values as null, numbers and flags typed.

    Columns the input lacks are null. ``keep`` names further columns to carry along.
    """
    have = set(df.columns)
    columns = [
        _typed(f.name, f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.RECORD.fields
    ]
    return df.select(*columns, *keep)


def row_in_file() -> Column:
    """Grows with the rows of a file; unique within it, not between files.

    A multi-line file is read by one task, and the lower 33 bits are the row's place there.
    """
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _headers(spark: SparkSession, path: str, **options: str) -> dict[str, list[str]]:
    """Files by their first line: one short row per file comes to the driver."""
    lines = spark.read.options(**options).text(path)
    first = (
        lines.select(
            F.col("_metadata.file_path").alias("path"),
            "value",
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        )
        .groupBy("path")
        .agg(F.min_by("value", "place").alias("header"))
    )
    by_header: dict[str, list[str]] = {}
    for row in first.orderBy("path").collect():
        by_header.setdefault(row["header"].lstrip("\ufeff"), []).append(row["path"])
    return by_header


def _read_semicolon(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Text files with all columns as text, taken by the names in each file's own header."""
    tables = []
    for paths in _headers(spark, path, **options).values():
        reader = (
            spark.read.option("sep", ";")
            .option("header", "true")
            .option("multiLine", "true")
            .option("quote", '"')
            .option("escape", '"')
            .option("encoding", "UTF-8")
        )
        rows = reader.csv(paths)
        named = [F.col(f"`{c}`").alias(c.strip()) for c in rows.columns]
        tables.append(rows.select(*named, F.col("_metadata.file_name").alias("file_name"), row_in_file().alias("ord")))
    if not tables:
        names = ", ".join(f"{c} string" for c in schemas.RECORD_COLUMNS)
        return spark.createDataFrame([], f"{names}, file_name string, ord bigint")
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def read_records(spark: SparkSession, path: str, extra: bool = False) -> DataFrame:
    """Records of ``;``-separated files, with the file name and the row order.

    Columns are found by name, in any order; those a file lacks are null. With ``extra`` the columns
    that are not of the record schema, as merged tables have them, are carried along as text.
    Text files are for exchange: a multi-line file cannot be split. Large tables are Parquet.
    """
    rows = _read_semicolon(spark, path)
    known = {*schemas.RECORD_COLUMNS, "file_name", "ord"}
    others = [c for c in rows.columns if c not in known] if extra else []
    return apply_record_schema(rows, *[f"`{c}`" for c in others], "file_name", "ord")


def read_searches(spark: SparkSession, folder: str, role: str = "results") -> DataFrame:
    """All searches of one role in a folder, without merged outputs."""
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    rows = _read_semicolon(spark, folder, pathGlobFilter=f"*__{role}.csv")
    rows = rows.where(~F.col("file_name").contains("__merged"))
    return apply_record_schema(rows, "file_name", "ord").withColumn(
        "search_id", filenames.search_id("file_name")
    )


def search_config_defaults(configs: DataFrame) -> DataFrame:
    return configs.select(
        "search_id",
        "query",
        F.coalesce("year", F.lit(schemas.DEFAULT_YEARS)).alias("year"),
        F.coalesce("onlyOpenAccess", F.lit(schemas.DEFAULT_OPEN_ACCESS)).alias("onlyOpenAccess"),
    )


def read_search_configs(spark: SparkSession, path: str) -> DataFrame:
    """Search configs as JSON lines; the id defaults to the file's stem."""
    rows = spark.read.schema(schemas.SEARCH_CONFIG).json(path)
    named = rows.withColumn(
        "search_id", F.coalesce("search_id", filenames.search_id(F.col("_metadata.file_name")))
    )
    return search_config_defaults(named)


def file_parts(files: DataFrame) -> DataFrame:
    """Adds stem and extension to a table with ``file_name``."""
    parts = filenames.split_name("file_name")
    return files.withColumns({"stem": parts["stem"], "ext": parts["ext"]})


def read_file_inventory(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Names of the files in a folder. File contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "length",
            "modificationTime",
        )
    )
    return file_parts(files)


def _whole_texts(spark: SparkSession, folder: str, names: str) -> DataFrame:
    read = spark.read.option("pathGlobFilter", names).text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("file_name"), "value")


def parsed_documents(texts: DataFrame) -> DataFrame:
    """Files as ``file_name, value`` by stem and extension; those that are no ``.md`` and ``.txt`` are left out."""
    rows = file_parts(texts.where(F.col("file_name").rlike(r"\.(md|txt|MD|TXT)$")))
    return rows.select("file_name", "stem", "ext", F.col("value").alias("content"))


def prompt_templates(texts: DataFrame) -> DataFrame:
    """``.txt`` files as ``file_name, value`` as templates: the id is the file's stem."""
    return texts.where(F.col("file_name").endswith(".txt")).select(
        F.regexp_replace("file_name", r"\.txt$", "").alias("prompt_id"),
        template_text("value").alias("template"),
    )


def read_parsed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text of every ``.md`` and ``.txt`` file, one row per file.

    Spark's reader takes some milliseconds per file, and its driver lists them all. For folders of very
    many files there is :func:`litspark.sources.listing.read_texts`.
    """
    return parsed_documents(_whole_texts(spark, folder, "*.{md,txt,MD,TXT}"))


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt templates: the id is the file's stem."""
    return prompt_templates(_whole_texts(spark, folder, "*.txt"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated table with open columns, all of them text (ids stay as written)."""
    rows = (
        spark.read.option("sep", ";")
        .option("header", "true")
        .option("multiLine", "true")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    cleaned = [F.when(~is_missing(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) for c in rows.columns]
    return rows.select(*cleaned, row_in_file().alias("ord"))
