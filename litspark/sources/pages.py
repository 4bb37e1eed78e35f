"""Landed response pages of the two search engines, flattened to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import schemas
from litspark.functions import filenames, text
from litspark.functions.language import detect_language


CORRUPT = "_corrupt"


def page_schema(engine: int) -> str:
    return schemas.PAGE_ENGINE_1 if engine == 1 else schemas.PAGE_ENGINE_2


def parse_pages(raw: DataFrame, engine: int, layout: str = "lines") -> DataFrame:
    """Pages from a text column ``value``; other columns of ``raw`` are kept.

    ``layout`` says what a value is: one page (``lines``) or one array of pages (``array``). What can't
    be read stays as a row with its text in ``_corrupt`` and no page.
    """
    page = f"page_no bigint, {page_schema(engine)}, {CORRUPT} string"
    options = {"columnNameOfCorruptRecord": CORRUPT}
    others = [c for c in raw.columns if c != "value"]
    if layout == "lines":
        rows = raw.where(F.trim("value") != "").select(*others, "value", F.from_json("value", page, options).alias("p"))
    elif layout == "array":
        # A file of one page, not in an array, is taken as an array of one.
        text_ = F.ltrim(F.translate("value", "\r\n\t", "   "))
        whole = F.when(F.startswith(text_, F.lit("[")), text_).otherwise(F.concat(F.lit("["), text_, F.lit("]")))
        items = F.from_json(whole, "array<string>")
        # The file's text stays only where it holds no item; beside items it would be repeated.
        read = raw.where(text_ != "").withColumn("_items", items)
        text_ = F.when(F.coalesce(F.size("_items"), F.lit(0)) < 1, F.col("value"))
        listed = read.select(*others, text_.alias("value"), F.posexplode_outer("_items").alias("place", "item"))
        rows = listed.select(
            *others,
            F.coalesce("value", "item", F.lit("null")).alias("value"),
            "place",
            F.from_json("item", page, options).alias("p"),
        )
        others.append("place")
    else:
        raise ValueError("layout must be lines or array")
    bad = F.when(F.col("p").isNull(), F.col("value")).otherwise(F.col(f"p.{CORRUPT}"))
    read = rows.withColumn("_bad", bad).select(*others, "p.*", "_bad").drop(CORRUPT)
    return read.withColumnRenamed("_bad", CORRUPT)


def raw_text(spark: SparkSession, path: str, layout: str = "lines", stream: bool = False) -> DataFrame:
    """Text of landed files: a row per line, or per file for arrays.

    A file that holds one array can't be split: it is one search's pages. Large tables of pages are
    JSON lines.
    """
    reader = spark.readStream if stream else spark.read
    return reader.text(path, wholetext=layout == "array")


def split_pages(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable pages, and what could not be read."""
    good = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def or_fail(parsed: DataFrame) -> DataFrame:
    """All pages; the job ends with an error at one that can't be read."""
    message = F.concat(F.lit("unreadable page: "), F.substring(CORRUPT, 1, 200))
    read = F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.where(read).drop(CORRUPT)


def read_pages(
    spark: SparkSession, path: str, engine: int, layout: str = "lines", rejected: str | None = None
) -> DataFrame:
    """Every page of the landed files, with ``page_no`` to order by: file, place in it.

    Pages that can't be read go to the table ``rejected``; without one they are an error.
    """
    raw = raw_text(spark, path, layout).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    parsed = parse_pages(raw, engine, layout).drop("page_no")
    place = [c for c in ("file", "block", "row", "place") if c in parsed.columns]
    parsed = parsed.withColumn("page_no", F.struct(*place)).drop(*place)
    if rejected is None:
        return or_fail(parsed)
    good, bad = split_pages(parsed)
    bad.write.mode("append").parquet(rejected)
    return good


def _explode(pages: DataFrame, items: str) -> DataFrame:
    keys = [c for c in ("page_no",) if c in pages.columns]
    return pages.select(*keys, F.posexplode(items).alias("pos", "w"))


def _records(works: DataFrame, **columns: Column) -> DataFrame:
    """Project to the record schema. Names and language are worked out from what was read."""
    keys = [c for c in ("page_no", "pos") if c in works.columns]
    first = works.select(*keys, *[value.alias(name) for name, value in columns.items()])
    return first.select(
        *[
            F.col(c)
            for c in ("search_engine_internal_id", "year", "title", "authors", "abstract")
        ],
        "isOpenAccess",
        "doi",
        detect_language("title", "abstract").alias("language"),
        "citationCount",
        "referenceCount",
        "entry_source",
        filenames.structured_filename("year", "last_name", "title", "doi").alias("pdf_filename"),
        F.lit(None).cast("string").alias("txt_filename"),
        F.lit(None).cast("string").alias("markdown_filename"),
        F.lit(False).alias("pdf_downloaded"),
        *keys,
    )


def flatten_s2_pages(pages: DataFrame) -> DataFrame:
    """Pages of engine 1 as records, with page number and position as the row order."""
    w = F.col("w")
    names = F.transform(w["authors"], lambda a: a["name"])
    return _records(
        _explode(pages, "data"),
        search_engine_internal_id=w["paperId"],
        year=w["year"],
        title=w["title"],
        authors=text.join_authors(names),
        last_name=text.first_author_last_name(names),
        abstract=w["abstract"],
        isOpenAccess=w["isOpenAccess"],
        doi=w["externalIds"]["DOI"],
        citationCount=w["citationCount"],
        referenceCount=w["referenceCount"],
        entry_source=F.lit(schemas.SOURCE_ENGINE_1),
    )


def flatten_oa_pages(pages: DataFrame) -> DataFrame:
    """Pages of engine 2 as records: prefixes cut, abstract rebuilt, references counted."""
    w = F.col("w")
    names = text.author_names(w["authorships"])
    return _records(
        _explode(pages, "results"),
        search_engine_internal_id=text.strip_work_id_prefix(w["id"]),
        year=w["publication_year"],
        title=w["display_name"],
        authors=text.join_authors(names),
        last_name=text.first_author_last_name(names),
        abstract=text.rebuild_abstract(w["abstract_inverted_index"]),
        isOpenAccess=w["open_access"]["is_oa"],
        doi=text.strip_doi_prefix(w["doi"]),
        citationCount=w["cited_by_count"],
        referenceCount=F.coalesce(
            F.when(w["referenced_works"].isNotNull(), F.size(w["referenced_works"])), F.lit(0)
        ),
        entry_source=F.lit(schemas.SOURCE_ENGINE_2),
    )


def union_pages(*engines: DataFrame) -> DataFrame:
    """Records of several engines in one table."""
    first, *rest = engines
    for other in rest:
        first = first.unionByName(other)
    return first
