"""Reconciling records with the files that are there; download and extraction plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions.filenames import companion, stem
from litspark.functions.requests import parse_resolution
from litspark.functions.text import is_missing, strip
from litspark.operators.curate import usable_doi
from litspark.operators.skew import lookup_join
from litspark.schemas import RECORD, SOURCE_MANUAL
from litspark.session import materialize


# Bits of a stem's files: 0 is the stem itself as a name, 1 to 8 are the spellings of ``.pdf``.
LOWER_PDF_BIT = 1
TXT_BIT = 9
MD_BIT = 10


def _spelling(name: Column) -> Column:
    """Bit number of a file name: which letters of a ``.pdf`` ending are upper case."""
    upper = [
        F.when(F.substring(name, at, 1) == letter, weight).otherwise(0)
        for at, letter, weight in ((-3, "P", 4), (-2, "D", 2), (-1, "F", 1))
    ]
    return F.when(F.lower(name).endswith(".pdf"), upper[0] + upper[1] + upper[2] + 1).otherwise(0)


def _bit(number: Column | int) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number)


def _has(number: Column | int) -> Column:
    return F.coalesce(F.col("_files").bitwiseAND(_bit(number)) != 0, F.lit(False))


def _files_by_stem(files: DataFrame) -> DataFrame:
    """One row per stem with a bit for each of its files that matters here."""
    name = F.col("file_name")
    cut = F.regexp_replace(name, r"\.(txt|md)$", "")
    entries = F.array(
        F.struct(stem(name).alias("_stem"), _bit(_spelling(name)).alias("bit")),
        F.struct(
            cut.alias("_stem"), F.when(name.endswith(".txt"), _bit(TXT_BIT)).otherwise(_bit(MD_BIT)).alias("bit")
        ),
    )
    # Without a text ending the second entry says nothing.
    kept = F.when(cut != name, entries).otherwise(F.slice(entries, 1, 1))
    return files.select(F.inline(kept)).groupBy("_stem").agg(F.bit_or("bit").alias("_files"))


def _record_name() -> Column:
    """A record's file name, null where it has none."""
    return F.when(~is_missing("pdf_filename"), strip("pdf_filename"))


def sync(
    records: DataFrame, files: DataFrame, add_extra: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records brought up to date with a folder, and the counts of updated and added rows.

    The PDF flag only ever turns to true; names of text files are filled in where empty.
    ``changed`` marks updated rows, ``added`` the rows of unlisted PDFs.
    """
    by_stem = _files_by_stem(files)
    keyed = records.withColumn("_name", _record_name()).withColumn("_stem", stem("_name"))
    found = lookup_join(keyed, by_stem, "_stem", "left")
    name = F.col("_name")
    to_flag = _has(_spelling(name)) & ~F.coalesce(F.col("pdf_downloaded"), F.lit(False))
    to_txt = _has(TXT_BIT) & is_missing("txt_filename")
    to_md = _has(MD_BIT) & is_missing("markdown_filename")
    updated = found.select(
        *[
            {
                "pdf_downloaded": F.when(to_flag, F.lit(True)).otherwise(F.col(c)).alias(c),
                "txt_filename": F.when(to_txt, companion(name, "txt")).otherwise(F.col(c)).alias(c),
                "markdown_filename": F.when(to_md, companion(name, "md")).otherwise(F.col(c)).alias(c),
            }.get(c, F.col(c))
            for c in records.columns
        ],
        (to_flag | to_txt | to_md).alias("changed"),
        F.lit(False).alias("added"),
    )
    if add_extra:
        updated = updated.unionByName(unlisted_pdfs(records, by_stem), allowMissingColumns=True)
    counts = updated.agg(F.count_if("changed").alias("updated"), F.count_if("added").alias("added"))
    return updated, counts


def unlisted_pdfs(records: DataFrame, by_stem: DataFrame) -> DataFrame:
    """Records for PDFs no row lists. Only the lower-case ending counts, as in a file pattern."""
    listed = records.select(_record_name().alias("pdf_filename")).where("pdf_filename is not null")
    pdfs = by_stem.where(_has(LOWER_PDF_BIT)).withColumn("pdf_filename", F.concat("_stem", F.lit(".pdf")))
    extra = pdfs.join(listed.distinct(), "pdf_filename", "left_anti")
    name = F.col("pdf_filename")
    values = {
        "pdf_filename": name,
        "pdf_downloaded": F.lit(True),
        "entry_source": F.lit(SOURCE_MANUAL),
        "txt_filename": F.when(_has(TXT_BIT), companion(name, "txt")),
        "markdown_filename": F.when(_has(MD_BIT), companion(name, "md")),
    }
    return extra.select(
        *[
            values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in RECORD.fields
        ],
        F.lit(False).alias("changed"),
        F.lit(True).alias("added"),
    )


def download_plan(
    records: DataFrame,
    resolutions: DataFrame,
    files: DataFrame,
    failed: DataFrame | None = None,
    order: str = "ord",
) -> DataFrame:
    """One row per record with a DOI and what its download comes to.

    ``resolutions`` has the lookup answer per DOI (``doi``, ``response``), ``failed`` the row
    orders whose fetch went wrong. Of several rows with one target file the first that can be
    fetched is fetched; the later ones find it there.
    """
    answers = resolutions.groupBy("doi").agg(F.min("response").alias("response"))
    answers = answers.select("doi", parse_resolution("response").alias("_r"))
    wanted = usable_doi(records).select("doi", "title", "pdf_filename", order)
    resolved = lookup_join(wanted, answers, "doi").select(
        "doi",
        "title",
        "pdf_filename",
        order,
        F.col("_r.pdf_url").alias("pdf_url"),
        F.coalesce(F.col("_r.outcome"), F.lit("no_answer")).alias("resolution"),
    )
    there = files.select(F.col("file_name").alias("pdf_filename")).distinct()
    there = there.withColumn("_there", F.lit(True))
    checked = lookup_join(resolved, there, "pdf_filename")
    if failed is None:
        checked = checked.withColumn("_failed", F.lit(False))
    else:
        marks = failed.select(order).distinct().withColumn("_failed", F.lit(True))
        checked = checked.join(marks, order, "left")
    # Read twice below: written once, so that the joins so far run once.
    checked = materialize(checked)
    can_fetch = (
        (F.col("resolution") == "ok")
        & F.col("_there").isNull()
        & ~F.coalesce(F.col("_failed"), F.lit(False))
    )
    first = (
        checked.where(can_fetch).groupBy("pdf_filename").agg(F.min(order).alias("_first"))
    )
    outcome = (
        F.when(F.col("resolution") != "ok", "skipped")
        .when(F.col("_there").isNotNull() | (F.col(order) > F.col("_first")), "exists")
        .when(F.col("_failed"), "failed")
        .otherwise("succeeded")
    )
    return lookup_join(checked, first, "pdf_filename").select(
        order, "doi", "title", "pdf_url", "pdf_filename", "resolution", outcome.alias("outcome")
    )


def add_plan(sources: DataFrame, files: DataFrame) -> DataFrame:
    """PDFs to copy into the folder: those whose name is there already are left alone."""
    name = F.element_at(F.split("path", "/"), -1)
    pdfs = sources.where(F.lower("path").endswith(".pdf")).withColumn("file_name", name)
    there = files.select("file_name").distinct().withColumn("_there", F.lit(True))
    outcome = F.when(F.col("_there"), "exists").otherwise("copied")
    return lookup_join(pdfs, there, "file_name").select("path", "file_name", outcome.alias("outcome"))


def extract_plan(
    files: DataFrame, ext: str = "txt", rewrite: bool = False, skip_if_md: bool = False
) -> DataFrame:
    """Every PDF with ``existing`` or ``to_extract``. ``files`` has ``file_name``."""
    names = files.select("file_name").distinct()
    pdfs = names.where(F.lower("file_name").endswith(".pdf")).withColumn("stem", stem("file_name"))
    block = ([] if rewrite else [ext]) + (["md"] if skip_if_md and ext == "txt" else [])
    if not block:
        return pdfs.withColumn("outcome", F.lit("to_extract"))
    pattern = rf"\.({'|'.join(block)})$"
    done = (
        names.where(F.col("file_name").rlike(pattern))
        .select(F.regexp_replace("file_name", pattern, "").alias("stem"))
        .distinct()
        .withColumn("_done", F.lit(True))
    )
    outcome = F.when(F.col("_done"), "existing").otherwise("to_extract")
    return pdfs.join(done, "stem", "left").select("file_name", "stem", outcome.alias("outcome"))


def list_searches(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Search configs with a flag whether they have results."""
    ids = results.select("search_id").distinct().withColumn("_has", F.lit(True))
    return configs.join(ids, "search_id", "left").select(
        *configs.columns, F.col("_has").isNotNull().alias("has_results")
    )


# The four input tables a project must have.
PROJECT_INPUTS = ("data.csv", "llm-params.csv", "mapping.csv", "llm-models.csv")


def list_projects(files: DataFrame) -> DataFrame:
    """Per project: when it was made, and whether all its inputs are there.

    ``files`` has ``project``, ``file_name``, ``modificationTime``. Each input is a flag of its
    own, so a project of any size adds up before the shuffle.
    """
    has = [F.max(F.col("file_name") == name) for name in PROJECT_INPUTS]
    return files.groupBy("project").agg(
        F.min("modificationTime").alias("created"),
        reduce(Column.__and__, has).alias("initialized"),
    )


def project_snapshots(files: DataFrame, prefix: str = "experiment", suffix: str = ".db") -> DataFrame:
    """One row per project and experiment snapshot."""
    name = F.col("file_name")
    return files.where(name.startswith(prefix) & name.endswith(suffix)).select("project", name).distinct()


def sorted_list(listed: DataFrame, by: str = "project", descending: bool = False) -> DataFrame:
    """A list by name or by creation time, in either direction; names settle ties."""
    first = F.desc(by) if descending else F.asc(by)
    return listed.orderBy(first, *[c for c in ("project", "search_id") if c in listed.columns and c != by])
