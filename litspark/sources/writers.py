"""Writers, the guard against overwriting, and versioned names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import schemas
from litspark.functions.text import clean_value, provider_key


def write_mode(rewrite: bool) -> str:
    """An existing output is an error unless it is to be rewritten."""
    return "overwrite" if rewrite else "errorifexists"


def sort_records(df: DataFrame) -> DataFrame:
    """Newest first, then by title; missing values last.

    Further columns order the rows of one title, so that many such rows (those without year
    and title, say) can be sorted in several ranges.
    """
    ties = ["search_engine_internal_id", "doi", F.xxhash64(*df.columns)]
    return df.orderBy(F.desc_nulls_last("year"), F.asc_nulls_last("title"), *ties)


def write_records(df: DataFrame, path: str, rewrite: bool = False, fmt: str = "parquet") -> None:
    """Write records in their order, as Parquet or as ``;``-separated text."""
    rows = sort_records(df)
    if fmt == "csv":
        writer = (
            rows.write.option("sep", ";")
            .option("header", "true")
            .option("quote", '"')
            .option("escape", '"')
        )
        writer.mode(write_mode(rewrite)).csv(path)
    else:
        rows.write.mode(write_mode(rewrite)).format(fmt).save(path)


def write_raw_pages(pages: DataFrame, path: str, fmt: str = "json") -> None:
    """Append landed pages to the raw zone; nothing written before is touched."""
    pages.write.mode("append").format(fmt).save(path)


def plan_counts(**tables: DataFrame) -> DataFrame:
    """Dry run: rows each table would have. Nothing is written."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    first, *rest = counts
    for other in rest:
        first = first.unionByName(other)
    return first


def experiment_columns(df: DataFrame, *keep: str) -> DataFrame:
    """Every known column with its type; lacking ones null, unknown ones but ``keep`` dropped, NaN as null."""
    have = set(df.columns)

    def column(name: str) -> Column:
        kind = schemas.EXPERIMENT_TYPES[name]
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        value = F.col(name).cast(kind)
        return (clean_value(value) if kind == "double" else value).alias(name)

    return df.select(
        *[column(name) for name in schemas.EXPERIMENT_COLUMNS],
        *keep,
        provider_key("provider_name").alias("provider"),
    )


def write_experiment(df: DataFrame, path: str, rewrite: bool = False) -> None:
    """One folder per provider, so that reading one provider reads its files only."""
    experiment_columns(df).write.mode(write_mode(rewrite)).partitionBy("provider").parquet(path)


def provider_view(df: DataFrame, provider: str) -> DataFrame:
    """One provider's rows with its own columns, of a grid read without its texts all but those."""
    textless = "prompt" not in df.columns and "original_data" not in df.columns
    own = [c for c in schemas.provider_columns(provider) if not textless or c not in ("prompt", "original_data")]
    return df.where(F.col("provider") == provider.lower()).select(*own)


def write_responses(df: DataFrame, path: str) -> None:
    """One JSON document per finished call, by provider."""
    (
        df.where(F.col("response_json").isNotNull())
        .select("provider", F.col("response_json").alias("value"))
        .write.mode("append")
        .partitionBy("provider")
        .text(path)
    )


def failure_rows(outcomes: DataFrame) -> DataFrame:
    """Download rows that brought no new file. Those whose file is there count as downloaded."""
    return outcomes.where(F.col("outcome") != "succeeded").select(
        "doi",
        "title",
        F.col("pdf_url").alias("url"),
        "pdf_filename",
        (F.col("outcome") == "exists").alias("pdf_downloaded"),
    )


def write_failures(outcomes: DataFrame, path: str, rewrite: bool = False) -> None:
    rows = failure_rows(outcomes).write.option("sep", ";").option("header", "true")
    rows.option("escape", '"').mode(write_mode(rewrite)).csv(path)


def append_filter_log(audit: DataFrame, path: str) -> None:
    """Keep the counts of an exclusion run, with the time they were taken."""
    audit.withColumn("applied_at", F.current_timestamp()).write.mode("append").parquet(path)


def _counter(file_name: Column, suffix: str) -> Column:
    stem = F.regexp_replace(file_name, rf"\Q{suffix}\E$", "")
    return F.coalesce(F.substring_index(stem, "_", -1).try_cast("int"), F.lit(0))


def _versions(inventory: DataFrame, prefix: str, suffix: str) -> DataFrame:
    name = F.col("file_name")
    return inventory.where(name.startswith(prefix) & name.endswith(suffix)).select(
        name, _counter(name, suffix).alias("counter")
    )


def next_snapshot(
    inventory: DataFrame, date: str, prefix: str = "experiment", suffix: str = ".db"
) -> DataFrame:
    """``<prefix>_<date>_<NN>``: one more than the highest counter of any date."""
    highest = F.coalesce(F.max("counter"), F.lit(0))
    name = F.format_string(f"{prefix}_{date}_%02d{suffix}", highest + 1)
    return _versions(inventory, prefix, suffix).agg(name.alias("file_name"))


def next_backup(inventory: DataFrame, date: str, stem: str = "data", suffix: str = ".csv") -> DataFrame:
    """``<stem>_backup_<date>_<NN>``: here the counter starts anew each day."""
    return next_snapshot(
        inventory.where(F.col("file_name").startswith(f"{stem}_backup_{date}_")),
        date,
        f"{stem}_backup",
        suffix,
    )


def latest_snapshot(
    inventory: DataFrame, prefix: str = "experiment", suffix: str = ".db"
) -> DataFrame:
    """The file with the highest counter; of equal ones the first by name."""
    order = F.struct(-F.col("counter"), F.col("file_name"))
    return _versions(inventory, prefix, suffix).agg(F.min_by("file_name", order).alias("file_name"))
