"""The experiment grid: data x prompt x model x parameters as rendered, hashed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import schemas
from litspark.functions import text
from litspark.functions.prompts import data_context, render_prompt
from litspark.operators.ordering import with_dense_index
from litspark.operators.skew import (
    HOT_SHARE,
    broadcast_limit,
    estimated_bytes,
    hot_keys,
    lookup_join,
)
from litspark.sources.writers import experiment_columns, write_mode

TEXTS = ["prompt", "original_data"]
COPY_COLUMNS = ["title", "abstract", "doi", "authors"]


def check_unique(df: DataFrame, key: str) -> None:
    """Raise if a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").select(key).take(1)
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} occurs more than once")


def trimmed_mapping(mapping: DataFrame) -> DataFrame:
    return mapping.select(
        text.strip("data_id").alias("data_id"), text.strip("prompt_id").alias("prompt_id"), "ord"
    )


def unmatched(mapping: DataFrame, data: DataFrame, prompts: DataFrame) -> DataFrame:
    """Mapping rows that generate nothing, with the id that was not found.

    The prompt is looked at only where the data row is there.
    """
    rows = trimmed_mapping(mapping)
    data_ids = data.select(F.col("ID").alias("data_id"), F.lit(True).alias("_data"))
    prompt_ids = prompts.select("prompt_id", F.lit(True).alias("_prompt"))
    found = lookup_join(lookup_join(rows, data_ids, "data_id"), prompt_ids, "prompt_id")
    kind = F.when(F.col("_data").isNull(), "data_id").when(F.col("_prompt").isNull(), "prompt_id")
    return found.select(
        "ord",
        kind.alias("kind"),
        F.when(kind == "data_id", F.col("data_id")).otherwise(F.col("prompt_id")).alias("missing_id"),
    ).where("kind is not null")


def model_pairs(models: DataFrame, params: DataFrame) -> DataFrame:
    """Models with their parameter rows, numbered in grid order.

    Parameter rows belong to a model by name alone; the provider is the model's. ``pos`` is
    the place within all pairs of that model name, ``pairs`` their number, ``before`` the
    number of pairs of earlier names.
    """
    ranks = models.groupBy("name").agg(F.min("ord").alias("rank"))
    listed = models.select("name", F.col("provider").alias("provider_name"), F.col("ord").alias("m"))
    settings = params.select(
        F.col("model_name").alias("name"), *schemas.ALL_PARAMS, F.col("ord").alias("p")
    )
    pairs = listed.join(settings, "name").join(ranks, "name")
    numbered = with_dense_index(pairs, ["rank", "m", "p"], start=0, name="pair_idx")
    spans = numbered.groupBy("rank").agg(
        F.min("pair_idx").alias("before"), F.count("*").alias("pairs")
    )
    return numbered.join(spans, "rank").select(
        "pair_idx",
        "before",
        "pairs",
        (F.col("pair_idx") - F.col("before")).alias("pos"),
        F.col("name").alias("model_name"),
        "provider_name",
        *schemas.ALL_PARAMS,
    )


def matched(mapping: DataFrame, data: DataFrame, prompts: DataFrame) -> DataFrame:
    """Mapping rows that have data and prompt, numbered from 0 (ids only, written out)."""
    ids = data.select(F.col("ID").alias("data_id"))
    names = prompts.select("prompt_id")
    known = lookup_join(trimmed_mapping(mapping), ids, "data_id", "left_semi")
    known = lookup_join(known, names, "prompt_id", "left_semi")
    return with_dense_index(known, ["ord"], start=0, name="map_idx").drop("ord")


def render_rows(numbered: DataFrame, data: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompt text and hashes of the matched mapping rows.

    The join carries the data columns once; the JSON and the context are made after it.
    """
    columns = [c for c in data.columns if c not in ("ID", "ord")]
    raw = data.select(F.col("ID").alias("data_id"), *columns)
    # Hot prompts are looked for in the ids, before the data is joined.
    fits = estimated_bytes(prompts) <= broadcast_limit(data.sparkSession)
    hot = [] if fits else hot_keys(numbered, "prompt_id")
    rows = lookup_join(numbered, raw, "data_id", "inner")
    rows = lookup_join(rows, prompts, "prompt_id", "inner", hot=hot)
    rendered = rows.select(
        "map_idx",
        "data_id",
        "prompt_id",
        render_prompt("template", data_context("data_id", columns)).alias("prompt"),
        text.original_data("data_id", columns).alias("original_data"),
    )
    return rendered.select(
        "*",
        text.estimate_tokens("prompt").alias("tokens_estimate"),
        text.sha256_hex("prompt").alias("prompt_hash"),
        text.sha256_hex("original_data").alias("original_data_hash"),
    )


def _prepared(
    mapping: DataFrame, data: DataFrame, prompts: DataFrame, models: DataFrame, params: DataFrame
) -> tuple[DataFrame, DataFrame, int]:
    """The rendered mapping rows, the numbered pairs, and how many mapping rows there are."""
    check_unique(data, "ID")
    pairs = model_pairs(models, params)
    numbered = matched(mapping, data, prompts)
    return render_rows(numbered, data, prompts), pairs, numbered.count()


def _repeated(rendered: DataFrame, pairs: DataFrame, n_rows: int, *texts: str) -> DataFrame:
    """A grid row per rendered row and pair; ``texts`` are the columns of the rendered row to repeat."""
    n_pairs = pairs.count()
    if n_pairs:
        numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_pairs - 1).cast("bigint")))
    else:
        numbers = F.explode(F.array().cast("array<bigint>"))
    # All pairs have equally many rows: each is hot, or none.
    hot = list(range(n_pairs)) if n_pairs * HOT_SHARE <= 1 else []
    grid = lookup_join(rendered.withColumn("pair_idx", numbers), pairs, "pair_idx", "inner", hot=hot)
    row_id = (
        F.lit(n_rows) * F.col("before") + F.col("map_idx") * F.col("pairs") + F.col("pos") + 1
    ).cast("bigint")
    return grid.select(
        row_id.alias("ID"),
        text.combo_code("data_id", "prompt_id", "model_name", "profile_name").alias("code"),
        *texts,
        "model_name",
        "provider_name",
        text.provider_key("provider_name").alias("provider"),
        *schemas.ALL_PARAMS,
        "prompt_hash",
        "original_data_hash",
    )


def generate(
    mapping: DataFrame, data: DataFrame, prompts: DataFrame, models: DataFrame, params: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Grid rows with dense ids, and the mapping rows that were skipped.

    Each prompt is rendered and hashed once, then repeated per (model, parameters) pair by an
    exploded pair number and an equality join on it. The id is arithmetic on the numbers of
    the mapping row and the pair: models in list order, mapping order within a model.
    ``mapping``, ``models`` and ``params`` carry their row order in ``ord``.
    """
    rendered, pairs, n_rows = _prepared(mapping, data, prompts, models, params)
    rows = _repeated(rendered, pairs, n_rows, "prompt", "tokens_estimate", "original_data")
    return rows, unmatched(mapping, data, prompts)


def write_grid(
    mapping: DataFrame,
    data: DataFrame,
    prompts: DataFrame,
    models: DataFrame,
    params: DataFrame,
    path: str,
    rewrite: bool = False,
) -> DataFrame:
    """Store the rows of :func:`generate` by provider, each text once; gives the mapping rows that were skipped.

    ``path/texts`` has prompt and data text per mapping row (``map_idx``), ``path/rows`` all other
    columns of the grid; :func:`read_grid` puts them together. So what is written grows with the
    mapping, and not with the mapping times the pairs.
    """
    rendered, pairs, n_rows = _prepared(mapping, data, prompts, models, params)
    rendered.write.mode(write_mode(rewrite)).parquet(f"{path}/texts")
    stored = data.sparkSession.read.schema(rendered.schema).parquet(f"{path}/texts")
    rows = _repeated(stored, pairs, n_rows, "map_idx", "tokens_estimate")
    whole = experiment_columns(rows, "map_idx").drop(*TEXTS)
    whole.write.mode(write_mode(rewrite)).partitionBy("provider").parquet(f"{path}/rows")
    return unmatched(mapping, data, prompts)


def read_grid(spark: SparkSession, path: str, texts: bool = True) -> DataFrame:
    """The grid that :func:`write_grid` stored; with ``texts`` also prompt and data text, by a join."""
    rows = spark.read.parquet(f"{path}/rows")
    if texts:
        stored = spark.read.parquet(f"{path}/texts").select("map_idx", *TEXTS)
        rows = rows.join(stored, "map_idx")
    kept = [c for c in schemas.EXPERIMENT_COLUMNS if texts or c not in TEXTS]
    return rows.select(*kept, "provider")


def copy_papers(documents: DataFrame) -> DataFrame:
    """Extracted documents as a data table: one per stem, Markdown first, ids by file name."""
    rank = F.when(F.lower("ext") == "md", 0).otherwise(1)
    chosen = (
        documents.where(F.lower("ext").isin("md", "txt"))
        .groupBy("stem")
        .agg(
            F.min_by(F.struct("file_name", "content"), F.struct(rank, F.col("file_name"))).alias("f")
        )
        .select(F.col("f.file_name").alias("filename"), "f.content")
    )
    numbered = with_dense_index(chosen, ["filename"])
    return numbered.select(text.sequence_code("P", "idx").alias("ID"), "filename", "content")


def copy_search(records: DataFrame, order: list[str]) -> DataFrame:
    """Records as a data table, ids in row order, missing values as empty text."""
    missing = [c for c in COPY_COLUMNS if c not in records.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    numbered = with_dense_index(records.select(*COPY_COLUMNS, *order), order)
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COPY_COLUMNS}
    return numbered.select(
        text.sequence_code("S", "idx").alias("ID"),
        filled["title"].alias("Title"),
        filled["abstract"].alias("Abstract"),
        filled["doi"].alias("doi"),
        filled["authors"].alias("authors"),
    )
