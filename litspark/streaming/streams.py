"""Incremental forms of page flattening, first-seen records, runs and run statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litspark.functions.text import dedup_key
from litspark.operators import stats
from litspark.operators.inference import RESULT_SCHEMA, Client, pending, run_experiment
from litspark.session import materialize
from litspark.sources.pages import flatten_oa_pages, flatten_s2_pages, or_fail, parse_pages, raw_text, split_pages


def stream_pages(
    spark: SparkSession,
    landed: str,
    engine: int,
    out: str,
    checkpoint: str,
    layout: str = "lines",
    rejected: str | None = None,
) -> StreamingQuery:
    """Flatten pages as they land, each exactly once; ends when all landed pages are done.

    Pages that can't be read go to ``rejected``, by a query of its own over the same files, which is
    done before this returns; without it they end the stream with an error.
    """
    flatten = flatten_s2_pages if engine == 1 else flatten_oa_pages
    parsed = parse_pages(raw_text(spark, landed, layout, stream=True), engine, layout)
    if rejected is None:
        return run_available(flatten(or_fail(parsed)), out, checkpoint)
    good, bad = split_pages(parsed)
    run_available(bad, rejected, f"{checkpoint}-rejected").awaitTermination()
    return run_available(flatten(good), out, checkpoint)


def first_seen_batch(batch: DataFrame, number: int, keys: str, out: str, row_id: str = "ord") -> None:
    """Append the batch's records whose key is in no earlier batch; rows without a key all pass.

    The keys are a table with a folder per batch. A batch that is repeated writes its own folders
    anew and doesn't look at them, so it gives the same rows again.
    """
    spark = batch.sparkSession
    keyed = batch.withColumn("dedup_key", dedup_key())
    least = F.min(row_id).alias("_first")
    new = keyed.where("dedup_key IS NOT NULL").groupBy("dedup_key").agg(least)
    try:
        known = spark.read.parquet(keys).where(F.col("batch") < number).select("dedup_key")
        new = new.join(known, "dedup_key", "left_anti")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    new = materialize(new)
    firsts = keyed.join(new.select("dedup_key", F.col("_first").alias(row_id)), ["dedup_key", row_id], "left_semi")
    own = F.concat(F.lit("row:"), F.col(row_id).cast("string"))
    bare = keyed.where("dedup_key IS NULL").withColumn("dedup_key", own)
    firsts.unionByName(bare).write.mode("overwrite").parquet(f"{out}/batch={number}")
    new.select("dedup_key").write.mode("overwrite").parquet(f"{keys}/batch={number}")


def stream_first_seen(
    records: DataFrame, out: str, keys: str, checkpoint: str, row_id: str = "ord"
) -> StreamingQuery:
    """First record of every key, however late it comes.

    Keys seen are kept in the table ``keys`` and not in the state of the stream, so none is
    forgotten and no row is late. ``row_id`` tells which of a batch's rows is the first.
    """
    return (
        records.writeStream.foreachBatch(lambda batch, n: first_seen_batch(batch, n, keys, out, row_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stored_results(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(path)
    except AnalysisException as error:
        # Nothing stored yet. Anything else must not look like it: all calls would be paid again.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULT_SCHEMA)


def run_batch(
    rows: DataFrame, out: str, connect: Callable[[], Client], concurrency: int | None = None
) -> None:
    """Run the rows that have no stored success, and append their results.

    A batch that is repeated after its append finds its successes stored and calls only for the
    rows that failed.
    """
    stored = _stored_results(rows.sparkSession, out)
    done = stored.where("status = 'success'").select("provider", "ID")
    todo = pending(rows).join(done, ["provider", "ID"], "left_anti")
    run_experiment(todo, connect, concurrency).write.mode("append").parquet(out)


def stream_run(
    rows: DataFrame,
    out: str,
    checkpoint: str,
    connect: Callable[[], Client],
    concurrency: int | None = None,
) -> StreamingQuery:
    """Run experiment rows as they arrive."""
    return (
        rows.writeStream.foreachBatch(
            lambda batch, _: run_batch(batch, out, connect, concurrency)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stats_batch(batch: DataFrame, number: int, partial: str, event_time: str, window: str) -> None:
    """Sums of one batch per window and model, in a folder of its own: a repeat writes it anew."""
    spans: Column = F.window(event_time, window)
    timed = batch.withColumn(event_time, F.col(event_time).cast("timestamp"))
    stats.by_model_sums(timed, spans.alias("window")).write.mode("overwrite").parquet(f"{partial}/batch={number}")


def stream_run_stats(
    runs: DataFrame, partial: str, checkpoint: str, event_time: str = "ts", window: str = "1 hour"
) -> StreamingQuery:
    """Per-model sums per time window of what arrives; :func:`run_stats` adds them up.

    Every event counts when it comes: none is late, and the window at the end is there too.
    """
    return (
        runs.writeStream.foreachBatch(lambda batch, n: stats_batch(batch, n, partial, event_time, window))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_stats(spark: SparkSession, partial: str) -> DataFrame:
    """Totals per window and model over all batches so far."""
    return stats.add_up(spark.read.parquet(partial).drop("batch"), "window", "model_name")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows to Parquet until all available input is done."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
