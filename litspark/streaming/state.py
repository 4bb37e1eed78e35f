"""Streams that keep their memory in Spark's state store: first record per key, and time windows.

The store holds one row per key or open window, is read and written for the keys of a batch only, and
comes back from the checkpoint when a query starts again. Output of a batch goes to a folder of its
own, which a repeat of the batch writes anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litspark.functions.text import dedup_key
from litspark.operators import stats


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stream_first_seen(records: DataFrame, out: str, checkpoint: str, row_id: str = "ord") -> StreamingQuery:
    """First record of every key, each key in the batch in which it is met first.

    The state of a key is its first record and the times of the batches that first and last held it (a
    batch's time is fixed in the checkpoint). A key whose two times are one is new. Of the rows of
    one batch the one with the least ``row_id`` is the first. Rows without a key count each; their key
    is their ``row_id``. Rows of a frequent key shrink to one per task before they are shuffled.
    """
    keyed = records.withColumn(
        "dedup_key", F.coalesce(dedup_key(), F.concat(F.lit("row:"), F.col(row_id).cast("string")))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    kept = keyed.withColumn("_now", F.current_timestamp()).groupBy("dedup_key").agg(
        F.min_by(row, F.struct("_now", row_id)).alias("first"),
        F.min("_now").alias("since"),
        F.max("_now").alias("last"),
    )

    def store(batch: DataFrame, number: int) -> None:
        new = batch.where("since = last").select("dedup_key", "first.*")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        kept.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


CLOSED_SCHEMA = (
    "window struct<start: timestamp, end: timestamp>, model_name string, requests bigint, finished bigint, "
    "open bigint, tokens bigint, elapsed_seconds double"
)


def _window_end(event_time: str, window: str) -> Column:
    """End of the window of a time; ``F.window`` would drop the rows without one."""
    size = F.expr(f"CAST(unix_micros(TIMESTAMP '1970-01-01 00:00:00+00:00' + INTERVAL {window}) AS BIGINT)")
    begin = F.unix_micros(event_time) - F.pmod(F.unix_micros(event_time), size)
    return F.timestamp_micros(begin + size)


def _set_late_aside(base: str, event_time: str, window: str, delay: str):
    """Batch function: rows whose window was closed before the batch are late, the others in time.

    Windows close by the times of earlier batches only, so a batch that is repeated parts its rows in
    the same way.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        clock = _read(spark, f"{base}/clock", "at timestamp, batch int")
        latest = None
        if clock is not None:
            latest = clock.where(F.col("batch") < number).agg(F.max("at") - F.expr(f"INTERVAL {delay}")).first()[0]
        late = F.col(event_time).isNull()
        if latest is not None:
            # A null end is that of a row without a time.
            late = F.coalesce(_window_end(event_time, window) <= F.lit(latest), F.lit(True))
        marked = batch.withColumn("late", late.cast("int"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{base}/parted/batch={number}")
        seen = _read(spark, f"{base}/parted/batch={number}")
        if seen is None:
            return
        times = seen.agg(F.max(event_time).alias("at")).where("at IS NOT NULL")
        times.coalesce(1).write.mode("overwrite").parquet(f"{base}/clock/batch={number}")

    return store


def stream_windows(
    runs: DataFrame, base: str, event_time: str = "ts", window: str = "1 hour", delay: str = "1 hour"
) -> None:
    """Per-model sums of closed time windows of what has arrived, and late rows as a table of their own.

    Two queries run one after the other, each from its checkpoint under ``base``: the first parts rows
    by whether their window was closed by earlier batches, the second keeps the sums of open windows as
    state under a watermark of ``delay`` and writes a window once, when it closes, and forgets it. Rows
    it gets are never late for it, so nothing is dropped. Rows without a time are with the late ones.
    """
    runs = runs.withColumn(event_time, F.col(event_time).cast("timestamp"))
    parted = (
        runs.writeStream.foreachBatch(_set_late_aside(base, event_time, window, delay))
        .option("checkpointLocation", f"{base}/checkpoint-parted")
        .trigger(availableNow=True)
        .start()
    )
    parted.awaitTermination()
    spark = runs.sparkSession
    if _read(spark, f"{base}/parted") is None:
        return
    in_time = (
        spark.readStream.schema(runs.schema.add("late", "integer").add("batch", "integer"))
        .option("maxFilesPerTrigger", 1 << 20)
        .parquet(f"{base}/parted")
        .where("late = 0")
        .withWatermark(event_time, delay)
    )
    spans: Column = F.window(event_time, window)
    closed = stats.by_model_sums(in_time, spans.alias("window"))
    query = (
        closed.writeStream.format("parquet")
        .option("path", f"{base}/closed")
        .option("checkpointLocation", f"{base}/checkpoint-closed")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def closed_windows(spark: SparkSession, base: str) -> DataFrame:
    """Sums of the windows closed so far; each is there once."""
    found = _read(spark, f"{base}/closed", CLOSED_SCHEMA)
    return spark.createDataFrame([], CLOSED_SCHEMA) if found is None else found


def late_rows(spark: SparkSession, base: str) -> DataFrame:
    """Rows that came after their window was closed."""
    return spark.read.parquet(f"{base}/parted").where("late = 1")


def whole_windows(spark: SparkSession, base: str, event_time: str = "ts", window: str = "1 hour") -> DataFrame:
    """Totals per closed window and model with the late rows added."""
    late = stats.by_model_sums(late_rows(spark, base), F.window(event_time, window).alias("window"))
    return stats.add_up(closed_windows(spark, base).unionByName(late), "window", "model_name")
