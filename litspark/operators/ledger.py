"""Ledger of calls: answers are kept in small chunks while a task still runs.

A run through :func:`run_logged` writes each answer to the ledger, a folder of Parquet files, a few
answers at a time. A chunk is written under a hidden name and then moved to its own, so a reader
sees it whole or not at all. If a task dies, its answers but those of the chunk being filled are
there; the attempt that Spark starts in its place, and any later run, calls for the rest only.

Rows are dealt by ``(provider, ID)``, so an attempt gets the rows of the one before, and finds that
one's chunks in the folder of the run and the task. ``attempt`` counts a row's calls.

Tasks of a job that failed may go on for a moment. So a run closes all earlier ones before it looks at what
is answered: a chunk of a closed run is not kept, and its task ends. At most one run of a ledger is open.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions.requests import provider_request
from litspark.operators.inference import RESULT_ARROW, RESULT_SCHEMA, Client, _call, in_slices, merge_results, pending

LEDGER_SCHEMA = f"{RESULT_SCHEMA}, attempt int, run string, task int"
_KEYS = ["provider", "ID"]
_ARROW = RESULT_ARROW.append(pa.field("attempt", pa.int32()))


_CLOSED = "_closed"


class RunClosed(RuntimeError):
    """The run of a task has been closed by a later one."""


def close_runs(ledger: str) -> None:
    """Close all runs that are open; their tasks keep no more answers."""
    files, base = fs.FileSystem.from_uri(ledger)
    for run in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        mark = f"{run.path}/{_CLOSED}"
        if run.base_name.startswith("run=") and files.get_file_info(mark).type == fs.FileType.NotFound:
            files.open_output_stream(mark).close()


class _Chunks:
    """Writer of one task's chunks."""

    def __init__(self, folder: str, run: str, task: int, rows: int, seconds: float):
        # A path, or a URI of a store that Arrow can write to (local, HDFS, S3, GCS).
        self.files, base = fs.FileSystem.from_uri(folder)
        self.closed = f"{base}/run={run}/{_CLOSED}"
        self.base, self.rows, self.seconds = f"{base}/run={run}/task={task}", rows, seconds
        self.held: list[dict] = []
        self.files.create_dir(self.base, recursive=True)

    def answered(self) -> set[tuple[str, int]]:
        """Rows whose answers an earlier attempt of this task has kept."""
        done: set[tuple[str, int]] = set()
        for found in self.files.get_file_info(fs.FileSelector(self.base)):
            if not found.base_name.startswith("_"):
                chunk = pq.read_table(self.files.open_input_file(found.path), columns=_KEYS)
                done |= set(zip(*(chunk.column(k).to_pylist() for k in _KEYS)))
        return done

    def add(self, answer: dict) -> None:
        if not self.held:
            self.since = time.monotonic()
        self.held.append(answer)
        if len(self.held) >= self.rows or time.monotonic() - self.since >= self.seconds:
            self.commit()

    def commit(self) -> None:
        if not self.held:
            return
        name = f"{uuid.uuid4().hex}.parquet"
        hidden = f"{self.base}/_{name}"
        table = pa.Table.from_pylist(self.held, schema=_ARROW)
        with self.files.open_output_stream(hidden) as out:
            pq.write_table(table, out)
        if self.files.get_file_info(self.closed).type != fs.FileType.NotFound:
            raise RunClosed("a later run of this ledger has closed the one of this task")
        self.files.move(hidden, f"{self.base}/{name}")
        self.held = []


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All answers kept so far; none where there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as error:
        # Anything else must not look like an empty ledger: all calls would be paid again.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def unanswered(rows: DataFrame, ledger: str) -> DataFrame:
    """Rows without a success, in the table or in the ledger; ``_made`` is the calls made so far."""
    kept = read_ledger(rows.sparkSession, ledger).groupBy(*_KEYS).agg(
        F.max("attempt").alias("_made"), F.max(F.col("status") == "success").alias("_good")
    )
    return pending(rows).join(kept, _KEYS, "left").where(~F.coalesce("_good", F.lit(False))).drop("_good")


def run_logged(
    rows: DataFrame,
    ledger: str,
    connect: Callable[[], Client],
    concurrency: int | None = None,
    chunk_rows: int = 16,
    chunk_seconds: float = 5.0,
) -> int:
    """Call for every row that has no success yet and keep the answers; gives the number of calls.

    At most ``chunk_rows`` answers, or those of ``chunk_seconds``, are lost with a task. ``concurrency``
    bounds the calls made at a time. Errors of a call are answers; a task that dies fails the job once
    Spark gives up on it, and the ledger holds what it had answered.
    """
    close_runs(ledger)
    todo = unanswered(rows, ledger).select(
        *_KEYS,
        F.col("model_name").alias("model"),
        "prompt",
        provider_request("provider").alias("params"),
        F.greatest(F.coalesce("call_count", F.lit(0)), F.coalesce("_made", F.lit(0))).alias("calls"),
    )
    dealt = todo.repartition(concurrency, *_KEYS) if concurrency else todo.repartition(*_KEYS)
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunks = _Chunks(ledger, run_id, TaskContext.get().partitionId(), chunk_rows, chunk_seconds)
        done = chunks.answered()
        client, made = None, 0
        for row in (row for part in in_slices(batches) for row in part):
            if (row["provider"], row["ID"]) in done:
                continue
            client = client or connect()
            request = {"model": row["model"], "prompt": row["prompt"], "params": json.loads(row["params"])}
            count = row["calls"] + 1
            chunks.add(_call(client, request) | {"provider": row["provider"], "ID": row["ID"], "call_count": count, "attempt": count})
            made += 1
        chunks.commit()
        yield pa.RecordBatch.from_pydict({"made": [made]})

    try:
        return dealt.mapInArrow(run, "made bigint").agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]
    finally:
        close_runs(ledger)


def settled(rows: DataFrame, ledger: str) -> DataFrame:
    """Rows with the best answer of the ledger written over theirs: a success first, then the newest."""
    answers = read_ledger(rows.sparkSession, ledger).drop("attempt", "run", "task")
    return merge_results(rows, answers)
