"""Running the rows of an experiment, picking rows, and writing results back."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark import schemas
from litspark.functions.requests import provider_request, raw_response, response_payload

# A client takes one request (model, prompt, params) and returns text, tokens and raw answer.
Client = Callable[[dict], dict]

RESULT_SCHEMA = (
    "provider string, ID bigint, response_text string, usage_tokens int, status string, "
    "state string, call_count int, total_tokens int, elapsed_seconds double, "
    "timestamp timestamp, raw string"
)
RESULT_ARROW = pa.schema(
    [
        ("provider", pa.string()), ("ID", pa.int64()), ("response_text", pa.string()), ("usage_tokens", pa.int32()),
        ("status", pa.string()), ("state", pa.string()), ("call_count", pa.int32()), ("total_tokens", pa.int32()),
        ("elapsed_seconds", pa.float64()), ("timestamp", pa.timestamp("us", "UTC")), ("raw", pa.string()),
    ]
)
# Rows of a batch that a task takes out of it at a time.
ROWS = 200


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[list[dict]]:
    """Rows of Arrow batches as dicts, few at a time, however large a batch is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pylist()


def pending(rows: DataFrame) -> DataFrame:
    """Rows without a successful result."""
    return rows.where(~F.col("status").eqNullSafe("success"))


def pick(rows: DataFrame, id_or_code: int | str) -> DataFrame:
    """The row with this number or this code."""
    match = F.col("code") == str(id_or_code)
    try:
        match = match | (F.col("ID") == int(id_or_code))
    except ValueError:
        pass
    return rows.where(match)


def for_provider(rows: DataFrame, provider: str) -> DataFrame:
    """Rows of one provider in any case; only that partition of a stored table is read."""
    return rows.where(F.col("provider") == provider.lower())


def across_providers(*tables: DataFrame) -> DataFrame:
    """Tables of several providers as one; columns a provider lacks are null."""
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def with_defaults(rows: DataFrame) -> DataFrame:
    """Result columns of rows not run yet as empty text and zero."""
    texts = ["prompt", "model_name", "provider_name", "profile_name", "response_text"]
    numbers = {"call_count": 0, "total_tokens": 0, "elapsed_seconds": 0.0}
    filled = {c: F.coalesce(c, F.lit("")) for c in texts}
    filled |= {c: F.coalesce(c, F.lit(zero)) for c, zero in numbers.items()}
    return rows.withColumns({c: value for c, value in filled.items() if c in rows.columns})


def _call(client: Client, request: dict) -> dict:
    """One call; an exception becomes a result with an error status."""
    started = time.monotonic()
    try:
        answer = client(request)
        text, tokens, raw = answer.get("text") or "", answer.get("tokens"), answer.get("raw")
        status, state = "success", "finished"
        raw = None if raw is None else json.dumps(raw, ensure_ascii=False)
    except Exception as error:  # one bad row must not end the batch
        text, tokens, raw = "", None, None
        status, state = f"Error: {error}", "error"
    return {
        "response_text": text,
        "usage_tokens": tokens,
        "status": status,
        "state": state,
        "total_tokens": tokens or 0,
        "elapsed_seconds": time.monotonic() - started,
        "timestamp": datetime.now(UTC).replace(tzinfo=None),
        "raw": raw,
    }


def run_experiment(
    rows: DataFrame, connect: Callable[[], Client], concurrency: int | None = None
) -> DataFrame:
    """Results of calling a model once per row, keyed by ``(provider, ID)``.

    ``connect`` makes a client; it is called once per task. ``concurrency`` spreads the rows
    evenly over that many tasks and so bounds the calls made at a time. Only what a call
    needs goes to Python, and the prompt does not come back.
    """
    requests = rows.select(
        "provider",
        "ID",
        F.col("model_name").alias("model"),
        "prompt",
        provider_request("provider").alias("params"),
        F.coalesce("call_count", F.lit(0)).alias("calls"),
    )
    if concurrency:
        requests = requests.repartition(concurrency, "provider", "ID")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = connect()
        for part in in_slices(batches):
            results = []
            for row in part:
                asked = {"model": row["model"], "prompt": row["prompt"], "params": json.loads(row["params"])}
                key = {"provider": row["provider"], "ID": row["ID"], "call_count": row["calls"] + 1}
                results.append(_call(client, asked) | key)
            yield pa.RecordBatch.from_pylist(results, schema=RESULT_ARROW)

    return requests.mapInArrow(run, RESULT_SCHEMA)


def merge_results(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows with the given result columns of ``results`` written over theirs, by ``(provider, ID)``.

    A matched row takes the result's value also where that is null. Of several results of one row
    a success counts before an error, and the newest of its kind.
    """
    keys = ["provider", "ID"]
    given = [c for c in results.columns if c in rows.columns and c not in keys]
    rank = [F.col("status") == "success"] if "status" in results.columns else []
    rank += [F.col(c) for c in ("timestamp", "call_count") if c in results.columns]
    best = F.max_by(F.struct(F.lit(True).alias("_hit"), *given), F.struct(*rank, F.xxhash64(*given)))
    renamed = results.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, "_best._hit", *[F.col(f"_best.{c}").alias(f"_new_{c}") for c in given]
    )
    joined = rows.join(renamed, keys, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else c
            for c in rows.columns
        ]
    )


def with_response_json(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the document kept per call; request fields come from the rows."""
    keys = ["provider", "ID"]
    asked = rows.select(*keys, "model_name", "prompt", "profile_name")
    payload = response_payload(raw_response("raw"))
    return results.join(asked, keys).select(
        *results.drop("raw").columns, payload.alias("response_json")
    )


def resume(rows: DataFrame, connect: Callable[[], Client], concurrency: int | None = None) -> DataFrame:
    """Results for the rows that have no success yet.

    Write them before merging: a table read twice from the calls would call twice.
    """
    return run_experiment(pending(rows), connect, concurrency)


def run_one(rows: DataFrame, id_or_code: int | str, connect: Callable[[], Client]) -> DataFrame:
    """Result of one row, run whether or not it has been run before."""
    chosen = pick(rows, id_or_code)
    if chosen.isEmpty():
        raise ValueError(f"no row with id {id_or_code!r}")
    return run_experiment(chosen.orderBy("ID").limit(1), connect)


def by_id(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ID")
