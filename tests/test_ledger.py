import os

import pytest
from pyspark.sql import functions as F

from litspark.operators import ledger
from litspark.operators.offline import connect_dying, connect_offline

KINDS = """provider string, ID bigint, model_name string, prompt string, temperature double, top_p double, max_tokens int,
    ollama_context_window int, ollama_repeat_penalty double, vllm_min_p double, vllm_best_of int, openai_seed int,
    gemini_thinking_level string, status string, call_count int, response_text string"""


@pytest.fixture
def rows(spark):
    n = KINDS.count(",") + 1
    made = [("ollama", i, "m", f"prompt {i}", *[None] * (n - 4)) for i in range(1, 41)]
    return spark.createDataFrame(made, KINDS)


def logging_client(log, inner=connect_offline):
    """Clients that note every prompt they are asked, in a file per process."""

    def connect():
        answer = inner()

        def complete(request):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(request["prompt"] + "\n")
            return answer(request)

        return complete

    return connect


def asked(log):
    return [line for name in os.listdir(log) for line in open(f"{log}/{name}").read().splitlines()]


def test_a_lost_task_keeps_its_chunks(spark, rows, tmp_path):
    kept, first, second = (str(tmp_path / n) for n in ("ledger", "first", "second"))
    os.mkdir(first), os.mkdir(second)
    with pytest.raises(Exception, match="TaskLost"):
        ledger.run_logged(rows, kept, logging_client(first, connect_dying(10)), concurrency=1, chunk_rows=4)
    before = ledger.read_ledger(spark, kept).collect()
    assert len(before) == 8  # ten answers, two full chunks
    left = ledger.run_logged(rows, kept, logging_client(second), concurrency=2, chunk_rows=4)
    good = {r.ID for r in before if r.status == "success"}
    assert left == 40 - len(good) and {int(p.split()[1]) for p in asked(second)} == set(range(1, 41)) - good
    merged = {r.ID: r for r in ledger.settled(rows, kept).collect()}
    assert len(merged) == 40 and all(r.status for r in merged.values())
    refused = [r.ID for r in merged.values() if r.status == "Error: refused"]
    assert ledger.run_logged(rows, kept, connect_offline) == len(refused)
    attempts = {r.ID: r.n for r in ledger.read_ledger(spark, kept).groupBy("ID").agg(F.max("attempt").alias("n")).collect()}
    assert all(attempts[i] >= 2 for i in refused)


def test_next_attempt_of_a_task_goes_on(spark, tmp_path):
    """A task that finds chunks of its own run leaves those rows out."""
    chunks = ledger._Chunks(str(tmp_path), "r", 3, 2, 60)
    answer = dict.fromkeys(ledger._ARROW.names) | {"provider": "p", "status": "success"}
    for i in range(5):
        chunks.add(answer | {"ID": i})
    assert ledger._Chunks(str(tmp_path), "r", 3, 2, 60).answered() == {("p", i) for i in range(4)}
    assert ledger._Chunks(str(tmp_path), "r", 4, 2, 60).answered() == set()
    chunks.commit()
    assert ledger.read_ledger(spark, str(tmp_path)).count() == 5


def test_process_that_ends_without_a_word(spark, rows, tmp_path):
    """The worker process itself ends; what it had written is there, and nothing half written."""

    def connect():
        answer, left = connect_offline(), 7

        def complete(request):
            nonlocal left
            left -= 1
            if left < 0:
                os._exit(1)
            return answer(request)

        return complete

    kept = f"file://{tmp_path}/ledger"
    with pytest.raises(Exception):
        ledger.run_logged(rows, kept, connect, concurrency=1, chunk_rows=3)
    assert ledger.read_ledger(spark, kept).count() == 6
    ledger.run_logged(rows, kept, connect_offline)
    assert ledger.read_ledger(spark, kept).select("ID").distinct().count() == 40


def test_nothing_to_do(spark, rows, tmp_path):
    done = rows.withColumn("status", F.lit("success"))
    assert ledger.run_logged(done, f"{tmp_path}/ledger", connect_offline) == 0
    assert ledger.read_ledger(spark, f"{tmp_path}/none").count() == 0


def test_a_closed_run_keeps_nothing_more(spark, tmp_path):
    """A task that outlives its job, when a later run has looked at the ledger."""
    chunks = ledger._Chunks(str(tmp_path), "r", 0, 1, 60)
    answer = dict.fromkeys(ledger._ARROW.names) | {"provider": "p", "status": "success"}
    chunks.add(answer | {"ID": 1})
    ledger.close_runs(str(tmp_path))
    with pytest.raises(ledger.RunClosed):
        chunks.add(answer | {"ID": 2})
    assert [r.ID for r in ledger.read_ledger(spark, str(tmp_path)).collect()] == [1]
    ledger.close_runs(str(tmp_path / "none"))
