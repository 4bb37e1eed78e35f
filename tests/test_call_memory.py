import sys

import pyarrow as pa

from litspark.operators import inference


def test_rows_leave_a_batch_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"ID": list(range(1001)), "prompt": ["p"] * 1001})
    parts = list(inference.in_slices(iter([batch, batch.slice(0, 0)])))
    assert max(map(len, parts)) <= inference.ROWS
    assert [r["ID"] for p in parts for r in p] == list(range(1001))


def test_calls_give_their_results_on_as_they_come(spark):
    """A task of many rows holds a part of them at a time: the client sees answers go before the last row is read."""
    rows = spark.range(1000).coalesce(1).selectExpr(
        "'vllm' AS provider", "id AS ID", "'m' AS model_name", "repeat('x', 10) AS prompt", "CAST(NULL AS INT) AS call_count",
        "CAST(NULL AS DOUBLE) AS temperature", "CAST(NULL AS DOUBLE) AS top_p", "CAST(NULL AS INT) AS max_tokens",
        "CAST(NULL AS INT) AS ollama_context_window", "CAST(NULL AS DOUBLE) AS ollama_repeat_penalty",
        "CAST(NULL AS DOUBLE) AS vllm_min_p", "CAST(NULL AS INT) AS vllm_best_of", "CAST(NULL AS INT) AS openai_seed",
        "CAST(NULL AS STRING) AS gemini_thinking_level",
    )

    def connect():
        def answer(request):
            # The longest list or table of Python objects that the task holds.
            held, frame = 0, sys._getframe(1)
            while frame is not None:
                held = max([held, *(len(v) for v in frame.f_locals.values() if type(v).__name__ in ("list", "DataFrame"))])
                frame = frame.f_back
            return {"text": str(held), "tokens": 1}

        return answer

    got = inference.run_experiment(rows, connect).collect()
    assert len(got) == 1000 and {r["status"] for r in got} == {"success"}
    assert max(int(r["response_text"]) for r in got) <= inference.ROWS
