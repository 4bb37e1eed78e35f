import datetime
import hashlib
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from litspark import schemas
from litspark.operators import inference, stats
from litspark.operators.offline import connect_offline
from litspark.sources import writers
from litspark.streaming import streams

COLUMNS = [c for c in schemas.EXPERIMENT_COLUMNS if c != "response_json"] + ["provider"]


@pytest.fixture
def rows(spark):
    kinds = ", ".join(f"{c} {schemas.EXPERIMENT_TYPES.get(c, 'string')}" for c in COLUMNS)

    def make(*given):
        full = []
        for i, row in enumerate(given, start=1):
            values = dict.fromkeys(COLUMNS) | {
                "ID": i, "code": f"c{i}", "model_name": "m", "provider_name": "Ollama", "provider": "ollama",
                "prompt": "x" * 40, "profile_name": "base",
            } | row
            full.append(tuple(values[c] for c in COLUMNS))
        return spark.createDataFrame(full, kinds)

    return make


REFUSED = next(p for p in (f"prompt {i}" for i in range(1000)) if hashlib.md5(p.encode()).hexdigest()[0] == "0")


def test_run_and_merge(rows):
    df = rows({}, {"prompt": REFUSED}, {"status": "success", "response_text": "kept", "call_count": 1}, {"call_count": 2})
    results = inference.resume(df, connect_offline, concurrency=3)
    assert sorted(r["ID"] for r in results.collect()) == [1, 2, 4]
    merged = {r["ID"]: r for r in inference.merge_results(df, results).collect()}
    assert (merged[1]["status"], merged[1]["state"], merged[1]["total_tokens"], merged[1]["call_count"]) == ("success", "finished", 10, 1)
    assert merged[1]["response_text"] == "m read 40 characters"
    assert (merged[2]["status"], merged[2]["state"], merged[2]["usage_tokens"], merged[2]["total_tokens"]) == (
        "Error: refused", "error", None, 0)
    assert merged[3]["response_text"] == "kept" and merged[4]["call_count"] == 3
    assert merged[1]["elapsed_seconds"] >= 0 and isinstance(merged[1]["timestamp"], datetime.datetime)


def test_second_run_does_nothing(rows):
    df = rows({}, {})
    done = inference.merge_results(df, inference.resume(df, connect_offline))
    assert inference.resume(done, connect_offline).count() == 0


def test_merge_takes_only_given_columns(spark, rows):
    df = rows({"response_text": "old", "status": "Error: x"}, {"response_text": "other"})
    results = spark.createDataFrame([("ollama", 1, "success", None)], "provider string, ID bigint, status string, state string")
    merged = {r["ID"]: r for r in inference.merge_results(df, results).collect()}
    assert (merged[1]["status"], merged[1]["state"], merged[1]["response_text"]) == ("success", None, "old")
    assert (merged[2]["status"], merged[2]["response_text"]) == (None, "other")


def test_response_json(rows):
    df = rows({"temperature": 0.5, "max_tokens": 9})
    results = inference.run_experiment(df, connect_offline)
    kept = json.loads(inference.with_response_json(df, results).first()["response_json"])
    assert list(kept) == ["model", "provider", "prompt", "profile", "response_text", "usage_tokens", "status", "timestamp", "raw_response"]
    assert kept["raw_response"] == {"size": 40, "params": {"temperature": 0.5, "extra_body": {"num_predict": 9}}}


def test_client_is_made_once_per_task(spark, rows):
    def connect():
        calls = []

        def complete(request):
            calls.append(1)
            return {"text": str(len(calls)), "tokens": None}

        return complete

    df = rows(*[{}] * 6).coalesce(1)
    results = inference.run_experiment(df, connect).collect()
    assert sorted(int(r["response_text"]) for r in results) == [1, 2, 3, 4, 5, 6]
    assert {(r["usage_tokens"], r["total_tokens"]) for r in results} == {(None, 0)}


def test_pick_rows(rows):
    df = rows({"code": "a"}, {"code": "1", "provider": "vllm"}, {"code": "z"})
    assert sorted(r["ID"] for r in inference.pick(df, "1").collect()) == [1, 2]
    assert [r["ID"] for r in inference.pick(df, "z").collect()] == [3]
    assert [r["ID"] for r in inference.pick(df, 3).collect()] == [3]
    assert [r["ID"] for r in inference.for_provider(df, "VLLM").collect()] == [2]
    assert inference.for_provider(df, "none").count() == 0
    assert inference.pending(df).count() == 3


def test_run_one(rows):
    df = rows({"status": "success"}, {"code": "x"})
    assert [r["ID"] for r in inference.run_one(df, 1, connect_offline).collect()] == [1]
    assert [r["ID"] for r in inference.run_one(df, "x", connect_offline).collect()] == [2]
    with pytest.raises(ValueError):
        inference.run_one(df, "nothing", connect_offline)


def test_write_responses(spark, rows, tmp_path):
    df = rows({"provider": "vllm"}, {})
    results = inference.run_experiment(df, connect_offline)
    kept = inference.with_response_json(df, results)
    writers.write_responses(kept, str(tmp_path / "responses"))
    stored = spark.read.json(str(tmp_path / "responses"))
    assert sorted(r["provider"] for r in stored.collect()) == ["ollama", "vllm"]
    assert len(list((tmp_path / "responses").glob("provider=*"))) == 2


def test_across_providers(spark):
    a = spark.createDataFrame([(1, 2)], "ID bigint, openai_seed int")
    b = spark.createDataFrame([(0, "low")], "ID bigint, gemini_thinking_level string")
    got = inference.by_id(inference.across_providers(a, b)).collect()
    assert [tuple(r) for r in got] == [(0, None, "low"), (1, 2, None)]


def test_defaults(rows):
    r = inference.with_defaults(rows({"prompt": None})).first()
    assert (r["prompt"], r["response_text"], r["call_count"], r["elapsed_seconds"], r["status"]) == ("", "", 0, 0.0, None)


def test_run_statistics(rows):
    df = rows({}, {"model_name": "n"})
    assert {r["model_name"]: r["open"] for r in stats.by_model(df).collect()} == {"m": 1, "n": 1}
    done = {"status": "success", "total_tokens": 42, "elapsed_seconds": 2.0}
    df = rows(done, done | {"total_tokens": None, "usage_tokens": 40, "elapsed_seconds": None}, {"status": "ERROR: x", "state": "running", "total_tokens": 5},
              {"model_name": "n", "provider": "vllm", "status": "error"})
    assert stats.run_totals(df).first().asDict() == {"total": 4, "finished": 2, "running": 1, "errors": 2, "total_tokens": 87}
    got = {r["model_name"]: r for r in stats.by_model(df).collect()}
    assert (got["m"]["requests"], got["m"]["finished"], got["m"]["tokens"], got["m"]["elapsed_seconds"], got["m"]["avg_elapsed_seconds"]) == (3, 2, 82, 2.0, 1.0)
    assert (got["n"]["finished"], got["n"]["avg_elapsed_seconds"]) == (0, 0.0)
    assert {r["provider"]: r["requests"] for r in stats.by_provider(df).collect()} == {"ollama": 3, "vllm": 1}


def test_stream_run_skips_stored_successes(spark, rows, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = rows({}, {"prompt": REFUSED}, {"status": "success"}, {})
    df.write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(df.schema).parquet(source)
        streams.stream_run(stream, out, str(tmp_path / checkpoint), connect_offline).awaitTermination()
        return [(r["ID"], r["status"]) for r in spark.read.parquet(out).orderBy("ID", "timestamp").collect()]

    bad = (2, "Error: refused")
    assert run("one") == [(1, "success"), bad, (4, "success")]
    assert run("one") == [(1, "success"), bad, (4, "success")]
    # A replay from the start repeats the failed row alone.
    assert run("two") == [(1, "success"), bad, bad, (4, "success")]


def test_merge_takes_one_result_of_several(spark, rows):
    t = datetime.datetime(2026, 1, 1)
    kinds = "provider string, ID bigint, status string, response_text string, timestamp timestamp_ntz"
    results = spark.createDataFrame(
        [("ollama", 1, "success", "first", t), ("ollama", 1, "success", "second", t.replace(day=2)),
         ("ollama", 1, "Error: late", "", t.replace(day=3)), ("ollama", 2, "Error: a", "", t), ("ollama", 2, "Error: b", "", t.replace(day=2))], kinds)
    merged = [(r["ID"], r["status"], r["response_text"]) for r in inference.merge_results(rows({}, {}, {}), results).orderBy("ID").collect()]
    assert merged == [(1, "success", "second"), (2, "Error: b", ""), (3, None, None)]


def test_stream_first_seen_keeps_late_rows(spark, tmp_path):
    rows = [(f"d{i % 5}" if i % 3 else "hot", None, i) for i in range(300)] + [(None, None, 900), (None, " ", 901)]
    df = spark.createDataFrame(rows, "doi string, title string, ord bigint")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run():
        streams.stream_first_seen(stream, out, str(tmp_path / "keys"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r["dedup_key"] for r in spark.read.parquet(out).collect())

    want = [f"doi:d{i}" for i in range(5)] + ["doi:hot", "row:900", "row:901"]
    assert run() == sorted(want)
    late = spark.createDataFrame([("d1", None, -5), ("new", None, -4), (None, None, -3)], df.schema)
    late.coalesce(1).write.mode("append").parquet(source)
    assert run() == sorted([*want, "doi:new", "row:-3"])
    streams.first_seen_batch(late, 4, str(tmp_path / "keys"), out)  # a replay of the batch
    assert run() == sorted([*want, "doi:new", "row:-3"])


def test_stream_stats_equal_batch(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    rows = [(start + datetime.timedelta(minutes=7 * i), f"m{i % 2}", "success" if i % 3 else None, i, None, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, model_name string, status string, total_tokens int, usage_tokens int, elapsed_seconds double")
    df.orderBy(F.desc("ts")).repartitionByRange(3, F.desc("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_run_stats(stream, str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination()
    got = streams.run_stats(spark, str(tmp_path / "sums"))
    batch = stats.by_model(df.withColumn("ts", F.col("ts").cast("timestamp")), F.window("ts", "1 hour").alias("window"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(got.columns).collect()))
    assert got.agg(F.sum("requests")).first()[0] == 60


def test_stream_pages_set_aside(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    page = lambda i: {"page_no": i, "data": [{"paperId": str(i), "title": "T", "authors": []}]}
    (landed / "a.json").write_text(json.dumps([page(1), page(2)], indent=2))
    (landed / "b.json").write_text('[{"page_no": 3, "data"')
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    streams.stream_pages(spark, str(landed), 1, out, str(tmp_path / "cp"), "array", bad).awaitTermination()
    assert sorted(r["search_engine_internal_id"] for r in spark.read.parquet(out).collect()) == ["1", "2"]
    assert spark.read.parquet(bad).count() == 1
    with pytest.raises(StreamingQueryException):
        streams.stream_pages(spark, str(landed), 1, str(tmp_path / "o2"), str(tmp_path / "cp2"), "array").awaitTermination()


def test_stream_pages_once(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()

    def land(name, ids):
        works = [{"paperId": i, "title": f"T {i}", "authors": []} for i in ids]
        (landed / name).write_text(json.dumps({"page_no": 1, "data": works}) + "\n")

    def run():
        streams.stream_pages(spark, str(landed), 1, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r["search_engine_internal_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    land("a.json", ["1", "2"])
    assert run() == ["1", "2"]
    land("b.json", ["3"])
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]
