import datetime

import pytest
from pyspark.sql import functions as F

from litspark.operators import stats
from litspark.streaming import state

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
KIND = "ts timestamp, model_name string, status string, total_tokens int, usage_tokens int, elapsed_seconds double"


def event(minutes, model="m"):
    at = None if minutes is None else START + datetime.timedelta(minutes=minutes)
    return (at, model, "success", 1, None, 0.5)


def land(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def windows(spark, tmp_path):
    landed, base = str(tmp_path / "landed"), str(tmp_path / "base")

    def run(*rows):
        if rows:
            land(spark, landed, list(rows), KIND)
        state.stream_windows(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(landed), base)
        closed = {r.window.start.hour: r.requests for r in state.closed_windows(spark, base).collect()}
        return closed, state.late_rows(spark, base).count()

    run.base = base
    return run


def test_windows_close_once_and_late_rows_are_kept(spark, windows):
    assert windows(event(10), event(50), event(70)) == ({}, 0)
    assert windows(event(20), event(250)) == ({0: 3, 1: 1}, 0)  # 20 was in time: nothing had closed before
    assert windows(event(30), event(None), event(200)) == ({0: 3, 1: 1}, 2)
    assert windows() == ({0: 3, 1: 1}, 2)
    closed, late = windows(event(10_000))
    assert late == 2 and closed == {0: 3, 1: 1, 3: 1, 4: 1}
    whole = {r.window.start.hour: (r.requests, r.tokens) for r in state.whole_windows(spark, windows.base).collect()}
    assert whole == {0: (4, 4), 1: (1, 1), 3: (1, 1), 4: (1, 1)}


def test_a_repeated_batch_parts_its_rows_alike(spark, tmp_path):
    store = state._set_late_aside(str(tmp_path), "ts", "1 hour", "1 hour")
    batches = [[event(10), event(300)], [event(20), event(290)], []]
    for number in (0, 1, 1, 2, 1):
        store(spark.createDataFrame(batches[number], KIND), number)
    rows = spark.read.parquet(f"{tmp_path}/parted").groupBy("batch", "late").count().collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 2), (1, 0, 1), (1, 1, 1)]


def test_sums_equal_a_batch_over_all(spark, windows):
    rows = [event(i * 37 % 600, f"m{i % 3}") for i in range(90)]
    windows(*rows[:30])
    windows(*rows[30:60])
    windows(*rows[60:], event(9999, None))
    whole = state.whole_windows(spark, windows.base)
    df = spark.createDataFrame(rows, KIND)
    want = stats.by_model(df, F.window("ts", "1 hour").alias("window")).select(whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, want.collect()))


def test_first_seen_over_restarts(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    kind = "doi string, title string, ord bigint"

    def run(*rows):
        land(spark, landed, list(rows), kind)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(landed)
        state.stream_first_seen(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.dedup_key, r.ord) for r in spark.read.parquet(out).collect())

    assert run(("10.1/A", "x", 5), ("10.1/a ", "y", 4), (None, None, 6)) == [("doi:10.1/a", 4), ("row:6", 6)]
    more = [("doi:10.1/a", 4), ("row:6", 6), ("title:t", 2)]
    assert run(("10.1/a", "old", 1), ("", "T", 2), (None, "t", 3)) == more
    assert run(("10.1/a", "again", 0)) == more
