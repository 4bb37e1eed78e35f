import os
import threading

import pytest
from pyspark.sql import functions as F

from litspark.operators import stats
from litspark.sources import versions

KIND = """provider string, ID bigint, model_name string, status string, state string, response_text string,
    usage_tokens int, total_tokens int, elapsed_seconds double, call_count int, timestamp timestamp"""


@pytest.fixture
def rows(spark):
    made = [("p" if i % 3 else "q", i, f"m{i % 2}", None, None, None, None, None, None, None, None) for i in range(200)]
    return spark.createDataFrame(made, KIND)


def answers(spark, ids, status="success", tokens=4):
    made = [("p" if i % 3 else "q", i, status, "finished", f"a{i}", tokens, tokens, 0.5, 1) for i in ids]
    return spark.createDataFrame(
        made, "provider string, ID bigint, status string, state string, response_text string, usage_tokens int, "
        "total_tokens int, elapsed_seconds double, call_count int")


def files(root):
    return {f"{d}/{f}" for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def seen(df):
    return {(r.provider, r.ID): r.response_text for r in df.collect()}


def test_merge_rewrites_what_it_touches(spark, rows, tmp_path):
    root = str(tmp_path / "t")
    assert versions.latest(spark, root) is None
    assert versions.create(rows, root, width=10) == 1
    before = files(root)
    assert versions.merge(answers(spark, [31, 32]), root) == 2
    assert len(files(root) - before) == 1 and before <= files(root)
    now, old = seen(versions.read_version(spark, root)), seen(versions.read_version(spark, root, 1))
    assert len(now) == len(old) == 200 and not any(old.values())
    assert {k: v for k, v in now.items() if v} == {("p", 31): "a31", ("p", 32): "a32"}
    # Answers to rows that are not there change nothing.
    assert versions.merge(answers(spark, [10**6]), root) == 3
    assert seen(versions.read_version(spark, root)) == now
    assert versions.versions(spark, root) == [1, 2, 3]


def test_two_writers_one_commits(spark, rows, tmp_path):
    root = str(tmp_path / "t")
    versions.create(rows, root, width=50)
    outcome = []
    gate = threading.Barrier(2)

    def write(i):
        gate.wait()
        try:
            outcome.append((versions.merge(answers(spark, [i]), root, parent=1), i))
        except versions.VersionConflict as error:
            outcome.append((str(error), i))

    threads = [threading.Thread(target=write, args=(i,)) for i in (1, 101)]
    [t.start() for t in threads], [t.join() for t in threads]
    won = [i for n, i in outcome if n == 2]
    assert len(won) == 1 and len(outcome) == 2
    assert {k[1] for k, v in seen(versions.read_version(spark, root)).items() if v} == set(won)
    writes = {d for d in os.listdir(f"{root}/data") if d.startswith("v=")}
    assert len(writes) == 2  # the loser's files are gone
    lost = ({1, 101} - set(won)).pop()
    assert versions.merge(answers(spark, [lost]), root) == 3
    assert {k[1] for k, v in seen(versions.read_version(spark, root)).items() if v} == {1, 101}


def test_statistics_follow_the_changes(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    versions.create(rows, root, width=20)
    versions.statistics(spark, root, 1)
    steps = [answers(spark, range(0, 60)), answers(spark, range(50, 90), "Error: x", 0), answers(spark, range(70, 75), tokens=9)]
    for step in steps:
        number = versions.merge(step, root)
        with monkeypatch.context() as m:
            m.setattr(versions, "read_version", lambda *a: pytest.fail("all rows were read"))
            sums = versions.statistics(spark, root, number)
        whole = versions.read_version(spark, root)
        for kept, counted in (
            (stats.totals_from_sums(sums), stats.run_totals(whole)),
            (stats.by_provider_from_sums(sums), stats.by_provider(whole)),
            (stats.by_model_from_sums(sums), stats.by_model(whole)),
        ):
            assert sorted(map(str, kept.collect())) == sorted(map(str, counted.select(kept.columns).collect()))
    changed = versions.changes(spark, root, 3, 4)
    assert changed.groupBy("sign").count().count() == 2 and changed.count() < 100


def test_empty_table(spark, rows, tmp_path):
    root = str(tmp_path / "t")
    versions.create(rows.limit(0), root)
    with pytest.raises(versions.VersionConflict):
        versions.create(rows, root)
    assert versions.create(rows, root, parent=1) == 2
    assert versions.read_version(spark, root).agg(F.count("*")).first()[0] == 200
