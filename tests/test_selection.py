import random

import pytest

from pyspark.sql import functions as F

from litspark.operators.selection import By, first_rows, nth_key, top_per_group


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "é", ""]), i) for i in range(700)]
    return rows, spark.createDataFrame(rows, "year int, title string, n int").repartition(5)


def key(row):
    year, title, n = row
    return (year is None, -(year or 0), title is None, (title or "").encode(), n)


@pytest.mark.parametrize("n", [0, 1, 349, 699, 700, 10**6])
def test_same_rows_as_a_sort(table, n):
    rows, df = table
    found = first_rows(df, [By("year", descending=True), By("title"), By("n")], n, ranges=4)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(rows, key=key)[:n]


def test_rows_alike(spark, table):
    _, df = table
    assert first_rows(df, [By("year")], 100, ranges=4).count() == 100
    same = spark.createDataFrame([(1,)] * 5000, "a int")
    assert first_rows(same, [By("a")], 4321).count() == 4321 and first_rows(same.limit(0), [By("a")], 3).count() == 0


def test_few_rounds_and_no_single_task(table):
    _, df = table
    order = [By("title"), By("n")]
    row, taken = nth_key(df, order, 350, ranges=4, few=10)
    assert taken == 1
    plan = first_rows(df, order, 350)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "GlobalLimit 1" in plan


def test_top_of_each_group(table):
    rows, df = table
    found = top_per_group(df, ["year"], [F.desc("n")], 5, spread_by="n", salts=3).collect()
    for year in (None, 1, 2, 3):
        want = sorted((r[2] for r in rows if r[0] == year), reverse=True)[:5]
        assert [r.n for r in sorted(found, key=lambda r: r["rank"]) if r.year == year] == want
