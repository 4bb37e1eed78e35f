"""Queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from litspark.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert set(names) == set(found.columns)
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
