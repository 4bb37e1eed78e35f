import pytest

from litspark.plans import queries
from litspark.plans.bindings import TABLES


@pytest.mark.parametrize("name, table", [("stream_first_seen", "documents"), ("stream_run", "documents"), ("stream_run_stats", "events")])
def test_table_in_part_files(spark, tmp_path, name, table):
    """A table may be a folder of files, as Spark writes it, or one file."""
    whole = f"/root/testdata/sf0.001/{table}.parquet"
    rows = spark.read.schema(TABLES[table]).parquet(whole)
    rows.repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    rows.limit(5).write.parquet(str(tmp_path / f"{table}2.parquet"))  # another table
    parts, one = (queries.REGISTRY[name](spark, f) for f in (str(tmp_path), "/root/testdata/sf0.001"))
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, one.collect()))
