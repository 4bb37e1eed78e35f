"""Operators on skewed and larger tables, with broadcasts switched off."""

import pytest
from pyspark.sql import functions as F

from litspark.operators import skew
from litspark.operators.ordering import with_dense_index
from litspark.session import materialize, work_dir


@pytest.fixture
def hot_table(spark):
    """Every third row has the key ``hot``."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))
    )
    return spark.range(0, 6000, numPartitions=6).select(F.col("id"), key.alias("key"), F.create_map(F.lit("m"), "id").alias("m"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, hot_table, how):
    right = hot_table.where("id % 7 <> 1").groupBy("key").agg(F.max("id").alias("top"))
    salted = skew.lookup_join(hot_table, right, "key", how, limit=0)
    plain = hot_table.join(right, "key", how)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_salted_join_splits_the_hot_key(spark, hot_table):
    """Without a broadcast, no task gets all rows of the hot key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = hot_table.groupBy("key").agg(F.max("id").alias("top"))
        joined = skew.lookup_join(hot_table, right, "key")
        tasks = joined.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(t["count"] for t in tasks) == 2000
        assert max(t["count"] for t in tasks) < 1200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_small_right_side_is_broadcast(spark, hot_table, tmp_path):
    spark.range(10).select(F.concat(F.lit("k"), "id").alias("key")).write.parquet(str(tmp_path / "r"))
    joined = skew.lookup_join(hot_table, spark.read.parquet(str(tmp_path / "r")), "key")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_hot_keys(spark, hot_table):
    assert skew.hot_keys(hot_table, "key") == ["hot"]
    assert skew.hot_keys(hot_table.where("key <> 'hot'"), "key") == []
    assert skew.hot_keys(hot_table.where("false"), "key") == []


def test_hot_keys_of_a_table_of_unknown_size(spark):
    df = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}",) for i in range(6000)], "key string")
    assert skew.estimated_bytes(df) > skew.SAMPLE_BYTES / skew.LEAST_SAMPLE
    assert "hot" in skew.hot_keys(df, "key")


def test_dense_index(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"), "id"
    )
    rows = with_dense_index(df, ["name", "id"]).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(1, 5001))
    names = [(r["name"], r["id"]) for r in rows]
    assert names == sorted(names)


def test_dense_index_of_nothing(spark):
    assert with_dense_index(spark.range(0), ["id"], name="n").columns == ["id", "n"]
    assert with_dense_index(spark.range(0), ["id"]).count() == 0
    assert [r["n"] for r in with_dense_index(spark.range(1), ["id"], start=0, name="n").collect()] == [0]


def test_work_folder_is_the_cluster_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert work_dir(spark).startswith(f"{base.rstrip('/')}/litspark-")
    assert work_dir(spark) != work_dir(spark)
    assert materialize(spark.range(3)).count() == 3
