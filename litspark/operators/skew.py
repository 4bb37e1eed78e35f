"""Joins against a table with one row per key, safe where one key holds much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 0.02
SALTS = 64
# Size up to which all keys are counted, and the least share that is: estimates of joined
# tables, and of tables of unknown size, are far too high.
SAMPLE_BYTES = 1 << 30
LEAST_SAMPLE = 0.01


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; negative where it is off."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: the figure its own broadcast decision rests on."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold at least ``share`` of the rows: never more than ``1 / share``.

    Counted on the key column alone, on a sample where that is large. A sample is enough: the
    counts only decide what is salted, not what is in the result.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    fraction = max(SAMPLE_BYTES / max(estimated_bytes(keys), 1), LEAST_SAMPLE)
    if fraction < 1:
        keys = keys.sample(fraction, seed=0)
    seen = Observation()
    counts = keys.observe(seen, F.count("*").alias("n")).groupBy(key).count()
    top = counts.orderBy(F.desc("count")).limit(int(1 / share)).collect()
    return [row[key] for row in top if row["count"] >= share * seen.get["n"]]


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    limit: int | None = None,
    salts: int = SALTS,
    hot: list | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per ``key``.

    A right side under Spark's broadcast limit is left to Spark, which then shuffles nothing.
    Above it, rows of a hot key go to ``salts`` tasks and the right row of that key is
    repeated as often. AQE alone would not split it: it needs a plain shuffle on both sides,
    and the right side usually comes out of an aggregation. ``hot`` spares the pass that
    looks for hot keys where the caller knows them.
    """
    spark = left.sparkSession
    limit = broadcast_limit(spark) if limit is None else limit
    if estimated_bytes(right) <= limit:
        return left.join(right, key, how)
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    # The salt depends on the row's content alone, so that a repeated task gives the same one.
    # Maps cannot be hashed.
    content = [f"`{f.name}`" for f in left.schema if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*content), F.lit(salts)).cast("int")
    salted_left = left.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
