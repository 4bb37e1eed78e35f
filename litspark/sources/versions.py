"""Experiment tables in committed versions, and run statistics that follow the changes.

A table is a folder:

- ``data/v=<write>/provider=<p>/slice=<k>``: rows of one provider whose ``ID div width`` is ``k``, as one
  write has left them; nothing here is ever changed;
- ``manifests/<write>``: which write holds each (provider, slice) of a version;
- ``versions/<n>``: a small file that names the write. It is made by creating a file that must not exist,
  so of two writers that set out from one version exactly one commits, and the other is told.

A merge reads and writes the slices it touches only; all others stay in the files of earlier writes.
Every version that was committed can be read. The difference of two versions is read from the slices
that differ, and statistics are brought up to date by it without reading the other rows.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.operators import stats
from litspark.operators.inference import merge_results

WIDTH = 100_000
_PLACE = ["v", "provider", "slice"]
_MANIFEST = "v string, provider string, slice bigint"


class VersionConflict(RuntimeError):
    """Another writer has committed the version that was to be written."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not be there; false if it is."""
    files, where = _files(spark, path)
    if files.exists(where):
        return False
    # The name comes into being by the create call alone: of several callers one gets through.
    try:
        out = files.create(where, False)
    except Exception as error:
        if "AlreadyExists" in str(error) or files.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all committed versions, oldest first."""
    files, where = _files(spark, f"{root}/versions")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def latest(spark: SparkSession, root: str) -> int | None:
    return max(versions(spark, root), default=None)


def describe(spark: SparkSession, root: str, version: int) -> dict:
    """What a version's file says: the write that made it, its parent, and when."""
    text = spark.read.text(f"{root}/versions/{version:012d}", wholetext=True).first()
    if text is None:
        raise ValueError(f"version {version} of {root} is being committed")
    return json.loads(text[0])


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/{describe(spark, root, version)['write']}")


def _rows(spark: SparkSession, root: str, places: DataFrame) -> DataFrame:
    """Rows of the given places. The folders that are read follow from the join with them."""
    stored = spark.read.parquet(f"{root}/data").withColumn("v", F.col("v").cast("string"))
    return stored.join(F.broadcast(places) if _is_small(places) else places, _PLACE, "left_semi").drop("v", "slice")


def _is_small(df: DataFrame) -> bool:
    """A manifest has a row per slice; Spark may broadcast it up to its own limit."""
    from litspark.operators.skew import broadcast_limit, estimated_bytes

    return estimated_bytes(df) <= broadcast_limit(df.sparkSession)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of a version, the latest unless one is named."""
    if version is None:
        version = latest(spark, root)
    if version is None:
        raise ValueError(f"{root} has no version yet")
    return _rows(spark, root, manifest(spark, root, version))


def _write(rows: DataFrame, root: str, width: int) -> tuple[str, DataFrame]:
    """Store rows under a new write; gives its name and the places it holds."""
    write = f"w{uuid.uuid4().hex}"
    placed = rows.withColumn("slice", F.expr(f"ID div {width}"))
    dealt = placed.repartition("provider", "slice").sortWithinPartitions("provider", "slice", "ID")
    dealt.write.partitionBy("provider", "slice").parquet(f"{root}/data/v={write}")
    spark = rows.sparkSession
    try:
        held = spark.read.parquet(f"{root}/data/v={write}").select("provider", "slice").distinct()
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        held = spark.createDataFrame([], "provider string, slice bigint")
    return write, held.select(F.lit(write).alias("v"), "provider", F.col("slice").cast("bigint").alias("slice"))


def _commit(spark: SparkSession, root: str, write: str, parent: int | None, width: int) -> int:
    number = (parent or 0) + 1
    text = {"write": write, "parent": parent, "width": width, "at": datetime.now(UTC).isoformat()}
    if not _create_new(spark, f"{root}/versions/{number:012d}", json.dumps(text)):
        for part in (f"data/v={write}", f"manifests/{write}"):
            files, where = _files(spark, f"{root}/{part}")
            files.delete(where, True)
        raise VersionConflict(f"version {number} of {root} has been committed by another writer")
    return number


def create(rows: DataFrame, root: str, width: int = WIDTH, parent: int | None = None) -> int:
    """Commit ``rows`` as a whole version, the first unless a parent is named."""
    spark = rows.sparkSession
    write, held = _write(rows, root, width)
    held.write.parquet(f"{root}/manifests/{write}")
    return _commit(spark, root, write, parent, width)


def merge(results: DataFrame, root: str, parent: int | None = None) -> int:
    """Commit a version in which ``results`` are written over the rows of ``parent`` (the latest).

    Only slices that hold a row of ``results`` are read and written. ``results`` are looked at twice, so
    they should be a stored table. Rows of ``results`` that the table does not have are left out.
    """
    spark = results.sparkSession
    parent = latest(spark, root) if parent is None else parent
    width = describe(spark, root, parent)["width"]
    places = manifest(spark, root, parent)
    touched = results.select("provider", F.expr(f"ID div {width}").cast("bigint").alias("slice")).distinct()
    old = places.join(touched, ["provider", "slice"], "left_semi").select(*_PLACE)
    write, held = _write(merge_results(_rows(spark, root, old), results), root, width)
    stay = places.join(held.select("provider", "slice"), ["provider", "slice"], "left_anti").select(*_PLACE)
    stay.unionByName(held).write.parquet(f"{root}/manifests/{write}")
    return _commit(spark, root, write, parent, width)


def changes(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """Rows of the slices in which two versions differ: with ``sign`` -1 as they were, with 1 as they are."""
    before, after = manifest(spark, root, old), manifest(spark, root, new)
    gone = _rows(spark, root, before.join(after, _PLACE, "left_anti").select(*_PLACE))
    come = _rows(spark, root, after.join(before, _PLACE, "left_anti").select(*_PLACE))
    return gone.withColumn("sign", F.lit(-1)).unionByName(come.withColumn("sign", F.lit(1)))


def statistics(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Run sums per provider and model of a version, kept under ``sums``.

    A version's sums are its parent's and the signed sums of what changed; where there is no parent, or
    its sums were never asked for, they are counted from the rows.
    """
    path = f"{root}/sums/{describe(spark, root, version)['write']}"
    try:
        return spark.read.schema(stats.SIGNED_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    parent = describe(spark, root, version)["parent"]
    files, where = _files(spark, f"{root}/sums/{describe(spark, root, parent)['write']}" if parent else path)
    if parent and files.exists(where):
        delta = stats.signed_sums(changes(spark, root, parent, version))
        sums = stats.add_signed(statistics(spark, root, parent).unionByName(delta))
    else:
        sums = stats.signed_sums(read_version(spark, root, version).withColumn("sign", F.lit(1)))
    sums.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema(stats.SIGNED_SCHEMA).parquet(path)
