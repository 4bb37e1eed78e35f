"""Session builder and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "litspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings this library expects; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Looking up the call site of every column function makes large expressions slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # A task that calls a model must not be started twice side by side.
        .config("spark.speculation", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is missing and the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="litspark-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/litspark-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Values that depend on task order (partition numbers) are fixed by this, also when
    executors are lost later. The shuffle files of the write are dropped once it is done: the
    table takes their place, and a long job holds one step's files at a time.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
