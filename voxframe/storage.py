"""Shared storage for cut lineage: every table lands where driver and executors both see it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished query are of no use once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="voxframe-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voxframe/{name}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators count on: early clean-up, and Arrow batches of few rows, as texts are long."""
    spark.conf.set(CLEANUP, "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files any executor can reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    prepare(spark)
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` returned and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        drop_path(table.sparkSession, folder)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
