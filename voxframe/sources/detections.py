"""Detection tables as CSV and JSON text, and files of checkpoints and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

COLUMNS = ("id", "post_z", "post_y", "post_x", "pre_z", "pre_y", "pre_x", "score", "size")


@F.pandas_udf(StringType())
def _fixed1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


@F.pandas_udf(StringType())
def _fixed4(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.4f}")


def fixed(c: Column, digits: int) -> Column:
    """Decimal text rounded as Python does it (half to even on the exact binary value)."""
    return {1: _fixed1, 4: _fixed4}[digits](c)


def csv_lines(det: DataFrame) -> DataFrame:
    """(id, line): coordinates with one decimal, score with four."""
    parts = [F.col("id").cast("string"), *[fixed(F.col(c).cast("double"), 1) for c in COLUMNS[1:7]], fixed(F.col("score").cast("double"), 4), F.col("size").cast("string")]
    return det.select("id", F.concat_ws(",", *parts).alias("line"))


def write_csv(det: DataFrame, path: str) -> None:
    """One header line, then the rows by id; the files in path, read in name order, are the table."""
    spark = det.sparkSession
    lines = csv_lines(det).unionByName(spark.createDataFrame([(-1, ",".join(COLUMNS))], "id long, line string").select(F.col("id").cast(dict(det.dtypes)["id"]), "line"))
    lines.repartitionByRange("id").sortWithinPartitions("id").select("line").write.mode("overwrite").text(path)


def write_json(det: DataFrame, path: str) -> None:
    """Line-delimited detections, and their number in a summary beside them; an empty result still writes both."""
    det.select(*COLUMNS).write.mode("overwrite").json(f"{path}/synapses")
    det.agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def latest_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(model, path, iteration) of the checkpoint with the highest number for each model."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_checkpoint_*.pt").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)_checkpoint_(\d+)\.pt$", 1)
    n = F.regexp_extract("path", r"_(\d+)\.pt$", 1).cast("long")
    return files.groupBy(name.alias("model")).agg(F.max_by("path", n).alias("path"), F.max(n).alias("iteration"))


def renamed_keys(key: Column) -> Column:
    """Parameter names of older checkpoints in the present scheme."""
    return F.regexp_replace(F.regexp_replace(key, r"encoder\.conv_blocks\.(\d+)", "encoder.conv_$1"), r"^(_orig_mod|module)\.", "")


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.select("tag", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value")).write.mode("append").partitionBy("tag").parquet(path)
