"""Point lists: headerless CSV with z, y, x in the first three fields; other lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators import ordered


def read_points(spark: SparkSession, path: str, delimiter: str = ",", parts: int | None = None) -> DataFrame:
    """(row_id, file, z, y, x): rows whose first three fields are numbers, numbered in file order after the others are dropped.

    Files are split among tasks. A line's place is that of its split in the file, then its own within the split; numbers
    come from an ordered scan over ranges of places, so that a file of any size is never one task's work."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.col("value").alias("text"))
    f = F.split("text", F.lit("[" + delimiter + "]")) if len(delimiter) == 1 else F.split("text", delimiter)
    cols = [F.expr(f"try_cast(trim(f[{i}]) as double)").alias(c) for i, c in enumerate("zyx")]
    rows = lines.withColumn("f", f).where(F.size("f") >= 3).select("file", "place", *cols).where("z is not null and y is not null and x is not null")
    return ordered.ranked(rows, ["file"], "place", parts).select(F.col("_i").cast("long").alias("row_id"), "file", "z", "y", "x")


def has_points(spark: SparkSession, path: str) -> bool:
    """Whether the file has more than one line; a file of one line counts as empty."""
    return spark.read.text(path).limit(2).count() > 1


def zip_pairs(pre: DataFrame, post: DataFrame) -> DataFrame | None:
    """Row i of pre with row i of post; None if their numbers differ (the sample is rejected)."""
    if pre.count() != post.count():
        return None
    return pre.select("row_id", *[F.col(c).alias(f"pre_{c}") for c in "zyx"]).join(post.select("row_id", *[F.col(c).alias(f"post_{c}") for c in "zyx"]), "row_id")
