"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.storage import written


def global_index(df: DataFrame, order: list[Column], name: str = "id", start: int = 0) -> DataFrame:
    """df plus consecutive numbers in this (total) order: ranges are sorted and counted, then the counts are added up."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("_base"))
    inner = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return inner.join(bases, "_part").withColumn(name, (F.col("_base") + F.col("_rank")).cast("long")).drop("_part", "_base", "_rank")
