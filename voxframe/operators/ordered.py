"""Ordered scans of series with a carried state, however long a series is.

Rows are cut into ranges of (keys, order), so that a series of any length lies in as many ranges as it needs. Each range tells one
associative summary per series (a count, a maximum, its last row); a prefix over these few summaries gives what
is carried into each range, and a second pass works within ranges only. No series is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from voxframe.storage import written

RANGE = "_range"


def in_ranges(df: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """df with the number of each row's range, ascending along (keys, order); written, so that ranges stay as they are. Adaptive
    execution sizes the ranges unless their number is given."""
    dealt = df.repartitionByRange(parts, *keys, order) if parts else df.repartitionByRange(*keys, order)
    return written(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")


def within(keys: list[str], order: str) -> WindowSpec:
    """Rows of a series within one range."""
    return Window.partitionBy(*keys, RANGE).orderBy(order)


def carried(rows: DataFrame, keys: list[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with the columns of ``carry``, worked out over one row of ``summary`` for each series and range. ``carry`` may use
    windows over ``earlier`` and ``later`` ranges of the series."""
    told = rows.groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in summary.items()])
    for name, column in carry.items():  # one after the other, as they may build on each other
        told = told.withColumn(name, column)
    told = told.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, RANGE)], *carry)
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, RANGE)]
    return rows.join(told, on).drop(*[f"_of_{k}" for k in (*keys, RANGE)])


def earlier(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(1, Window.unboundedFollowing)


def previous(keys: list[str], name: str) -> Column:
    """A summary of the range before."""
    return F.lag(name).over(Window.partitionBy(*keys).orderBy(RANGE))


def ranked(df: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """df with ``_i``, the place of each row in its series from 0, and ``_n``, the length of the series."""
    count = lambda w: F.coalesce(F.sum("_rows").over(w), F.lit(0))
    carry = {"_before": count(earlier(keys)), "_after": count(later(keys)), "_own": F.col("_rows")}
    rows = carried(in_ranges(df, keys, order, parts), keys, {"_rows": F.count("*")}, carry)
    rows = rows.withColumn("_i", F.col("_before") + F.row_number().over(within(keys, order)) - 1)
    return rows.withColumn("_n", F.col("_before") + F.col("_own") + F.col("_after")).drop("_before", "_after", "_own", RANGE)
