"""Small helpers for column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(condition: Column) -> Column:
    """The condition, marked so that a later filter on it is not pushed below the projection that makes it.

    The optimiser would put the whole expression in place of the column at every step down, and work out nested
    array expressions again for each place that they are named in.
    """
    return condition & (F.spark_partition_id() >= 0)
