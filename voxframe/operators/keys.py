"""Join keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more than 1 / HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1000


def shuffled(df: DataFrame) -> DataFrame:
    """df, which grows with the data, as a side of a join that is not to be sent to all tasks. The planner takes the size of the
    files for that of the rows, though rows take up to a hundred times as much, and they all go through the driver."""
    return df.hint("merge")


def dealt_anew(key: str) -> Column:
    """A whole-number key under its own name, as an expression that the planner does not take for dealt out already.

    An aggregate leaves its rows dealt by key, so a join on it would use them as they are, and adaptive execution can
    split a hot key of the other side only where both sides are dealt for the join itself. The aggregate is small.
    """
    return F.col(key).bitwiseXOR(F.lit(0)).alias(key)


def whole_groups(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by keys: ``work`` gets tables of about ``rows`` rows that hold whole groups only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            ends = np.flatnonzero(new_groups(table, keys)[1:]) + 1
            if len(ends):
                yield work(table.slice(0, ends[-1]).combine_chunks())
                table = table.slice(ends[-1]).combine_chunks()
            held, size = table.to_batches(), table.num_rows
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def new_groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row is the first of its group."""
    new = np.ones(table.num_rows, bool)
    values = [table.column(k).to_numpy() for k in keys]
    new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    return new


def attach(rows: DataFrame, small: DataFrame, key: str, of: str, held: str, spread: Column) -> DataFrame:
    """rows left-joined with ``small`` (one row a key ``of``, all names unlike those of rows) on ``key`` = ``of``.

    ``held`` counts the rows of each key. Hot keys are sent to all tasks (fewer than HOT_SHARE rows, since their
    counts add up to at most the number of rows), and their rows are dealt out by ``spread``, a whole number, instead
    of the key. No key's rows meet in one task, and nothing is sampled or dropped. ``small`` is read three times, so it
    should be a written table.
    """
    total = small.agg(F.sum(held).alias("n")).collect()[0]["n"] or 0  # one row
    names = [c for c in small.columns if c != of]
    is_hot = F.col(held) * HOT_SHARE > total
    hot = small.where(is_hot).select(F.col(of).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    rest = small.where(~is_hot).select(dealt_anew(of), *names)
    at = F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(spread)
    both = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn("_hot_at", at).join(rest, F.col("_hot_at") == F.col(of), "left")
    known = F.col("_hot_key").isNotNull()
    return both.select(*rows.columns, *[F.when(known, F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in names])
