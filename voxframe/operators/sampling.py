"""Sampling of training crops with portable random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.operators.ranking import global_index


def weighted_choice(draws: DataFrame, items: DataFrame, key: str, weight: str, cells: int = 1024) -> DataFrame:
    """draws (with u in [0, 1)) plus the key whose share of the summed weights u falls in.

    Shares are laid out over [0, 1) and cut into cells, so that a draw meets only the items of its own cell. The
    running sum is taken per bucket of keys and then over the buckets' sums, not in one window over all items."""
    n = items.agg(F.sum(weight).alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if n["w"] is None:
        return draws.withColumn(key, F.lit(None)).limit(0)
    width = max(1, (n["hi"] - n["lo"] + 64) // 64)
    ranged = items.withColumn("_b", F.floor((F.col(key) - n["lo"]) / width).cast("int"))
    sums = ranged.groupBy("_b").agg(F.sum(weight).alias("_s"))
    base = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_base"))  # at most 64 rows
    w = Window.partitionBy("_b").orderBy(key)
    laid = ranged.join(F.broadcast(base), "_b").select(key, ((F.col("_base") + F.sum(weight).over(w)) / n["w"]).alias("_hi"), ((F.col("_base") + F.sum(weight).over(w) - F.col(weight)) / n["w"]).alias("_lo"))
    laid = laid.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)))))
    return draws.withColumn("_c", F.floor(F.col("u") * cells)).join(laid, "_c").where((F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_hi"))).drop("_c", "_lo", "_hi")


def reject(candidates: DataFrame, accepted: Column, u: Column, probability: float) -> DataFrame:
    """Candidates that are accepted outright, and of the rest those with u >= probability."""
    return candidates.where(accepted | (u >= probability))


def crop_offset(u: Column, room: Column) -> Column:
    """Uniform integer in [0, room]."""
    return F.floor(u * (room + 1)).cast("int")


def epoch_size(max_iteration: int) -> int:
    return min(max(max_iteration // 100, 1000), 10000)


def elastic_context(sigma: tuple[float, float, float] = (1.0, 3.0, 3.0), enabled: bool = True) -> tuple[int, ...]:
    import math

    return tuple(max(math.ceil(s) * 3 + 2, int(4 * s) + 4) if enabled else 0 for s in sigma)


def in_output_region(pairs: DataFrame, input_size: tuple[int, int, int], output_size: tuple[int, int, int], context: tuple[int, int, int] = (0, 0, 0), post: tuple[str, ...] = ("post_z", "post_y", "post_x")) -> DataFrame:
    """Rows whose post lies in the output box in the middle of a crop (its input box after the context); pre and all else go along."""
    keep = F.lit(True)
    for c, n, m, k in zip(post, input_size, output_size, context, strict=True):
        lo = k + (n - m) // 2
        keep = keep & (F.col(c) >= lo) & (F.col(c) < lo + m)
    return pairs.where(keep)


def batches(crops: DataFrame, draw: str, size: int, drop_last: bool = False) -> DataFrame:
    """crops with ``batch`` and ``place``: in the order of their draws, ``size`` to a batch."""
    out = global_index(crops, [F.asc(draw)], "_n")
    if drop_last:
        out = out.where(F.col("_n") < crops.count() // size * size)
    return out.withColumns({"batch": F.floor(F.col("_n") / size), "place": (F.col("_n") % size).cast("int")}).drop("_n")


def first_accepted(candidates: DataFrame, draw: str, attempt: str, accepted: Column, u: Column, probability: float) -> DataFrame:
    """The draw loop at once: of the attempts of each draw, the first that is accepted; draws without one are left out."""
    ok = reject(candidates, accepted, u, probability)
    w = Window.partitionBy(draw).orderBy(attempt)
    return ok.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def stride(size: int, overlap: float) -> int:
    """Step between tiles that overlap by a share of their size; half to even, at least 1."""
    return max(1, round(size * (1 - overlap)))


def endless(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """A stream of draws (draw, u) that does not end."""
    from voxframe.operators.augment import uniform

    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("draw"), uniform(F.col("value") + 1).alias("u"))
