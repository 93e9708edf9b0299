"""Snapshots of a training step as Parquet partitions, and regions from metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators.voxels import centre_crop
from voxframe.sources.volume import _read, attributes, metadata


def write_snapshot(vox: DataFrame, path: str, iteration: int) -> None:
    """Voxels (z, y, x, raw, gt, p, ...) of one iteration; writing it again replaces it."""
    vox.write.mode("overwrite").parquet(f"{path}/iteration={iteration}")


def read_snapshot(spark: SparkSession, path: str, iteration: int | None = None) -> DataFrame:
    """One iteration, the latest by default; a mask and vectors stored in exchange for each other are put right."""
    df = spark.read.parquet(path)
    if iteration is None:
        iteration = df.agg(F.max("iteration").alias("i")).first()["i"]
    out = df.where(F.col("iteration") == F.lit(iteration)).drop("iteration")
    if "swapped" in out.columns:
        out = out.withColumns({"gt": F.when(F.col("swapped"), F.col("vectors")).otherwise(F.col("gt")), "vectors": F.when(F.col("swapped"), F.col("gt")).otherwise(F.col("vectors"))}).drop("swapped")
    return out


def aligned(raw: DataFrame, pred: DataFrame, have: tuple[int, int, int], want: tuple[int, int, int]) -> DataFrame:
    """raw cropped to the middle that pred covers, joined with it."""
    return centre_crop(raw, have, want).join(pred, ["z", "y", "x"])


def region_of(path: str, dataset: str = "RAW") -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(offset, shape) of a volume in its own voxels."""
    return (0, 0, 0), tuple(metadata(path, dataset)["shape"][-3:])


def region_from_json(path: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(offset, shape) of a region file: source_info.offset and size over vox, cut to whole voxels."""
    info = json.loads(_read(path) or b"{}")["source_info"]
    return tuple(tuple(int(a / b) for a, b in zip(info[k], info["vox"], strict=True)) for k in ("offset", "size"))


def shape_or_default(path: str, dataset: str = "RAW", default: tuple[int, int, int] = (100, 500, 500)) -> tuple[int, ...]:
    try:
        return tuple(metadata(path, dataset)["shape"][-3:])
    except (KeyError, OSError, ValueError):
        return default


def origin_of(path: str, dataset: str = "RAW") -> tuple[float, ...]:
    a = attributes(path, dataset)
    return tuple(o / r for o, r in zip(a["offset"], a["resolution"], strict=True))
