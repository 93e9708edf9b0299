"""Command line: ``python -m voxframe.plans.run CONFIG.json`` reads predicted volumes and writes the detection table."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.plans.extract import ExtractParams, extract
from voxframe.sources import volume
from voxframe.sources.detections import write_csv, write_json


def indicator_voxels(spark: SparkSession, path: str, threshold: float, indicator: str = "pred_syn_indicators") -> DataFrame:
    """Voxels (z, y, x, p) of at least the threshold."""
    volume.register(spark)
    v = spark.read.format("volume").option("path", path).option("dataset", indicator).option("rows", "voxels").load()
    return v.select("z", "y", "x", (F.col("c0") / 255.0).alias("p")).where(F.col("p") >= threshold)


def late_vectors(path: str, vectors: str = "pred_partner_vectors"):
    """For ``extract``: adds vz, vy, vx to voxels; of the vector volume only the chunks with such a voxel are read, each once."""
    return lambda vox: volume.values_at(vox, path, vectors, ("vz", "vy", "vx"))


def extract_volume(spark: SparkSession, path: str, p: ExtractParams, indicator: str = "pred_syn_indicators", vectors: str = "pred_partner_vectors") -> DataFrame:
    """Detections of predicted volumes. Vectors are read last, and only where a component passed the thresholds."""
    shape = volume.metadata(path, indicator)["shape"]
    return extract(indicator_voxels(spark, path, p.cc_threshold, indicator), shape[-2], shape[-1], p, late_vectors(path, vectors))


def main(config_path: str) -> None:
    with open(config_path) as f:
        config = json.load(f)
    part = config.get("extract", config)
    spark = SparkSession.builder.getOrCreate()
    path = part["input"]
    attributes = volume.attributes(path, "pred_syn_indicators")
    p = ExtractParams.of({"voxel_size": attributes["resolution"], "offset": attributes["offset"], **part})
    det = extract_volume(spark, path, p)
    write_csv(det, part["output"].removesuffix(".json") + ".csv")
    write_json(det, part["output"])


if __name__ == "__main__":
    main(sys.argv[1])
