import json

from pyspark.sql import functions as F

from voxframe.plans import run
from voxframe.plans.extract import predict_blocks
from voxframe.sources import snapshots, volume


def test_volume_to_table(spark, tmp_path):
    path = str(tmp_path / "pred.zarr")
    volume.create(path, "pred_syn_indicators", [4, 16, 16], [2, 8, 8], "uint8", offset=(100, 0, 0), resolution=(10, 1, 1))
    volume.create(path, "pred_partner_vectors", [3, 4, 16, 16], [3, 2, 8, 8], "int8")
    rows = [(z, y, x, 230.0, 1.0, 0.0, -3.0) for z in (1, 2) for y in (6, 7, 8) for x in (7, 8, 9)]
    df = spark.createDataFrame(rows, "z int, y int, x int, v double, vz double, vy double, vx double")
    volume.write_voxels(df, path, "pred_syn_indicators")
    volume.write_voxels(df, path, "pred_partner_vectors", ("vz", "vy", "vx"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"extract": {"input": path, "output": str(tmp_path / "out"), "loc_type": "centroid", "size_thr": 4}}))
    run.main(str(config))
    got = spark.read.option("header", True).csv(str(tmp_path / "out.csv")).collect()
    assert len(got) == 1 and (got[0]["post_z"], got[0]["pre_z"], got[0]["pre_x"], got[0]["size"]) == ("115.0", "125.0", "5.0", "18")
    assert spark.read.json(str(tmp_path / "out" / "summary")).first()["n"] == 1


def test_regions(tmp_path):
    volume.create(str(tmp_path / "v"), "RAW", [1, 5, 6, 7], [1, 5, 6, 7], "uint8", offset=(40, 8, 4), resolution=(40, 4, 4))
    assert snapshots.region_of(str(tmp_path / "v")) == ((0, 0, 0), (5, 6, 7)) and snapshots.origin_of(str(tmp_path / "v")) == (1, 2, 1)
    assert snapshots.shape_or_default(str(tmp_path / "none")) == (100, 500, 500)
    (tmp_path / "r.json").write_text(json.dumps({"source_info": {"vox": [40, 4, 4], "offset": [90, 8, 4], "size": [400, 40, 44]}}))
    assert snapshots.region_from_json(str(tmp_path / "r.json")) == ((2, 2, 1), (10, 10, 11))


def test_snapshots(spark, tmp_path):
    df = spark.range(8).select((F.col("id") / 4).cast("int").alias("z"), (F.col("id") / 2 % 2).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("x"), F.col("id").cast("double").alias("raw"))
    for i in (5, 12, 12):
        snapshots.write_snapshot(df.withColumn("raw", F.col("raw") + i), str(tmp_path / "s"), i)
    assert snapshots.read_snapshot(spark, str(tmp_path / "s")).agg(F.min("raw")).first()[0] == 12
    assert snapshots.read_snapshot(spark, str(tmp_path / "s"), 5).count() == 8


def test_model_hook_keeps_the_middle(spark):
    import numpy as np

    raw = np.arange(6 * 6 * 6, dtype=np.uint8).reshape(6, 6, 6)
    block = spark.createDataFrame([(10, 0, 0, 6, 6, 6, "|u1", bytearray(raw.tobytes()))], "oz int, oy int, ox int, sz int, sy int, sx int, dtype string, data binary")
    out = predict_blocks(block, lambda a: np.stack([a[1:-1, 1:-1, 1:-1] / 255.0] * 4), (2, 2, 2))
    got = {(r["z"], r["y"], r["x"]): r["p"] for r in out.collect()}
    assert len(got) == 8 and abs(got[12, 2, 2] * 255 - raw[2, 2, 2]) < 1e-9
