import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxframe.plans import search
from voxframe.sources import detections, points, volume
from voxframe.streaming import blocks


def test_points_skip_headers_and_bad_rows(spark, tmp_path):
    f = tmp_path / "a_post.csv"
    f.write_text("z,y,x\n1,2,3\n\n4,5\n 7 , 8 ,9,extra\nx,1,2\n")
    got = [(r["row_id"], r["z"], r["y"], r["x"]) for r in points.read_points(spark, str(f)).orderBy("row_id").collect()]
    assert got == [(0, 1.0, 2.0, 3.0), (1, 7.0, 8.0, 9.0)]
    one = tmp_path / "one.csv"
    one.write_text("1,2,3\n")
    assert points.has_points(spark, str(f)) and not points.has_points(spark, str(one))
    pre, post = points.read_points(spark, str(f)), points.read_points(spark, str(one))
    assert points.zip_pairs(pre, post) is None and points.zip_pairs(pre, pre).count() == 2


@pytest.mark.parametrize("compressor", [None, "zlib", "gzip"])
def test_volume_round_trip(spark, tmp_path, compressor):
    volume.register(spark)
    path = str(tmp_path / "v.zarr")
    volume.create(path, "RAW", [3, 10, 9], [2, 4, 4], "uint8", offset=(1, 2, 3), compressor=compressor)
    vox = spark.range(270).select((F.col("id") / 90).cast("int").alias("z"), (F.col("id") / 9 % 10).cast("int").alias("y"), (F.col("id") % 9).cast("int").alias("x"), (F.col("id") % 250 + 1).cast("double").alias("v"))
    assert volume.write_voxels(vox, path, "RAW") == 18
    back = volume.to_voxels(spark.read.format("volume").option("path", path).option("dataset", "RAW").load())
    assert back.exceptAll(vox).count() == 0 and back.count() == 270
    box = volume.to_voxels(spark.read.format("volume").option("path", path).option("box", "1,3,2,3,6,9").load())
    assert box.exceptAll(vox.where("z >= 1 and y between 3 and 5 and x >= 2")).count() == 0 and box.count() == 2 * 3 * 7
    assert volume.attributes(path, "RAW")["offset"] == [1, 2, 3]
    with pytest.raises(KeyError):
        volume.metadata(path, "nothing")


def test_volume_with_channels(spark, tmp_path):
    volume.register(spark)
    path = str(tmp_path / "w.zarr")
    volume.create(path, "vec", [3, 2, 4, 4], [3, 2, 2, 4], "int8")
    rows = spark.createDataFrame([(0, 0, 0, 1.0, -2.0, 3.0), (1, 3, 3, -128.0, 0.0, 127.0)], "z int, y int, x int, a double, b double, c double")
    volume.write_voxels(rows, path, "vec", ("a", "b", "c"))
    back = volume.to_voxels(spark.read.format("volume").option("path", path).option("dataset", "vec").load(), ("a", "b", "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def _det(spark):
    return spark.createDataFrame([(1, 0.25, 0.35, 1.0, 2.0, 3.0, 4.05, 0.12345, 7), (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1)], "id long, post_z double, post_y double, post_x double, pre_z double, pre_y double, pre_x double, score double, size long")


def test_detection_text(spark, tmp_path):
    detections.write_csv(_det(spark), str(tmp_path / "csv"))
    text = "".join((tmp_path / "csv" / f).read_text() for f in sorted(os.listdir(tmp_path / "csv")) if f.startswith("part"))
    assert text.splitlines() == [",".join(detections.COLUMNS), "0,0.0,0.0,0.0,0.0,0.0,0.0,1.0000,1", f"1,{0.25:.1f},{0.35:.1f},1.0,2.0,3.0,{4.05:.1f},{0.12345:.4f},7"]
    detections.write_json(_det(spark).where("id > 5"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "summary")).first()["n"] == 0


def test_latest_checkpoint(spark, tmp_path):
    for n in (9, 10, 100):
        (tmp_path / f"m_checkpoint_{n}.pt").write_bytes(b"x")
    (tmp_path / "m_checkpoint_bad.pt").write_bytes(b"x") if False else None
    r = detections.latest_checkpoints(spark, str(tmp_path)).first()
    assert (r["model"], r["iteration"]) == ("m", 100) and r["path"].endswith("_100.pt")


def test_metrics_append(spark, tmp_path):
    rows = spark.createDataFrame([("loss", 1, 0.5)], "tag string, step int, value double")
    for _ in range(2):
        detections.append_metrics(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_blocks_resume(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("src", "sink", "cp"))
    spark.range(10).repartition(5).write.parquet(src)
    work = lambda df: df.withColumn("v", F.col("id") * 2)
    blocks.process_blocks(spark, src, "id long", work, sink, cp, 2).awaitTermination()
    spark.range(10, 14).write.mode("append").parquet(src)
    blocks.process_blocks(spark, src, "id long", work, sink, cp, 2).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.count() == 14 and got.agg(F.sum("v")).first()[0] == 2 * sum(range(14))


def run_series(spark, src, cp, per_batch=1, idle=None):
    stream = spark.readStream.schema("tag string, step long, value double, ts string").option("maxFilesPerTrigger", per_batch).parquet(src)
    out = []
    q = blocks.online_series(stream, idle_seconds=idle).writeStream.foreachBatch(lambda df, n: out.extend(map(tuple, df.collect())))
    q.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return out


def test_online_series_over_any_batches(spark, tmp_path):
    rows = [("a", i, float(i * 7 % 5), f"2024-01-01 00:00:{i:02}") for i in range(0, 40, 2)] + [("b", 3, 1.5, "2024-01-01 00:00:01")]
    e = rows[0][2]
    for r in rows[1:20]:
        e = 0.98 * e + 0.02 * r[2]
    schema = "tag string, step long, value double, ts string"
    for n, cuts in enumerate(([0, 21], [0, 4, 5, 13, 21], [0, 20, 21])):
        src, cp, last = str(tmp_path / f"m{n}"), str(tmp_path / f"c{n}"), {}
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(rows[a:b][::-1], schema).coalesce(1).write.mode("append").parquet(src)
            last |= {r[0]: r for r in run_series(spark, src, cp)}  # a restart for each part
        assert last == {"a": ("a", 38, pytest.approx(e), 1.0), "b": ("b", 3, 1.5, None)}
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.mode("append").parquet(src)  # late rows change nothing
    assert [(r[1], r[2]) for r in run_series(spark, src, cp)] == [(38, pytest.approx(e))]


class Handle:
    """A state and timers as the processor sees them."""

    def __init__(self):
        self.value, self.timers = None, []
        self.exists = lambda: self.value is not None
        self.get = lambda: self.value
        self.listTimers = lambda: list(self.timers)
        self.deleteTimer = self.timers.remove
        self.registerTimer = self.timers.append
        self.getCurrentProcessingTimeInMs = lambda: 1000

    def getValueState(self, name, schema):
        return self

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_idle_tags_are_forgotten():
    handle, state = Handle(), blocks.SeriesState(0.5, 3.0)
    state.init(handle)
    rows = lambda *steps: iter([pd.DataFrame({"step": [s], "value": [float(s)], "seconds": [float(s)]}) for s in steps])
    told = [next(state.handleInputRows(("a",), rows(*s), handle)) for s in ((5, 4), (6,), (2,))]
    assert [(t["step"][0], t["ema"][0]) for t in told] == [(5, 4.5), (6, 5.25), (6, 5.25)]  # step 2 is late
    assert handle.timers == [4000]
    assert list(state.handleExpiredTimer(("a",), handle, None)) == [] and handle.value is None
    assert next(state.handleInputRows(("a",), rows(2), handle))["ema"][0] == 2.0


def test_search(spark):
    t = search.run_trials(spark, {"cc_threshold": (0.2, 0.9), "score_thr": (0.1, 0.3), "lr": (1e-4, 1e-2, "log"), "how": ["a", "b"]}, lambda p, c: p["cc_threshold"] - c, 30, checks=3)
    rows = search.summary(t).collect()
    assert len(rows) == 20 and [r["value"] for r in rows] == sorted((r["value"] for r in rows), reverse=True)
