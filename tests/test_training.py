import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import augment, components, grid, nn, sampling, voxels
from voxframe.plans.extract import ExtractParams, extract
from voxframe.sources import logs, manifest, volume


def test_parameters_and_objects(spark, tmp_path):
    config = {"a": {"b": [1, 2]}, "c": True}
    logs.dump_parameters(config, f"{tmp_path}/p/params.json")
    assert logs.read_parameters(f"{tmp_path}/p/params.json") == config
    with pytest.raises(FileNotFoundError):
        logs.read_parameters(f"{tmp_path}/none.json")
    det = spark.createDataFrame([(0, 1.5), (1, 2.5)], "id long, score double")
    for df, n in ((det, 2), (det.limit(0), 0)):
        assert logs.write_object(df, f"{tmp_path}/o/{n}.json", ["id", "score"]) == n
        got = json.loads((tmp_path / "o" / f"{n}.json").read_text())
        assert got["n"] == n and [r["score"] for r in got["synapses"]] == [1.5, 2.5][:n]


def test_files_and_checkpoints(spark, tmp_path):
    for n in (1, 20, 3):
        (tmp_path / f"m_checkpoint_{n}.pt").write_bytes(b"x")
    files = manifest.list_files(spark, str(tmp_path), "*.pt")
    assert files.count() == 3 and manifest.checkpoint_at(files, 20).count() == 1
    assert [r["path"].rsplit("_", 1)[1] for r in manifest.stale_checkpoints(files).orderBy("path").collect()] == ["1.pt", "3.pt"]
    with pytest.raises(FileNotFoundError):
        manifest.checkpoint_at(files, 4)


@pytest.mark.parametrize("chunks", [[1, 2, 2, 2], [2, 2, 2, 2], [3, 4, 4, 4]])
def test_second_write_keeps_the_first(spark, tmp_path, chunks):
    path = str(tmp_path / "v")
    volume.create(path, "P", [3, 4, 4, 4], chunks, "int8")
    rows = [(z, y, x, z + 1, y - 2, x) for z in range(4) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "z int, y int, x int, a int, b int, c int")
    for part in ("(z + y + x) % 2 = 0", "(z + y + x) % 2 = 1"):
        volume.write_voxels(df.where(part), path, "P", ("a", "b", "c"))
    volume.register(spark)
    got = volume.to_voxels(spark.read.format("volume").option("path", path).option("dataset", "P").load(), ("a", "b", "c"), keep_zero=True).collect()
    assert sorted(tuple(map(int, r)) for r in got) == rows


def test_tasks_take_neighbouring_chunks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    volume.create(path, "RAW", [5, 6, 7], [2, 2, 2], "uint8")
    monkeypatch.setattr(volume, "MOST_TASKS", 5)
    reader = volume.VolumeReader({"path": path, "box": "1,2,0,5,6,7"})
    parts = reader.partitions()
    seen = [i for p in parts for i in p.indices()]
    assert len(parts) <= 5 and sorted(seen) == [(z, y, x) for z in range(3) for y in (1, 2) for x in range(4)]


def test_components_within_and_across_tasks(spark):
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 3000, 2200), rng.integers(0, 3000, 2200)
    path = np.arange(5000, 5400)
    u, v = np.concatenate((u, path[:-1], [9000])), np.concatenate((v, path[1:], [9000]))
    nodes, least = components.least_of_component(u, v)
    want = dict(zip(nodes.tolist(), least.tolist()))
    brute = {int(n): int(n) for n in nodes}
    for _ in range(len(brute)):
        changed = False
        for a, b in zip(u.tolist(), v.tolist()):
            m = min(brute[a], brute[b])
            changed |= brute[a] != m or brute[b] != m
            brute[a] = brute[b] = m
        if not changed:
            break
    assert want == brute
    df = spark.createDataFrame(list(zip(u.tolist(), v.tolist())), "u long, v long").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 7.0], 50), np.array([4.0]), np.concatenate((rng.normal(size=500), [1e12, -1e12]))):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
        got = voxels.quantiles(df, "v", [0.0, 0.01, 0.5, 0.99, 1.0], bins=16, few=8)
        assert got == pytest.approx(np.quantile(values, [0.0, 0.01, 0.5, 0.99, 1.0]).tolist(), rel=1e-12)
    assert np.isnan(voxels.quantiles(df.limit(0), "v", [0.5])[0])


def test_nearest_beyond_all_rings(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3e6, 0.0, 0.0)], "id long, post_z double, post_y double, post_x double")
    right = spark.createDataFrame([(7, 0.0, 0.0, 2e6), (8, -5e6, 0.0, 0.0)], left.schema)
    assert sorted((r["l_id"], r["r_id"]) for r in grid.nearest(left, right).collect()) == [(1, 7), (2, 7)]
    assert grid.nearest(left, right.limit(0)).count() == 0


def test_extraction_without_foreground(spark):
    vox = spark.createDataFrame([(0, 0, 0, 0.1, 0.0, 0.0, 0.0)], "z int, y int, x int, p double, vz double, vy double, vx double")
    for p in (ExtractParams(), ExtractParams(suppression=True, splitting=True), ExtractParams(loc_type="centroid", nms_radius=2.0)):
        assert extract(vox, 4, 4, p).count() == 0


def test_size_is_asked_before_splitting(spark):
    """Two balls joined by a neck: the whole passes the size, its parts are not asked for it."""
    at = np.argwhere(np.ones((5, 5, 15), bool))
    ball = lambda c: ((at - c) ** 2).sum(axis=1) <= 5
    keep = ball(np.array([2, 2, 3])) | ball(np.array([2, 2, 11])) | ((at[:, 0] == 2) & (at[:, 1] == 2) & (at[:, 2] > 2) & (at[:, 2] < 12))
    rows = [(int(z), int(y), int(x), 0.9, 0.0, 0.0, 1.0) for z, y, x in at[keep]]
    vox = spark.createDataFrame(rows, "z int, y int, x int, p double, vz double, vy double, vx double")
    p = ExtractParams(size_thr=len(rows), splitting=True, split_min_size=20, split_min_peak_dist=3, split_min_sub_size=8, loc_type="centroid")
    assert extract(vox, 5, 15, p).count() == 2
    assert extract(vox, 5, 15, ExtractParams(size_thr=len(rows) + 1, splitting=True)).count() == 0


def test_strides_counts_and_streams(spark):
    assert [sampling.stride(n, o) for n, o in ((10, 0.25), (10, 0.5), (1, 0.9), (5, 0.5))] == [8, 5, 1, 2]
    assert nn.parameter_count([[(0, 0, 0, 0, 0, 1.0)] * 27, [(0, 0, 0, 0, 0, 1.0)] * 2], 3) == 32
    assert sampling.endless(spark).isStreaming


def test_gaussian_like_the_kernel(spark):
    from voxframe.functions.kernels import gaussian

    rng = np.random.default_rng(2)
    for n, sigma in ((9, 1.0), (3, 2.0), (1, 1.0)):
        a = rng.random((2, n))
        padded = np.stack([[row[min(m := i % (2 * n), 2 * n - 1 - m)] for i in range(-20, n + 20)] for row in a])
        want = gaussian(padded, sigma)[:, 20 : 20 + n]
        df = spark.createDataFrame([(z, x, float(a[z, x])) for z in range(2) for x in range(n)], "z int, x int, p double")
        got = {(r["z"], r["x"]): r["p"] for r in augment.gaussian(df, "x", n, F.lit(sigma), sigma).collect()}
        assert all(abs(got[z, x] - want[z, x]) < 1e-9 for z in range(2) for x in range(n))
