"""Pruned and late scans, the committing writer and the overlap blend."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import blend, grid
from voxframe.sources import volume


def rows_of(spark, blocks):
    """Block rows of {(z, y, x): array of (channel, z, y, x)}."""
    return spark.createDataFrame([(*o, *a.shape[1:], len(a), a.dtype.str, bytearray(a.tobytes())) for o, a in blocks.items()], volume.SCHEMA)


def load(spark, path, dataset="RAW", **options):
    return spark.read.format("volume").options(path=path, dataset=dataset, **options).load()


def array_of(spark, path, dataset="RAW"):
    m = volume.metadata(path, dataset)
    out = np.zeros((volume._channels(m), *m["shape"][-3:]))
    for r in load(spark, path, dataset).collect():
        to = tuple(slice(r[f"o{a}"], r[f"o{a}"] + r[f"s{a}"]) for a in "zyx")
        out[(slice(None), *to)] = np.frombuffer(r["data"], r["dtype"]).reshape(r["channels"], r["sz"], r["sy"], r["sx"])
    return out


def spoil(path, dataset, keep):
    """Make all chunk files but those kept unreadable."""
    for name in os.listdir(f"{path}/{dataset}"):
        if name[0] != "." and tuple(map(int, name.split(".")))[-3:] not in keep:
            with open(f"{path}/{dataset}/{name}", "wb") as f:
                f.write(b"no chunk")


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "v.zarr")
    volume.register(spark)
    volume.create(path, "RAW", [9, 20, 21], [3, 8, 7], "uint8")
    a = np.random.default_rng(1).integers(1, 250, (1, 9, 20, 21)).astype(np.uint8)
    volume.write_chunks(rows_of(spark, {(0, 0, 0): a[:, :5], (5, 0, 0): a[:, 5:]}), path, "RAW")
    return path, a


@pytest.mark.parametrize("where,chunks", [
    ("z >= 3 AND z < 6 AND y = 9 AND x > 13", {(1, 1, 2)}),
    ("z IN (0, 2) AND y <= 7 AND x < 7", {(0, 0, 0)}),
    ("6 <= z AND y BETWEEN 16 AND 100 AND x >= 7 AND x < 14 AND c0 > 20", {(2, 2, 1)}),
    ("z > 100", set()),
    ("z < 0", set()),
])
def test_filters_reach_only_their_chunks(spark, stored, where, chunks):
    path, a = stored
    spoil(path, "RAW", chunks)
    got = {(r["z"], r["y"], r["x"]): r["c0"] for r in load(spark, path, rows="voxels").where(where).collect()}
    z, y, x = np.indices(a.shape[1:])
    keep = eval(where.replace(" IN (0, 2)", " % 3 != 1").replace("BETWEEN 16 AND 100", ">= 16").replace("y = 9", "y == 9").replace("c0", "a[0]").replace(" AND ", ") & (").join("()"))  # noqa: S307
    if "IN" in where:
        keep = keep & ((z == 0) | (z == 2))
    assert got == {tuple(map(int, k)): float(a[0][tuple(k)]) for k in np.argwhere(keep)}


def test_chunk_rows_are_pruned_too(spark, stored):
    path, a = stored
    spoil(path, "RAW", {(1, 1, 1), (1, 1, 2)})
    got = load(spark, path).where("oz = 3 AND oy > 7 AND oy < 16 AND ox >= 1").collect()
    assert sorted((r["oz"], r["oy"], r["ox"]) for r in got) == [(3, 8, 7), (3, 8, 14)]
    assert got[0]["data"] == a[0, 3:6, 8:16, got[0]["ox"] : got[0]["ox"] + 7].tobytes()


def test_values_are_read_where_voxels_are(spark, stored):
    path, a = stored
    vox = spark.createDataFrame([(0, 1, 2, "a"), (8, 19, 20, "b"), (8, 19, 19, "c"), (-1, 0, 0, "d"), (9, 0, 0, "e")], "z int, y int, x int, name string")
    spoil(path, "RAW", {(0, 0, 0), (2, 2, 2)})
    got = {r["name"]: r["value"] for r in volume.values_at(vox, path, "RAW", ("value",)).collect()}
    assert got == {"a": float(a[0, 0, 1, 2]), "b": float(a[0, 8, 19, 20]), "c": float(a[0, 8, 19, 19]), "d": None, "e": None}
    assert volume.values_at(vox.where("z > 99"), path, "RAW", ("value",)).count() == 0


@pytest.mark.parametrize("compressor", [None, "zlib", "gzip", "zstd"])
def test_append_keeps_and_overwrite_replaces(spark, tmp_path, compressor):
    path = str(tmp_path / "w.zarr")
    volume.create(path, "d", [2, 4, 6, 6], [2, 2, 4, 4], "int8", compressor=compressor)
    first = np.arange(288, dtype=np.int64).reshape(2, 4, 6, 6).astype(np.int8)
    volume.write_chunks(rows_of(spark, {(0, 0, 0): first}), path, "d")
    patch = np.full((2, 2, 3, 3), -7, np.int8)
    volume.write_chunks(rows_of(spark, {(1, 2, 2): patch, (3, 5, 5): patch}), path, "d")  # over borders and beyond the shape
    want = first.astype(float)
    want[:, 1:3, 2:5, 2:5] = -7
    want[:, 3, 5, 5] = -7
    assert (array_of(spark, path, "d") == want).all() and volume.pending_chunks(spark, path, "d").count() == 0
    volume.write_chunks(rows_of(spark, {(0, 0, 0): patch}), path, "d", overwrite=True)
    want = np.zeros_like(want)
    want[:, :2, :3, :3] = -7
    assert (array_of(spark, path, "d") == want).all()
    assert {tuple(r) for r in volume.pending_chunks(spark, path, "d").collect()} == {(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)} - {(0, 0, 0)}
    assert sorted(os.listdir(path)) == [".zgroup", "d", "d_done"]


def test_done_map_spans_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(volume, "DONE_EDGE", 2)
    path = str(tmp_path / "m.zarr")
    volume.create(path, "d", [10, 6, 2], [2, 2, 2], "uint8")
    (tmp_path / "t").mkdir()
    for keys in ([[0, 0, 0], [4, 2, 0]], [[3, 1, 0]]):
        volume.mark_done(path, "d", np.array(keys, np.int32), str(tmp_path / "t"))
    assert volume.metadata(path, "d_done")["chunks"] == [2, 2, 1]
    left = {tuple(r) for r in volume.pending_chunks(spark, path, "d").collect()}
    assert left == {(z, y, 0) for z in range(5) for y in range(3)} - {(0, 0, 0), (4, 2, 0), (3, 1, 0)}


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_killed_write_leaves_whole_chunks_and_no_marks(spark, stored, overwrite):
    path, a = stored
    new = {(z, y, 0): np.full((1, 3, 8, 21), 255, np.uint8) for z in (0, 3, 6) for y in (0, 8, 16)}
    rows = rows_of(spark, new).repartitionByRange(3, "oz")
    names = rows.columns

    def break_off(batches):
        for batch in batches:
            if 6 in batch.column(0).to_pylist():
                os._exit(1)  # the worker dies in the middle of the write
            yield batch

    schema = volume.SCHEMA
    broken = rows.mapInArrow(break_off, schema)
    os.remove(f"{path}/RAW_done/0.0.0")
    with pytest.raises(Exception, match="."):
        broken.write.format("volume").mode("overwrite" if overwrite else "append").option("path", path).save()
    now = array_of(spark, path)
    kept = now == a
    if overwrite:
        assert kept.all()
    for k in np.ndindex(3, 3, 3):  # a chunk is all old or all new
        box = tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, (3, 8, 7)))
        assert kept[0][box].all() or (now[0][box] == 255).all()
    assert volume.pending_chunks(spark, path, "RAW").count() == 27
    volume.write_chunks(rows.select(*names), path, "RAW", overwrite)
    assert (array_of(spark, path) == 255).all() and volume.pending_chunks(spark, path, "RAW").count() == 0
    assert not [n for n in os.listdir(path) if n.startswith((".tmp", ".RAW"))]


def brute_blend(blocks, shape, size):
    top, low = np.zeros((4, *shape)), np.zeros(shape)
    w = [np.array([math.sin(math.pi * (i + 0.5) / n) for i in range(n)]) for n in size]
    for o, a in blocks.items():
        for z, y, x in np.ndindex(a.shape[1:]):
            at = (o[0] + z, o[1] + y, o[2] + x)
            if all(0 <= i < s for i, s in zip(at, shape)):
                k = w[0][z] * w[1][y] * w[2][x]
                low[at] += k
                top[(slice(None), *at)] += k * a[:, z, y, x]
    return np.where(low > 0, top / np.where(low > 0, low, 1), 0)


def test_blend_matches_brute_force(spark, tmp_path):
    rng, shape, size = np.random.default_rng(4), (7, 11, 10), (4, 6, 5)
    blocks = {}
    for z in range(0, 7, 3):
        for y in range(0, 11, 4):
            for x in range(0, 10, 3):
                n = [min(k, s - o) for k, s, o in zip(size, shape, (z, y, x))]  # smaller at the far border
                blocks[z, y, x] = rng.uniform(-2, 2, (4, *n))
    blocks[6, 8, -2] = rng.uniform(-2, 2, (4, 4, 6, 5))  # over three borders
    del blocks[0, 0, 0]  # leaves voxels without a block
    want = brute_blend(blocks, shape, size)
    got = np.zeros_like(want)
    for r in blend.blended(rows_of(spark, blocks).repartition(5), shape, size, (3, 4, 10)).collect():
        to = tuple(slice(r[f"o{a}"], r[f"o{a}"] + r[f"s{a}"]) for a in "zyx")
        got[(slice(None), *to)] = np.frombuffer(r["data"]).reshape(4, r["sz"], r["sy"], r["sx"])
    assert np.allclose(got, want, atol=1e-12) and (want[:, 0, 0, 0] == 0).all()
    path = str(tmp_path / "out.zarr")
    blend.blend_to_volume(rows_of(spark, blocks), path, shape, size, (3, 4, 10), scale=200.0, vector_scale=90.0, resolution=(40, 4, 4))
    assert (array_of(spark, path, "pred_syn_indicators")[0] == np.trunc(np.clip(np.round(want[0] * 200, 6), 0, 255))).all()
    assert (array_of(spark, path, "pred_partner_vectors") == np.trunc(np.clip(np.round(want[1:] * 90, 6), -128, 127))).all()
    assert volume.attributes(path, "pred_partner_vectors")["resolution"] == [40, 4, 4]


def test_blend_without_blocks(spark, tmp_path):
    path = str(tmp_path / "none.zarr")
    blend.blend_to_volume(rows_of(spark, {(0, 0, 0): np.zeros((4, 1, 1, 1))}).where("oz > 0"), path, (2, 2, 2), (2, 2, 2), (2, 2, 2))
    assert (array_of(spark, path, "pred_syn_indicators") == 0).all()


def test_dense_blocks_from_voxels(spark):
    vox = spark.createDataFrame([(0, 0, 0, 1.0), (2, 3, 4, 2.0), (2, 9, 0, 3.0)], "z int, y int, x int, v double")
    placed = blend.overlapping(vox, (3, 5, 5), (2, 4, 4), (1, 2, 2))
    at = {(r["v"], r["blk_z"], r["blk_y"], r["blk_x"]) for r in placed.collect()}
    assert at == {(1.0, 0, 0, 0)} | {(2.0, z, y, x) for z in (1, 2) for y in (0, 1) for x in (1, 2)}
    r = next(r for r in blend.dense_blocks(placed, (3, 5, 5), (2, 4, 4), (1, 2, 2), ("v",)).collect() if (r["oz"], r["oy"], r["ox"]) == (2, 2, 4))
    assert (r["sz"], r["sy"], r["sx"]) == (1, 3, 1) and np.frombuffer(r["data"]).tolist() == [0.0, 2.0, 0.0]


def test_halo_rows_leave_out_what_is_outside(spark):
    vox = spark.createDataFrame([(0, 0, 0), (6, 95, 95), (3, 150, 0), (3, 191, 191), (7, 0, 0), (-1, 5, 5)], "z int, y int, x int")
    got = grid.halo_rows(vox, (7, 96, 96), (4, 40, 40), (1, 8, 8))
    assert {(r["y"], r["blk_z"], r["blk_y"], r["blk_x"], r["owned"]) for r in got.collect()} == {(0, 0, 0, 0, True), (95, 1, 2, 2, True)}


def test_schema_has_no_gaps(spark, stored):
    path, _ = stored
    assert load(spark, path, rows="voxels").columns == ["z", "y", "x", "c0"]
    assert load(spark, path).agg(F.count("*")).first()[0] == 27
