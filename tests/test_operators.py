import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import kernels
from voxframe.operators import grid, render, series, voxels
from voxframe.operators.components import connected_components
from voxframe.operators.nms import nms
from voxframe.operators.ranking import global_index
from voxframe.plans.extract import ExtractParams, extract


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (60, 60)], [(random.Random(i).randrange(60), random.Random(i + 99).randrange(60)) for i in range(40)]])
def test_components_match_union_find(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == union_find(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_nms_is_the_greedy_pass(spark, inclusive):
    rng = random.Random(5)
    rows = [(i, rng.choice([0.1, 0.5, 0.9]), *[float(rng.randrange(12)) for _ in range(3)]) for i in range(80)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        d = [sum((a - b) ** 2 for a, b in zip(r[2:], k[2:])) ** 0.5 for k in kept]
        if not any(x <= 3 if inclusive else x < 3 for x in d):
            kept.append(r)
    df = spark.createDataFrame(rows, "id long, score double, post_z double, post_y double, post_x double")
    assert {r["id"] for r in nms(df, 3.0, inclusive).collect()} == {k[0] for k in kept}


def test_distance_transform_by_brute_force():
    rng = np.random.default_rng(3)
    m = rng.random((4, 5, 6)) < 0.8
    holes = np.argwhere(~m)
    want = np.array([[[min(np.sqrt(((holes - (z, y, x)) ** 2).sum(1))) if m[z, y, x] else 0 for x in range(6)] for y in range(5)] for z in range(4)])
    assert np.allclose(kernels.distance_transform(m), want)
    assert np.isinf(kernels.distance_transform(np.ones((2, 2), bool))).all()


def test_two_balls_are_split():
    z, y, x = np.indices((9, 9, 22))
    m = ((z - 4) ** 2 + (y - 4) ** 2 + (x - 5) ** 2 <= 16) | ((z - 4) ** 2 + (y - 4) ** 2 + (x - 14) ** 2 <= 25)
    parts = kernels.split_mask(m, 4, 8)
    assert len(parts) == 2 and sum(p.sum() for p in parts) == m.sum()
    assert len(kernels.split_mask(np.ones((3, 3, 3), bool))) == 1


def test_elongation():
    assert kernels.elongation(np.ones((3, 3, 3), bool)) == pytest.approx(1.0)
    assert kernels.elongation(np.ones((3, 3, 9), bool)) == pytest.approx((80 / 8) ** 0.5)  # axes go with the moments alone
    assert kernels.elongation(np.ones((1, 1, 9), bool)) > 1e6  # a shortest axis of none counts as 1e-6


def test_gaussian_and_warp_identity():
    a = np.arange(24.0).reshape(2, 3, 4)
    assert np.allclose(kernels.warp(a, np.zeros((3, 2, 3, 4))), a)
    assert np.allclose(kernels.gaussian(np.ones((2, 9)), 1.0), 1)


def test_nearest_by_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, *[rng.uniform(-200, 200) for _ in range(3)]) for i in range(60)]
    schema = "id long, post_z double, post_y double, post_x double"
    a, b = pts[:30], pts[30:]
    got = {r["l_id"]: r["r_id"] for r in grid.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {p[0]: min(b, key=lambda q: (sum((x - y) ** 2 for x, y in zip(p[1:], q[1:])), q[0]))[0] for p in a}


def test_reflect_and_halo(spark):
    got = [r[0] for r in spark.range(-3, 8).select(voxels.reflect(F.col("id"), 4)).collect()]
    assert got == [3, 2, 1, 0, 1, 2, 3, 2, 1, 0, 1]
    v = spark.createDataFrame([(0, 5, 5), (3, 9, 0)], "z int, y int, x int")
    rows = grid.halo_rows(v, (4, 10, 10), (2, 5, 5), (1, 1, 1))
    assert rows.where("owned").count() == 2 and rows.count() > 2


def test_owner_of_an_overlap_is_the_nearest_centre(spark):
    pts = spark.createDataFrame([(1, 2.0, 4.0, 4.0), (2, 2.0, 4.0, 8.0)], "id long, z double, y double, x double")
    got = {(r["z"], r["y"], r["x"]): r["id"] for r in render.owners(pts, (1, 3, 3), (5, 9, 13)).collect()}
    assert got[2, 4, 5] == 1 and got[2, 4, 7] == 2 and got[2, 4, 6] == 1
    cover = {(r["z"], r["y"], r["x"]) for r in render.indicator(pts, (1, 3, 3), (5, 9, 13)).collect()}
    assert set(got) == cover


def test_repair_feeds_the_next_slice(spark):
    df = spark.createDataFrame([(0, 0, 0, 4.0, False), (1, 0, 0, 9.0, True), (2, 0, 0, 9.0, True), (3, 0, 0, 8.0, False)], "z int, y int, x int, v double, missing boolean")
    got = {r["z"]: r["v"] for r in series.repair_missing(df, ["y", "x"]).collect()}
    assert got == {0: 4.0, 1: 6.5, 2: 7.25, 3: 8.0}


def test_ema_by_loop(spark):
    xs = [3.0, 1.0, 4.0, 1.0, 5.0]
    e = xs[0]
    for x in xs[1:]:
        e = 0.98 * e + 0.02 * x
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "tag string, step int, value double")
    assert series.ema(df, ["tag"], "step", "value").first()["ema"] == pytest.approx(e)


def test_global_index(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k int")
    assert sorted((r["k"], r["id"]) for r in global_index(df, [F.col("k").asc()]).collect()) == [(i, i) for i in range(50)]


def test_three_blobs_end_to_end(spark):
    rows, centres = [], [(5, 8, 8), (5, 8, 24), (5, 24, 16)]
    for i, (cz, cy, cx) in enumerate(centres):
        for dz in range(-2, 3):
            for dy in range(-3, 4):
                for dx in range(-3, 4):
                    if dz * dz + dy * dy + dx * dx <= 9:
                        rows.append((cz + dz, cy + dy, cx + dx, 1.0 - 0.02 * i if (dz, dy, dx) == (0, 0, 0) else 0.9 - 0.02 * i, 1.0, 0.0, -2.0))
    vox = spark.createDataFrame(rows, "z int, y int, x int, p double, vz double, vy double, vx double")
    for how in ("edt", "centroid", "peak"):
        got = extract(vox, 32, 32, ExtractParams(loc_type=how, nms_radius=3.0, voxel_size=(4.0, 1.0, 1.0))).orderBy("id").collect()
        assert [(r["post_z"] / 4, r["post_y"], r["post_x"]) for r in got] == [tuple(map(float, c)) for c in centres]
        assert [(r["pre_z"] - r["post_z"], r["pre_x"] - r["post_x"]) for r in got] == [(4.0, -2.0)] * 3
        assert [r["id"] for r in got] == [0, 1, 2]
    assert extract(vox, 32, 32, ExtractParams(cc_threshold=2.0)).count() == 0


def test_suppression_finds_the_weak_neighbour(spark):
    rows = [(0, y, x, 0.99, 0.0, 0.0, 0.0) for y in range(4) for x in range(4)] + [(0, 2, x, 0.6, 0.0, 0.0, 0.0) for x in range(4, 8)]
    rows += [(0, y, x, 0.8, 0.0, 0.0, 0.0) for y in range(4) for x in range(8, 12)]
    vox = spark.createDataFrame(rows, "z int, y int, x int, p double, vz double, vy double, vx double")
    one = extract(vox, 16, 16, ExtractParams(loc_type="centroid"))
    two = extract(vox, 16, 16, ExtractParams(loc_type="centroid", suppression=True, suppression_threshold=0.8, score_thr=0.85, suppression_radius=(1.0, 4.0, 4.0)))
    assert one.count() == 1 and two.count() <= 1
