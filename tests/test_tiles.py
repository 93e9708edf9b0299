"""Operators that solve tiles, blocks and lines by themselves and settle only what goes across."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import kernels
from voxframe.operators import nms as nms_module
from voxframe.operators import ordered, series, voxels
from voxframe.operators.nms import nms

AT = ("post_z", "post_y", "post_x")


def greedy(rows, radius, inclusive):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        d = [sum((a - b) ** 2 for a, b in zip(r[2:], k[2:])) ** 0.5 for k in kept]
        if not any(x < radius or inclusive and x <= radius for x in d):
            kept.append(r)
    return {r[0] for r in kept}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, score double, post_z double, post_y double, post_x double").repartition(3)


def count_rounds(monkeypatch):
    rounds, once = [], nms_module._round
    monkeypatch.setattr(nms_module, "_round", lambda *a: (rounds.append(1), once(*a))[1])
    return rounds


@pytest.mark.parametrize("seed,inclusive,tile_rows", [(1, False, 10), (2, True, 25), (3, False, 10_000)])
def test_suppression_over_tiles(spark, monkeypatch, seed, inclusive, tile_rows):
    rng, rounds = random.Random(seed), count_rounds(monkeypatch)
    rows = [(i, rng.choice([0.25, 0.5, 1.0, float(i)]), *[float(rng.randrange(-30, 30)) / rng.choice([1, 2]) for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, 2.0, 5.0, 5.0, 5.0) for i in range(60)]  # many at one place
    got = {r["id"] for r in nms(frame(spark, rows), 6.0, inclusive, tile_rows=tile_rows).collect()}
    assert got == greedy(rows, 6.0, inclusive)
    assert len(rounds) <= 5


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    rounds = count_rounds(monkeypatch)
    n = 10_000
    df = spark.range(n).select("id", (-F.col("id")).cast("double").alias("score"), F.lit(0.0).alias("post_z"), F.lit(0.0).alias("post_y"), (F.col("id") * 0.75).alias("post_x"))
    got = sorted(r["id"] for r in nms(df, 1.0, tile_rows=100).collect())
    assert got == list(range(0, n, 2)) and len(rounds) <= 8


def test_rows_without_score_or_place_stay(spark):
    rows = [(1, 1.0, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0, 0.0), (3, 0.5, None, 0.0, 0.0), (4, 0.5, 0.0, 0.0, 0.1), (5, 0.1, float("nan"), 0.0, 0.0)]
    assert {r["id"] for r in nms(frame(spark, rows), 1.0).collect()} == {1, 2, 3, 5}
    assert nms(frame(spark, rows).where("id > 9"), 1.0).count() == 0


def foreground(spark, mask, offset=(0, 0, 0)):
    at = np.argwhere(mask)
    rows = [(int(i), *(int(c) for c in p + np.array(offset)), 7) for i, p in enumerate(at)]
    return spark.createDataFrame(rows, "id long, z int, y int, x int, v int").repartition(4), rows


def flood(rows):
    """Least id of each voxel's 6-connected component."""
    at = {r[1:4]: r[0] for r in rows}
    comp = {}
    for p, i in sorted(at.items(), key=lambda e: e[1]):
        if p in comp:
            continue
        todo = [p]
        comp[p] = i
        while todo:
            q = todo.pop()
            for k in range(3):
                for s in (-1, 1):
                    t = tuple(c + s * (j == k) for j, c in enumerate(q))
                    if t in at and t not in comp:
                        comp[t] = i
                        todo.append(t)
    return {at[p]: c for p, c in comp.items()}


@pytest.mark.parametrize("block,offset", [((1, 1, 1), (0, 0, 0)), ((2, 3, 4), (-5, -3, 1)), ((16, 64, 64), (0, 0, 0)), ((3, 100, 2), (7, 0, -9))])
def test_labels_do_not_depend_on_blocks(spark, block, offset):
    mask = np.random.default_rng(sum(block)).random((7, 9, 8)) < 0.45
    df, rows = foreground(spark, mask, offset)
    got = {r["id"]: r["comp"] for r in voxels.label(df.unionByName(df.limit(5)), block).collect()}
    assert got == flood(rows)


def test_links_grow_with_surfaces(spark):
    df, _ = foreground(spark, np.ones((8, 16, 16), bool))
    lab = voxels.blockwise_labels(df, (4, 8, 8))
    assert lab.select("_local").distinct().count() == 8
    inner = lab.where(F.col("_faces") == 0).count()
    assert inner == 8 * 2 * 6 * 6
    assert voxels.label(df, (4, 8, 8)).select("comp").distinct().count() == 1
    assert voxels.label(df.where("z < 0")).count() == 0


def farthest(mask):
    d = kernels.distance_transform(mask)
    if np.isinf(d).any():
        return tuple(map(int, np.argwhere(mask)[0])), None
    best = np.unravel_index(np.argmax(np.where(mask, d, -1)), mask.shape)
    return tuple(map(int, best)), float(d[best])


def test_distance_peaks_by_lines(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for comp in range(40):
        mask = rng.random(tuple(rng.integers(1, 9, 3))) < rng.choice([0.7, 0.95, 1.0])
        at = np.argwhere(mask)
        if not len(at):
            continue
        lo = at.min(axis=0)
        tight = mask[tuple(slice(a, b + 1) for a, b in zip(lo, at.max(axis=0)))]
        spot, d = farthest(tight)
        want[comp] = (*[int(a + b) for a, b in zip(spot, lo)], d)
        rows += [(comp, *map(int, p)) for p in at]
    got = {r["comp"]: (r["ez"], r["ey"], r["ex"], r["edt"]) for r in voxels.edt_peaks(spark.createDataFrame(rows, "comp long, z int, y int, x int").repartition(5)).collect()}
    assert got == want


def test_a_thin_diagonal_takes_time_for_its_voxels_only(spark):
    n = 1000  # a staircase of about 3000 voxels in a box of 10**9 cells
    stairs = spark.range(3 * n - 2).select(F.lit(1).cast("long").alias("comp"), *[F.floor((F.col("id") + k) / 3).cast("int").alias(a) for k, a in enumerate("zyx")])
    start = time.perf_counter()
    r = voxels.edt_peaks(stairs).first()
    assert (r["ez"], r["ey"], r["ex"], r["edt"]) == (0, 0, 0, 1.0) and time.perf_counter() - start < 60


def test_envelope_is_linear():
    g = [1] * 200_000
    start = time.perf_counter()
    assert kernels.lower_envelope(g, True, False)[:3] == [1, 1, 1] and time.perf_counter() - start < 5
    flat = kernels.distance_transform(np.pad(np.ones((1, 3, 30_000), bool), ((0, 0), (1, 1), (1, 1))))
    assert flat.max() == 2.0


@pytest.fixture
def metric(spark):
    """Three series, one of them with nearly all rows."""
    rng = random.Random(11)
    rows = [("long" if i % 50 else None if i % 100 else "few", i, float(rng.randrange(1000)), f"2024-01-01 00:{i // 60 % 60:02}:{i % 60:02}") for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "tag string, step long, value double, ts string"), sorted(rows, key=lambda r: r[1])


def by_tag(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans_over_ranges(spark, metric, parts):
    df, rows = metric
    tagged = by_tag(rows)
    best, rate, kept = {}, {}, set()
    for own in tagged.values():
        top, stopped, last = float("-inf"), False, None
        for r in own:
            top = max(top, r[2])
            best[r[1]] = top
            rate[r[1]] = None if last is None else (r[1] - last[1]) / max((int(r[3][14:16]) - int(last[3][14:16])) * 60 + int(r[3][17:]) - int(last[3][17:]), 1e-6)
            stopped |= last is not None and r[2] < last[2]
            kept |= set() if stopped else {r[1]}
            last = r
    assert {r["step"]: r["best"] for r in series.running_best(df, ["tag"], "step", "value", parts).collect()} == best
    assert {r["step"]: r["rate"] for r in series.throughput(df, ["tag"], "step", "ts", parts).collect()} == rate
    assert {r["step"] for r in series.early_stop(df, ["tag"], "step", "value", parts).collect()} == kept
    rising = df.withColumn("value", F.when(F.col("step") < 2000, F.col("step")).otherwise(-F.col("step")).cast("double"))
    assert {r["step"] for r in series.early_stop(rising, ["tag"], "step", "value", parts).collect()} == set(range(2000))
    ema = {r["tag"]: (r["ema"], r["n"]) for r in series.ema(df, ["tag"], "step", "value", 0.9, parts).collect()}
    mean = {r["tag"]: (r["mean"], r["n"]) for r in series.mean_times(df, ["tag"], "step", "value", 3, parts).collect()}
    for tag, own in tagged.items():
        e = own[0][2]
        for r in own[1:]:
            e = 0.9 * e + 0.1 * r[2]
        assert ema[tag] == (pytest.approx(e), len(own)) and mean[tag] == (pytest.approx(sum(r[2] for r in own[3:]) / (len(own) - 3)), len(own) - 3)


def test_one_series_is_spread_over_all_ranges(spark):
    df = spark.range(2_000_000).select(F.lit("only").alias("tag"), F.col("id").alias("step"), (F.col("id") % 1000).cast("double").alias("value"))
    sizes = [r["count"] for r in ordered.in_ranges(df, ["tag"], "step", 16).groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 2_000_000 / 16
    r = ordered.ranked(df, ["tag"], "step", 16).agg(F.max("_i").alias("i"), F.min("_n").alias("n"), F.count_if(F.expr("_i <> step")).alias("bad")).first()
    assert (r["i"], r["n"], r["bad"]) == (1_999_999, 2_000_000, 0)
    assert series.running_best(df.where("step < 0"), ["tag"], "step", "value").count() == 0
