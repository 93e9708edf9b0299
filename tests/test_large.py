"""Work that must grow with its input, and results beyond the size of the small tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import kernels


def test_watershed_of_a_large_mask():
    """A percolating mask of many peaks: time must not grow with peaks times voxels."""
    mask = np.random.default_rng(1).random((40, 96, 96)) < 0.67
    start = time.time()
    label = kernels.split_labels(mask, 2, 8)
    assert time.time() - start < 60
    assert (label >= 0).any() and (label[~mask] == -1).all()
    counts = np.bincount(label[label >= 0])
    assert counts.min() >= 8


def test_parts_are_numbered_as_their_masks():
    mask = np.random.default_rng(2).random((6, 9, 9)) < 0.75
    label, parts = kernels.split_labels(mask, 2, 4), kernels.split_mask(mask, 2, 4)
    assert len(parts) == label.max() + 1 and all((p == (label == i)).all() for i, p in enumerate(parts))


def _objects(mask):
    """Rows (z, y, x, id, comp) of a mask's voxels, comp the least id of what hangs together by faces."""
    from voxframe.operators.components import least_of_component

    ids, u, v = np.arange(mask.size).reshape(mask.shape), [], []
    for axis in range(3):
        low, high = (np.take(a, range(k, mask.shape[axis] - 1 + k), axis) for a in (mask,) for k in (0, 1))
        u.append(np.take(ids, range(mask.shape[axis] - 1), axis)[low & high])
        v.append(np.take(ids, range(1, mask.shape[axis]), axis)[low & high])
    comp = ids.ravel().copy()
    node, least = least_of_component(np.concatenate(u), np.concatenate(v))
    comp[node] = least
    return [(int(z), int(y), int(x), int(i), int(comp[i])) for (z, y, x), i in zip(np.argwhere(mask), ids[mask])]


def _split_whole(rows, p):
    """Rows with parts by the kernel, each object in one piece."""
    out, held = set(), {}
    for r in rows:
        held.setdefault(r[4], []).append(r)
    for own in held.values():
        at = np.array([r[:3] for r in own])
        mask = np.zeros(at.max(axis=0) - at.min(axis=0) + 1, bool)
        mask[tuple((at - at.min(axis=0)).T)] = True
        label = kernels.split_labels(mask, p.split_min_peak_dist, p.split_min_sub_size) if len(own) >= p.split_min_size else mask - 1
        out |= {(*r, int(part)) for r, part in zip(own, label[tuple((at - at.min(axis=0)).T)]) if part >= 0}
    return out


@pytest.mark.parametrize("case", range(4))
def test_objects_are_split_in_blocks(spark, case):
    """As the kernel splits them whole, though no task sees more than one small block of an object."""
    from voxframe.plans.extract import ExtractParams, split_components

    rng = np.random.default_rng(20 + case)
    mask = rng.random((13, 14, 15)) < (0.75, 0.9, 0.6, 0.0)[case]
    if case == 3:  # balls and necks, wide flat tops, a box that it fills, objects next to each other
        z, y, x = np.indices(mask.shape)
        mask |= ((z - 6) ** 2 + (y - 4) ** 2 + (x - 4) ** 2 <= 12) | ((z - 6) ** 2 + (y - 9) ** 2 + (x - 4) ** 2 <= 12) | ((abs(z - 10) <= 1) & (x <= 8) & (y <= 12)) | ((x >= 10) & (x <= 12) & (z <= 11)) | ((x == 14) & (y > 2))
    p = ExtractParams(split_min_size=20, split_min_peak_dist=(2, 1, 2, 3)[case], split_min_sub_size=(8, 3, 5, 8)[case])
    rows = _objects(mask)
    got = split_components(spark.createDataFrame(rows, "z int, y int, x int, id long, comp long"), p, (3, 5, 4))
    assert got.columns == ["z", "y", "x", "id", "comp", "part"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == _split_whole(rows, p)
    assert max(r[5] for r in got) > 1


def _points(spark, rng, n, first, spread=3.0):
    """Dense points, a tight cluster, copies of one place and some far away."""
    at = np.concatenate((rng.normal(0, spread, (n, 3)), rng.normal(9, 1e-3, (n // 4, 3)), np.full((n // 8, 3), 1.5), rng.normal(0, 300, (5, 3))))
    rows = [(first + i, *map(float, p)) for i, p in enumerate(at)]
    return rows, spark.createDataFrame(rows, "id long, post_z double, post_y double, post_x double")


def _distances(a, b):
    p, q = np.array([r[1:] for r in a]), np.array([r[1:] for r in b])
    d = np.zeros((len(p), len(q)))
    for i in range(3):
        d += (p[:, None, i] - q[None, :, i]) ** 2
    return np.sqrt(d)


def test_nearest_pairs_few_rows(spark, monkeypatch):
    """Against brute force; the fullest cell of a round's first join is small, so dense rows are not paired with each other."""
    from voxframe.operators import grid

    rng = np.random.default_rng(3)
    (a, left), (b, right) = _points(spark, rng, 240, 0), _points(spark, rng, 320, 10_000)
    made, join = [], grid.radius_join

    def counted(*args, **kw):
        out = join(*args, **kw)
        made.append(out.count())
        return out

    monkeypatch.setattr(grid, "radius_join", counted)
    got = {r["l_id"]: (r["r_id"], r["dist"]) for r in grid.nearest(left, right).collect()}
    d = _distances(a, b)
    best = d.argmin(axis=1)
    assert {k: v[0] for k, v in got.items()} == {r[0]: b[j][0] for r, j in zip(a, best)}
    assert sum(made) < len(a) * len(b) / 10


def test_greedy_matches_of_dense_rows(spark):
    """Against the greedy pass by (dist, l_id, r_id), with copies at one place."""
    from voxframe.operators import grid

    rng = np.random.default_rng(4)
    (a, left), (b, right) = _points(spark, rng, 60, 0), _points(spark, rng, 90, 10_000)
    d = _distances(a, b)
    used, want = set(), []
    for dist, l, r in sorted((d[i, j], a[i][0], b[j][0]) for i in range(len(a)) for j in range(len(b)) if d[i, j] < 5.0):
        if l not in used and r not in used:
            used |= {l, r}
            want.append((l, r))
    assert sorted((r["l_id"], r["r_id"]) for r in grid.matched_one_to_one(left, right, 5.0).collect()) == sorted(want)


def test_bars_beyond_the_top(spark):
    from voxframe.operators import series

    df = spark.createDataFrame([(2500,), (12500,), (0,)], "n long")
    assert {r["n"]: len(r["bar"]) for r in series.bars(df, "n", 5000.0).collect()} == {2500: 20, 12500: 100, 0: 0}


def test_points_are_written_by_as_many_tasks_as_there_are_ranges(spark, monkeypatch):
    import glob

    from voxframe.plans import catalogue_training as ct

    paths, new = [], ct.new_path
    monkeypatch.setattr(ct, "new_path", lambda s, name: paths.append(new(s, name)) or paths[-1])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ct.points_csv_scan(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(glob.glob(paths[0].removeprefix("file:") + "/part-*")) == 9


def test_boxes_are_read_by_many_tasks(spark, monkeypatch, tmp_path):
    from voxframe.sources import volume

    path = f"{tmp_path}/v"
    volume.create(path, "RAW", [6, 8, 8], [3, 4, 4], "uint8")
    vox = spark.createDataFrame([(z, y, x, z * 64 + y * 8 + x & 255) for z in range(6) for y in range(8) for x in range(8)], "z int, y int, x int, v int")
    volume.write_voxels(vox, path, "RAW")
    monkeypatch.setattr(volume, "BOXES_A_TASK", 3)
    boxes = spark.createDataFrame([(i, i % 5, i % 7, (3 * i) % 7) for i in range(30)], "draw long, oz int, oy int, ox int")
    got = volume.read_boxes(boxes, path, "RAW", (2, 2, 2))
    data = {r["draw"]: np.frombuffer(r["data"], np.uint8).reshape(2, 2, 2) for r in got.collect()}
    at = np.indices((2, 2, 2))
    assert all((data[i] == ((at[0] + i % 5) * 64 + (at[1] + i % 7) * 8 + at[2] + (3 * i) % 7 & 255)).all() for i in range(30))
    assert got.rdd.getNumPartitions() >= 5


def test_transposed_convolution_shuffles_its_input_only(spark):
    from voxframe.operators import nn

    rng = np.random.default_rng(5)
    feat = [(c, z, y, x, float(rng.normal())) for c in range(3) for z in range(2) for y in range(3) for x in range(3) if rng.random() < 0.6]
    kernel = [(o, c, 0, dy, dx, float(rng.normal())) for o in range(2) for c in range(2) for dy in range(2) for dx in range(2) if (o, dy) != (1, 1)]
    want = {}
    for c, z, y, x, v in feat:
        for o, k, dz, dy, dx, w in kernel:
            if k == c:
                at = (o, z + dz, y * 2 + dy, x * 2 + dx)
                want[at] = want.get(at, 0.5) + v * w
    got = nn.conv_transpose3d(spark.createDataFrame(feat, "c int, z int, y int, x int, v double"), kernel, (1, 2, 2), 0.5)
    rows = {tuple(r[a] for a in ("c", "z", "y", "x")): r["v"] for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_convolution_shuffles_its_input_only(spark, monkeypatch):
    from voxframe.operators import nn

    rng = np.random.default_rng(6)
    monkeypatch.setattr(nn, "BLOCK", (2, 3, 4))
    feat = [(c, z, y, x, float(rng.normal())) for c in range(3) for z in range(5) for y in range(7) for x in range(6) if rng.random() < 0.15]
    kernel = [(o, c, dz, dy, dx, float(rng.normal())) for o in range(2) for c in range(2) for dz in (-1, 0) for dy in (-1, 0, 1) for dx in (0, 1, 2) if (o, dy, c) != (1, 1, 0)]
    top = [max(r[i] for r in feat) for i in (1, 2, 3)]
    want = {}
    for c, z, y, x, v in feat:
        for o, k, dz, dy, dx, w in kernel:
            at = (o, z - dz, y - dy, x - dx)
            if k == c and all(0 <= a <= t for a, t in zip(at[1:], top)):
                want[at] = want.get(at, 0.0) + v * w
    got = nn.conv3d(spark.createDataFrame(feat, "c int, z int, y int, x int, v double"), kernel)
    rows = {tuple(r[a] for a in ("c", "z", "y", "x")): r["v"] for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)
    assert "Aggregate" not in _plan(got)


def test_gaussian_shuffles_its_input_only(spark, monkeypatch):
    from voxframe.operators import augment

    monkeypatch.setattr(augment, "LINE_CELLS", 20)
    rng = np.random.default_rng(7)
    vox = [(z, y, x, float(rng.normal())) for z in range(4) for y in range(9) for x in range(5) if rng.random() < 0.2]
    df = spark.createDataFrame(vox, "z int, y int, x int, p double")
    got = augment.gaussian(df, "y", 9, 0.5 + F.col("z") * 0.75, 2.75)
    want = {}
    for z, y, x, p in vox:
        s = 0.5 + z * 0.75
        r = int(4 * s + 0.5)
        total = sum(np.exp(-0.5 * (k / s) ** 2) for k in range(-r, r + 1))
        for t in range(9):
            for k in range(-r, r + 1):
                m = (t + k) % 18
                if (m if m < 9 else 17 - m) == y:
                    want[z, t, x] = want.get((z, t, x), 0.0) + p * np.exp(-0.5 * (k / s) ** 2) / total
    rows = {(r["z"], r["y"], r["x"]): r["p"] for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)
    assert "Aggregate" not in _plan(got)


def test_layers_are_not_worked_out_again(spark):
    """A layer's convolution is read by its norm and by what follows, so it is written."""
    from voxframe.operators import nn

    feat = spark.createDataFrame([(c, z, y, 0, float(c + z + y)) for c in range(2) for z in range(3) for y in range(4)], "c int, z int, y int, x int, v double")
    kernel = [(o, c, dz, 0, 0, 1.0 + o) for o in range(2) for c in range(2) for dz in (-1, 0, 1)]
    out = nn.conv_block(feat, [kernel], 2)
    assert out.count() == 24 and "MapInArrow" not in _plan(out) and "Generate" not in _plan(out)


def test_what_grows_with_the_volume_is_not_broadcast(spark):
    from voxframe.operators import grid, voxels
    from voxframe.plans import catalogue, extract

    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    vox = catalogue._predicted(spark, "/root/testdata/sf0.001")
    p = extract.ExtractParams(cc_threshold=0.88, score_thr=0.9, loc_type="peak", suppression=True, suppression_threshold=0.95, suppression_radius=(1.0, 3.0, 3.0))
    found, lab, passed = extract.locate(vox, 96, 96, p)
    more = extract.suppressed_pass(vox, lab, passed, grid.partner(found), 96, 96, p)
    for df in (lab, voxels.label(catalogue.foreground(spark, "/root/testdata/sf0.001")), found, more):
        assert "BroadcastHashJoin" not in planned(df)
