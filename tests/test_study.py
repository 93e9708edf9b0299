"""Studies that go on from their table, and the small operators about crops, blocks and pastes."""

import json
import math

import numpy as np
import pytest

from voxframe.operators import grid, render, sampling
from voxframe.operators.nms import nms
from voxframe.plans import study
from voxframe.sources import volume

SPACE = {"cc_threshold": (0.1, 0.9), "lr": (1e-4, 1e-1, "log"), "kind": ["edt", "peak"]}


def objective(p):
    return -abs(p["cc_threshold"] - 0.6) - abs(math.log10(p["lr"]) + 2) / 4 - (p["kind"] == "edt")


def told(trials):
    return [(r["number"], r["params"], r["value"]) for r in trials.orderBy("number").collect()]


def test_a_study_goes_on_where_it_ended(spark, tmp_path):
    whole = study.Study(spark, str(tmp_path / "a"), SPACE, start=4, drawn=12)
    broken = study.Study(spark, str(tmp_path / "b"), SPACE, start=4, drawn=12)
    want = told(whole.run(objective, 14))
    for until in (3, 7, 7, 14):
        got = told(broken.run(objective, until))
    assert got == want and [r[0] for r in want] == list(range(14))
    first, last = [r[2] for r in want[:4]], [r[2] for r in want[8:]]
    assert sum(last) / len(last) > sum(first) / len(first)
    assert all(0.1 <= json.loads(p)["cc_threshold"] <= 0.9 and 1e-4 <= json.loads(p)["lr"] <= 1e-1 for _, p, _ in want)


def test_trials_that_fail_count_for_nothing(spark, tmp_path):
    s = study.Study(spark, str(tmp_path), SPACE, start=2, drawn=4)
    s.run(lambda p: None, 4)
    assert s.trials().where("value is null").count() == 4 and s.propose(4)["kind"] in SPACE["kind"]


def test_density_ratios(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), "ab"[int(x > 0)], float(-(x**2))) for i, x in enumerate(rng.normal(0, 2, 300))]
    trials = study.split(spark.createDataFrame(rows, "number int, x double, k string, value double"))
    assert trials.where("good").count() == 25
    cand = [(0, 0.0, "a"), (1, 3.0, "b"), (2, -0.4, "a")]
    got = {r["candidate"]: r["ratio"] for r in study.density_ratios(trials, spark.createDataFrame(cand, "candidate int, x double, k string"), {"x": 10.0, "k": 0.0}).collect()}
    good = {r[0] for r in sorted(rows, key=lambda r: (-r[3], r[0]))[:25]}
    for c, x, k in cand:
        side = []
        for part in ([r for r in rows if r[0] in good], [r for r in rows if r[0] not in good]):
            h = max(np.std([r[1] for r in part]) * len(part) ** -0.2, 0.1)
            side.append(np.mean([math.exp(-0.5 * ((r[1] - x) / h) ** 2) / h * ((r[2] == k) + 1 / len(part)) for r in part]))
        assert got[c] == pytest.approx(math.log(side[0] + 1e-300) - math.log(side[1] + 1e-300))


def test_trials_score_the_detection_plan(spark):
    vox = spark.createDataFrame([(z, y, x, 0.9 if x < 8 else 0.6, 0.0, 0.0, 0.0) for z in (1, 2) for y in (3, 4) for x in (2, 3, 12, 13)], "z int, y int, x int, p double, vz double, vy double, vx double")
    truth = spark.createDataFrame([(0, 1.0, 3.0, 2.0)], "id long, post_z double, post_y double, post_x double")
    score = study.extraction_objective(vox, truth, 8, 16, 3.0, {"loc_type": "centroid"})
    assert score({"cc_threshold": 0.5, "score_thr": 0.5}) == pytest.approx(2 / 3) and score({"cc_threshold": 0.8, "score_thr": 0.8}) == 1.0
    assert study.detection_score(truth.where("id > 9"), truth.where("id > 9"), 1.0) == 0.0


def test_boxes_are_read_from_their_chunks(spark, tmp_path):
    path = str(tmp_path / "v")
    volume.create(path, "RAW", [6, 10, 9], [4, 4, 4], "uint8")
    a = np.arange(540, dtype=np.int64).reshape(1, 6, 10, 9).astype(np.uint8)
    rows = spark.createDataFrame([(0, 0, 0, 6, 10, 9, 1, "|u1", bytearray(a.tobytes()))], volume.SCHEMA)
    volume.write_chunks(rows, path, "RAW")
    boxes = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 3, 5), (3, -1, 8, 7), (4, 50, 0, 0)], "draw long, oz int, oy int, ox int").repartition(3)
    pad = np.pad(a[0], 60)
    for r in volume.read_boxes(boxes, path, "RAW", (2, 5, 3)).collect():
        o = [r[c] + 60 for c in ("oz", "oy", "ox")]
        want = pad[tuple(slice(b, b + n) for b, n in zip(o, (2, 5, 3)))]
        assert np.array_equal(np.frombuffer(r["data"], np.uint8).reshape(2, 5, 3), want), r["draw"]


def test_crops_and_batches(spark):
    pairs = spark.createDataFrame([(i, float(i), 9.0, 9.0, -i) for i in range(12)], "k long, post_z double, post_y double, post_x double, pre_z long")
    got = sampling.in_output_region(pairs, (6, 10, 10), (4, 4, 4), (2, 3, 3)).collect()
    assert [(r["k"], r["pre_z"]) for r in got] == [(i, -i) for i in range(3, 7)]
    crops = spark.range(10, 21).withColumnRenamed("id", "draw")
    assert sorted((r["batch"], r["place"], r["draw"]) for r in sampling.batches(crops, "draw", 4).collect()) == [(i // 4, i % 4, 10 + i) for i in range(11)]
    assert sampling.batches(crops, "draw", 4, drop_last=True).count() == 8
    assert [sampling.epoch_size(n) for n in (1, 500_000, 5_000_000)] == [1000, 5000, 10_000]
    assert sampling.elastic_context((1.0, 3.0, 3.0)) == (8, 16, 16) and sampling.elastic_context(enabled=False) == (0, 0, 0)


def test_blocks_with_nothing_to_read_are_left_out(spark):
    got = grid.reading_blocks(spark, (4, 10, 10), (2, 4, 4), (2, 3, 3), (1, 1, 1), (0, -8, 0), (4, 10, 10)).collect()
    assert {r["blk_y"] for r in got} == {2, 3} and all(r["ry1"] > r["ry0"] >= 0 for r in got)
    r = next(r for r in got if (r["blk_z"], r["blk_y"], r["blk_x"]) == (0, 2, 3))
    assert (r["wy0"], r["wy1"], r["ry0"], r["ry1"], r["pad_y0"], r["pad_y1"], r["wx1"], r["rx1"], r["pad_x1"]) == (6, 10, 0, 3, 3, 0, 10, 10, 4)


def test_pastes_and_reversed_ties(spark):
    points = spark.createDataFrame([(1, 2.0, 2.0, 2.0, 5.0, 1.0), (2, 2.0, 2.0, 3.0, 4.0, 9.0)], "id long, z double, y double, x double, a double, b double")
    at = lambda how: {r["x"]: (r["a"], r["b"]) for r in render.pasted(points, ["a", "b"], (0.0, 0.0, 1.0), (5, 5, 6), how).collect()}
    assert at("last") == {1: (5.0, 1.0), 2: (4.0, 9.0), 3: (4.0, 9.0), 4: (4.0, 9.0)}
    assert at("max") == {1: (5.0, 1.0), 2: (5.0, 9.0), 3: (5.0, 9.0), 4: (4.0, 9.0)}
    det = spark.createDataFrame([(i, 0.5, 0.0, 0.0, float(i)) for i in range(5)], "id long, score double, post_z double, post_y double, post_x double")
    assert {r["id"] for r in nms(det, 1.5).collect()} == {0, 2, 4}
    assert {r["id"] for r in nms(det.where("id < 4"), 1.5, later_first=True).collect()} == {1, 3}
