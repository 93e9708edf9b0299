"""Registered queries of sources, sinks, augmentation, sampling and networks, and their SQL (for the grid of sf0.01)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators import augment, blend, chunked, grid, nn, sampling, series, voxels
from voxframe.operators.ranking import global_index
from voxframe.plans import catalogue
from voxframe.plans import fixtures as fx
from voxframe.plans import study
from voxframe.plans.catalogue import _FEAT, AX, UNIT, _features, foreground, query, r6, unit_voxels
from voxframe.plans.fixtures import COMPONENTS, DEPTH, DET, GRID, VOX, detections, sql_u, table, u, volume_shape
from voxframe.plans.fixtures import voxels as voxel_table
from voxframe.sources import logs, manifest, points, snapshots, volume
from voxframe.storage import new_path, written


# ---- volumes, points, snapshots


def _stored(spark, sf_dir) -> str:
    """The voxels in a chunked volume, written in two parts that share chunks."""
    path = new_path(spark, "volume").removeprefix("file:")
    shape = volume_shape(spark, sf_dir)
    volume.create(path, "RAW", list(shape), [3, 40, 40], "uint8", (120, 8, 4), (40, 4, 4))
    v = written(voxel_table(spark, sf_dir), "voxels")
    for part in ("z < 4", "z >= 4"):
        volume.write_voxels(v.where(part), path, "RAW")
    volume.register(spark)
    return path


def _read(spark, path: str, **options: str) -> DataFrame:
    df = spark.read.format("volume").option("path", path)
    for k, v in options.items():
        df = df.option(k, v)
    return volume.to_voxels(df.load())


@query(f"SELECT z, y, x, v::DOUBLE AS v FROM ({VOX})")
def volume_full_scan(spark, sf_dir):
    return _read(spark, _stored(spark, sf_dir))


@query(f"SELECT z, y, x, v::DOUBLE AS v FROM ({VOX}) WHERE z >= 1 AND z < 5 AND y >= 10 AND y < 60 AND x >= 20 AND x < 90")
def volume_sliced_scan(spark, sf_dir):
    return _read(spark, _stored(spark, sf_dir), box="1,10,20,5,60,90")


@query(f"SELECT z, y, x, v::DOUBLE AS v FROM ({VOX}) WHERE z >= 1 AND z < 5 AND y >= 10 AND y < 60 AND x IN (20, 21, 50)")
def volume_filtered_scan(spark, sf_dir):
    """The filters become ranges of chunks before the scan; x is left to Spark within its range."""
    v = spark.read.format("volume").option("path", _stored(spark, sf_dir)).option("rows", "voxels").load()
    return v.where("z >= 1 AND z < 5 AND y >= 10 AND y < 60 AND x IN (20, 21, 50)").select(*AX, F.col("c0").alias("v"))


@query(f"SELECT CAST(blk_z AS INTEGER) AS kz, CAST(blk_y AS INTEGER) AS ky, CAST(blk_x AS INTEGER) AS kx FROM (SELECT unnest(range((d + 2) // 3)) AS blk_z FROM (SELECT {DEPTH} AS d)), range(3) b(blk_y), range(3) c(blk_x) WHERE blk_z % 2 = 1 OR blk_x = 2")
def volume_pending_chunks(spark, sf_dir):
    """What is left to do after a first run that wrote some of the chunks: the run after it takes only these."""
    path, part = new_path(spark, "volume").removeprefix("file:"), F.floor(F.col("z") / 3) % 2 == 0
    volume.create(path, "RAW", list(volume_shape(spark, sf_dir)), [3, 40, 40], "uint8")
    volume.register(spark)
    whole = spark.read.format("volume").option("path", _stored(spark, sf_dir)).load()
    volume.write_chunks(whole.where((F.floor(F.col("oz") / 3) % 2 == 0) & (F.col("ox") < 80)), path, "RAW")
    return volume.pending_chunks(spark, path, "RAW")


_SIZE, _STRIDE = (4, 40, 40), (3, 32, 32)
_BLEND_W = " * ".join(f"sin(pi() * (({a} - k{a} * {s}) + 0.5) / {n})" for a, n, s in zip(AX, _SIZE, _STRIDE))
_BLEND_K = " ".join(f"SELECT *, unnest(range(greatest(({a} - {n}) // {s} + CASE WHEN {a} < {n} AND ({a} - {n}) % {s} <> 0 THEN 0 ELSE 1 END, 0), {a} // {s} + 1)) AS k{a} FROM (" for a, n, s in zip(AX, _SIZE, _STRIDE))


@query(
    f"""WITH b AS ({_BLEND_K} SELECT z, y, x, v FROM ({VOX}))))), w AS (SELECT *, {_BLEND_W} AS w, 1 + ((kz + 2 * ky + 3 * kx) % 4) / 10.0::DOUBLE AS f FROM b)
 SELECT z, y, x, ind, vz, vy, vx FROM (SELECT z, y, x, CAST(trunc(round(least(greatest(sum(w * f * v / 300.0::DOUBLE) / sum(w) * 255, 0), 255), 6)) AS DOUBLE) AS ind,
  {", ".join(f"CAST(trunc(round(least(greatest(sum(w * f * ((v + {k}) % 9 - 4)) / sum(w) * 20, -128), 127), 6)) AS DOUBLE) + 0.0 AS v{a}" for k, a in enumerate(AX))} FROM w GROUP BY z, y, x) WHERE ind <> 0"""
)
def overlap_blend(spark, sf_dir):
    """Overlapping blocks that tell different values of a voxel, blended, cut to whole numbers and flushed to a volume; read back."""
    shape, v, k = volume_shape(spark, sf_dir), F.col("v"), F.col("blk_z") + 2 * F.col("blk_y") + 3 * F.col("blk_x")
    own = 1 + k % 4 / 10
    values = {"p": own * v / 300.0} | {f"v{a}": own * ((v + i) % 9 - 4) for i, a in enumerate(AX)}
    vox = blend.overlapping(voxel_table(spark, sf_dir), shape, _SIZE, _STRIDE).withColumns(values)
    path = new_path(spark, "blended").removeprefix("file:")
    blend.blend_to_volume(blend.dense_blocks(vox, shape, _SIZE, _STRIDE, tuple(values)), path, shape, _SIZE, (5, 32, 48), vector_scale=20.0)
    volume.register(spark)
    found = spark.read.format("volume").option("path", path).option("dataset", "pred_syn_indicators").option("rows", "voxels").load()
    return volume.values_at(found.withColumnRenamed("c0", "ind"), path, "pred_partner_vectors", ("vz", "vy", "vx"))


@query(catalogue.ORACLES["extract_detections"])
def extract_volumes(spark, sf_dir):
    """The detection plan from stored volumes: vectors are read last, and only in chunks where a component passed."""
    from voxframe.plans.extract import ExtractParams
    from voxframe.plans.run import extract_volume

    path, shape = new_path(spark, "predicted").removeprefix("file:"), volume_shape(spark, sf_dir)
    v = written(voxel_table(spark, sf_dir).withColumns({f"v{a}": (F.col("v") + k) % 7 - 3 for k, a in enumerate(AX)}), "voxels")
    volume.create(path, "pred_syn_indicators", list(shape), [4, 32, 48], "uint8")
    volume.create(path, "pred_partner_vectors", [3, *shape], [3, 4, 32, 48], "int8")
    volume.write_voxels(v, path, "pred_syn_indicators")
    volume.write_voxels(v, path, "pred_partner_vectors", ("vz", "vy", "vx"))
    p = ExtractParams(cc_threshold=0.88, score_thr=0.9, size_thr=2, nms_radius=4.0, voxel_size=(2.0, 1.0, 1.0))
    return extract_volume(spark, path, p).select("id", *r6(*catalogue._OUT), "size")


@query(f"SELECT * FROM (VALUES ('z', {DEPTH}::INTEGER, 120, 40, 3.0::DOUBLE), ('y', {GRID}, 8, 4, 2.0::DOUBLE), ('x', {GRID}, 4, 4, 1.0::DOUBLE)) t(axis, size, \"offset\", resolution, origin)")
def volume_attributes(spark, sf_dir):
    path = _stored(spark, sf_dir)
    a, shape, origin = volume.attributes(path, "RAW"), snapshots.shape_or_default(path), snapshots.origin_of(path)
    rows = [(axis, shape[i], a["offset"][i], a["resolution"][i], float(origin[i])) for i, axis in enumerate(AX)]
    return spark.createDataFrame(rows, "axis string, size int, offset int, resolution int, origin double")


_BY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(f"SELECT row_number() OVER (ORDER BY {_BY}) - 1 AS row_id, l_linenumber::DOUBLE AS z, l_partkey::DOUBLE AS y, l_suppkey::DOUBLE AS x FROM lineitem")
def points_csv_scan(spark, sf_dir):
    path = new_path(spark, "points")
    li = table(spark, sf_dir, "lineitem").repartitionByRange(*_BY.split(", ")).sortWithinPartitions(*_BY.split(", "))
    li.select(F.concat_ws(",", "l_linenumber", "l_partkey", "l_suppkey").alias("value")).write.text(path)
    numbered = global_index(points.read_points(spark, path), [F.asc("file"), F.asc("row_id")])
    return numbered.select(F.col("id").alias("row_id"), "z", "y", "x")


@query(f"SELECT z, y, x, v + 1 AS v FROM ({VOX})")
def snapshot_latest(spark, sf_dir):
    path = new_path(spark, "snapshots")
    for i in (100, 200):
        snapshots.write_snapshot(voxel_table(spark, sf_dir).withColumn("v", F.col("v") + (1 if i == 200 else 0)), path, i)
    return snapshots.read_snapshot(spark, path).select(*AX, "v")


# ---- manifests, checkpoints, logs

_STEM = "CASE WHEN p_size % 7 = 0 THEN concat('odd', p_partkey) ELSE concat(lower(replace(p_brand, 'Brand#', 'sp')), '_r', p_size, '_', p_partkey) END"
_MANIFEST = f"""SELECT concat('/v/', stem, '.zarr') AS path, stem, split_part(stem, '_', 1) AS species, p_size % 3 > 1 AND p_size > 1 AS has_points
 FROM (SELECT *, {_STEM} AS stem FROM part) WHERE stem LIKE '%\\_%' ESCAPE '\\' AND split_part(stem, '_', 1) IN ('sp11', 'sp12', 'sp21') AND p_partkey % 5 <> 0 AND p_partkey % 4 <> 0"""


def _manifest(spark, sf_dir):
    odd = F.concat(F.lit("odd"), F.col("p_partkey").cast("string"))
    stem = F.when(F.col("p_size") % 7 == 0, odd).otherwise(F.concat(F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("sp"))), F.lit("_r"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string")))
    p = table(spark, sf_dir, "part").withColumn("stem", stem)
    lists = [p.where(F.col("p_partkey") % k != 0).select(F.concat(F.lit("/c/"), "stem", F.lit(f"_{kind}.csv")).alias("path"), n.alias("n")) for kind, k, n in (("pre", 5, F.col("p_size") % 3), ("post", 4, F.col("p_size")))]
    return manifest.build(p.select(F.concat(F.lit("/v/"), "stem", F.lit(".zarr")).alias("path")), lists[0].unionByName(lists[1]), ["sp11", "sp12", "sp21"])


@query(_MANIFEST)
def manifest_build(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(f"SELECT count(*) AS total, count_if(has_points) AS with_points FROM ({_MANIFEST})")
def manifest_counts(spark, sf_dir):
    return manifest.counts(_manifest(spark, sf_dir))


@query("SELECT p_partkey, sz >= 8 AND sy >= 40 AND sx >= 40 AS context FROM (SELECT p_partkey, p_size AS sz, p_size * 2 AS sy, p_partkey % 100 AS sx FROM part) WHERE sz >= 4 AND sy >= 20 AND sx >= 20")
def volumes_that_fit(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("sz"), (F.col("p_size") * 2).alias("sy"), (F.col("p_partkey") % 100).alias("sx"))
    return manifest.fitting(p, (4, 20, 20), (2, 10, 10)).select("p_partkey", "context")


def _checkpoints(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_checkpoint_"), F.col("p_partkey").cast("string"), F.lit(".pt")).alias("path"))


_PT = "SELECT concat(replace(p_brand, '#', ''), '_checkpoint_', p_partkey, '.pt') AS path, p_brand, p_partkey FROM part"


@query(f"SELECT path FROM ({_PT}) WHERE p_partkey = 150")
def checkpoint_by_number(spark, sf_dir):
    return manifest.checkpoint_at(_checkpoints(spark, sf_dir), 150)


@query(f"SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k FROM ({_PT})) WHERE k > 1")
def stale_checkpoints(spark, sf_dir):
    return manifest.stale_checkpoints(_checkpoints(spark, sf_dir))


@query("SELECT concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S'), '] ', event_type) AS line FROM events")
def log_lines(spark, sf_dir):
    path = new_path(spark, "log")
    logs.append_text(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("message")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT concat_ws('_', n_regionkey, n_nationkey, n_name) AS block FROM nation")
def block_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(logs.block_id(F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_name")).alias("block"))


@query(f"SELECT id, post_z, score FROM ({DET})")
def json_round_trip(spark, sf_dir):
    return logs.decoded(logs.encoded(detections(spark, sf_dir), ["id", "post_z", "score"]), "id long, post_z double, score double")


@query("SELECT 'train/batch' AS name, '4' AS value, 4.0::DOUBLE AS number UNION ALL SELECT 'train/amp', 'True', 1.0 UNION ALL SELECT 'name', 'run', NULL UNION ALL SELECT 'lr', '0.5', 0.5")
def hyper_parameters(spark, sf_dir):
    return logs.hyper_parameters(spark, {"train": {"batch": 4, "amp": True, "steps": [1, 2]}, "name": "run", "lr": 0.5})


@query("SELECT o_orderpriority, n, repeat('#', CAST(floor(n / 5000.0::DOUBLE * 40) AS INTEGER)) AS bar FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def bar_report(spark, sf_dir):
    return series.bars(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "n", 5000.0)


@query("SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE i > 1 GROUP BY 1")
def mean_times(spark, sf_dir):
    return series.mean_times(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value").select("event_type", *r6("mean"), "n")


@query("SELECT round(coalesce(avg(value), 0), 6) AS score, 'some' AS which FROM events UNION ALL SELECT 0.0, 'none'")
def mean_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    some, none = series.mean_score(e, "value"), series.mean_score(e.where("event_id < 0"), "value")
    return some.withColumn("which", F.lit("some")).unionByName(none.withColumn("which", F.lit("none"))).select(*r6("score"), "which")


_ODD = "CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE WHEN l_tax = 0 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END"


@query(f"SELECT l_orderkey, l_linenumber, loss FROM (SELECT l_orderkey, l_linenumber, {_ODD} AS loss FROM lineitem) WHERE isfinite(loss)")
def finite_guard(spark, sf_dir):
    loss = F.when(F.col("l_discount") == 0, float("nan")).when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("l_extendedprice"))
    return series.finite_only(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", loss.alias("loss")), "loss")


# ---- detections and objects


@query(f"SELECT id FROM ({DET}) WHERE abs(post_z - 5) < 2")
def near_slice(spark, sf_dir):
    return grid.near_slice(detections(spark, sf_dir), 5.0).select("id")


@query(f"SELECT z, y, x, round(CASE WHEN p < 0.4 THEN 0 ELSE p END, 6) AS p FROM {UNIT}")
def confidence_mask(spark, sf_dir):
    return grid.confident(unit_voxels(spark, sf_dir), 0.4).select(*AX, *r6("p"))


@query(f"SELECT id, z, y, x FROM {UNIT}")
def unravel_index(spark, sf_dir):
    g = GRID
    return unit_voxels(spark, sf_dir).select("id", *[c.alias(a) for a, c in voxels.unravel(F.col("id"), g, g).items()])


@query(
    f"""{COMPONENTS}, o AS (SELECT comp, count(*) AS n, sum(v * z) / sum(v)::DOUBLE AS wz, sum(v * y) / sum(v)::DOUBLE AS wy, sum(v * x) / sum(v)::DOUBLE AS wx FROM lab GROUP BY comp HAVING count(*) >= 3)
 SELECT comp, n, round(wz, 6) AS wz, round(wy, 6) AS wy, round(wx, 6) AS wx, round(sqrt(((t.v % 7) ** 2 + 4 + 1)::DOUBLE), 6) AS length
 FROM o LEFT JOIN ({VOX}) t ON t.z = round_even(wz, 0) AND t.y = round_even(wy, 0) AND t.x = round_even(wx, 0)"""
)
def object_report(spark, sf_dir):
    vec = voxel_table(spark, sf_dir).select(*AX, (F.col("v") % 7).cast("double").alias("vz"), F.lit(2.0).alias("vy"), F.lit(1.0).alias("vx"))
    return voxels.object_report(voxels.label(foreground(spark, sf_dir)), vec).select("comp", "n", *r6("wz", "wy", "wx", "length"))


@query(f"SELECT d.id, a.v AS post_segment, b.v AS pre_segment FROM ({DET}) d LEFT JOIN ({VOX}) a ON a.z = floor(post_z) AND a.y = floor(post_y) AND a.x = floor(post_x) LEFT JOIN ({VOX}) b ON b.z = floor(post_z + vz) AND b.y = floor(post_y + vy) AND b.x = floor(post_x + vx)")
def segment_match(spark, sf_dir):
    det = grid.partner(detections(spark, sf_dir))
    return grid.segments_of(det, voxel_table(spark, sf_dir).withColumnRenamed("v", "segment")).select("id", "post_segment", "pre_segment")


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dist, l_id, r_id) AS rk FROM (SELECT a.id AS l_id, b.id AS r_id, sqrt((a.post_z - b.post_z) ** 2 + (a.post_y - b.post_y) ** 2 + (a.post_x - b.post_x) ** 2) AS dist
  FROM ({DET}) a, ({DET}) b WHERE a.label >= 5 AND b.label < 5) WHERE dist < 10),
 c AS MATERIALIZED (SELECT a.rk AS hi, b.rk AS lo FROM p a JOIN p b ON a.rk < b.rk AND a.l_id = b.l_id UNION SELECT a.rk, b.rk FROM p a JOIN p b ON a.rk < b.rk AND a.r_id = b.r_id),
 s(rk, kept) USING KEY (rk) AS (SELECT rk, 1 FROM p WHERE rk = 1 UNION
  SELECT n.rk, CASE WHEN count(r.rk) > 0 THEN 0 ELSE 1 END FROM s JOIN p n ON n.rk = s.rk + 1 LEFT JOIN c ON c.lo = n.rk LEFT JOIN recurring.s r ON r.rk = c.hi AND r.kept = 1 GROUP BY n.rk)
 SELECT l_id, r_id, round(dist, 6) AS dist FROM p JOIN s ON p.rk = s.rk WHERE s.kept = 1"""
)
def one_to_one_match(spark, sf_dir):
    d = detections(spark, sf_dir)
    return grid.matched_one_to_one(d.where("label >= 5"), d.where("label < 5"), 10.0).select("l_id", "r_id", *r6("dist"))


# ---- sampling


@query(f"SELECT draw, attempt, event_id FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY attempt) AS k FROM (SELECT event_id // 5 AS draw, event_id % 5 AS attempt, event_id, value FROM events) WHERE value > 250 OR {sql_u('event_id')} >= 0.9) WHERE k = 1")
def draw_loop(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("draw"), (F.col("event_id") % 5).alias("attempt"), "event_id", "value")
    return sampling.first_accepted(e, "draw", "attempt", F.col("value") > 250, u(F.col("event_id")), 0.9).select("draw", "attempt", "event_id")


@query(f"SELECT event_id, CAST(floor({sql_u('event_id + 3')} * (event_id % 40 + 1)) AS INTEGER) AS \"offset\" FROM events")
def crop_offsets(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sampling.crop_offset(u(F.col("event_id") + 3), F.col("event_id") % 40).alias("offset"))


# ---- augmentation


def _su(k: int) -> str:
    return sql_u(f"{k}::BIGINT")


@query(f"""SELECT z, CASE WHEN {_su(8)} < 0.5 THEN b ELSE a END AS y, CASE WHEN {_su(8)} < 0.5 THEN a ELSE b END AS x, v
 FROM (SELECT z, CASE WHEN {_su(6)} < 0.5 THEN 95 - y ELSE y END AS a, CASE WHEN {_su(7)} < 0.5 THEN 95 - x ELSE x END AS b, v FROM ({VOX}))""")
def aug_simple(spark, sf_dir):
    g = GRID
    return augment.simple(voxel_table(spark, sf_dir), g, g, 5).select(*AX, "v")


_HOLE = " OR ".join(f"(y BETWEEN CAST(floor({_su(k)} * 81) AS INTEGER) AND CAST(floor({_su(k)} * 81) AS INTEGER) + 14 AND x BETWEEN CAST(floor({_su(k + 1)} * 66) AS INTEGER) AND CAST(floor({_su(k + 1)} * 66) AS INTEGER) + 29)" for k in (70001, 70003))


@query(f"SELECT z, y, x, round(CASE WHEN {_su(70000)} < 0.9 AND ({_HOLE}) THEN 0 ELSE p END, 6) AS p FROM {UNIT}")
def aug_cutout_drawn(spark, sf_dir):
    g = GRID
    return augment.cutout_drawn(unit_voxels(spark, sf_dir), g, g, 0.9, 2, (30, 15), 70000).select(*AX, *r6("p"))


@query(f"SELECT z, y, x, round(p * 2 - 1, 6) AS p FROM {UNIT}")
def aug_scale_shift(spark, sf_dir):
    return augment.scale_shift(unit_voxels(spark, sf_dir)).select(*AX, *r6("p"))


def _mirror(n: int, r: int) -> str:
    return f"(SELECT t, k, CASE WHEN m < {n} THEN m ELSE {2 * n - 1} - m END AS src FROM (SELECT t, k, (((t + k) % {2 * n}) + {2 * n}) % {2 * n} AS m FROM range({n}) a(t), range(-{r}, {r + 1}) b(k)))"


def _soft(rel: str, axis: str, n: int, sigma: float, others: str) -> str:
    r = int(4 * sigma + 0.5)
    w = f"(SELECT k, exp(-0.5 * (k / {sigma}::DOUBLE) ** 2) / sum(exp(-0.5 * (k / {sigma}::DOUBLE) ** 2)) OVER () AS w FROM range(-{r}, {r + 1}) t(k))"
    return f"(SELECT {others}, CAST(t AS INTEGER) AS {axis}, sum(w * p) AS p FROM {rel} r JOIN {_mirror(n, r)} s ON r.{axis} = s.src JOIN {w} w ON w.k = s.k GROUP BY ALL)"


@query(f"SELECT z, y, x, round(p, 6) AS p FROM {_soft(f'(SELECT z, y, x, p FROM {UNIT})', 'y', 96, 1.5, 'z, x')}")
def gaussian_axis(spark, sf_dir):
    return augment.gaussian(unit_voxels(spark, sf_dir).select(*AX, "p"), "y", GRID, F.lit(1.5), 1.5).select(*AX, *r6("p"))


_SLICE = f"(SELECT z, 1.5::DOUBLE * {sql_u('z::BIGINT * 104729 + 1003')} AS s, {sql_u('z::BIGINT * 104729 + 3')} < 0.6 AND 1.5::DOUBLE * {sql_u('z::BIGINT * 104729 + 1003')} > 0.1 AS hit FROM (SELECT DISTINCT z FROM ({VOX})))"
_BELL = f"(SELECT z, k, exp(-0.5 * (k / s) ** 2) / sum(exp(-0.5 * (k / s) ** 2)) OVER (PARTITION BY z) AS w FROM {_SLICE}, range(-6, 7) t(k) WHERE hit AND abs(k) <= floor(s * 4 + 0.5))"


@query(
    f"""WITH w AS {_BELL}, m AS {_mirror(96, 6)}, a AS (SELECT r.z, r.x, CAST(t AS INTEGER) AS y, sum(w * p) AS p FROM {UNIT} r JOIN m ON r.y = m.src JOIN w ON w.z = r.z AND w.k = m.k GROUP BY ALL),
 b AS (SELECT r.z, r.y, CAST(t AS INTEGER) AS x, sum(w * p) AS p FROM a r JOIN m ON r.x = m.src JOIN w ON w.z = r.z AND w.k = m.k GROUP BY ALL)
 SELECT z, y, x, round(p, 6) AS p FROM b UNION ALL SELECT r.z, y, x, round(p, 6) FROM {UNIT} r JOIN {_SLICE} s ON r.z = s.z WHERE NOT hit"""
)
def aug_blur(spark, sf_dir):
    g = GRID
    return augment.blur(unit_voxels(spark, sf_dir), g, g, 0.6, seed=3).select(*AX, *r6("p"))


_KIND = f"CASE WHEN {sql_u('z::BIGINT * 104729 + 5000')} < 0.25 THEN 'missing' WHEN {sql_u('z::BIGINT * 104729 + 5000')} < 0.5 THEN 'dark' WHEN {sql_u('z::BIGINT * 104729 + 5000')} < 0.75 THEN 'shift' ELSE 'ok' END"
_STEP = "CASE WHEN kind = 'shift' THEN CAST(floor({}  * 33) AS INTEGER) - 16 ELSE 0 END"


@query(
    f"""WITH RECURSIVE g AS MATERIALIZED (SELECT y, x, z, p FROM {UNIT}),
 c AS MATERIALIZED (SELECT a.y, a.x, s.z, coalesce(g.p, 0) AS v, {_KIND.replace('z::BIGINT', 's.z::BIGINT')} AS kind FROM (SELECT DISTINCT y, x FROM g) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS z FROM range(7)) s LEFT JOIN g ON g.y = a.y AND g.x = a.x AND g.z = s.z),
 r AS (SELECT y, x, z, kind, CASE WHEN kind = 'missing' THEN 0.0::DOUBLE ELSE v END AS f FROM c WHERE z = 0
  UNION ALL SELECT c.y, c.x, c.z, c.kind, CASE WHEN c.kind <> 'missing' THEN c.v WHEN c.z = 6 THEN 0 ELSE (r.f + n.v) / 2 END FROM r JOIN c ON c.y = r.y AND c.x = r.x AND c.z = r.z + 1 LEFT JOIN c n ON n.y = c.y AND n.x = c.x AND n.z = c.z + 1)
 SELECT z, CAST((y + {_STEP.format(sql_u('z::BIGINT * 104729 + 7000'))} + 96) % 96 AS INTEGER) AS y, CAST((x + {_STEP.format(sql_u('z::BIGINT * 104729 + 8000'))} + 96) % 96 AS INTEGER) AS x,
 round(least(greatest(CASE WHEN kind = 'dark' THEN f * (0.1 + 0.3::DOUBLE * {sql_u('z::BIGINT * 104729 + 6000')}) ELSE f END, 0), 1), 6) AS p FROM r"""
)
def aug_defects_applied(spark, sf_dir):
    return augment.defects(unit_voxels(spark, sf_dir), volume_shape(spark, sf_dir), 0.25, 0.25, 0.25, 16, 5000).select(*AX, *r6("p"))


_SPACING, _SIGMA = (4, 24, 24), (0.5, 2.0, 2.0)
_N = f"sqrt(-2 * ln(greatest({sql_u('(i + 9) * 104729')}, 1e-12))) * cos(6.283185307179586::DOUBLE * {sql_u('(i + 9) * 104729 * 7 + 331')})"
_NODES = f"(SELECT CAST(i // 75 AS INTEGER) AS c, CAST(i // 25 % 3 AS INTEGER) AS z, CAST(i // 5 % 5 AS INTEGER) AS y, CAST(i % 5 AS INTEGER) AS x, {_N} * CASE WHEN i < 75 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS p FROM range(225) t(i))"
_CORNER = "CASE WHEN {b} = 1 THEN {f} ELSE 1 - {f} END"
_FIELD = f"""n1 AS (SELECT * FROM {_soft(_NODES, 'z', 3, 1.0, 'c, y, x')}), n2 AS (SELECT * FROM {_soft('n1', 'y', 5, 1.0, 'c, z, x')}), n3 AS MATERIALIZED (SELECT * FROM {_soft('n2', 'x', 5, 1.0, 'c, z, y')}),
 at AS (SELECT z, y, x, least(floor(z * 2 / 6.0::DOUBLE), 1) AS z0, least(floor(y * 4 / 95.0::DOUBLE), 3) AS y0, least(floor(x * 4 / 95.0::DOUBLE), 3) AS x0, z * 2 / 6.0::DOUBLE AS pz, y * 4 / 95.0::DOUBLE AS py, x * 4 / 95.0::DOUBLE AS px FROM ({VOX})),
 field AS MATERIALIZED (SELECT a.z, a.y, a.x, {", ".join(f"sum(CASE WHEN n.c = {i} THEN n.p * ({_CORNER.format(b='i', f='(pz - z0)')}) * ({_CORNER.format(b='j', f='(py - y0)')}) * ({_CORNER.format(b='k', f='(px - x0)')}) END) AS d{a}" for i, a in enumerate(AX))}
  FROM at a CROSS JOIN range(2) ti(i) CROSS JOIN range(2) tj(j) CROSS JOIN range(2) tk(k) JOIN n3 n ON n.z = z0 + i AND n.y = y0 + j AND n.x = x0 + k GROUP BY ALL)""".replace(" at AS (", " spots AS (").replace("FROM at a", "FROM spots a")


@query(f"WITH {_FIELD} SELECT z, y, x, round(dz, 6) AS dz, round(dy, 6) AS dy, round(dx, 6) AS dx FROM field")
def displacement_field(spark, sf_dir):
    return augment.displacements(voxel_table(spark, sf_dir), volume_shape(spark, sf_dir), _SPACING, _SIGMA, 9).select(*AX, *r6("dz", "dy", "dx"))


_SLIP = f"CASE WHEN {sql_u('z::BIGINT * 104729 + 509')} < 0.4 THEN floor({{}} * 7) - 3 ELSE 0 END"


@query(
    f"""WITH {_FIELD}, v AS MATERIALIZED (SELECT z, y, x, p FROM {UNIT}), q AS (SELECT z, y, x, least(greatest(z + dz, 0), 6) AS pz, least(greatest(y + dy + {_SLIP.format(sql_u('z::BIGINT * 104729 + 609'))}, 0), 95) AS py, least(greatest(x + dx + {_SLIP.format(sql_u('z::BIGINT * 104729 + 709'))}, 0), 95) AS px FROM field)
 SELECT q.z, q.y, q.x, round(sum(({_CORNER.format(b='i', f='(pz - floor(pz))')}) * ({_CORNER.format(b='j', f='(py - floor(py))')}) * ({_CORNER.format(b='k', f='(px - floor(px))')}) * coalesce(v.p, 0)), 5) AS p
 FROM q CROSS JOIN range(2) ti(i) CROSS JOIN range(2) tj(j) CROSS JOIN range(2) tk(k) LEFT JOIN v ON v.z = floor(pz) + i AND v.y = floor(py) + j AND v.x = floor(px) + k GROUP BY q.z, q.y, q.x"""
)
def aug_elastic(spark, sf_dir):
    out = augment.elastic(unit_voxels(spark, sf_dir), volume_shape(spark, sf_dir), _SPACING, _SIGMA, 0.4, 3, seed=9)
    return out.select(*AX, F.round("p", 5).alias("p"))


@query(f"SELECT z, y, x, 0.0::DOUBLE AS dz, round((cos(0.3::DOUBLE) - 1) * (y - 47.5) - sin(0.3::DOUBLE) * (x - 47.5), 6) AS dy, round(sin(0.3::DOUBLE) * (y - 47.5) + (cos(0.3::DOUBLE) - 1) * (x - 47.5), 6) AS dx FROM ({VOX})")
def rotation_field(spark, sf_dir):
    g = GRID
    return augment.rotation(voxel_table(spark, sf_dir), g, g, 0.3).select(*AX, *r6("dz", "dy", "dx"))


def _central(c: str, axis: str) -> str:
    w = f"(PARTITION BY {', '.join(a for a in AX if a != axis)} ORDER BY {axis})"
    b, a = f"lag({c}) OVER {w}", f"lead({c}) OVER {w}"
    return f"CASE WHEN {b} IS NULL AND {a} IS NULL THEN 0 WHEN {b} IS NULL THEN {a} - {c} WHEN {a} IS NULL THEN {c} - {b} ELSE ({a} - {b}) / 2.0 END"


_J = ", ".join(f"{_central(f'd{c}', a)} + {int(c == a)} AS j{c}{a}" for c in AX for a in AX)


@query(
    f"""WITH f AS (SELECT z, y, x, p AS dz, p * p AS dy, 1 - p AS dx, 1.0::DOUBLE AS vz, p * 2 AS vy, 0.5::DOUBLE AS vx FROM {UNIT}), j AS (SELECT *, {_J} FROM f)
 SELECT z, y, x, {", ".join(f"round(j{c}z * vz + j{c}y * vy + j{c}x * vx, 6) AS v{c}" for c in AX)} FROM j"""
)
def jacobian_vectors(spark, sf_dir):
    p = F.col("p")
    f = unit_voxels(spark, sf_dir).select(*AX, p.alias("dz"), (p * p).alias("dy"), (1 - p).alias("dx"), F.lit(1.0).alias("vz"), (p * 2).alias("vy"), F.lit(0.5).alias("vx"))
    return augment.turned_vectors(f).select(*AX, *r6("vz", "vy", "vx"))


_I = f"least(greatest(p * (0.8 + 0.4::DOUBLE * {sql_u('nz * 2 + 14 + 101')}) + (-0.15 + 0.3::DOUBLE * {sql_u('nz * 2 + 14 + 102')}), 0), 1)"
_G = f"greatest(least({_I}, 1), 1e-8) ** (0.75 + 0.75::DOUBLE * {sql_u('nz + 64')})"
_V = f"CASE WHEN {sql_u('nz + 74')} < 0.3 THEN 1 - {_G} ELSE {_G} END"


@query(f"""SELECT nz AS z, CASE WHEN {_su(7)} < 0.5 THEN b ELSE a END AS y, CASE WHEN {_su(7)} < 0.5 THEN a ELSE b END AS x,
 round((CASE WHEN {sql_u('id + 94')} < 0.05 THEN 0 WHEN {sql_u('id + 94')} < 0.1 THEN 1 ELSE {_V} END) * 2 - 1, 6) AS p
 FROM (SELECT z AS nz, CASE WHEN {_su(5)} < 0.5 THEN 95 - y ELSE y END AS a, CASE WHEN {_su(6)} < 0.5 THEN 95 - x ELSE x END AS b, p, id FROM {UNIT})""")
def aug_pipeline(spark, sf_dir):
    off = {"enabled": False}
    params = {"noise": off, "defect": off, "elastic": off, "blur": off, "cutout": off, "invert": {"prob": 0.3}, "salt_pepper": {"prob": 0.1}}
    return augment.pipeline(unit_voxels(spark, sf_dir), params, volume_shape(spark, sf_dir), 3).select(*AX, *r6("p"))


# ---- networks


@query(f"SELECT c, z, y, x, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 5) AS v FROM {_FEAT} WINDOW w AS (PARTITION BY c)")
def batch_norm(spark, sf_dir):
    return nn.batch_norm(_features(spark, sf_dir)).select("c", *AX, F.round("v", 5).alias("v"))


@query(f"SELECT c, z, y, x, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 5) AS v FROM {_FEAT} WINDOW w AS (PARTITION BY z, c)")
def instance_norm(spark, sf_dir):
    return nn.instance_norm(_features(spark, sf_dir), "z").select("c", *AX, F.round("v", 5).alias("v"))


def _weights(out: int, into: int) -> list[tuple[int, int, int, int, int, float]]:
    return [(o, c, dz, dy, dx, round(0.2 * (o + 1) - 0.07 * c + 0.05 * (dz - dy * (o + 1) + dx), 4)) for o in range(out) for c in range(into) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _weights_sql(out: int, into: int) -> str:
    return f"(SELECT o, c, dz, dy, dx, round(0.2::DOUBLE * (o + 1) - 0.07::DOUBLE * c + 0.05::DOUBLE * (dz - dy * (o + 1) + dx), 4) AS w FROM range({out}) a(o), range({into}) b(c), range(-1, 2) d(dz), range(-1, 2) e(dy), range(-1, 2) f(dx))"


def _conv_block_sql(name: str, rel: str, out: int, into: int) -> str:
    """CTEs name_c (convolution) and name (normalised by channel, without what is below 0)."""
    return f"""{name}_c AS MATERIALIZED (SELECT CAST(o AS INTEGER) AS c, CAST(f.z - dz AS INTEGER) AS z, CAST(f.y - dy AS INTEGER) AS y, CAST(f.x - dx AS INTEGER) AS x, sum(v * w) AS v FROM {rel} f JOIN {_weights_sql(out, into)} k ON f.c = k.c,
  (SELECT max(z) AS mz, max(y) AS my, max(x) AS mx FROM {rel}) m WHERE f.z - dz BETWEEN 0 AND mz AND f.y - dy BETWEEN 0 AND my AND f.x - dx BETWEEN 0 AND mx GROUP BY 1, 2, 3, 4),
 {name} AS MATERIALIZED (SELECT c, z, y, x, greatest((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-3), 0) AS v FROM {name}_c WINDOW w AS (PARTITION BY c))"""


@query(
    f"""WITH f AS MATERIALIZED (SELECT * FROM {_FEAT}), {_conv_block_sql("fine", "f", 2, 4)}, pool AS MATERIALIZED (SELECT c, z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, max(v) AS v FROM fine WHERE y < 96 AND x < 24 GROUP BY 1, 2, 3, 4),
 {_conv_block_sql("coarse", "pool", 2, 2)}, up AS (SELECT CAST(o AS INTEGER) AS c, z, CAST(y * 2 + dy AS INTEGER) AS y, CAST(x * 2 + dx AS INTEGER) AS x, sum(v * (0.5::DOUBLE + 0.25::DOUBLE * o - 0.1::DOUBLE * coarse.c + 0.05::DOUBLE * dy)) AS v FROM coarse, range(2) a(o), range(2) b(dy), range(2) c(dx) GROUP BY 1, 2, 3, 4),
 both AS MATERIALIZED (SELECT c, z, y, x, v FROM fine UNION ALL SELECT c + 2, z, y, x, v FROM up), {_conv_block_sql("last", "both", 2, 4)}
 SELECT z, y, x, round(sum(v * CASE WHEN c = 0 THEN 0.6 ELSE -0.4 END) + 0.1, 4) AS logit, round(sum(v * CASE WHEN c = 0 THEN 0.5 ELSE 0.25 END), 4) AS vz FROM last GROUP BY z, y, x""".replace("both", "joined").replace("last", "final")
)
def unet_forward(spark, sf_dir):
    shape = (volume_shape(spark, sf_dir)[0], GRID, GRID // 4)
    up = [(o, c, 0, dy, dx, 0.5 + 0.25 * o - 0.1 * c + 0.05 * dy) for o in range(2) for c in range(2) for dy in range(2) for dx in range(2)]
    skips = nn.encoder(_features(spark, sf_dir), [([_weights(2, 4)], 2), ([_weights(2, 2)], 2)], [(1, 2, 2)], shape)
    out = nn.decoder(skips, [(up, 2, (1, 2, 2))], [([_weights(2, 4)], 2)])
    return nn.heads(out, {"logit": [0.6, -0.4], "vz": [0.5, 0.25]}, {"logit": 0.1}).select(*AX, F.round("logit", 4).alias("logit"), F.round("vz", 4).alias("vz"))


# ---- networks on dense chunks

_CHUNK = (4, 32, 12)
_DENSE = f"(SELECT CAST(c AS INTEGER) AS c, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, coalesce(v, 0) AS v FROM (SELECT * FROM (SELECT unnest(range({DEPTH})) AS z), range({GRID}) b(y), range({GRID // 4}) d(x), range(4) e(c)) LEFT JOIN {_FEAT} f USING (c, z, y, x))"


def _dense(spark, sf_dir):
    shape = (volume_shape(spark, sf_dir)[0], GRID, GRID // 4)
    return written(chunked.from_voxels(_features(spark, sf_dir), 4, shape, _CHUNK), "chunks")


@query(catalogue.ORACLES["conv3d"].replace(_FEAT, _DENSE))
def conv3d_chunks(spark, sf_dir):
    out = chunked.conv3d(_dense(spark, sf_dir), chunked.kernel_array(catalogue.KERNEL, -1), _CHUNK)
    return chunked.to_voxels(out).select("c", *AX, F.round("v", 5).alias("v"))


@query(catalogue.ORACLES["unet_forward"].replace(_FEAT, _DENSE))
def unet_chunks(spark, sf_dir):
    """The network of unet_forward, chunk by chunk."""

    def block(rows, out, into, chunk):
        return written(chunked.group_norm(written(chunked.conv3d(rows, chunked.kernel_array(_weights(out, into), -1), chunk), "chunks"), out, rectify=True), "chunks")

    half = (_CHUNK[0], _CHUNK[1] // 2, _CHUNK[2] // 2)
    fine = block(_dense(spark, sf_dir), 2, 4, _CHUNK)
    coarse = block(chunked.max_pool3d(fine, (1, 2, 2), _CHUNK), 2, 2, half)
    up = np.array([[[[[0.5 + 0.25 * o - 0.1 * c + 0.05 * dy for _ in range(2)] for dy in range(2)]] for c in range(2)] for o in range(2)])
    last = block(chunked.concat_channels(fine, chunked.conv_transpose3d(coarse, up)), 2, 4, _CHUNK)
    both = chunked.to_voxels(chunked.heads(last, np.array([[0.6, -0.4], [0.5, 0.25]]), np.array([0.1, 0.0])))
    return both.groupBy(*AX).agg(*[F.round(F.max(F.when(F.col("c") == i, F.col("v"))), 4).alias(n) for i, n in enumerate(("logit", "vz"))])


@query(f"SELECT z, y, x, round(1 / (1 + exp(-(v - 1))), 4) AS p FROM ({catalogue.ORACLES['conv3d'].replace(_FEAT, _DENSE).replace('round(sum(v * w), 5)', 'sum(v * w)')}) WHERE c = 1")
def predict_chunks(spark, sf_dir):
    """A model over chunks with context; it is made once in each worker."""
    w = chunked.kernel_array(catalogue.KERNEL, -1)[1:]
    out = chunked.predict(_dense(spark, sf_dir), lambda: lambda a: 1 / (1 + np.exp(1 - chunked.convolved(a[:, 1:-1, 2:-2, :], w))), _CHUNK, (2, 3, 1))
    return chunked.to_voxels(out).select(*AX, F.round("v", 4).alias("p"))


# ---- crops in batches, studies

_CROP, _OUT_BOX = (4, 24, 24), (2, 12, 12)
_DRAWS = f"(SELECT o_orderkey AS draw, CAST(floor({sql_u('o_orderkey * 3 + 11')} * ({DEPTH} - 4 + 1)) AS INTEGER) AS oz, CAST(floor({sql_u('o_orderkey * 3 + 12')} * ({GRID} - 24 + 1)) AS INTEGER) AS oy, CAST(floor({sql_u('o_orderkey * 3 + 13')} * ({GRID} - 24 + 1)) AS INTEGER) AS ox FROM orders WHERE o_orderkey % 16 = 3)"


@query(
    f"""WITH d AS {_DRAWS}, v AS MATERIALIZED ({VOX}), hit AS (SELECT DISTINCT draw FROM d JOIN v ON v.v >= 245 AND z BETWEEN oz + 1 AND oz + 2 AND y BETWEEN oy + 6 AND oy + 17 AND x BETWEEN ox + 6 AND ox + 17),
 ok AS (SELECT *, row_number() OVER (ORDER BY draw) - 1 AS n FROM d SEMI JOIN hit USING (draw))
 SELECT n // 8 AS batch, CAST(n % 8 AS INTEGER) AS place, draw, sum(v.v)::BIGINT AS total FROM ok JOIN v ON z BETWEEN oz AND oz + 3 AND y BETWEEN oy AND oy + 23 AND x BETWEEN ox AND ox + 23 GROUP BY ALL"""
)
def crop_batches(spark, sf_dir):
    """Crops at drawn places whose output region holds a bright voxel, read from a volume and put into batches."""
    shape, path = volume_shape(spark, sf_dir), _stored(spark, sf_dir)
    key = F.col("draw") * 3
    offsets = {f"o{a}": sampling.crop_offset(u(key + 11 + i), F.lit(s - n)) for i, (a, s, n) in enumerate(zip(AX, shape, _CROP))}
    draws = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 16 == 3).select(F.col("o_orderkey").alias("draw")).withColumns(offsets)
    crops = volume.read_boxes(draws, path, "RAW", _CROP)
    lo = [(n - m) // 2 for n, m in zip(_CROP, _OUT_BOX)]

    def judge(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a = np.frombuffer(batch.column(1)[i].as_py(), np.uint8).reshape(_CROP)
                inner = a[tuple(slice(b, b + m) for b, m in zip(lo, _OUT_BOX))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([int(a.sum())], pa.int64()), pa.array([int(inner.max())], pa.int64())], ["draw", "total", "brightest"])

    told = crops.select("draw", "data").mapInArrow(judge, "draw long, total long, brightest long").where("brightest >= 245")
    return sampling.batches(told, "draw", 8).select("batch", "place", "draw", "total")


@query(
    f"""WITH p AS (SELECT z, y, x, v FROM ({VOX})), g AS (SELECT z % 8 AS post_z, y % 40 AS post_y, x % 40 AS post_x, v AS pre_z, y AS pre_y, x AS pre_x FROM p)
 SELECT * FROM g WHERE post_z >= 3 AND post_z < 6 AND post_y >= 10 AND post_y < 30 AND post_x >= 15 AND post_x < 25"""
)
def output_region(spark, sf_dir):
    v = voxel_table(spark, sf_dir)
    g = v.select(*[(F.col(a) % n).alias(f"post_{a}") for a, n in zip(AX, (8, 40, 40))], F.col("v").alias("pre_z"), F.col("y").alias("pre_y"), F.col("x").alias("pre_x"))
    return sampling.in_output_region(g, (5, 36, 30), (3, 20, 10), (2, 2, 5))


@query(
    """WITH t AS (SELECT o_orderkey AS number, ln(o_totalprice) AS a, (o_custkey % 100)::DOUBLE AS b, o_orderpriority AS c, -abs(o_totalprice - 150000) / 1000 - abs(o_custkey % 100 - 40) AS value FROM orders),
 k AS (SELECT *, row_number() OVER (ORDER BY value DESC, number) <= least(25, ceil(0.1 * count(*) OVER ())) AS good FROM t),
 s AS (SELECT good, count(*) AS n, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM k GROUP BY good),
 c AS (SELECT n_nationkey AS candidate, ln(50000.0::DOUBLE + 8000 * n_nationkey) AS ca, (n_nationkey * 4)::DOUBLE AS cb, CASE WHEN n_nationkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS cc FROM nation),
 w AS (SELECT candidate, good, n, greatest(sa * n ** -0.2, 0.05) AS ha, greatest(sb * n ** -0.2, 1.0) AS hb, a, b, c, ca, cb, cc FROM k JOIN s USING (good), c),
 d AS (SELECT candidate, good, sum(exp(-0.5 * ((a - ca) / ha) ** 2) / ha * exp(-0.5 * ((b - cb) / hb) ** 2) / hb * (CASE WHEN c = cc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 1.0::DOUBLE / n) / n) AS s FROM w GROUP BY ALL)
 SELECT candidate, round(ln(max(CASE WHEN good THEN s END) + 1e-300) - ln(max(CASE WHEN NOT good THEN s END) + 1e-300), 6) AS ratio FROM d GROUP BY candidate"""
)
def tpe_ratios(spark, sf_dir):
    """Density ratios of candidates over a table of trials derived from orders."""
    price, b = F.col("o_totalprice"), (F.col("o_custkey") % 100)
    value = -F.abs(price - 150000) / 1000 - F.abs(b - 40)
    trials = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.log(price).alias("a"), b.cast("double").alias("b"), F.col("o_orderpriority").alias("c"), value.alias("value"))
    n = F.col("n_nationkey")
    who = table(spark, sf_dir, "nation").select(n.alias("candidate"), F.log(50000.0 + 8000 * n).alias("a"), (n * 4).cast("double").alias("b"), F.when(n % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("c"))
    return study.density_ratios(study.split(trials), who, {"a": 5.0, "b": 100.0, "c": 0.0}).select("candidate", *r6("ratio"))
