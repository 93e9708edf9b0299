"""Registered queries and their SQL oracles (run at sf0.01, whose depth some of the SQL is written for)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.operators import augment, grid, metrics, nn, render, series, voxels
from voxframe.operators.nms import nms
from voxframe.operators.ranking import global_index
from voxframe.plans import fixtures as fx
from voxframe.plans.fixtures import COMPONENTS, DEPTH, DET, FG, GRID, VOX, detections, sql_u, table, u, volume_shape
from voxframe.plans.fixtures import voxels as voxel_table
from voxframe.storage import written
from voxframe.streaming import blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AX = ("z", "y", "x")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GRID
    return voxels.threshold(voxel_table(spark, sf_dir), fx.THRESHOLD).withColumn("id", voxels.voxel_id(g, g))


def r6(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def unit_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GRID
    return voxel_table(spark, sf_dir).withColumns({"p": F.col("v") / F.lit(255.0), "id": voxels.voxel_id(g, g)})


UNIT = f"(SELECT *, v / 255.0::DOUBLE AS p, (CAST(z AS BIGINT) * {GRID} + y) * {GRID} + x AS id FROM ({VOX}))"

# ---- thresholds, components, measures


@query(f"SELECT z, y, x, v, id FROM ({FG})")
def threshold_foreground(spark, sf_dir):
    return foreground(spark, sf_dir).select("z", "y", "x", "v", "id")


@query(f"WITH fg AS ({FG}) {fx.EDGES}")
def voxel_edges_6conn(spark, sf_dir):
    return voxels.edges6(foreground(spark, sf_dir))


@query(f"{COMPONENTS} SELECT id, comp FROM lab")
def components_label(spark, sf_dir):
    return voxels.label(foreground(spark, sf_dir)).select("id", "comp")


_MEASURE = """SELECT comp, count(*) AS size, round({f}(v / 255.0::DOUBLE), 6) AS score, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx,
 min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM lab GROUP BY comp"""
_MEASURED = ["z0", "z1", "y0", "y1", "x0", "x1"]


@query(f"{COMPONENTS} {_MEASURE.format(f='avg')}")
def component_measure_mean(spark, sf_dir):
    return voxels.measure(voxels.label(foreground(spark, sf_dir))).select("comp", "size", *r6("score", "cz", "cy", "cx"), *_MEASURED)


@query(f"{COMPONENTS} {_MEASURE.format(f='max')}")
def component_measure_max(spark, sf_dir):
    return voxels.measure(voxels.label(foreground(spark, sf_dir)), "max").select("comp", "size", *r6("score", "cz", "cy", "cx"), *_MEASURED)


@query(f"{COMPONENTS} SELECT comp, z AS pz, y AS py, x AS px FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY v DESC, z, y, x) AS k FROM lab) WHERE k = 1")
def component_peak(spark, sf_dir):
    return voxels.measure(voxels.label(foreground(spark, sf_dir))).select("comp", "pz", "py", "px")


@query(f"{COMPONENTS} SELECT comp, count(*) AS size, round(avg(v / 255.0::DOUBLE), 6) AS score FROM lab GROUP BY comp HAVING count(*) >= 3 AND avg(v / 255.0::DOUBLE) >= 0.93")
def component_filter_size_score(spark, sf_dir):
    return voxels.survivors(voxels.measure(voxels.label(foreground(spark, sf_dir))), 3, 0.93).select("comp", "size", *r6("score"))


@query(f"{COMPONENTS} SELECT comp, round(sum(v * z) / sum(v)::DOUBLE, 6) AS wz, round(sum(v * y) / sum(v)::DOUBLE, 6) AS wy, round(sum(v * x) / sum(v)::DOUBLE, 6) AS wx FROM lab GROUP BY comp")
def component_weighted_com(spark, sf_dir):
    return voxels.weighted_centre(voxels.label(foreground(spark, sf_dir)), F.col("v")).select("comp", *r6("wz", "wy", "wx"))


@query(
    f"""{COMPONENTS}, box AS (SELECT comp, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM lab GROUP BY comp),
 cells AS (SELECT comp, zz AS z, yy AS y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS yy FROM (SELECT *, unnest(range(z0, z1 + 1)) AS zz FROM box))),
 holes AS (SELECT c.* FROM cells c ANTI JOIN lab l ON c.comp = l.comp AND c.z = l.z AND c.y = l.y AND c.x = l.x),
 d AS (SELECT l.comp, l.z, l.y, l.x, coalesce(min((l.z - h.z) ** 2 + (l.y - h.y) ** 2 + (l.x - h.x) ** 2), 1e9) AS d2 FROM lab l LEFT JOIN holes h ON l.comp = h.comp GROUP BY ALL)
 SELECT comp, z AS ez, y AS ey, x AS ex, round(CASE WHEN d2 < 1e9 THEN sqrt(d2::DOUBLE) END, 6) AS edt
 FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY d2 DESC, z, y, x) AS k FROM d) WHERE k = 1"""
)
def component_edt_peak(spark, sf_dir):
    return voxels.edt_peaks(voxels.label(foreground(spark, sf_dir))).select("comp", "ez", "ey", "ex", *r6("edt"))


@query(f"SELECT count(*) AS total, count_if(v >= {fx.THRESHOLD}) AS foreground, max(v) AS hi, min(v) AS lo FROM ({VOX})")
def foreground_counts(spark, sf_dir):
    return voxel_table(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("v") >= fx.THRESHOLD).alias("foreground"), F.max("v").alias("hi"), F.min("v").alias("lo"))


@query(f"SELECT z FROM ({VOX}) GROUP BY z HAVING max(v) > 248")
def slices_with_foreground(spark, sf_dir):
    return voxel_table(spark, sf_dir).groupBy("z").agg(F.max("v").alias("m")).where("m > 248").select("z")


# ---- detections


@query(f"SELECT id, round(post_z, 6) AS post_z, round(post_z + vz, 6) AS pre_z, round(post_y + vy, 6) AS pre_y, round(post_x + vx, 6) AS pre_x FROM ({DET})")
def partner_projection(spark, sf_dir):
    return grid.partner(detections(spark, sf_dir)).select("id", *r6("post_z", "pre_z", "pre_y", "pre_x"))


@query(f"SELECT id, round(post_z + vz, 6) AS post_z, round(post_z, 6) AS pre_z, round(post_x + vx, 6) AS post_x, round(post_x, 6) AS pre_x FROM ({DET})")
def flip_prepost(spark, sf_dir):
    return grid.flip(grid.partner(detections(spark, sf_dir))).select("id", *r6("post_z", "pre_z", "post_x", "pre_x"))


@query(f"SELECT id, round(post_z * 40 + 120, 6) AS post_z, round(post_y * 4 - 8, 6) AS post_y, round(post_x * 4 + 3, 6) AS post_x FROM ({DET})")
def affine_world(spark, sf_dir):
    return grid.affine(detections(spark, sf_dir), (40.0, 4.0, 4.0), (120.0, -8.0, 3.0)).select("id", *r6("post_z", "post_y", "post_x"))


_D2 = "(a.post_z - b.post_z) ** 2 + (a.post_y - b.post_y) ** 2 + (a.post_x - b.post_x) ** 2"


def _nms_sql(op: str) -> str:
    return f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk FROM ({DET})),
 c AS (SELECT a.rk AS hi, b.rk AS lo FROM d a JOIN d b ON a.rk < b.rk WHERE sqrt({_D2}) {op} 8),
 s(rk, kept) USING KEY (rk) AS (SELECT rk, 1 FROM d WHERE rk = 1 UNION
  SELECT n.rk, CASE WHEN count(r.rk) > 0 THEN 0 ELSE 1 END FROM s JOIN d n ON n.rk = s.rk + 1 LEFT JOIN c ON c.lo = n.rk
  LEFT JOIN recurring.s r ON r.rk = c.hi AND r.kept = 1 GROUP BY n.rk)
 SELECT d.id, round(d.score, 6) AS score FROM d JOIN s ON d.rk = s.rk WHERE s.kept = 1"""


@query(_nms_sql("<"))
def nms_strict(spark, sf_dir):
    return nms(detections(spark, sf_dir), 8.0).select("id", *r6("score"))


@query(_nms_sql("<").replace(f"({DET})", f"(SELECT * REPLACE (round(score, 1) AS score) FROM ({DET}))").replace("score DESC, id", "score DESC, id DESC"))
def nms_later_first(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("score", F.round("score", 1))
    return nms(d, 8.0, later_first=True).select("id", *r6("score"))


@query(_nms_sql("<="))
def nms_inclusive(spark, sf_dir):
    return nms(detections(spark, sf_dir), 8.0, inclusive=True).select("id", *r6("score"))


@query(f"SELECT id AS det, row_number() OVER (ORDER BY score DESC, id) - 1 AS id FROM ({DET})")
def reindex_ids(spark, sf_dir):
    d = detections(spark, sf_dir).select(F.col("id").alias("det"), "score")
    return global_index(d, [F.desc("score"), F.asc("det")]).select("det", "id")


@query(f"SELECT a.id AS l_id, b.id AS r_id, round(sqrt({_D2}), 6) AS dist FROM ({DET}) a JOIN ({DET}) b ON a.id < b.id WHERE sqrt({_D2}) < 8")
def radius_join(spark, sf_dir):
    d = detections(spark, sf_dir).select("id", *grid.POST)
    return grid.radius_join(d, d, 8.0).where("l_id < r_id").select("l_id", "r_id", *r6("dist"))


@query(f"SELECT a.id FROM ({DET}) a WHERE a.label >= 5 AND NOT EXISTS (SELECT 1 FROM ({DET}) b WHERE b.label < 5 AND sqrt({_D2}) < 6)")
def min_separation_anti(spark, sf_dir):
    d = detections(spark, sf_dir)
    return grid.separated(d.where("label >= 5"), d.where("label < 5"), 6.0).select("id")


_NEAR = f"""SELECT l_id, r_id, dist FROM (SELECT a.id AS l_id, b.id AS r_id, sqrt({_D2}) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY sqrt({_D2}), b.id) AS k
 FROM ({DET}) a, ({DET}) b WHERE a.label >= 5 AND b.label < 5) WHERE k = 1"""


@query(f"SELECT l_id, r_id, round(dist, 6) AS dist FROM ({_NEAR})")
def nearest_center(spark, sf_dir):
    d = detections(spark, sf_dir)
    return grid.nearest(d.where("label >= 5"), d.where("label < 5")).select("l_id", "r_id", *r6("dist"))


@query(
    f"""WITH n AS ({_NEAR}), c AS (SELECT count_if(label >= 5) AS np, count_if(label < 5) AS ng FROM ({DET})), t AS (SELECT count(*) AS tp FROM n WHERE dist < 10)
 SELECT tp, round(tp / np::DOUBLE, 6) AS precision, round(tp / ng::DOUBLE, 6) AS recall, round(2 * (tp / np::DOUBLE) * (tp / ng::DOUBLE) / (tp / np::DOUBLE + tp / ng::DOUBLE + 1e-8), 6) AS f1 FROM t, c"""
)
def pr_f1(spark, sf_dir):
    d = detections(spark, sf_dir)
    n = d.agg(F.count_if(F.col("label") >= 5).alias("p"), F.count_if(F.col("label") < 5).alias("g")).first()
    near = grid.radius_join(d.where("label >= 5").select("id", *grid.POST), d.where("label < 5").select("id", *grid.POST), 10.0).select("l_id").distinct()
    return metrics.pr_f1(near, n["p"], n["g"]).select("tp", *r6("precision", "recall", "f1"))


def _vectors(spark, sf_dir):
    e = F.col("embedding")
    cols = [e[i].cast("double").alias(n) for i, n in enumerate(("pz", "py", "px", "tz", "ty", "tx", "p"))]
    return table(spark, sf_dir, "embeddings").select(*cols, (F.col("label") / 9.0).alias("gt"), F.when(F.col("label") > 4, 1.0).otherwise(0.0).alias("target"), F.when(F.col("label") > 2, 1.0).otherwise(0.0).alias("w"), (e[7].cast("double") * 10).alias("logit"))


_VEC = """(SELECT CAST(embedding[1] AS DOUBLE) pz, CAST(embedding[2] AS DOUBLE) py, CAST(embedding[3] AS DOUBLE) px, CAST(embedding[4] AS DOUBLE) tz, CAST(embedding[5] AS DOUBLE) ty,
 CAST(embedding[6] AS DOUBLE) tx, CAST(embedding[7] AS DOUBLE) p, label / 9.0::DOUBLE AS gt, CASE WHEN label > 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target,
 CASE WHEN label > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w, CAST(embedding[8] AS DOUBLE) * 10 AS logit FROM embeddings)"""


@query(
    f"""SELECT round(avg(CASE WHEN gt > 0.5 THEN p END) - avg(CASE WHEN gt <= 0.5 THEN p END), 6) AS separation,
 round(avg(CASE WHEN gt > 0.5 THEN (pz * tz + py * ty + px * tx) / ((sqrt(pz * pz + py * py + px * px) + 1e-8) * (sqrt(tz * tz + ty * ty + tx * tx) + 1e-8)) END), 6) AS cosine FROM {_VEC}"""
)
def cosine_separation(spark, sf_dir):
    return metrics.separation_cosine(_vectors(spark, sf_dir)).select(*r6("separation", "cosine"))


_CE = "(greatest(x, 0) - x * target + ln(1 + exp(-abs(x))))"
_PT = "((1 / (1 + exp(-x))) * target + (1 - 1 / (1 + exp(-x))) * (1 - target))"
_LOGIT = f"(SELECT *, greatest(least(logit, 15.0::DOUBLE), -15.0::DOUBLE) AS x FROM {_VEC})"


@query(f"SELECT round(avg((1 - {_PT}) ** 2 * {_CE} * CASE WHEN target > 0.5 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS loss FROM {_LOGIT}")
def focal_bce(spark, sf_dir):
    return metrics.focal_bce(_vectors(spark, sf_dir), 2.0, pos_weight=3.0).select(*r6("loss"))


@query(
    f"""WITH c AS (SELECT sum(target) AS pp, count(*) AS n FROM {_LOGIT})
 SELECT round(avg((1 - {_PT}) * {_CE} * CASE WHEN target > 0.5 THEN n / (2 * c.pp) ELSE n / (2 * (n - c.pp)) END), 6) AS loss FROM {_LOGIT}, c"""
)
def balanced_bce(spark, sf_dir):
    return metrics.focal_bce(_vectors(spark, sf_dir), 1.0, balance=True).select(*r6("loss"))


_DIR = "(((pz - tz) ** 2 + (py - ty) ** 2 + (px - tx) ** 2) * w / (sqrt(tz * tz + ty * ty + tx * tx) + 1))"


@query(f"SELECT round(sum{_DIR} / (sum(w) * 3 + 1e-7), 6) AS loss FROM {_VEC}")
def direction_loss(spark, sf_dir):
    return metrics.direction_loss(_vectors(spark, sf_dir), by_magnitude=True).select(*r6("loss"))


@query(f"SELECT round(3 * avg((1 - {_PT}) ** 2 * {_CE}) + 0.02 * (sum{_DIR} / (sum(w) * 3 + 1e-7)), 6) AS loss FROM {_LOGIT}")
def combined_loss(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a, b = metrics.focal_bce(v, 2.0).withColumnRenamed("loss", "m"), metrics.direction_loss(v, by_magnitude=True).withColumnRenamed("loss", "d")
    one = lambda df, k: df.withColumn("k", F.lit(k))
    return one(a, 0).join(one(b, 0), "k").select(F.round(metrics.combine(F.col("m"), F.col("d"), 3.0, 0.02), 6).alias("loss"))


_BINS = f"(SELECT least(floor(p * 126), 126)::INTEGER AS bin, CASE WHEN (z + y + x) % 3 = 0 THEN 1 ELSE 0 END AS t FROM {UNIT})"


@query(
    f"""WITH b AS (SELECT bin, sum(t) AS pos, sum(1 - t) AS neg FROM {_BINS} GROUP BY bin), n AS (SELECT sum(pos) AS n FROM b),
 c AS (SELECT bin, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM b WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING))
 SELECT bin, round(bin / 126.0::DOUBLE, 6) AS threshold, tp, fp, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / n::DOUBLE, 6) AS recall FROM c, n"""
)
def pr_curve(spark, sf_dir):
    v = unit_voxels(spark, sf_dir).withColumn("target", F.when((F.col("z") + F.col("y") + F.col("x")) % 3 == 0, 1.0).otherwise(0.0))
    return metrics.pr_curve(v).select("bin", *r6("threshold"), "tp", "fp", *r6("precision", "recall"))


@query("SELECT CAST(least(floor((l_extendedprice - 0) / 5000), 30) AS INTEGER) AS bucket, count(*) AS n, round(min(l_extendedprice), 6) AS lo, round(max(l_extendedprice), 6) AS hi FROM lineitem GROUP BY 1")
def value_histogram(spark, sf_dir):
    b = F.least(F.floor(F.col("l_extendedprice") / 5000), F.lit(30)).cast("int").alias("bucket")
    return table(spark, sf_dir, "lineitem").groupBy(b).agg(F.count("*").alias("n"), F.round(F.min("l_extendedprice"), 6).alias("lo"), F.round(F.max("l_extendedprice"), 6).alias("hi"))


@query("SELECT l_returnflag, round(sqrt(sum(l_discount * l_discount)), 6) AS norm, round(avg(abs(l_tax)), 6) AS mean_abs FROM lineitem GROUP BY 1")
def gradient_norms(spark, sf_dir):
    c = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sqrt(F.sum(c * c)), 6).alias("norm"), F.round(F.avg(F.abs("l_tax")), 6).alias("mean_abs"))


# ---- schedules and series

_LR = "CASE WHEN s < 200 THEN greatest(s / 200.0::DOUBLE, 1e-6) ELSE 0.01::DOUBLE + 0.99::DOUBLE * 0.5 * (1 + cos(pi() * least((s - 200) / 800.0::DOUBLE, 1.0))) END"


@query(f"SELECT s AS step, round({_LR}, 6) AS factor FROM (SELECT event_id AS s FROM events)")
def lr_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.round(metrics.lr_factor(F.col("event_id"), 200, 1000, 100.0), 6).alias("factor"))


@query("SELECT event_id AS step, CASE WHEN event_id >= 400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gamma FROM events")
def gamma_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), metrics.gamma_at(F.col("event_id"), 0.0, 400, 1.0).alias("gamma"))


@query(
    """WITH n AS (SELECT event_type AS tag, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT tag, round(sum(value * 0.98::DOUBLE ** (n - 1 - i) * CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 1 - 0.98::DOUBLE END), 6) AS ema, count(*) AS n FROM n GROUP BY tag"""
)
def ema_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), "event_id", "value")
    return series.ema(e, ["tag"], "event_id", "value").select("tag", *r6("ema"), "n")


@query(
    """WITH n AS (SELECT event_type AS tag, event_id, value, epoch_us(ts) / 1e6 AS t, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, lag(event_id) OVER w AS before, lag(epoch_us(ts)) OVER w / 1e6 AS past
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
 SELECT tag, max(event_id) AS step, round(sum(value * 0.98::DOUBLE ** (n - 1 - i) * CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 1 - 0.98::DOUBLE END), 6) AS ema,
  round(max(CASE WHEN i = n - 1 THEN (event_id - before) / greatest(t - past, 1e-6) END), 4) AS rate FROM n GROUP BY tag"""
)
def online_series(spark, sf_dir):
    """The stateful operator of streams over a whole table."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value", "ts")
    return blocks.online_series(e).select("tag", "step", *r6("ema"), F.round("rate", 4).alias("rate"))


@query("SELECT event_id, round((event_id - lag(event_id) OVER w) / greatest(epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER w / 1e6, 1e-6), 4) AS rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def throughput(spark, sf_dir):
    return series.throughput(table(spark, sf_dir, "events"), ["event_type"], "event_id", "ts").select("event_id", F.round("rate", 4).alias("rate"))


@query("SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark, sf_dir):
    return series.running_best(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value").select("event_id", "best")


@query(
    """WITH d AS (SELECT user_id, event_id, value, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS d FROM events)
 SELECT user_id, event_id, value FROM (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM d) WHERE s = 0"""
)
def early_stop(spark, sf_dir):
    return series.early_stop(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def leaderboard_top20(spark, sf_dir):
    return series.leaderboard(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderpriority, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS best FROM orders GROUP BY 1")
def best_trial(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


# ---- points, manifests, paths


@query("SELECT split_part(p_name, ' ', 1) AS species, count(*) AS n, count_if(p_size > 25) AS with_points FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23') GROUP BY 1")
def manifest_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23"))
    return p.groupBy(F.split("p_name", " ")[0].alias("species")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("with_points"))


_ORD = "row_number() OVER (PARTITION BY {k} ORDER BY {o})"


@query(
    f"""WITH post AS (SELECT l_orderkey AS vol, l_partkey AS z, {_ORD.format(k="l_orderkey", o="l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate")} AS row_id FROM lineitem),
 pre AS (SELECT l_orderkey AS vol, l_suppkey AS z, {_ORD.format(k="l_orderkey", o="l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate")} AS row_id FROM lineitem WHERE l_quantity > 5)
 SELECT vol, CAST(row_id AS INTEGER) AS row_id, pre.z AS pre_z, post.z AS post_z FROM pre JOIN post USING (vol, row_id)"""
)
def points_zip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("vol").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = lambda df, c, n: df.withColumn("vol", F.col("l_orderkey")).withColumn("row_id", F.row_number().over(w)).select("vol", "row_id", F.col(c).alias(n))
    return rows(li.where("l_quantity > 5"), "l_suppkey", "pre_z").join(rows(li, "l_partkey", "post_z"), ["vol", "row_id"])


@query("SELECT a.k AS vol, a.n AS n_post, b.n AS n_pre FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY 1) b USING (k) WHERE a.n <> b.n")
def row_count_mismatch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("vol")).agg(F.count("*").alias("n_post"))
    b = li.where("l_quantity > 5").groupBy(F.col("l_orderkey").alias("vol")).agg(F.count("*").alias("n_pre"))
    return a.join(b, "vol").where("n_post <> n_pre")


@query("SELECT brand, max(n) AS latest FROM (SELECT p_brand AS brand, CAST(regexp_extract(concat('model_checkpoint_', p_partkey, '.pt'), '_([0-9]+)\\.pt$', 1) AS BIGINT) AS n FROM part) GROUP BY 1")
def latest_by_suffix(spark, sf_dir):
    path = F.concat(F.lit("model_checkpoint_"), F.col("p_partkey").cast("string"), F.lit(".pt"))
    n = F.regexp_extract(path, r"_(\d+)\.pt$", 1).cast("long")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max(n).alias("latest"))


@query("SELECT p_partkey, regexp_replace(concat('encoder.conv_blocks.', p_size, '.weight'), 'encoder\\.conv_blocks\\.([0-9]+)', 'encoder.conv_\\1') AS name FROM part")
def key_rename(spark, sf_dir):
    k = F.concat(F.lit("encoder.conv_blocks."), F.col("p_size").cast("string"), F.lit(".weight"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(k, r"encoder\.conv_blocks\.(\d+)", "encoder.conv_$1").alias("name"))


_DRAW = f"(SELECT event_id, {sql_u('event_id + 17')} AS u FROM events)"


@query(
    f"""WITH w AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM part), c AS (SELECT p_partkey, sum(w) OVER (ORDER BY p_partkey) / sum(w) OVER () AS hi FROM w)
 SELECT event_id, p_partkey FROM {_DRAW} d ASOF JOIN c ON d.u < c.hi"""
)
def weighted_choice(spark, sf_dir):
    from voxframe.operators.sampling import weighted_choice as choose

    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, 4.0).otherwise(1.0).alias("w"))
    d = table(spark, sf_dir, "events").select("event_id", u(F.col("event_id") + 17).alias("u"))
    return choose(d, p, "p_partkey", "w").select("event_id", "p_partkey")


@query(f"SELECT p_partkey, p_size FROM part WHERE p_size > 40 OR {sql_u('p_partkey')} >= 0.8")
def rejection_sample(spark, sf_dir):
    from voxframe.operators.sampling import reject

    return reject(table(spark, sf_dir, "part"), F.col("p_size") > 40, u(F.col("p_partkey")), 0.8).select("p_partkey", "p_size")


# ---- crops, blocks, normalisation


@query(f"SELECT z, y, x, v FROM ({VOX}) WHERE z >= 1 AND z < 5 AND y >= 10 AND y < 60 AND x >= 20 AND x < 90")
def in_bounds(spark, sf_dir):
    return voxels.in_box(voxel_table(spark, sf_dir), (1, 10, 20), (5, 60, 90))


@query(f"SELECT z - 1 AS z, y - 10 AS y, x - 20 AS x, v FROM ({VOX}) WHERE z >= 1 AND z < 5 AND y >= 10 AND y < 60 AND x >= 20 AND x < 90")
def crop_rebase(spark, sf_dir):
    return voxels.crop(voxel_table(spark, sf_dir), (1, 10, 20), (4, 50, 70))


@query(f"WITH c AS (SELECT ({DEPTH} - 3) // 2 AS z0) SELECT CAST(z - z0 AS INTEGER) AS z, y - 23 AS y, x - 15 AS x, v FROM ({VOX}), c WHERE z >= z0 AND z < z0 + 3 AND y >= 23 AND y < 73 AND x >= 15 AND x < 80")
def center_crop(spark, sf_dir):
    return voxels.centre_crop(voxel_table(spark, sf_dir), volume_shape(spark, sf_dir), (3, 50, 65))


BLOCK, CONTEXT = (4, 40, 40), (1, 8, 8)
_GRID_SQL = f"""SELECT blk_z, blk_y, blk_x, blk_z * 4 AS wz0, least(blk_z * 4 + 4, d) AS wz1, greatest(blk_z * 4 - 1, 0) AS rz0, least(least(blk_z * 4 + 4, d) + 1, d) AS rz1,
 blk_y * 40 AS wy0, least(blk_y * 40 + 40, {GRID}) AS wy1, greatest(blk_y * 40 - 8, 0) AS ry0, least(least(blk_y * 40 + 40, {GRID}) + 8, {GRID}) AS ry1,
 blk_x * 40 AS wx0, least(blk_x * 40 + 40, {GRID}) AS wx1, greatest(blk_x * 40 - 8, 0) AS rx0, least(least(blk_x * 40 + 40, {GRID}) + 8, {GRID}) AS rx1
 FROM (SELECT CAST(i // 9 AS INTEGER) AS blk_z, CAST(i // 3 % 3 AS INTEGER) AS blk_y, CAST(i % 3 AS INTEGER) AS blk_x, CAST(d AS INTEGER) AS d FROM (SELECT d, unnest(range((d + 3) // 4 * 9)) AS i FROM (SELECT {DEPTH} AS d)))"""


@query(_GRID_SQL)
def block_grid(spark, sf_dir):
    return grid.blocks(spark, volume_shape(spark, sf_dir), BLOCK, CONTEXT)


@query(f"WITH g AS ({_GRID_SQL}) SELECT blk_z, blk_y, blk_x FROM g WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 2 = blk_z AND n_nationkey % 3 = blk_y AND n_regionkey % 3 = blk_x)")
def pending_blocks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    done = n.select((F.col("n_nationkey") % 2).alias("blk_z"), (F.col("n_nationkey") % 3).alias("blk_y"), (F.col("n_regionkey") % 3).alias("blk_x"))
    return grid.blocks(spark, volume_shape(spark, sf_dir), BLOCK).select("blk_z", "blk_y", "blk_x").join(done, ["blk_z", "blk_y", "blk_x"], "left_anti")


@query(
    f"""WITH g AS (SELECT blk_z * 100 + blk_y * 10 + blk_x AS id, * FROM ({_GRID_SQL})), t AS (SELECT n_nationkey AS id, n_nationkey % 5 AS z0, n_nationkey % 5 + 2 AS z1, n_nationkey * 3 AS y0, n_nationkey * 3 + 20 AS y1, 10 AS x0, 50 AS x1 FROM nation)
 SELECT g.id AS l_id, t.id AS r_id FROM g JOIN t ON g.wz1 > t.z0 AND g.wz0 < t.z1 AND g.wy1 > t.y0 AND g.wy0 < t.y1 AND g.wx1 > t.x0 AND g.wx0 < t.x1"""
)
def block_tile_overlap(spark, sf_dir):
    g = grid.blocks(spark, volume_shape(spark, sf_dir), BLOCK).select((F.col("blk_z") * 100 + F.col("blk_y") * 10 + F.col("blk_x")).alias("id"), *[F.col(f"w{a}{k}").alias(f"{a}{k}") for a in AX for k in (0, 1)])
    k = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select(k.alias("id"), (k % 5).alias("z0"), (k % 5 + 2).alias("z1"), (k * 3).alias("y0"), (k * 3 + 20).alias("y1"), F.lit(10).alias("x0"), F.lit(50).alias("x1"))
    return grid.box_overlap(g, t, 4).select("l_id", "r_id")


@query(
    f"""WITH v AS ({VOX}), g AS ({_GRID_SQL}) SELECT blk_z, blk_y, blk_x, count(*) AS n, count_if(z >= wz0 AND z < wz1 AND y >= wy0 AND y < wy1 AND x >= wx0 AND x < wx1) AS n_owned
 FROM v JOIN g ON z >= rz0 AND z < rz1 AND y >= ry0 AND y < ry1 AND x >= rx0 AND x < rx1 GROUP BY ALL"""
)
def write_roi_ownership(spark, sf_dir):
    h = grid.halo_rows(voxel_table(spark, sf_dir), volume_shape(spark, sf_dir), BLOCK, CONTEXT)
    return h.groupBy("blk_z", "blk_y", "blk_x").agg(F.count("*").alias("n"), F.count_if("owned").alias("n_owned"))


@query(
    f"""SELECT *, wz0 + 5 - 2 AS rz0_full, rz0 - (wz0 + 3) AS pad_z0 FROM (SELECT CAST(z AS INTEGER) AS blk_z, CAST(y AS INTEGER) AS blk_y, CAST(x AS INTEGER) AS blk_x, CAST(z * 3 AS INTEGER) AS wz0, CAST(least(z * 3 + 4, d) AS INTEGER) AS wz1,
  CAST(greatest(z * 3 + 3, 0) AS INTEGER) AS rz0, CAST(least(z * 3 + 11, d + 2) AS INTEGER) AS rz1, CAST(greatest(y * 30 - 16, 0) AS INTEGER) AS ry0, CAST(least(y * 30 + 40, 90) AS INTEGER) AS ry1, CAST(greatest(x * 30 - 2, 0) AS INTEGER) AS rx0, CAST(least(x * 30 + 54, {GRID}) AS INTEGER) AS rx1
  FROM (SELECT d, unnest(range((d + 2) // 3)) AS z FROM (SELECT {DEPTH} AS d)), range(4) b(y), range(4) c(x)) WHERE rz1 > rz0 AND ry1 > ry0 AND rx1 > rx0"""
)
def reading_blocks(spark, sf_dir):
    """Blocks of a region that lies askew in a smaller volume: those without anything to read are left out."""
    s = volume_shape(spark, sf_dir)
    b = grid.reading_blocks(spark, s, (4, 40, 40), (3, 30, 30), (2, 8, 8), (5, -8, 2 + 4), (s[0] + 2, 90, GRID))
    b = b.withColumn("rz0_full", F.col("wz0") + 5 - 2)
    return b.select("blk_z", "blk_y", "blk_x", "wz0", "wz1", "rz0", "rz1", "ry0", "ry1", "rx0", "rx1", "rz0_full", "pad_z0")


@query(f"SELECT z, y, x, round((v - lo) / greatest(hi - lo, 1e-8), 6) AS n FROM (SELECT *, min(v) OVER (PARTITION BY z, y // 32)::DOUBLE AS lo, max(v) OVER (PARTITION BY z, y // 32)::DOUBLE AS hi FROM ({VOX}))")
def block_minmax_normalise(spark, sf_dir):
    v = voxel_table(spark, sf_dir).withColumn("b", F.floor(F.col("y") / 32))
    return voxels.minmax_normalise(v, ["z", "b"]).select("z", "y", "x", *r6("n"))


@query(f"WITH v AS ({VOX}), q AS (SELECT quantile_cont(v::DOUBLE, 0.01) AS lo, quantile_cont(v::DOUBLE, 0.99) AS hi FROM v) SELECT z, y, x, round(least(greatest((v - lo) / greatest(hi - lo, 1e-8), 0), 1) * 2 - 1, 6) AS n FROM v, q")
def percentile_normalise(spark, sf_dir):
    return voxels.percentile_normalise(voxel_table(spark, sf_dir)).select("z", "y", "x", *r6("n"))


@query(f"SELECT z, y, x, CAST(trunc(least(greatest(p * 300, 0), 255)) AS INTEGER) AS q FROM {UNIT}")
def quantise_u8(spark, sf_dir):
    return unit_voxels(spark, sf_dir).select("z", "y", "x", voxels.quantise_u8(F.col("p"), 300.0).alias("q"))


@query(f"SELECT id, CAST(trunc(least(greatest(vz * 20, -128), 127)) AS INTEGER) AS qz, CAST(trunc(least(greatest(vy * 20, -128), 127)) AS INTEGER) AS qy FROM ({DET})")
def quantise_i8(spark, sf_dir):
    return detections(spark, sf_dir).select("id", voxels.quantise_i8(F.col("vz"), 20.0).alias("qz"), voxels.quantise_i8(F.col("vy"), 20.0).alias("qy"))


_TAPER = "sin(pi() * ((y - ry0) + 0.5) / (ry1 - ry0)) * sin(pi() * ((x - rx0) + 0.5) / (rx1 - rx0))"


@query(f"WITH v AS ({VOX}), g AS ({_GRID_SQL}) SELECT z, y, x, round(sum({_TAPER} * v) / sum({_TAPER}), 6) AS p FROM v JOIN g ON z >= rz0 AND z < rz1 AND y >= ry0 AND y < ry1 AND x >= rx0 AND x < rx1 GROUP BY z, y, x")
def taper_blend(spark, sf_dir):
    h = grid.halo_rows(voxel_table(spark, sf_dir), volume_shape(spark, sf_dir), BLOCK, CONTEXT)
    w = F.lit(1.0)
    for a in ("y", "x"):
        lo = F.greatest(F.col(f"blk_{a}") * 40 - 8, F.lit(0))
        n = F.least(F.least(F.col(f"blk_{a}") * 40 + 40, F.lit(GRID)) + 8, F.lit(GRID)) - lo
        w = w * F.sin(F.lit(3.141592653589793) * (F.col(a) - lo + 0.5) / n)
    return h.groupBy(*AX).agg(F.round(F.sum(w * F.col("v")) / F.sum(w), 6).alias("p"))


@query(f"SELECT i AS y, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM (SELECT i, CASE WHEN k < 96 THEN k ELSE 190 - k END AS src FROM (SELECT i, ((i % 190) + 190) % 190 AS k FROM range(-20, 117) t(i))) r JOIN ({VOX}) v ON v.y = r.src GROUP BY i")
def reflect_pad(spark, sf_dir):
    g = GRID
    padded = spark.range(-20, g + 21).select(F.col("id").alias("i"), voxels.reflect(F.col("id"), g).cast("int").alias("src"))
    return voxel_table(spark, sf_dir).join(padded, F.col("y") == F.col("src")).groupBy(F.col("i").alias("y")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))


# ---- rendering

_PTS = f"(SELECT id, CAST(round_even(post_z / 10, 0) AS INTEGER) + 10 AS cz, CAST(round_even(post_y / 2, 0) AS INTEGER) + 40 AS cy, CAST(round_even(post_x / 2, 0) AS INTEGER) + 40 AS cx FROM ({DET}))"
_SE = "(SELECT a, b, c FROM range(-2, 3) ta(a), range(-4, 5) tb(b), range(-4, 5) tc(c) WHERE (a / 2.5) ** 2 + (b / 4.5) ** 2 + (c / 4.5) ** 2 <= 1)"
_BLOB = f"(SELECT id, cz, cy, cx, cz + a AS z, cy + b AS y, cx + c AS x FROM {_PTS}, {_SE} WHERE cz + a BETWEEN 0 AND 20 AND cy + b BETWEEN 0 AND 79 AND cx + c BETWEEN 0 AND 79)"
_OWN = f"""(WITH blob AS {_BLOB}, n AS (SELECT z, y, x, count(*) AS n, min(id) AS id FROM blob GROUP BY 1, 2, 3),
 best AS (SELECT * FROM (SELECT n.z, n.y, n.x, p.id, p.cz, p.cy, p.cx, row_number() OVER (PARTITION BY n.z, n.y, n.x ORDER BY (n.z - cz) ** 2 + (n.y - cy) ** 2 + (n.x - cx) ** 2, p.id) AS k FROM n, {_PTS} p WHERE n.n > 1) WHERE k = 1)
 SELECT z, y, x, id FROM n WHERE n = 1 UNION ALL SELECT z, y, x, id FROM best WHERE abs(z - cz) <= 2 AND abs(y - cy) <= 4 AND abs(x - cx) <= 4)"""
RADIUS, SHAPE = (2.0, 4.0, 4.0), (21, 80, 80)


def _points(spark, sf_dir):
    d = detections(spark, sf_dir)
    half = lambda c, k, o: F.bround(F.col(c) / k) + o
    return d.select("id", half("post_z", 10, 10).alias("z"), half("post_y", 2, 40).alias("y"), half("post_x", 2, 40).alias("x"), "vz", "vy", "vx")


@query(f"SELECT DISTINCT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM {_BLOB}")
def render_indicator(spark, sf_dir):
    return render.indicator(_points(spark, sf_dir), RADIUS, SHAPE)


@query(f"SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(arg_max(vz, id), 6) AS vz, round(arg_max(vx, id), 6) AS vx FROM {_BLOB} b JOIN (SELECT id, vz, vx FROM ({DET})) d USING (id) GROUP BY 1, 2, 3")
def paste_last(spark, sf_dir):
    return render.pasted(_points(spark, sf_dir), ["vz", "vx"], RADIUS, SHAPE).select("z", "y", "x", *r6("vz", "vx"))


@query(f"SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(max(vy), 6) AS vy FROM {_BLOB} b JOIN (SELECT id, vy FROM ({DET})) d USING (id) GROUP BY 1, 2, 3")
def paste_max(spark, sf_dir):
    return render.pasted(_points(spark, sf_dir), ["vy"], RADIUS, SHAPE, "max").select("z", "y", "x", *r6("vy"))


@query(f"SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, count(*) AS n FROM {_BLOB} GROUP BY 1, 2, 3 HAVING count(*) > 1")
def blob_overlaps(spark, sf_dir):
    return render.overlaps(render.blobs(_points(spark, sf_dir), RADIUS, SHAPE))


@query(f"SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, id FROM {_OWN}")
def overlap_reassign(spark, sf_dir):
    return render.owners(_points(spark, sf_dir), RADIUS, SHAPE)


@query(f"SELECT CAST(o.z AS INTEGER) AS z, CAST(o.y AS INTEGER) AS y, CAST(o.x AS INTEGER) AS x, o.id, round(p.cz + d.vz - o.z, 6) AS vz, round(p.cx + d.vx - o.x, 6) AS vx FROM {_OWN} o JOIN {_PTS} p ON o.id = p.id JOIN ({DET}) d ON o.id = d.id")
def render_vectors(spark, sf_dir):
    p = _points(spark, sf_dir)
    pre = p.select("id", *[(F.col(a) + F.col(f"v{a}")).alias(a) for a in AX])
    return render.vectors(p, pre, RADIUS, SHAPE).select("z", "y", "x", "id", *r6("vz", "vx"))


# ---- augmentation


def _sl(k: int) -> str:
    return sql_u(f"z * 2 + 1 + {k}")


@query(f"SELECT z, x AS y, 95 - y AS x, v FROM ({VOX})")
def aug_flip_transpose(spark, sf_dir):
    g = GRID
    return augment.flip_transpose(voxel_table(spark, sf_dir), g, g, True, False, True).select("z", "y", "x", "v")


@query(f"SELECT z, y, x, round(least(greatest(p * (0.8 + 0.4::DOUBLE * {_sl(101)}) + (-0.15 + 0.3::DOUBLE * {_sl(102)}), 0), 1), 6) AS p FROM {UNIT}")
def aug_intensity(spark, sf_dir):
    return augment.intensity(unit_voxels(spark, sf_dir)).select("z", "y", "x", *r6("p"))


@query(f"SELECT z, y, x, round(least(greatest(p + sqrt(-2 * ln(greatest({sql_u('id * 2 + 1')}, 1e-12))) * cos(6.283185307179586::DOUBLE * {sql_u('id * 2 + 2')}) * 0.1, 0), 1), 6) AS p FROM {UNIT}")
def aug_noise(spark, sf_dir):
    return augment.noise(unit_voxels(spark, sf_dir), 0.01).select("z", "y", "x", *r6("p"))


@query(f"SELECT z, y, x, round(greatest(least(p, 1), 1e-8) ** (0.75 + 0.75::DOUBLE * {sql_u('z + 1')}), 6) AS p FROM {UNIT}")
def aug_gamma(spark, sf_dir):
    return augment.gamma(unit_voxels(spark, sf_dir)).select("z", "y", "x", *r6("p"))


@query(f"SELECT z, y, x, round(CASE WHEN {sql_u('z + 40001')} < 0.5 THEN 1 - p ELSE p END, 6) AS p FROM {UNIT}")
def aug_invert(spark, sf_dir):
    return augment.invert(unit_voxels(spark, sf_dir), 0.5, 40001).select("z", "y", "x", *r6("p"))


@query(f"SELECT z, y, x, round(CASE WHEN (y BETWEEN 10 AND 39 AND x BETWEEN 20 AND 39) THEN 0.0 ELSE p END, 6) AS p FROM {UNIT}")
def aug_cutout(spark, sf_dir):
    return augment.cutout(unit_voxels(spark, sf_dir), [(10, 20, 20, 30)]).select("z", "y", "x", *r6("p"))


@query(f"SELECT z, CAST((y + 5 + z) % {GRID} AS INTEGER) AS y, CAST((x + 90) % {GRID} AS INTEGER) AS x, v FROM ({VOX})")
def aug_roll(spark, sf_dir):
    g = GRID
    return augment.roll(voxel_table(spark, sf_dir), g, g, F.col("z") + 5, F.lit(-6)).select("z", "y", "x", "v")


_K = sql_u("z + 5000")


@query(f"SELECT z, CASE WHEN {_K} < 0.25 THEN 'missing' WHEN {_K} < 0.5 THEN 'dark' WHEN {_K} < 0.75 THEN 'shift' ELSE 'ok' END AS kind, count(*) AS n FROM ({VOX}) GROUP BY 1, 2")
def aug_defect(spark, sf_dir):
    k = augment.defect_kind(F.col("z"), 0.25, 0.25, 0.25, 5000)
    return voxel_table(spark, sf_dir).groupBy("z", k.alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE g AS (SELECT y, x, z, v::DOUBLE AS v FROM ({VOX})),
 c AS (SELECT a.y, a.x, s.z, coalesce(g.v, 0.0::DOUBLE) AS v, s.z IN (1, 2, 5) AS missing FROM (SELECT DISTINCT y, x FROM g) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS z FROM range(7)) s LEFT JOIN g ON g.y = a.y AND g.x = a.x AND g.z = s.z),
 r AS (SELECT y, x, z, CASE WHEN missing THEN (0 + coalesce((SELECT v FROM c n WHERE n.y = c.y AND n.x = c.x AND n.z = c.z + 1), 0)) / 2 ELSE v END AS f FROM c WHERE z = 0
  UNION ALL SELECT c.y, c.x, c.z, CASE WHEN c.missing THEN (r.f + coalesce(n.v, 0)) / 2 ELSE c.v END FROM r JOIN c ON c.y = r.y AND c.x = r.x AND c.z = r.z + 1 LEFT JOIN c n ON n.y = c.y AND n.x = c.x AND n.z = c.z + 1)
 SELECT z, y, x, round(f, 6) AS v FROM r"""
)
def slice_repair(spark, sf_dir):
    v = voxel_table(spark, sf_dir)
    full = v.select("y", "x").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(v, ["z", "y", "x"], "left")
    full = full.select("z", "y", "x", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"), F.col("z").isin(1, 2, 5).alias("missing"))
    return series.repair_missing(full, ["y", "x"]).select("z", "y", "x", *r6("v"))


@query(f"SELECT z, y, x, round(CASE WHEN {sql_u('id + 1')} < 0.05 THEN 0.0 WHEN {sql_u('id + 1')} < 0.1 THEN 1.0 ELSE p END, 6) AS p FROM {UNIT}")
def aug_salt_pepper(spark, sf_dir):
    return augment.salt_pepper(unit_voxels(spark, sf_dir), 0.1).select("z", "y", "x", *r6("p"))


# ---- network layers


def _features(spark, sf_dir):
    v = unit_voxels(spark, sf_dir)
    return v.select((F.col("x") % 4).cast("int").alias("c"), "z", "y", F.floor(F.col("x") / 4).cast("int").alias("x"), F.col("p").alias("v"))


_FEAT = f"(SELECT CAST(x % 4 AS INTEGER) AS c, z, y, CAST(x // 4 AS INTEGER) AS x, p AS v FROM {UNIT})"
KERNEL = [(o, c, dz, dy, dx, round(0.1 * (o + 1) - 0.03 * c + 0.01 * (dz + 2 * dy + 3 * dx), 4)) for o in range(2) for c in range(4) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_KSQL = "(SELECT CAST(o AS INTEGER) AS o, CAST(c AS INTEGER) AS c, dz, dy, dx, round(0.1::DOUBLE * (o + 1) - 0.03::DOUBLE * c + 0.01::DOUBLE * (dz + 2 * dy + 3 * dx), 4) AS w FROM range(2) a(o), range(4) b(c), range(-1, 2) d(dz), range(-1, 2) e(dy), range(-1, 2) f(dx))"


@query(
    f"""WITH f AS {_FEAT}, k AS {_KSQL}, m AS (SELECT max(z) mz, max(y) my, max(x) mx FROM f) SELECT o AS c, CAST(f.z - dz AS INTEGER) AS z, CAST(f.y - dy AS INTEGER) AS y, CAST(f.x - dx AS INTEGER) AS x, round(sum(v * w), 5) AS v
 FROM f JOIN k ON f.c = k.c, m WHERE f.z - dz BETWEEN 0 AND mz AND f.y - dy BETWEEN 0 AND my AND f.x - dx BETWEEN 0 AND mx GROUP BY 1, 2, 3, 4"""
)
def conv3d(spark, sf_dir):
    return nn.conv3d(_features(spark, sf_dir), KERNEL).select("c", "z", "y", "x", F.round("v", 5).alias("v"))


@query(f"SELECT CAST(o AS INTEGER) AS c, CAST(f.z AS INTEGER) AS z, CAST(f.y * 2 + dy AS INTEGER) AS y, CAST(f.x * 2 + dx AS INTEGER) AS x, round(sum(v * (0.5::DOUBLE + 0.25::DOUBLE * o - 0.1::DOUBLE * f.c + 0.05::DOUBLE * dy)) + 0.1, 5) AS v FROM {_FEAT} f, range(2) a(o), range(2) b(dy), range(2) c(dx) GROUP BY 1, 2, 3, 4")
def conv_transpose3d(spark, sf_dir):
    k = [(o, c, 0, dy, dx, 0.5 + 0.25 * o - 0.1 * c + 0.05 * dy) for o in range(2) for c in range(4) for dy in range(2) for dx in range(2)]
    return nn.conv_transpose3d(_features(spark, sf_dir), k, (1, 2, 2), 0.1).select("c", "z", "y", "x", F.round("v", 5).alias("v"))


@query(f"SELECT c, CAST(z // 2 AS INTEGER) AS z, CAST(y // 5 AS INTEGER) AS y, CAST(x // 5 AS INTEGER) AS x, round(max(v), 6) AS v FROM {_FEAT} WHERE z < {DEPTH} // 2 * 2 AND y < 95 AND x < 20 GROUP BY 1, 2, 3, 4")
def maxpool3d(spark, sf_dir):
    return nn.max_pool3d(_features(spark, sf_dir), (2, 5, 5), (volume_shape(spark, sf_dir)[0], GRID, GRID // 4)).select("c", "z", "y", "x", *r6("v"))


@query(f"SELECT c, z, y, x, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-3), 5) AS v FROM {_FEAT} WINDOW w AS (PARTITION BY c)")
def group_norm(spark, sf_dir):
    return nn.group_norm(_features(spark, sf_dir), 4).select("c", "z", "y", "x", F.round("v", 5).alias("v"))


@query(f"SELECT c, z, y, x, round(greatest(v - 0.5, 0), 6) AS v FROM {_FEAT}")
def relu(spark, sf_dir):
    return nn.relu(_features(spark, sf_dir).withColumn("v", F.col("v") - 0.5)).select("c", "z", "y", "x", *r6("v"))


@query(f"SELECT c, z, y, x, round(1 / (1 + exp(-(v * 4 - 2))), 6) AS v FROM {_FEAT}")
def sigmoid(spark, sf_dir):
    return _features(spark, sf_dir).select("c", "z", "y", "x", F.round(metrics.sigmoid(F.col("v") * 4 - 2), 6).alias("v"))


@query(f"SELECT c, count(*) AS n, round(sum(v), 4) AS s FROM (SELECT c, v FROM {_FEAT} UNION ALL SELECT c + 4, v FROM {_FEAT}) GROUP BY c")
def concat_channels(spark, sf_dir):
    f = _features(spark, sf_dir)
    return nn.concat_channels(f, f, 4).groupBy("c").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("s"))


_PROBE = f"(SELECT id, abs(post_z) / 20 AS z, abs(post_y) / 3 AS y, abs(post_x) / 3 AS x FROM ({DET}))"


@query(
    f"""SELECT p.id, round(sum((CASE WHEN a = 1 THEN p.z - floor(p.z) ELSE 1 - (p.z - floor(p.z)) END) * (CASE WHEN b = 1 THEN p.y - floor(p.y) ELSE 1 - (p.y - floor(p.y)) END)
 * (CASE WHEN c = 1 THEN p.x - floor(p.x) ELSE 1 - (p.x - floor(p.x)) END) * coalesce(v.v, 0)), 5) AS v
 FROM {_PROBE} p CROSS JOIN range(2) ta(a) CROSS JOIN range(2) tb(b) CROSS JOIN range(2) tc(c) LEFT JOIN ({VOX}) v ON v.z = floor(p.z) + a AND v.y = floor(p.y) + b AND v.x = floor(p.x) + c GROUP BY p.id"""
)
def trilinear_resample(spark, sf_dir):
    d = detections(spark, sf_dir).select("id", (F.abs("post_z") / 20).alias("z"), (F.abs("post_y") / 3).alias("y"), (F.abs("post_x") / 3).alias("x"))
    return nn.trilinear(voxel_table(spark, sf_dir), d).select("id", F.round("v", 5).alias("v"))


@query(
    f"""SELECT z, y, x, CASE WHEN b IS NULL AND a IS NULL THEN 0.0::DOUBLE WHEN b IS NULL THEN (a - v)::DOUBLE WHEN a IS NULL THEN (v - b)::DOUBLE ELSE (a - b) / 2.0::DOUBLE END AS dy
 FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM ({VOX}) WINDOW w AS (PARTITION BY z, x ORDER BY y))"""
)
def jacobian_field(spark, sf_dir):
    return nn.gradient(voxel_table(spark, sf_dir), "y").select("z", "y", "x", F.col("dy").cast("double").alias("dy"))


@query(f"SELECT d.id, CAST(least(greatest(round_even(abs(post_z) / 20, 0), 0), 6) AS INTEGER) AS z, v.v FROM ({DET}) d JOIN ({VOX}) v ON v.z = least(greatest(round_even(abs(post_z) / 20, 0), 0), 6) AND v.y = least(round_even(abs(post_y) / 3, 0), 95) AND v.x = least(round_even(abs(post_x) / 3, 0), 95)")
def vector_lookup(spark, sf_dir):
    near = lambda c, k, n: F.least(F.greatest(F.bround(F.abs(c) / k), F.lit(0.0)), F.lit(float(n))).cast("int")
    d = detections(spark, sf_dir).select("id", near("post_z", 20, 6).alias("z"), near("post_y", 3, GRID - 1).alias("y"), near("post_x", 3, GRID - 1).alias("x"))
    return d.join(voxel_table(spark, sf_dir), list(AX)).select("id", "z", "v")


# ---- text sinks and whole plans


@query(f"SELECT id, concat_ws(',', id::VARCHAR, printf('%.1f', post_z), printf('%.1f', post_y), printf('%.1f', post_x), printf('%.1f', post_z + vz), printf('%.1f', post_y + vy), printf('%.1f', post_x + vx), printf('%.4f', score), (label * 3)::VARCHAR) AS line FROM ({DET})")
def detections_csv_text(spark, sf_dir):
    from voxframe.sources.detections import csv_lines

    return csv_lines(grid.partner(detections(spark, sf_dir)).withColumn("size", F.col("label") * 3))


def _solid(spark, sf_dir):
    """A denser foreground, whose components are large enough to be split."""
    g = GRID
    return voxels.threshold(voxel_table(spark, sf_dir), 160).withColumn("id", voxels.voxel_id(g, g))


@query()
def watershed_split(spark, sf_dir):
    from voxframe.plans.extract import ExtractParams, split_components

    lab = written(voxels.label(_solid(spark, sf_dir)), "labels")
    parts = split_components(lab, ExtractParams(split_min_size=20, split_min_peak_dist=2))
    return parts.groupBy("comp", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_SUMS = ", ".join(f"sum({a} * {b})::DOUBLE AS s{a}{b}" for i, a in enumerate(AX) for b in AX[i:])
_COV = ", ".join(f"n * s{a}{b} - s{a} * s{b} AS c{a}{b}" for i, a in enumerate(AX) for b in AX[i:])


@query(
    f"""{COMPONENTS}, own AS (SELECT comp, z - min(z) OVER w AS z, y - min(y) OVER w AS y, x - min(x) OVER w AS x FROM lab WINDOW w AS (PARTITION BY comp)),
 m AS (SELECT comp, count(*)::DOUBLE AS n, sum(z)::DOUBLE AS sz, sum(y)::DOUBLE AS sy, sum(x)::DOUBLE AS sx, {_SUMS} FROM own GROUP BY comp), c AS (SELECT comp, n, {_COV} FROM m),
 d AS (SELECT *, (czz + cyy + cxx) / 3 AS q, czz * (cyy * cxx - cyx ** 2) - czy * (czy * cxx - cyx * czx) + czx * (czy * cyx - cyy * czx) AS det FROM c),
 p AS (SELECT *, sqrt(((czz - q) ** 2 + (cyy - q) ** 2 + (cxx - q) ** 2 + 2 * (czy ** 2 + czx ** 2 + cyx ** 2)) / 6) AS p FROM d),
 f AS (SELECT *, CASE WHEN p > 0 THEN acos(least(greatest(((czz - q) * ((cyy - q) * (cxx - q) - cyx ** 2) - czy * (czy * (cxx - q) - cyx * czx) + czx * (czy * cyx - (cyy - q) * czx)) / (2 * p ** 3), -1), 1)) / 3 ELSE 0 END AS phi FROM p),
 lam AS (SELECT comp, n, det, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi - 2.0943951023931953) AS e2 FROM f)
 SELECT comp, round(sqrt(20 * e1) / n / greatest(CASE WHEN det <= 0 OR e1 * e2 <= 0 THEN 0 ELSE sqrt(20 * det / (e1 * e2)) / n END, 1e-6), 3) AS ratio FROM lam WHERE n >= 3"""
)
def elongation(spark, sf_dir):
    lab = written(voxels.label(foreground(spark, sf_dir)), "labels")
    big = lab.groupBy("comp").agg(F.count("*").alias("n")).where("n >= 3").select("comp")
    return voxels.elongations(lab.join(big, "comp", "left_semi")).select("comp", F.round("ratio", 3).alias("ratio"))


def _predicted(spark, sf_dir):
    v = unit_voxels(spark, sf_dir)
    return v.select("z", "y", "x", "p", *[((F.col("v") + k) % 7 - 3).cast("double").alias(f"v{a}") for k, a in enumerate(AX)])


#: Components of two voxels or more and of a mean of 0.9 or more, with their mean vectors.
_FOUND = """found AS MATERIALIZED (SELECT comp, count(*) AS size, round(avg(v / 255.0::DOUBLE), 9) AS score, avg(v % 7 - 3) AS vz, avg((v + 1) % 7 - 3) AS vy, avg((v + 2) % 7 - 3) AS vx
 FROM {lab} GROUP BY comp HAVING count(*) >= 2 AND round(avg(v / 255.0::DOUBLE), 9) >= 0.9)"""
_BY_PEAK = "SELECT comp, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY v DESC, z, y, x) AS k FROM {lab}) WHERE k = 1"
_ROUNDED = ", ".join(f"round({p}_{a}, 6) AS {p}_{a}" for p in ("post", "pre") for a in AX)
_OUT = [*[f"{p}_{a}" for p in ("post", "pre") for a in AX], "score"]


@query(
    f"""{COMPONENTS}, {_FOUND.format(lab="lab")}, own AS MATERIALIZED (SELECT l.* FROM lab l SEMI JOIN found f ON l.comp = f.comp),
 box AS (SELECT comp, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM own GROUP BY comp),
 cells AS (SELECT comp, zz AS z, yy AS y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS yy FROM (SELECT *, unnest(range(z0, z1 + 1)) AS zz FROM box))),
 holes AS (SELECT c.* FROM cells c ANTI JOIN own l ON c.comp = l.comp AND c.z = l.z AND c.y = l.y AND c.x = l.x),
 far AS MATERIALIZED (SELECT l.comp, l.z, l.y, l.x, coalesce(min((l.z - h.z) ** 2 + (l.y - h.y) ** 2 + (l.x - h.x) ** 2), 1e9) AS d2 FROM own l LEFT JOIN holes h ON l.comp = h.comp GROUP BY ALL),
 place AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY d2 DESC, z, y, x) AS k FROM far) WHERE k = 1),
 d AS MATERIALIZED (SELECT f.comp, f.size, f.score, (p.z * 2)::DOUBLE AS post_z, p.y::DOUBLE AS post_y, p.x::DOUBLE AS post_x, (p.z + vz) * 2 AS pre_z, p.y + vy AS pre_y, p.x + vx AS pre_x, row_number() OVER (ORDER BY f.score DESC, f.comp) AS rk FROM found f JOIN place p ON f.comp = p.comp),
 c AS MATERIALIZED (SELECT a.rk AS hi, b.rk AS lo FROM d a JOIN d b ON a.rk < b.rk AND b.post_z BETWEEN a.post_z - 4 AND a.post_z + 4 AND b.post_y BETWEEN a.post_y - 4 AND a.post_y + 4 WHERE sqrt((a.post_z - b.post_z) ** 2 + (a.post_y - b.post_y) ** 2 + (a.post_x - b.post_x) ** 2) < 4),
 s(rk, kept) USING KEY (rk) AS (SELECT rk, 1 FROM d WHERE rk = 1 UNION
  SELECT n.rk, CASE WHEN count(r.rk) > 0 THEN 0 ELSE 1 END FROM s JOIN d n ON n.rk = s.rk + 1 LEFT JOIN c ON c.lo = n.rk
  LEFT JOIN recurring.s r ON r.rk = c.hi AND r.kept = 1 GROUP BY n.rk)
 SELECT row_number() OVER (ORDER BY d.rk) - 1 AS id, {_ROUNDED}, round(score, 6) AS score, size FROM d JOIN s ON d.rk = s.rk WHERE s.kept = 1"""
)
def extract_detections(spark, sf_dir):
    from voxframe.plans.extract import ExtractParams, extract

    g = GRID
    p = ExtractParams(cc_threshold=0.88, score_thr=0.9, size_thr=2, nms_radius=4.0, voxel_size=(2.0, 1.0, 1.0))
    return extract(_predicted(spark, sf_dir), g, g, p).select("id", *r6(*_OUT), "size")


@query(
    f"""{COMPONENTS}, {_FOUND.format(lab="lab")}, place AS MATERIALIZED ({_BY_PEAK.format(lab="lab")}),
 strong AS (SELECT p.* FROM place p JOIN (SELECT comp FROM lab GROUP BY comp HAVING round(avg(v / 255.0::DOUBLE), 9) >= 0.95) USING (comp)),
 hole AS (SELECT DISTINCT z + a AS z, y + b AS y, x + c AS x FROM strong, range(-1, 2) ta(a), range(-3, 4) tb(b), range(-3, 4) tc(c) WHERE a ** 2 + (b / 3.0) ** 2 + (c / 3.0) ** 2 <= 1),
 fg2 AS MATERIALIZED (SELECT fg.* FROM fg ANTI JOIN hole h ON fg.z = h.z AND fg.y = h.y AND fg.x = h.x ANTI JOIN (SELECT l.id FROM lab l SEMI JOIN found f ON l.comp = f.comp) t ON fg.id = t.id),
 g1 AS ({fx.EDGES.replace("fg a", "fg2 a").replace("fg b", "fg2 b")}), g AS MATERIALIZED (SELECT a, b FROM g1 UNION ALL SELECT b, a FROM g1),
 cc2(id, comp) USING KEY (id) AS (SELECT id, id FROM fg2 UNION
  SELECT g.b, min(c.comp) FROM cc2 c JOIN g ON c.id = g.a JOIN recurring.cc2 r ON r.id = g.b WHERE c.comp < r.comp GROUP BY g.b),
 lab2 AS MATERIALIZED (SELECT fg2.*, cc2.comp FROM fg2 JOIN cc2 ON fg2.id = cc2.id), {_FOUND.format(lab="lab2").replace("found AS MATERIALIZED", "found2 AS MATERIALIZED")}, place2 AS ({_BY_PEAK.format(lab="lab2")}),
 one AS (SELECT * FROM found JOIN place USING (comp)), two AS (SELECT * FROM found2 JOIN place2 USING (comp)),
 every AS (SELECT * FROM one UNION ALL BY NAME SELECT * FROM two t WHERE NOT EXISTS (SELECT 1 FROM one o WHERE sqrt((o.z - t.z) ** 2 + (o.y - t.y) ** 2 + (o.x - t.x) ** 2) < 1.5))
 SELECT row_number() OVER (ORDER BY score DESC, comp) - 1 AS id, z::DOUBLE AS post_z, y::DOUBLE AS post_y, x::DOUBLE AS post_x, round(z + vz, 6) AS pre_z, round(y + vy, 6) AS pre_y, round(x + vx, 6) AS pre_x, round(score, 6) AS score, size FROM every"""
)
def suppression_pass(spark, sf_dir):
    from voxframe.plans.extract import ExtractParams, extract

    g = GRID
    p = ExtractParams(cc_threshold=0.88, score_thr=0.9, size_thr=2, loc_type="peak", suppression=True, suppression_threshold=0.95, suppression_radius=(1.0, 3.0, 3.0), suppression_min_separation=1.5)
    return extract(_predicted(spark, sf_dir), g, g, p).select("id", *r6(*_OUT), "size")


@query(
    f"""WITH c AS (SELECT i, CAST(floor({sql_u('i * 3 + 42')} * ({DEPTH} - 3)) AS INTEGER) AS z0, CAST(floor({sql_u('i * 3 + 43')} * 93) AS INTEGER) AS y0, CAST(floor({sql_u('i * 3 + 44')} * 93) AS INTEGER) AS x0 FROM range(50) t(i))
 SELECT round(quantile_cont(v::DOUBLE, 0.01), 6) AS lo, round(quantile_cont(v::DOUBLE, 0.99), 6) AS hi FROM ({VOX}) JOIN c ON z >= z0 AND z < z0 + 4 AND y >= y0 AND y < y0 + 4 AND x >= x0 AND x < x0 + 4"""
)
def cube_percentiles(spark, sf_dir):
    g = GRID
    return voxels.cube_percentiles(voxel_table(spark, sf_dir), volume_shape(spark, sf_dir), 50, 4).select(*r6("lo", "hi"))


@query(f"SELECT z, y, x, round(n * (1 - m) + m, 6) AS r, round(n * (1 - m) + 0.2 * m, 6) AS g FROM (SELECT z, y, x, (v - min(v) OVER ()) / greatest(max(v) OVER () - min(v) OVER (), 1e-8)::DOUBLE AS n, CASE WHEN v >= 245 THEN 1.0::DOUBLE WHEN v >= 225 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS m FROM ({VOX}))")
def overlay_image(spark, sf_dir):
    from voxframe.operators import images

    v = images.grey_rgb(voxel_table(spark, sf_dir)).withColumn("m", F.when(F.col("v") >= 245, 1.5).when(F.col("v") >= 225, 0.5).otherwise(-0.5))
    return images.overlay(v).select("z", "y", "x", *r6("r", "g"))


@query("SELECT n_nationkey AS z, coalesce(lead(n_nationkey) OVER (ORDER BY n_nationkey), min(n_nationkey) OVER ()) AS following FROM nation")
def next_slice(spark, sf_dir):
    from voxframe.operators import images

    return images.next_slice(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("z")))


@query("SELECT z FROM (SELECT n_nationkey AS z, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i IN (0, 4, 9, 14, 19, 24)")
def spread_slices(spark, sf_dir):
    from voxframe.operators import images

    return images.spread_picks(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("z")))
