"""Detections from an indicator volume and its partner vectors: the flagship plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from voxframe.functions.kernels import split_labels
from voxframe.operators import basins, grid, voxels
from voxframe.operators.keys import attach, shuffled
from voxframe.operators.nms import nms
from voxframe.operators.ranking import global_index
from voxframe.storage import written


@dataclass(frozen=True)
class ExtractParams:
    cc_threshold: float = 0.5
    score_thr: float = 0.5
    loc_type: str = "edt"  # edt, centroid or peak; anything else is peak
    score_type: str = "mean"  # mean; anything else is max
    size_thr: int = 0
    nms_radius: float = 0.0
    nms_inclusive: bool = False
    flipprepost: bool = False
    post_offset: float = 0.0
    pre_offset: float = 0.0
    vector_scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    vector_op: str = "multiply"  # or divide
    voxel_size: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    splitting: bool = False
    split_min_size: int = 80
    split_min_elongation: float = 0.0
    split_min_peak_dist: int = 4
    split_min_sub_size: int = 8
    suppression: bool = False
    suppression_threshold: float = 0.9
    suppression_radius: tuple[float, float, float] = field(default=(3.0, 8.0, 8.0))
    suppression_min_separation: float = 5.0
    #: Thresholds of the second pass; those of the first where not given.
    suppression_score_thr: float | None = None
    suppression_size_thr: int | None = None

    @classmethod
    def of(cls, config: dict) -> ExtractParams:
        """From the ``extract`` part of a configuration, unknown keys ignored."""
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in config.items() if k in cls.__dataclass_fields__}
        return cls(**known)


#: How the voxels of an object are dealt with when objects are split.
REST, WHOLE, BLOCKS = 0, 1, 2


def split_components(labelled: DataFrame, p: ExtractParams, block: tuple[int, int, int] = voxels.BLOCK) -> DataFrame:
    """labelled with ``part``: components of at least split_min_size voxels and the wanted elongation are cut at their
    distance peaks: those whose box is no larger than a block as one group each, others in blocks, however large they are."""
    box = [f.alias(f"{a}{i}") for a in voxels.AXES for i, f in enumerate((F.min(a).cast("int"), F.max(a).cast("int")))]
    objects = labelled.groupBy(F.col("comp").alias("_object")).agg(F.count("*").alias("_n"), *box)
    big = F.col("_n") >= p.split_min_size
    if p.split_min_elongation > 0:
        objects = written(objects, "objects")
        most = labelled.join(shuffled(objects.where(big).select(F.col("_object").alias("comp"))), "comp", "left_semi")
        long = voxels.elongations(most).where(F.col("ratio") >= p.split_min_elongation).select(F.col("comp").alias("_object"), F.lit(True).alias("_long"))
        objects = objects.join(shuffled(long), "_object", "left")
        big = big & F.coalesce("_long", F.lit(False))
    cells = F.lit(1.0)
    for a in voxels.AXES:
        cells = cells * (F.col(f"{a}1") - F.col(f"{a}0") + 1)
    way = F.when(~big, REST).when(cells <= math.prod(block), WHOLE).otherwise(BLOCKS)
    objects = written(objects.withColumn("_way", way), "objects")
    rows = written(attach(labelled, objects, "comp", "_object", "_n", F.xxhash64(*voxels.AXES)), "objects")
    out = rows.where(F.col("_way") == REST).select(*labelled.columns, F.lit(0).alias("part"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["z", "y", "x"]].to_numpy()
        lo = at.min(axis=0)
        mask = np.zeros(at.max(axis=0) - lo + 1, bool)
        mask[tuple((at - lo).T)] = True
        label = split_labels(mask, p.split_min_peak_dist, p.split_min_sub_size)
        pdf = pdf.assign(part=label[tuple((at - lo).T)])
        return pdf[pdf["part"] >= 0]

    whole = rows.where(F.col("_way") == WHOLE).select(*labelled.columns)
    out = out.unionByName(whole.groupBy("comp").applyInPandas(cut, StructType([*labelled.schema, StructField("part", IntegerType())])))
    own = rows.where(F.col("_way") == BLOCKS)
    if own.isEmpty():
        return out
    at = own.select("comp", *[F.col(a).cast("int").alias(a) for a in voxels.AXES], *[f"{a}{i}" for a in voxels.AXES for i in "01"])
    told = basins.parts(at, p.split_min_peak_dist, p.split_min_sub_size, block).where("part >= 0")
    return out.unionByName(own.select(*labelled.columns).join(shuffled(told), list(voxels.AXES)).select(*labelled.columns, "part"))


def edt_locations(labelled: DataFrame) -> DataFrame:
    """(comp, ez, ey, ex) as doubles."""
    return voxels.edt_peaks(labelled.select("comp", "z", "y", "x")).select("comp", *[F.col(f"e{a}").cast("double").alias(f"e{a}") for a in "zyx"])


def _places(lab: DataFrame, measured: DataFrame, p: ExtractParams) -> DataFrame:
    """measured with post_*: the centroid, the peak of the distance, or the peak of the value, by loc_type."""
    if p.loc_type == "edt":
        measured = measured.join(shuffled(edt_locations(lab.join(shuffled(measured.select("comp")), "comp", "left_semi"))), "comp")
        place = {a: F.col(f"e{a}") for a in "zyx"}
    else:
        place = {a: F.col(f"c{a}" if p.loc_type == "centroid" else f"p{a}").cast("double") for a in "zyx"}
    return measured.withColumns({f"post_{a}": place[a] for a in "zyx"})


def _measured(lab: DataFrame, p: ExtractParams) -> DataFrame:
    """Measures of each component; scores are told apart to nine places, so that their order does not hang on that of sums."""
    return voxels.measure(lab, p.score_type, F.col("p")).withColumn("score", F.round("score", 9))


#: From voxels to the same voxels with vz, vy and vx.
Vectors = Callable[[DataFrame], DataFrame]


def locate(vox: DataFrame, height: int, width: int, p: ExtractParams, vectors: Vectors | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections in voxel units (post_*, v*, score, size, comp, first) of voxels (z, y, x, p, vz, vy, vx), the labelled voxels, and
    the components that passed the thresholds. Size and score are asked of whole components; of the parts of one that
    is split, only the score. Without foreground everything is empty and no component is looked for. With ``vectors`` the voxels
    have none; they are asked for those of components that passed."""
    fg = written(vox.where(F.col("p") >= p.cc_threshold).withColumn("id", voxels.voxel_id(height, width)), "foreground")
    lab = fg.withColumn("comp", F.col("id")) if fg.isEmpty() else written(voxels.label(fg), "labels")
    passed = voxels.survivors(_measured(lab, p), p.size_thr, p.score_thr)
    if p.splitting:
        passed = written(passed, "passed")
        own = split_components(lab.join(shuffled(passed.select("comp")), "comp", "left_semi").select(*lab.columns), p).withColumn("comp", F.xxhash64("comp", "part"))
        found = _measured(own, p).where(F.col("score") >= p.score_thr)
    else:
        own, found = lab, passed
    with_vectors = own if vectors is None else vectors(own.join(shuffled(found.select("comp")), "comp", "left_semi").select("comp", "id", "z", "y", "x"))
    means = with_vectors.groupBy("comp").agg(*[F.avg(f"v{a}").alias(f"v{a}") for a in "zyx"], F.min("id").alias("first"))
    found = _places(own, found.join(shuffled(means), "comp"), p)
    scale = {a: s if p.vector_op == "multiply" else 1 / s for a, s in zip("zyx", p.vector_scale, strict=True)}
    det = found.select("comp", "first", *[f"post_{a}" for a in "zyx"], *[(F.col(f"v{a}") * scale[a]).alias(f"v{a}") for a in "zyx"], "score", "size")
    return det, lab, passed.select("comp")


def ellipsoids(centres: DataFrame, radius: tuple[float, float, float]) -> DataFrame:
    """Distinct voxels (z, y, x) of the ellipsoids about real-valued centres (post_*), their surfaces included."""
    out = centres.select(*[F.col(f"post_{a}").alias(f"_{a}") for a in "zyx"])
    inside = F.lit(0.0)
    for a, r in zip("zyx", radius, strict=True):
        out = out.withColumn(a, F.explode(F.sequence(F.ceil(F.col(f"_{a}") - r).cast("int"), F.floor(F.col(f"_{a}") + r).cast("int"))))
        inside = inside + F.pow((F.col(a) - F.col(f"_{a}")) / r, 2)
    return out.where(inside <= 1.0).select("z", "y", "x").distinct()


def suppressed_pass(vox: DataFrame, lab: DataFrame, passed: DataFrame, first: DataFrame, height: int, width: int, p: ExtractParams, vectors: Vectors | None = None) -> DataFrame:
    """A second pass for weak neighbours of strong objects: an ellipsoid around every strong component, placed by loc_type, and
    all voxels of the components that passed are taken out, the rest is labelled anew, and detections nearer to the first
    ones' final places than the least separation are dropped."""
    strong = _places(lab, _measured(lab, p).where(F.col("score") >= p.suppression_threshold), p)
    taken = lab.join(shuffled(passed), "comp", "left_semi").select("z", "y", "x")
    left = vox.join(shuffled(ellipsoids(strong, p.suppression_radius)), ["z", "y", "x"], "left_anti").join(shuffled(taken), ["z", "y", "x"], "left_anti")
    score = p.score_thr if p.suppression_score_thr is None else p.suppression_score_thr
    size = p.size_thr if p.suppression_size_thr is None else p.suppression_size_thr
    more, _, _ = locate(left, height, width, replace(p, splitting=False, score_thr=score, size_thr=size), vectors)
    keyed = more.withColumn("id", F.col("comp"))
    return grid.separated(keyed, first, p.suppression_min_separation, "id").drop("id")


def extract(vox: DataFrame, height: int, width: int, p: ExtractParams = ExtractParams(), vectors: Vectors | None = None) -> DataFrame:
    """Detections in world units with ids from 0 by score: threshold, components, measures, location, partner, pass for
    weak neighbours, scale, flip, suppression of neighbours within nms_radius. ``vectors`` as for ``locate``."""
    found, lab, passed = locate(vox, height, width, p, vectors)
    det = grid.partner(found, p.post_offset, p.pre_offset)
    if p.suppression:
        det = written(det, "first-pass")
        more = suppressed_pass(vox, lab, passed, grid.flip(det, p.flipprepost), height, width, p, vectors)
        det = det.unionByName(grid.partner(more, p.post_offset, p.pre_offset))
    det = grid.affine(det, p.voxel_size, p.offset)
    det = grid.affine(det, p.voxel_size, p.offset, ("pre_z", "pre_y", "pre_x"))
    det = written(grid.flip(det, p.flipprepost).withColumn("id", F.col("first")), "detections")
    kept = nms(det, p.nms_radius, p.nms_inclusive)
    cols = ["post_z", "post_y", "post_x", "pre_z", "pre_y", "pre_x", "score", "size"]
    return global_index(kept.select(F.col("id").alias("first"), *cols), [F.desc("score"), F.asc("first")]).select("id", *cols)


def predict_blocks(chunks: DataFrame, predict_fn, context: tuple[int, int, int], names: tuple[str, ...] = ("p", "vz", "vy", "vx")) -> DataFrame:
    """Apply a model to block rows (block box, data) and keep its middle: predict_fn maps a (z, y, x) array to a
    (channel, z, y, x) array no larger than it. The function is made once per worker batch stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                raw = np.frombuffer(r.data, np.dtype(r.dtype)).reshape(r.sz, r.sy, r.sx)
                out = np.asarray(predict_fn(raw))
                cut = [(have - got) // 2 for have, got in zip(raw.shape, out.shape[1:], strict=True)]
                lo = [max(c, k) for c, k in zip(context, cut, strict=True)]
                inner = out[(slice(None), *[slice(a - k, n - a - k) for a, k, n in zip(lo, cut, raw.shape, strict=True)])]
                at = np.indices(inner.shape[1:]).reshape(3, -1)
                o = (r.oz, r.oy, r.ox)
                cols = {a: (at[i] + o[i] + lo[i]).astype(np.int32) for i, a in enumerate("zyx")}
                yield pd.DataFrame(cols | {n: inner[i].ravel().astype(float) for i, n in enumerate(names)})

    return chunks.mapInPandas(run, "z int, y int, x int, " + ", ".join(f"{n} double" for n in names))
