"""Points to voxels: ellipsoid blobs, overlaps and direction vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ball_offsets(radius: tuple[float, float, float], grow: float = 0.5) -> list[tuple[int, int, int]]:
    """Integer offsets of an ellipsoid; a blob's element has its radii grown by a half, a sphere mask has not."""
    r = [x + grow for x in radius]
    box = [range(-int(math.floor(x)), int(math.floor(x)) + 1) for x in r]
    return [(a, b, c) for a in box[0] for b in box[1] for c in box[2] if (a / r[0]) ** 2 + (b / r[1]) ** 2 + (c / r[2]) ** 2 <= 1]


def blobs(points: DataFrame, radius: tuple[float, float, float], shape: tuple[int, int, int], grow: float = 0.5) -> DataFrame:
    """(id, z, y, x, cz, cy, cx): voxels of each point's blob, centred on its half-even rounded place and cut to the shape.

    The offsets are a literal of the element's size, exploded beside each point."""
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip("zyx", o, strict=True)]) for o in ball_offsets(radius, grow)])
    centred = points.select("id", *[F.bround(F.col(a)).cast("int").alias(f"c{a}") for a in "zyx"])
    df = centred.withColumn("o", F.explode(offsets)).select("id", "cz", "cy", "cx", *[(F.col(f"c{a}") + F.col(f"o.d{a}")).alias(a) for a in "zyx"])
    inside = F.lit(True)
    for a, n in zip("zyx", shape, strict=True):
        inside = inside & F.col(a).between(0, n - 1)
    return df.where(inside)


def indicator(points: DataFrame, radius: tuple[float, float, float], shape: tuple[int, int, int]) -> DataFrame:
    return blobs(points, radius, shape).select("z", "y", "x").distinct()


def pasted(points: DataFrame, values: list[str], radius: tuple[float, float, float], shape: tuple[int, int, int], how: str = "last") -> DataFrame:
    """(z, y, x, values): each point's values over its blob. Where blobs meet, ``last`` takes all values of the point with the greatest
    id (the last writer), ``max`` the greatest of each value. Voxels are counted with partial aggregates."""
    cover = blobs(points, radius, shape).select("id", "z", "y", "x").join(points.select("id", *values), "id")
    if how == "max":
        return cover.groupBy("z", "y", "x").agg(*[F.max(v).alias(v) for v in values])
    top = F.max_by(F.struct(*values), "id").alias("_top")
    return cover.groupBy("z", "y", "x").agg(top).select("z", "y", "x", *[F.col(f"_top.{v}").alias(v) for v in values])


def overlaps(blob: DataFrame) -> DataFrame:
    """Voxels that more than one blob covers, with their number."""
    return blob.groupBy("z", "y", "x").agg(F.count("*").alias("n")).where("n > 1")


def owners(points: DataFrame, radius: tuple[float, float, float], shape: tuple[int, int, int], voxel_size: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(z, y, x, id) of rendered voxels. A voxel of one blob is its point's. A voxel of several goes to the nearest point
    of all, by distance of the rounded centres in world units (ties to the least id), if it lies in that point's box.

    Every point whose box holds the voxel is exploded with the voxels of its box; a voxel whose nearest point of all is
    farther than that box's half diagonal cannot be won by a point outside of it, so boxes are enough to find it."""
    cover = blobs(points, radius, shape)
    counted = cover.groupBy("z", "y", "x").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    single = counted.where("n = 1").select("z", "y", "x", "id")
    crowded = counted.where("n > 1").select("z", "y", "x")
    reach = [math.floor(r + 0.5) for r in radius]
    far = max(r * s for r, s in zip([x + 0.5 for x in radius], voxel_size, strict=True))
    # the covering blobs give a distance of at most ``far``; nearer points have centres within far / voxel_size on each axis
    span = [max(1, math.ceil(far / s)) for s in voxel_size]
    centres = points.select("id", *[F.bround(F.col(a)).cast("int").alias(f"c{a}") for a in "zyx"])
    near = centres
    for a, n in zip("zyx", span, strict=True):
        near = near.withColumn(a, F.explode(F.sequence(F.col(f"c{a}") - n, F.col(f"c{a}") + n)))
    d2 = sum((F.pow((F.col(a) - F.col(f"c{a}")) * float(s), 2) for a, s in zip("zyx", voxel_size, strict=True)), F.lit(0.0))
    best = near.join(crowded, ["z", "y", "x"]).groupBy("z", "y", "x").agg(F.min(F.struct(d2.alias("d"), "id", "cz", "cy", "cx")).alias("m"))
    boxed = F.lit(True)
    for a, r in zip("zyx", reach, strict=True):
        boxed = boxed & (F.abs(F.col(a) - F.col(f"m.c{a}")) <= r)
    return single.unionByName(best.where(boxed).select("z", "y", "x", F.col("m.id").alias("id")))


def vectors(points: DataFrame, pre: DataFrame, radius: tuple[float, float, float], shape: tuple[int, int, int], voxel_size: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(z, y, x, id, vz, vy, vx): each owned voxel's vector to its point's partner in world units."""
    own = owners(points, radius, shape, voxel_size).join(pre.select("id", *[F.col(a).alias(f"p{a}") for a in "zyx"]), "id")
    return own.select("z", "y", "x", "id", *[(F.col(f"p{a}") * float(s) - F.col(a) * float(s)).alias(f"v{a}") for a, s in zip("zyx", voxel_size, strict=True)])
