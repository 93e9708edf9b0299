"""Views of voxel slices: grey levels, overlays, picks of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grey_rgb(vox: DataFrame) -> DataFrame:
    """r, g, b of v, scaled to the range of the whole table, whose ends are one row for all tasks."""
    ends = vox.agg(F.min("v").cast("double").alias("_lo"), F.max("v").cast("double").alias("_hi"))
    n = (F.col("v") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-8))
    return vox.join(F.broadcast(ends)).withColumns({c: n for c in "rgb"}).drop("_lo", "_hi")


#: Fixed value: the red that a mask is shown in.
MASK_COLOUR = (1.0, 0.2, 0.2)


def overlay(rgb: DataFrame, mask: str = "m", colour: tuple[float, float, float] = MASK_COLOUR) -> DataFrame:
    m = F.least(F.greatest(F.col(mask), F.lit(0.0)), F.lit(1.0))
    return rgb.withColumns({c: F.col(c) * (1 - m) + F.lit(k) * m for c, k in zip("rgb", colour, strict=True)})


def spread_picks(zs: DataFrame, most: int = 6) -> DataFrame:
    """At most ``most`` of the distinct z, evenly spaced over their order (one row per slice of a volume)."""
    from pyspark.sql import Window

    d = zs.select("z").distinct()
    n = d.count()
    k = min(most, n)
    wanted = sorted({int(i * (n - 1) / max(k - 1, 1)) for i in range(k)})
    return d.withColumn("_i", F.row_number().over(Window.orderBy("z")) - 1).where(F.col("_i").isin(wanted)).select("z")


def next_slice(zs: DataFrame) -> DataFrame:
    """(z, following): the next slice in the list, the first after the last."""
    from pyspark.sql import Window

    w = Window.orderBy("z")
    d = zs.select("z").distinct()
    return d.withColumn("following", F.coalesce(F.lead("z").over(w), F.min("z").over(Window.partitionBy())))
