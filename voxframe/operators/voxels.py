"""Operators on sparse voxel tables (z, y, x, v): threshold, adjacency, components, measures, crops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from voxframe.functions.kernels import NO_HOLE, least_in_runs
from voxframe.operators.components import connected_components, least_of_component
from voxframe.operators.keys import dealt_anew, shuffled
from voxframe.storage import written

AXES = ("z", "y", "x")


def voxel_id(height: int, width: int) -> Column:
    """C-order number of a voxel; ordering by it is raster order."""
    return (F.col("z").cast("long") * height + F.col("y")) * width + F.col("x")


def threshold(vox: DataFrame, level: float, strict: bool = False, column: str = "v") -> DataFrame:
    c = F.col(column)
    return vox.where(c > level if strict else c >= level)


def edges6(fg: DataFrame) -> DataFrame:
    """(a, b) ids of face neighbours, each pair once: three equi-joins in one, by exploding the forward neighbours."""
    ahead = fg.select(
        F.col("id").alias("a"),
        F.explode(F.array(*[F.struct(*[(F.col(c) + (1 if c == axis else 0)).alias(c) for c in AXES]) for axis in AXES])).alias("n"),
    ).select("a", "n.*")
    return ahead.join(fg.select(F.col("id").alias("b"), *AXES), list(AXES)).select("a", "b")


#: Voxels of a block along z, y and x, whose components are found in one go.
BLOCK = (16, 64, 64)


def blockwise_labels(fg: DataFrame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """fg plus ``_local``, the least id of the voxel's component within its block, and ``_faces``, the sides of the block that it
    lies on: 1, 2, 4 for the lower side of z, y and x, 8, 16, 32 for the upper one. A block is worked off by one task."""
    keys = [F.floor(F.col(a) / n).cast("int").alias(f"_k{a}") for a, n in zip(AXES, block, strict=True)]
    own, cells, steps = fg.columns, block[0] * block[1] * block[2], (block[1] * block[2], block[2], 1)

    def solve(table: pa.Table) -> pa.RecordBatch:
        k = np.stack([table.column(f"_k{a}").to_numpy() for a in AXES]).astype(np.int64)
        at = np.stack([table.column(a).to_numpy() for a in AXES]) - k * np.array(block)[:, None]
        ids, new = table.column("id").to_numpy(), np.ones(len(k[0]), bool)
        new[1:] = (k[:, 1:] != k[:, :-1]).any(axis=0)
        code = (np.cumsum(new) - 1) * cells + sum(a * s for a, s in zip(at, steps, strict=True))
        order = np.argsort(code, kind="stable")
        code, ids_in_order = code[order], ids[order]
        u, v = [], []
        for i, step in enumerate(steps):
            inner = np.flatnonzero(at[i][order] < block[i] - 1)
            to = np.searchsorted(code, code[inner] + step)
            found = to < len(code)
            found[found] = code[to[found]] == code[inner[found]] + step
            u.append(ids_in_order[inner[found]])
            v.append(ids_in_order[to[found]])
        node, least = least_of_component(np.concatenate(u), np.concatenate(v))
        local = ids.copy()
        if len(node):
            spot = np.minimum(np.searchsorted(node, ids), len(node) - 1)
            local = np.where(node[spot] == ids, least[spot], ids)
        faces = sum((at[i] == 0) * (1 << i) + (at[i] == block[i] - 1) * (8 << i) for i in range(3)).astype(np.int32)
        kept = [table.column(c).combine_chunks() for c in own]
        return pa.RecordBatch.from_arrays([*kept, pa.array(local), pa.array(faces)], [*own, "_local", "_faces"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; whole blocks are worked off together."""
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size < cells:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            k = np.stack([table.column(f"_k{a}").to_numpy() for a in AXES])
            ends = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            if len(ends):
                yield solve(table.slice(0, ends[-1]))
                table = table.slice(ends[-1]).combine_chunks()
            held, size = table.to_batches(), table.num_rows
        if held:
            yield solve(pa.Table.from_batches(held))

    schema = StructType([*fg.schema, StructField("_local", LongType()), StructField("_faces", IntegerType())])
    names = [f"_k{a}" for a in AXES]
    return fg.select(*own, *keys).repartition(*names).sortWithinPartitions(*names).mapInArrow(local, schema)


def label(fg: DataFrame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """fg plus comp, the least voxel id of its 6-connected component; fg needs id.

    Components are found within blocks first. Only voxels on the sides of blocks are then joined, so that the links between
    blocks grow with surfaces; the components of these links rename what belongs together.
    """
    lab = written(blockwise_labels(fg, block), "block-labels")
    sides = []
    for i, axis in enumerate(AXES):
        ahead = [(F.col(a) + (1 if a == axis else 0)).alias(a) for a in AXES]
        upper = lab.where(F.col("_faces").bitwiseAND(8 << i) != 0).select(*ahead, F.col("_local").alias("u"))
        lower = lab.where(F.col("_faces").bitwiseAND(1 << i) != 0).select(*AXES, F.col("_local").alias("v"))
        sides.append(upper.join(shuffled(lower), list(AXES)).select("u", "v"))
    links = sides[0].unionByName(sides[1]).unionByName(sides[2]).distinct()
    parts = connected_components(links).where("node <> component")
    out = lab.join(shuffled(parts.select(F.col("node").alias("_local"), "component")), "_local", "left")
    return out.select(*fg.columns, F.coalesce("component", "_local").alias("comp"))


def measure(labelled: DataFrame, score: str = "mean", value: Column | None = None) -> DataFrame:
    """size, score (mean, else max), centroid, box and peak (first in raster order) of each component, in one pass."""
    p = value if value is not None else F.col("v") / F.lit(255.0)
    top = F.struct(p.alias("p"), (-F.col("z")).alias("a"), (-F.col("y")).alias("b"), (-F.col("x")).alias("c"))
    aggs = [F.count("*").alias("size"), (F.avg(p) if score == "mean" else F.max(p)).alias("score")]
    for c in AXES:
        aggs += [F.avg(c).alias(f"c{c}"), F.min(c).alias(f"{c}0"), (F.max(c) + 1).alias(f"{c}1")]
    out = labelled.groupBy("comp").agg(*aggs, F.max(top).alias("_top"))
    return out.withColumns({"pz": -F.col("_top.a"), "py": -F.col("_top.b"), "px": -F.col("_top.c")}).drop("_top")


def survivors(measured: DataFrame, size_thr: int = 0, score_thr: float = 0.5) -> DataFrame:
    return measured.where((F.col("size") >= size_thr) & (F.col("score") >= score_thr))


def weighted_centre(labelled: DataFrame, weight: Column) -> DataFrame:
    return labelled.groupBy("comp").agg(*[(F.sum(weight * F.col(c)) / F.sum(weight)).alias(f"w{c}") for c in AXES])


def elongations(labelled: DataFrame) -> DataFrame:
    """(comp, ratio): longest to shortest axis of the ellipsoid with the component's second moments, the shortest at least
    1e-6. Moments are sums of whole numbers from the box's corner; eigenvalues come in closed form, the least one from the
    determinant, so that a flat component has exactly none."""
    lo = labelled.groupBy("comp").agg(*[F.min(a).alias(f"{a}0") for a in AXES])
    at = labelled.join(shuffled(lo), "comp").select("comp", *[(F.col(a) - F.col(f"{a}0")).cast("double").alias(a) for a in AXES])
    sums = [F.count("*").alias("n")] + [F.sum(a).alias(a) for a in AXES] + [F.sum(F.col(a) * F.col(b)).alias(a + b) for i, a in enumerate(AXES) for b in AXES[i:]]
    m = at.groupBy("comp").agg(*sums)
    m = m.select("comp", "n", *[(F.col("n") * F.col(a + b) - F.col(a) * F.col(b)).alias(f"c{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]])
    c = F.col
    det = c("czz") * (c("cyy") * c("cxx") - c("cyx") * c("cyx")) - c("czy") * (c("czy") * c("cxx") - c("cyx") * c("czx")) + c("czx") * (c("czy") * c("cyx") - c("cyy") * c("czx"))
    off = c("czy") * c("czy") + c("czx") * c("czx") + c("cyx") * c("cyx")
    m = m.withColumn("q", (c("czz") + c("cyy") + c("cxx")) / 3).withColumn("det", det).withColumn("off", off)
    spread = sum(((c(f"c{a}{a}") - c("q")) * (c(f"c{a}{a}") - c("q")) for a in AXES), 2 * c("off"))
    m = m.withColumn("p", F.sqrt(spread / 6))
    d = [c(f"c{a}{a}") - c("q") for a in AXES]
    shifted = d[0] * (d[1] * d[2] - c("cyx") * c("cyx")) - c("czy") * (c("czy") * d[2] - c("cyx") * c("czx")) + c("czx") * (c("czy") * c("cyx") - d[1] * c("czx"))
    r = F.least(F.greatest(shifted / (2 * c("p") * c("p") * c("p")), F.lit(-1.0)), F.lit(1.0))
    m = m.withColumn("phi", F.when(c("p") > 0, F.acos(r) / 3).otherwise(0.0))
    m = m.withColumn("e1", c("q") + 2 * c("p") * F.cos("phi")).withColumn("e2", c("q") + 2 * c("p") * F.cos(c("phi") - 2.0943951023931953))
    least = F.when((c("det") <= 0) | (c("e1") * c("e2") <= 0), 0.0).otherwise(c("det") / (c("e1") * c("e2")))
    return m.select("comp", (F.sqrt(20 * c("e1")) / c("n") / F.greatest(F.sqrt(20 * least) / c("n"), F.lit(1e-6))).alias("ratio"))


def unravel(voxel: Column, height: int, width: int) -> dict[str, Column]:
    """z, y, x of a C-order voxel number."""
    return {"z": F.floor(voxel / (height * width)).cast("int"), "y": F.pmod(F.floor(voxel / width), F.lit(height)).cast("int"), "x": F.pmod(voxel, F.lit(width)).cast("int")}


def _line_pass(rows: DataFrame, axis: str) -> DataFrame:
    """rows (comp, z, y, x, the box, g) with g the least, over the cells of the same line of the box, of the squared distance to a
    cell plus its g, which is 0 outside the component. Lines are dealt to tasks; a line takes time linear in its voxels."""
    line = ["comp", *[a for a in AXES if a != axis]]
    names = rows.columns

    def told(batch: pa.Table) -> pa.RecordBatch:
        value = {c: batch.column(c).to_numpy() for c in names}
        at, new = value[axis].astype(np.int64), np.ones(batch.num_rows, bool)
        new[1:] = (at[1:] != at[:-1] + 1) | np.any([value[c][1:] != value[c][:-1] for c in line], axis=0)
        value["g"] = least_in_runs(at, value["g"], new, value[f"{axis}0"], value[f"{axis}1"])
        return pa.RecordBatch.from_arrays([pa.array(value[c]) for c in names], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by line; the last line of a batch waits for the next."""
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            ends = np.flatnonzero(np.any([np.diff(table.column(c).to_numpy()) != 0 for c in line], axis=0)) + 1
            if len(ends):
                yield told(table.slice(0, ends[-1]))
                table = table.slice(ends[-1]).combine_chunks()
            held = table.to_batches()
        if held:
            yield told(pa.Table.from_batches(held))

    return rows.repartition(*line).sortWithinPartitions(*line, axis).mapInArrow(work, rows.schema)


def distances(boxed: DataFrame) -> DataFrame:
    """boxed (comp, z, y, x, the box of comp as z0, z1, ...) plus g, the squared distance to the background inside the box."""
    cells = boxed.withColumn("g", F.lit(NO_HOLE).cast("long"))
    for axis in reversed(AXES):
        cells = _line_pass(cells, axis)
    return cells


def edt_peaks(labelled: DataFrame) -> DataFrame:
    """(comp, ez, ey, ex, edt): the voxel of each component that is farthest from the background inside the component's tight box.

    The border of the box is not background; a component that fills its box has infinite distance (null), so its first
    voxel in raster order is taken; ties go to the first voxel. Distances are exact, by one pass along each axis over the
    component's own voxels: in a line, only the run that a voxel is in and the cells next to its ends can be
    nearest, and the lower envelope of their parabolas gives all of a run at once. No cell of a box is made.
    """
    rows = labelled.select("comp", *[F.col(a).cast("int").alias(a) for a in AXES])
    box = rows.groupBy("comp").agg(*[F.min(c).alias(f"{c}0") for c in AXES], *[F.max(c).alias(f"{c}1") for c in AXES]).withColumn("comp", dealt_anew("comp"))
    cells = distances(rows.join(shuffled(box), "comp"))
    far = F.max(F.struct(F.col("g").alias("d"), *[(-F.col(c)).alias(c) for c in AXES])).alias("m")
    best = cells.groupBy("comp").agg(far)
    return best.select("comp", *[(-F.col(f"m.{c}")).alias(f"e{c}") for c in AXES], F.when(F.col("m.d") < NO_HOLE, F.sqrt(F.col("m.d").cast("double"))).alias("edt"))


def in_box(df: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int], columns: tuple[str, str, str] = AXES) -> DataFrame:
    """Rows in a half-open box."""
    cond = F.lit(True)
    for c, a, b in zip(columns, lo, hi, strict=True):
        cond = cond & (F.col(c) >= a) & (F.col(c) < b)
    return df.where(cond)


def crop(vox: DataFrame, offset: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Box select, rebased to zero."""
    out = in_box(vox, offset, tuple(o + s for o, s in zip(offset, shape, strict=True)))
    return out.withColumns({c: F.col(c) - o for c, o in zip(AXES, offset, strict=True)})


def centre_crop(vox: DataFrame, have: tuple[int, int, int], want: tuple[int, int, int]) -> DataFrame:
    return crop(vox, tuple((h - w) // 2 for h, w in zip(have, want, strict=True)), want)


def minmax_normalise(vox: DataFrame, keys: list[str]) -> DataFrame:
    """(v - lo) / max(hi - lo, 1e-8) per block; the ranges are partial aggregates joined back."""
    ranges = vox.groupBy(*keys).agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    return vox.join(ranges, keys).withColumn("n", (F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8))).drop("lo", "hi")


def quantiles(df: DataFrame, value: str, shares: list[float], bins: int = 1 << 12, few: int = 1 << 12) -> list[float]:
    """Exact quantiles, linear between neighbouring values: histograms of ever smaller ranges about each wanted rank, until
    a range holds ``few`` distinct values at most. What is brought back is at most ``bins`` counts a range."""
    d = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    top = d.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()  # one row
    if not top["n"]:
        return [float("nan")] * len(shares)

    def ranked(rank: int) -> float:
        lo, hi, below = top["lo"], top["hi"], 0
        while True:
            part = d.where(F.col("v").between(lo, hi))
            step = (hi - lo) / bins
            if step == 0 or lo + step == lo:
                return lo
            at = F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1)).alias("b")
            rows = sorted(part.groupBy(at).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"])  # at most bins rows
            for r in rows:
                if below + r["n"] > rank:
                    break
                below += r["n"]
            lo, hi = r["lo"], r["hi"]
            if lo == hi:
                return lo
            if r["n"] <= few:
                return sorted(x["v"] for x in d.where(F.col("v").between(lo, hi)).collect())[rank - below]  # at most few rows

    out = []
    for q in shares:
        place = q * (top["n"] - 1)
        one = ranked(int(place))
        out.append(one if place == int(place) else one + (ranked(int(place) + 1) - one) * (place - int(place)))
    return out


def percentile_normalise(vox: DataFrame, low: float = 0.01, high: float = 0.99, approximate: bool = False) -> DataFrame:
    """Clip to the percentile range, scale to [-1, 1]. The two percentiles are numbers."""
    lo, hi = (vox.agg(F.percentile_approx("v", [low, high]).alias("p")).first()["p"] or (0.0, 1.0)) if approximate else quantiles(vox, "v", [low, high])
    unit = F.least(F.greatest((F.col("v") - F.lit(float(lo))) / F.greatest(F.lit(float(hi - lo)), F.lit(1e-8)), F.lit(0.0)), F.lit(1.0))
    return vox.withColumn("n", unit * 2 - 1)


def quantise_u8(p: Column, scale: float = 255.0) -> Column:
    return F.least(F.greatest(p * scale, F.lit(0.0)), F.lit(255.0)).cast("int")


def quantise_i8(v: Column, scale: float = 1.0) -> Column:
    return F.least(F.greatest(v * scale, F.lit(-128.0)), F.lit(127.0)).cast("int")


def reflect(i: Column, n: int) -> Column:
    """Index of a mirror-padded axis (the edge is not repeated)."""
    if n == 1:
        return F.lit(0)
    k = F.pmod(i, F.lit(2 * (n - 1)))
    return F.when(k < n, k).otherwise(2 * (n - 1) - k)


def taper(i: Column, n: int) -> Column:
    return F.sin(F.lit(3.141592653589793) * (i + 0.5) / n)


def cube_percentiles(vox: DataFrame, shape: tuple[int, int, int], n: int = 50, size: int = 64, seed: int = 42, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row (lo, hi): percentiles pooled over n cubes at portable random offsets, cut to the volume. Cubes meet
    voxels by coarse cells."""
    from voxframe.operators.augment import uniform

    cubes = vox.sparkSession.range(n)
    cols = {}
    for k, (a, s) in enumerate(zip(AXES, shape, strict=True)):
        side = min(size, s)
        lo = F.floor(uniform(F.col("id") * 3 + k + seed) * (s - side + 1)).cast("int")
        cols |= {f"{a}0": lo, f"{a}1": lo + side}
    cubes = cubes.withColumns(cols)
    cells, cond = vox, F.lit(True)
    for a in AXES:
        cubes = cubes.withColumn(f"_{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / size), F.floor((F.col(f"{a}1") - 1) / size))))
        cells = cells.withColumn(f"_{a}", F.floor(F.col(a) / size))
        cond = cond & (F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1"))
    pooled = cells.join(cubes.drop("id"), [f"_{a}" for a in AXES]).where(cond)
    return pooled.agg(F.percentile("v", [low, high]).alias("p")).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def object_report(labelled: DataFrame, vectors: DataFrame, least: int = 3) -> DataFrame:
    """(comp, n, wz, wy, wx, length) of the objects of at least ``least`` voxels: their weighted middle, and the length of
    the vector (z, y, x, vz, vy, vx) at the voxel nearest to it, null if there is none."""
    big = labelled.groupBy("comp").agg(F.count("*").alias("n"), *[(F.sum(F.col("v") * F.col(a)) / F.sum("v")).alias(f"w{a}") for a in AXES]).where(F.col("n") >= least)
    big = big.withColumns({f"_{a}": F.bround(f"w{a}").cast("int") for a in AXES})
    there = vectors.select(*[F.col(a).alias(f"_{a}") for a in AXES], F.sqrt(F.col("vz") * F.col("vz") + F.col("vy") * F.col("vy") + F.col("vx") * F.col("vx")).alias("length"))
    return big.join(shuffled(there), [f"_{a}" for a in AXES], "left").select("comp", "n", *[f"w{a}" for a in AXES], "length")
