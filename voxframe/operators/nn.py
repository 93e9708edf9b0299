"""Network layers on feature tables (c, z, y, x, v): offset tables exploded on one side, sums on the other."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.keys import new_groups, whole_groups
from voxframe.operators.voxels import centre_crop
from voxframe.storage import written

SITE = ["z", "y", "x"]


#: Outputs of a block along z, y and x that one step of a convolution works out.
BLOCK = (8, 32, 32)


def conv3d(feat: DataFrame, kernel: list[tuple[int, int, int, int, int, float]]) -> DataFrame:
    """Zero-padded convolution; kernel is a list of (cout, cin, dz, dy, dx, w), whose size is the layer's. Each input voxel goes
    to the blocks of outputs that it reaches, so that what is shuffled is the input and its margins; a block is then one
    matrix product for each place of the kernel. Only outputs that an input voxel reaches become rows."""
    box = feat.agg(*[F.max(a).alias(a) for a in SITE]).first()  # one row
    top = [int(box[a] or 0) for a in SITE]
    lo, hi = [[f(k[2 + i] for k in kernel) for i in range(3)] for f in (min, max)]
    wide = [b + h - n for b, h, n in zip(BLOCK, hi, lo, strict=True)]  # places of a block's inputs
    count = [t // b + 1 for t, b in zip(top, BLOCK, strict=True)]
    ins, outs = max(k[1] for k in kernel) + 1, max(k[0] for k in kernel) + 1
    places: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
    for o, c, dz, dy, dx, w in kernel:
        weights, known = places.setdefault((dz, dy, dx), (np.zeros((outs, ins)), np.zeros((outs, ins), bool)))
        weights[o, c] += w
        known[o, c] = True
    rows = feat.where(F.col("v").isNotNull() & F.col("c").between(0, ins - 1))
    for i, a in enumerate(SITE):
        first, last = F.floor((F.col(a) - hi[i]) / BLOCK[i]), F.floor((F.col(a) - lo[i]) / BLOCK[i])
        blocks = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(count[i] - 1)).cast("int"))
        rows = rows.where((last >= 0) & (first < count[i])).withColumn(f"_k{a}", F.explode(blocks))
    block = (F.col("_kz").cast("long") * count[1] + F.col("_ky")) * count[2] + F.col("_kx")
    spot = F.col("c").cast("long")
    for i, a in enumerate(SITE):
        spot = spot * wide[i] + (F.col(a) - F.col(f"_k{a}") * BLOCK[i] - lo[i])
    rows = rows.select(block.alias("block"), spot.cast("int").alias("spot"), F.col("v").cast("double").alias("v"))
    size = ins * wide[0] * wide[1] * wide[2]

    def work(table: pa.Table) -> pa.RecordBatch:
        of, spots, v = (table.column(n).to_numpy() for n in ("block", "spot", "v"))
        heads = np.flatnonzero(new_groups(table, ["block"]))
        made = []
        for head, end in zip(heads, [*heads[1:], len(of)], strict=True):
            k = np.array(np.unravel_index(int(of[head]), count))
            a = np.bincount(spots[head:end], v[head:end], size).reshape(ins, *wide)
            there = np.zeros(size, bool)
            there[spots[head:end]] = True
            there = there.reshape(ins, *wide)
            shape = [min(b, t + 1 - b * i) for b, t, i in zip(BLOCK, top, k, strict=True)]
            out, reached = np.zeros((outs, *shape)), np.zeros((outs, *shape), bool)
            for d, (weights, known) in places.items():
                part = (slice(None), *[slice(s - n, s - n + m) for s, n, m in zip(d, lo, shape, strict=True)])
                out += np.tensordot(weights, a[part], 1)
                reached |= there[part].any(axis=0) if known.all() else np.tensordot(known.astype(np.int32), there[part].astype(np.int32), 1) > 0
            at = np.nonzero(reached)
            made.append((at[0], *[x + i * b for x, i, b in zip(at[1:], k, BLOCK, strict=True)], out[at]))
        columns = [np.concatenate(x) for x in zip(*made, strict=True)]
        return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in columns[:4]], pa.array(columns[4])], ["c", *SITE, "v"])

    dealt = rows.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(whole_groups(["block"], work, 20_000), "c int, z int, y int, x int, v double")


def conv_transpose3d(feat: DataFrame, kernel: list[tuple[int, int, int, int, int, float]], stride: tuple[int, int, int], bias: float = 0.0) -> DataFrame:
    """Transposed convolution with kernel = stride, so outputs do not overlap. The channels of a place are summed up for all of its
    outputs at once, so that what is shuffled is the input, and the outputs are made afterwards."""
    by: dict[tuple[int, ...], dict[int, float]] = {}
    for o, c, dz, dy, dx, w in kernel:
        channels = by.setdefault((o, dz, dy, dx), {})
        channels[c] = channels.get(c, 0.0) + float(w)
    # a weight by channel, null where the kernel has none: such channels make no output
    weights = [F.element_at(F.create_map(*[F.lit(x) for pair in channels.items() for x in pair]), F.col("c")) for channels in by.values()]
    sums = feat.groupBy(*SITE).agg(*[F.sum(F.col("v") * w).alias(f"_s{i}") for i, w in enumerate(weights)])
    made = F.explode(F.array(*[F.struct(*[F.lit(k).alias(n) for k, n in zip(at, ("o", "dz", "dy", "dx"), strict=True)], F.col(f"_s{i}").alias("s")) for i, at in enumerate(by)]))
    out = sums.select(*SITE, made.alias("_m")).where("_m.s is not null")
    return out.select(F.col("_m.o").alias("c"), *[(F.col(a) * s + F.col(f"_m.d{a}")).alias(a) for a, s in zip(SITE, stride, strict=True)], (F.col("_m.s") + bias).alias("v"))


def max_pool3d(feat: DataFrame, k: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Windows of k with stride k; partial windows at the far border are dropped."""
    keep = F.lit(True)
    for a, n, s in zip(SITE, k, shape, strict=True):
        keep = keep & (F.col(a) < (s // n) * n)
    return feat.where(keep).groupBy("c", *[F.floor(F.col(a) / n).cast("int").alias(a) for a, n in zip(SITE, k, strict=True)]).agg(F.max("v").alias("v"))


def group_norm(feat: DataFrame, channels: int, target_groups: int = 4, eps: float = 1e-3) -> DataFrame:
    """Normalise by the mean and variance of each channel group; the largest group count up to the target that divides."""
    g = max(i for i in range(1, min(target_groups, channels) + 1) if channels % i == 0)
    grp = F.floor(F.col("c") / (channels // g))
    stats = feat.groupBy(grp.alias("_g")).agg(F.avg("v").alias("_m"), F.var_pop("v").alias("_s"))
    return feat.withColumn("_g", grp).join(F.broadcast(stats), "_g").withColumn("v", (F.col("v") - F.col("_m")) / F.sqrt(F.col("_s") + eps)).drop("_g", "_m", "_s")


def relu(feat: DataFrame) -> DataFrame:
    return feat.withColumn("v", F.greatest(F.col("v"), F.lit(0.0)))


def concat_channels(a: DataFrame, b: DataFrame, channels_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("c", F.col("c") + channels_a))


def conv_block(feat: DataFrame, kernels: list[list[tuple]], channels: int) -> DataFrame:
    for k in kernels:
        feat = relu(group_norm(written(conv3d(feat, k), "features"), channels))  # read by the norm and by what follows
    return feat


def trilinear(vox: DataFrame, points: DataFrame) -> DataFrame:
    """Values of vox (z, y, x, v; missing voxels are 0) at points (id, z, y, x): each point asks its eight corners."""
    lo = points.select("id", *[F.floor(a).cast("int").alias(f"{a}0") for a in SITE], *[(F.col(a) - F.floor(a)).alias(f"f{a}") for a in SITE])
    corners = F.array(*[F.struct(*[F.lit(i >> b & 1).alias(f"d{a}") for b, a in enumerate(SITE)]) for i in range(8)])
    df = lo.withColumn("k", F.explode(corners))
    w = F.lit(1.0)
    for a in SITE:
        w = w * F.when(F.col(f"k.d{a}") == 1, F.col(f"f{a}")).otherwise(1 - F.col(f"f{a}"))
    df = df.select("id", w.alias("w"), *[(F.col(f"{a}0") + F.col(f"k.d{a}")).cast("int").alias(a) for a in SITE])
    return df.join(vox.select(*SITE, "v"), SITE, "left").groupBy("id").agg(F.sum(F.col("w") * F.coalesce(F.col("v"), F.lit(0))).alias("v"))


def central(value: str, axis: str) -> Column:
    """Central difference along an axis, one-sided at the ends (by neighbours that are present)."""
    w = Window.partitionBy(*[a for a in SITE if a != axis]).orderBy(axis)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2.0)


def gradient(df: DataFrame, axis: str, value: str = "v") -> DataFrame:
    return df.withColumn(f"d{axis}", central(value, axis))


def _normalised(feat: DataFrame, keys: list[str], eps: float) -> DataFrame:
    stats = feat.groupBy(*keys).agg(F.avg("v").alias("_m"), F.var_pop("v").alias("_s"))
    return feat.join(F.broadcast(stats), keys).withColumn("v", (F.col("v") - F.col("_m")) / F.sqrt(F.col("_s") + eps)).drop("_m", "_s")  # a row a channel


def batch_norm(feat: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Normalise each channel by its mean and variance over all samples."""
    return _normalised(feat, ["c"], eps)


def instance_norm(feat: DataFrame, sample: str, eps: float = 1e-5) -> DataFrame:
    """Normalise each channel of each sample by its own mean and variance; samples are joined on, not sent to all."""
    stats = feat.groupBy(sample, "c").agg(F.avg("v").alias("_m"), F.var_pop("v").alias("_s"))
    return feat.join(stats, [sample, "c"]).withColumn("v", (F.col("v") - F.col("_m")) / F.sqrt(F.col("_s") + eps)).drop("_m", "_s")


def parameter_count(kernels: list[list[tuple]], biases: int = 0) -> int:
    return sum(len(k) for k in kernels) + biases


def heads(feat: DataFrame, weights: dict[str, list[float]], bias: dict[str, float] | None = None) -> DataFrame:
    """(z, y, x, one column a head): 1 x 1 x 1 convolutions, each a weighted sum over channels."""
    cols = []
    for name, w in weights.items():
        pick = F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col("c") + 1)
        cols.append((F.sum(F.col("v") * pick) + float((bias or {}).get(name, 0.0))).alias(name))
    return feat.groupBy(*SITE).agg(*cols)


def encoder(feat: DataFrame, levels: list[tuple[list[list[tuple]], int]], pools: list[tuple[int, int, int]], shape: tuple[int, int, int]) -> list[tuple[DataFrame, int, tuple[int, int, int]]]:
    """(features, channels, shape) of each level, fine to coarse: blocks of convolutions with pooling between."""
    out = []
    for i, (kernels, channels) in enumerate(levels):
        feat = conv_block(feat, kernels, channels)
        out.append((feat, channels, shape))
        if i < len(pools):
            feat = max_pool3d(feat, pools[i], shape)
            shape = tuple(s // k for s, k in zip(shape, pools[i], strict=True))
    return out


def decoder(skips: list[tuple[DataFrame, int, tuple[int, int, int]]], ups: list[tuple[list[tuple], int, tuple[int, int, int]]], blocks: list[tuple[list[list[tuple]], int]]) -> DataFrame:
    """From the coarsest level up: enlarge, put the middle of the finer level's features before, and convolve. ups has
    (kernel, channels, stride) and blocks (kernels, channels) of each step, coarse to fine."""
    feat, _, shape = skips[-1]
    for (skip, channels, have), (kernel, _, stride), (kernels, made) in zip(skips[-2::-1], ups, blocks, strict=True):
        feat = conv_transpose3d(feat, kernel, stride)
        shape = tuple(s * k for s, k in zip(shape, stride, strict=True))
        feat = conv_block(concat_channels(centre_crop(skip, have, shape), feat, channels), kernels, made)
    return feat


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]
