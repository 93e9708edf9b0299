"""Overlapping block results, blended by tapered weights into the chunks of a volume.

A block is a row (oz, oy, ox, sz, sy, sx, channels, dtype, data); its payload stays dense from the first step to the last, and no
voxel becomes a row. Each block is weighed by its taper, cut at chunk borders, and its parts are dealt to their chunks,
where one task adds them up in the order of their blocks. What a chunk takes in is bounded by the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.sources import volume
from voxframe.storage import discard, written

_KEY, _BOX = ["kz", "ky", "kx"], ["oz", "oy", "ox", "sz", "sy", "sx"]


def overlapping(vox: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """Each voxel of the shape once for every block (blk_z, blk_y, blk_x) that holds it; block k starts at k * stride."""
    out = vox
    for a, n, s in zip("zyx", shape, stride, strict=True):
        out = out.where((F.col(a) >= 0) & (F.col(a) < n))
    for a, n, s in zip("zyx", size, stride, strict=True):
        first = F.greatest(F.floor((F.col(a) - n) / s) + 1, F.lit(0)).cast("int")
        out = out.withColumn(f"blk_{a}", F.explode(F.sequence(first, F.floor(F.col(a) / s).cast("int"))))
    return out


def dense_blocks(vox: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], stride: tuple[int, int, int], names: tuple[str, ...]) -> DataFrame:
    """Block rows of voxels (blk_z, blk_y, blk_x, z, y, x, names), 0 where a block has no voxel; blocks end with the shape."""

    def fill(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in table.column_names}
        o = [int(t[f"blk_{a}"][0]) * s for a, s in zip("zyx", stride, strict=True)]
        n = [min(k, s - a) for k, s, a in zip(size, shape, o, strict=True)]
        block = np.zeros((len(names), *n))
        at = tuple(t[a] - b for a, b in zip("zyx", o, strict=True))
        for c, name in enumerate(names):
            block[c][at] = t[name]
        values = [*o, *n, len(names), block.dtype.str, block.tobytes()]
        return pa.table([pa.array([v], k) for v, k in zip(values, [*[pa.int32()] * 7, pa.string(), pa.binary()], strict=True)], names=[*_BOX, "channels", "dtype", "data"])

    rows = vox.select("blk_z", "blk_y", "blk_x", "z", "y", "x", *names)
    return rows.groupBy("blk_z", "blk_y", "blk_x").applyInArrow(fill, volume.SCHEMA)


def taper(size: tuple[int, int, int]) -> list[np.ndarray]:
    """Weights of each axis: half a sine wave, never 0."""
    return [np.sin(np.pi * (np.arange(n) + 0.5) / n) for n in size]


def blended(blocks: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], chunk: tuple[int, int, int]) -> DataFrame:
    """Chunk rows (float64, all channels of the blocks): the weighted mean of the blocks at each voxel, 0 where there is none.

    A block smaller than ``size`` (at the far border) has the first weights of the whole taper. What lies outside the shape is left out.
    """
    weights = taper(size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                o, n = [r[c] for c in _BOX[:3]], [r[c] for c in _BOX[3:]]
                a = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["channels"], *n)
                w = weights[0][: n[0], None, None] * weights[1][None, : n[1], None] * weights[2][None, None, : n[2]]
                out = []
                for k, lo, hi in volume.chunk_parts(o, n, list(shape), list(chunk)):
                    to = tuple(slice(i - s, j - s) for i, j, s in zip(lo, hi, o, strict=True))
                    part = np.concatenate((w[to][None], a[(slice(None), *to)] * w[to]))
                    out.append((*k, *o, *lo, *[j - i for i, j in zip(lo, hi, strict=True)], r["channels"], part.tobytes()))
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int32()] * 13, pa.binary()], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [*_KEY, "bz", "by", "bx", *_BOX, "channels", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk and block: one chunk is held at a time."""
        key, total = None, None

        def told() -> pa.RecordBatch:
            mean = np.divide(total[1:], total[0], out=np.zeros_like(total[1:]), where=total[0] > 0)
            o = [k * c for k, c in zip(key, chunk, strict=True)]
            values = [*o, *total.shape[1:], len(mean), mean.dtype.str, mean.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [*[pa.int32()] * 7, pa.string(), pa.binary()], strict=True)], [*_BOX, "channels", "dtype", "data"])

        for batch in batches:
            for r in batch.to_pylist():
                now = tuple(r[k] for k in _KEY)
                if now != key:
                    if key is not None:
                        yield told()
                    key = now
                    total = np.zeros((r["channels"] + 1, *[min(c, s - k * c) for k, c, s in zip(key, chunk, shape, strict=True)]))
                o, n = [r[c] for c in _BOX[:3]], [r[c] for c in _BOX[3:]]
                to = tuple(slice(a - k * c, a - k * c + m) for a, m, k, c in zip(o, n, key, chunk, strict=True))
                total[(slice(None), *to)] += np.frombuffer(r["data"]).reshape(r["channels"] + 1, *n)
        if key is not None:
            yield told()

    parts = blocks.mapInArrow(cut, "kz int, ky int, kx int, bz int, by int, bx int, oz int, oy int, ox int, sz int, sy int, sx int, channels int, data binary")
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "bz", "by", "bx").mapInArrow(add, volume.SCHEMA)


#: Least and greatest value of the stored kinds.
RANGES = {"uint8": (0, 255), "int8": (-128, 127)}


def quantised(chunks: DataFrame, channels: range, scale: float, kind: str) -> DataFrame:
    """Some channels of chunk rows as whole numbers: scaled, held to the range of the kind, cut towards 0. Values are told apart
    to six places first, so that they do not hang on the order of a sum."""
    lo, hi = RANGES[kind]

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["channels"], -1)[channels.start : channels.stop]
                out = np.clip(np.round(a * scale, 6), lo, hi).astype(kind)
                values = [*[r[c] for c in _BOX], len(out), out.dtype.str, out.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [*[pa.int32()] * 7, pa.string(), pa.binary()], strict=True)], [*_BOX, "channels", "dtype", "data"])

    return chunks.mapInArrow(change, volume.SCHEMA)


def blend_to_volume(
    blocks: DataFrame, path: str, shape: tuple[int, int, int], size: tuple[int, int, int], chunk: tuple[int, int, int],
    indicator: str = "pred_syn_indicators", vectors: str = "pred_partner_vectors", scale: float = 255.0, vector_scale: float = 1.0,
    offset: tuple[float, ...] = (0, 0, 0), resolution: tuple[float, ...] = (1, 1, 1),
) -> None:
    """Blend blocks of an indicator and a vector (4 channels) and flush both as datasets of the volume at path: the indicator as
    uint8, the vectors as int8."""
    mean = written(blended(blocks, shape, size, chunk), "blended")
    volume.create(path, indicator, list(shape), list(chunk), "uint8", offset, resolution)
    volume.create(path, vectors, [3, *shape], [3, *chunk], "int8", offset, resolution)
    volume.write_chunks(quantised(mean, range(0, 1), scale, "uint8"), path, indicator)
    volume.write_chunks(quantised(mean, range(1, 4), vector_scale, "int8"), path, vectors)
    discard(mean)
