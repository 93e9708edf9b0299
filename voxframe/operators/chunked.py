"""Network layers on dense chunks: rows (oz, oy, ox, sz, sy, sx, channels, dtype, data) of a grid of chunks, float64.

No voxel becomes a row. A convolution first fetches each chunk's margin from its neighbours, so that what is shuffled is the
chunks and their faces, and is then one matrix product for each place of the kernel. Norms take one partial sum a
chunk; everything else stays within its chunk. Weights are arrays that go to the tasks with the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.sources import volume

Box = tuple[int, int, int]
_BOX, _KEY = ["oz", "oy", "ox", "sz", "sy", "sx"], ["kz", "ky", "kx"]
_KINDS = [*[pa.int32()] * 7, pa.string(), pa.binary()]


def _array(r: dict) -> np.ndarray:
    return np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["channels"], r["sz"], r["sy"], r["sx"])


def _row(origin, a: np.ndarray) -> pa.RecordBatch:
    values = [*[int(o) for o in origin], *a.shape[1:], len(a), "<f8", np.ascontiguousarray(a, np.float64).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], [*_BOX, "channels", "dtype", "data"])


def each(chunks: DataFrame, work: Callable[[tuple[int, ...], np.ndarray], tuple[tuple[int, ...], np.ndarray]]) -> DataFrame:
    """work(origin, array of (channel, z, y, x)) of every chunk, by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _row(*work(tuple(r[c] for c in _BOX[:3]), _array(r)))

    return chunks.select(*_BOX, "channels", "dtype", "data").mapInArrow(run, volume.SCHEMA)


def from_voxels(feat: DataFrame, channels: int, shape: Box, chunk: Box) -> DataFrame:
    """Chunks of (c, z, y, x, v), 0 where there is no voxel; chunks without any voxel are made, too."""

    def fill(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names}
        o = [int(t[k][0]) * n for k, n in zip(_KEY, chunk, strict=True)]
        a = np.zeros((channels, *[min(n, s - b) for n, s, b in zip(chunk, shape, o, strict=True)]))
        real = t["c"] >= 0
        a[tuple(t[x][real] - b for x, b in zip(("c", "z", "y", "x"), (0, *o), strict=True))] = t["v"][real]
        return pa.Table.from_batches([_row(o, a)])

    n = [-(-s // c) for s, c in zip(shape, chunk, strict=True)]
    i = F.col("id")
    keys = [F.floor(i / (n[1] * n[2])), F.floor(i / n[2]) % n[1], i % n[2]]
    empty = feat.sparkSession.range(n[0] * n[1] * n[2]).select(*[k.cast("int").alias(a) for k, a in zip(keys, _KEY, strict=True)], *[F.lit(-1).alias(a) for a in ("c", "z", "y", "x")], F.lit(0.0).alias("v"))
    rows = feat.select(*[F.floor(F.col(a) / c).cast("int").alias(k) for a, c, k in zip("zyx", chunk, _KEY, strict=True)], *[F.col(a).cast("int").alias(a) for a in ("c", "z", "y", "x")], F.col("v").cast("double").alias("v"))
    return rows.unionByName(empty).groupBy(*_KEY).applyInArrow(fill, volume.SCHEMA)


def to_voxels(chunks: DataFrame) -> DataFrame:
    """(c, z, y, x, v) of every voxel and channel."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = _array(r)
                at = [i.ravel() + o for i, o in zip(np.indices(a.shape), (0, r["oz"], r["oy"], r["ox"]), strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.array(i.astype(np.int32)) for i in at], pa.array(a.ravel().astype(np.float64))], ["c", "z", "y", "x", "v"])

    return chunks.mapInArrow(spread, "c int, z int, y int, x int, v double")


def with_margin(chunks: DataFrame, chunk: Box, margin: Box) -> DataFrame:
    """Each chunk with ``margin`` voxels of its neighbours on every side, 0 beyond the volume; origins are those of the
    larger boxes. A neighbour sends the part of itself that is wanted, and nothing else is shuffled. The margin is at most a chunk."""
    if any(m > c for m, c in zip(margin, chunk, strict=True)):
        raise ValueError("the margin is larger than a chunk")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_KEY, *[f"w{a}" for a in "zyx"], *_BOX, "channels", "data"]
        for batch in batches:
            for r in batch.to_pylist():
                a, o, out = _array(r), [r[c] for c in _BOX[:3]], []
                for step in product((-1, 0, 1), repeat=3):
                    k = [b // c + s for b, c, s in zip(o, chunk, step, strict=True)]
                    lo = [max(0, i * c - m - b) for i, c, m, b in zip(k, chunk, margin, o, strict=True)]
                    hi = [min(n, (i + 1) * c + m - b) for i, c, m, b, n in zip(k, chunk, margin, o, a.shape[1:], strict=True)]
                    if any(x >= y for x, y in zip(lo, hi, strict=True)) or min(k) < 0:
                        continue
                    part = np.ascontiguousarray(a[(slice(None), *[slice(x, y) for x, y in zip(lo, hi, strict=True)])], np.float64)
                    own = a.shape[1:] if step == (0, 0, 0) else (0, 0, 0)
                    out.append((*k, *own, *[b + x for b, x in zip(o, lo, strict=True)], *part.shape[1:], len(a), part.tobytes()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int32()] * 13, pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk, the chunk's own part first."""
        key, box, origin = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                now = tuple(r[k] for k in _KEY)
                if now != key:
                    if box is not None:
                        yield _row(origin, box)
                    key, box = now, None
                    if r["wz"]:
                        origin = [k * c - m for k, c, m in zip(now, chunk, margin, strict=True)]
                        box = np.zeros((r["channels"], *[r[f"w{a}"] + 2 * m for a, m in zip("zyx", margin, strict=True)]))
                if box is None:  # margins that are sent to no chunk
                    continue
                lo = [r[c] - o for c, o in zip(_BOX[:3], origin, strict=True)]
                end = [min(a + r[c], n) for a, c, n in zip(lo, _BOX[3:], box.shape[1:], strict=True)]
                part = np.frombuffer(r["data"]).reshape(r["channels"], r["sz"], r["sy"], r["sx"])
                box[(slice(None), *[slice(a, b) for a, b in zip(lo, end, strict=True)])] = part[(slice(None), *[slice(0, b - a) for a, b in zip(lo, end, strict=True)])]
        if box is not None:
            yield _row(origin, box)

    sent = chunks.select(*_BOX, "channels", "dtype", "data").mapInArrow(send, "kz int, ky int, kx int, wz int, wy int, wx int, oz int, oy int, ox int, sz int, sy int, sx int, channels int, data binary")
    return sent.repartition(*_KEY).sortWithinPartitions(*_KEY, F.desc("wz"), *_BOX[:3]).mapInArrow(join, volume.SCHEMA)


def convolved(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(cout, z, y, x): the valid cross-correlation of (cin, z, y, x) with (cout, cin, kz, ky, kx), a matrix product a place."""
    size = [n - k + 1 for n, k in zip(a.shape[1:], w.shape[2:], strict=True)]
    out = np.zeros((len(w), int(np.prod(size))))
    for at in np.ndindex(*w.shape[2:]):
        part = a[(slice(None), *[slice(i, i + n) for i, n in zip(at, size, strict=True)])]
        out += w[(slice(None), slice(None), *at)] @ part.reshape(len(a), -1)
    return out.reshape(len(w), *size)


def conv3d(chunks: DataFrame, w: np.ndarray, chunk: Box) -> DataFrame:
    """Zero-padded convolution with an odd kernel (cout, cin, kz, ky, kx)."""
    margin = tuple(k // 2 for k in w.shape[2:])
    return each(with_margin(chunks, chunk, margin), lambda o, a: (tuple(b + m for b, m in zip(o, margin, strict=True)), convolved(a, w)))


def conv_transpose3d(chunks: DataFrame, w: np.ndarray, bias: float = 0.0) -> DataFrame:
    """Transposed convolution whose stride is the kernel (cout, cin, kz, ky, kx); chunks grow by it."""
    stride = w.shape[2:]

    def grow(o: tuple[int, ...], a: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
        out = np.empty((len(w), *[n * s for n, s in zip(a.shape[1:], stride, strict=True)]))
        for at in np.ndindex(*stride):
            out[(slice(None), *[slice(i, None, s) for i, s in zip(at, stride, strict=True)])] = np.tensordot(w[(slice(None), slice(None), *at)], a, 1) + bias
        return tuple(b * s for b, s in zip(o, stride, strict=True)), out

    return each(chunks, grow)


def max_pool3d(chunks: DataFrame, k: Box, chunk: Box) -> DataFrame:
    """Windows of k with stride k; chunks are whole numbers of windows, partial windows at the far border are dropped."""
    if any(c % n for c, n in zip(chunk, k, strict=True)):
        raise ValueError("chunks must be whole numbers of windows")

    def pool(o: tuple[int, ...], a: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
        n = [s // w for s, w in zip(a.shape[1:], k, strict=True)]
        cut = a[(slice(None), *[slice(0, m * w) for m, w in zip(n, k, strict=True)])]
        return tuple(b // w for b, w in zip(o, k, strict=True)), cut.reshape(len(a), n[0], k[0], n[1], k[1], n[2], k[2]).max(axis=(2, 4, 6))

    return each(chunks, pool).where("sz > 0 AND sy > 0 AND sx > 0")


def group_norm(chunks: DataFrame, channels: int, target_groups: int = 4, eps: float = 1e-3, rectify: bool = False) -> DataFrame:
    """Normalise by the mean and variance of each channel group (the largest group count up to the target that divides); with
    rectify, negative results become 0. The mean comes first, then the squares about it: two passes of one row a chunk."""
    g = max(i for i in range(1, min(target_groups, channels) + 1) if channels % i == 0)

    def sums(about: np.ndarray, power: int) -> np.ndarray:
        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    a = _array(r).reshape(g, -1) - about[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(range(g), pa.int32()), pa.array([a.shape[1]] * g, pa.int64()), pa.array((a**power).sum(axis=1))], ["g", "n", "s"])

        rows = chunks.mapInArrow(told, "g int, n long, s double").groupBy("g").agg((F.sum("s") / F.sum("n")).alias("m")).collect()  # a row a group
        return np.array([r["m"] for r in sorted(rows)]) if rows else np.zeros(g)

    mean = sums(np.zeros(g), 1)
    scale = 1 / np.sqrt(sums(mean, 2) + eps)

    def norm(o: tuple[int, ...], a: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
        out = ((a.reshape(g, -1) - mean[:, None]) * scale[:, None]).reshape(a.shape)
        return o, np.maximum(out, 0) if rectify else out

    return each(chunks, norm)


def concat_channels(a: DataFrame, b: DataFrame) -> DataFrame:
    """The channels of b after those of a, chunk by chunk; both have one grid of chunks."""
    other = b.select(*[F.col(c).alias(f"_{c}") for c in _BOX[:3]], F.col("channels").alias("more"), F.col("data").alias("rest"))
    both = a.join(other, [F.col(c) == F.col(f"_{c}") for c in _BOX[:3]])
    return both.select(*_BOX, (F.col("channels") + F.col("more")).alias("channels"), "dtype", F.concat("data", "rest").alias("data"))


def heads(chunks: DataFrame, w: np.ndarray, bias: np.ndarray) -> DataFrame:
    """A 1 x 1 x 1 convolution with (cout, cin) and a bias a head."""
    return each(chunks, lambda o, a: (o, np.tensordot(w, a, 1) + bias[:, None, None, None]))


def kernel_array(kernel: list[tuple[int, int, int, int, int, float]], first: int = 0) -> np.ndarray:
    """(cout, cin, kz, ky, kx) of a list of (cout, cin, dz, dy, dx, w); first is the least offset on each axis."""
    low = np.array([0, 0, first, first, first])
    at = np.array([k[:5] for k in kernel]) - low
    out = np.zeros(at.max(axis=0) + 1)
    out[tuple(at.T)] = [k[5] for k in kernel]
    return out


_MADE: dict[str, Callable] = {}


def made_once(key: str, make: Callable[[], Callable]) -> Callable:
    """The model of a worker process, made by its first task."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def predict(chunks: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], chunk: Box, context: Box) -> DataFrame:
    """Chunks of a model's results. make_model() returns a function from a (channel, z, y, x) array with the context on all sides to
    a (channel, z, y, x) array of the middle, and is called once in each worker."""
    key = hashlib.sha256(cloudpickle.dumps(make_model)).hexdigest()

    def run(o: tuple[int, ...], a: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
        out = np.asarray(made_once(key, make_model)(a))
        cut = [(n - (m - 2 * c)) // 2 for n, m, c in zip(out.shape[1:], a.shape[1:], context, strict=True)]
        size = [m - 2 * c for m, c in zip(a.shape[1:], context, strict=True)]
        return tuple(b + c for b, c in zip(o, context, strict=True)), out[(slice(None), *[slice(k, k + n) for k, n in zip(cut, size, strict=True)])]

    return each(with_margin(chunks, chunk, context), run)
