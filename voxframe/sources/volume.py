"""Chunked volumes (Zarr version 2 folders) as a Spark data source: one row per chunk, read where it is needed.

    register(spark)
    spark.read.format("volume").option("path", p).option("dataset", "RAW").option("box", "0,0,0,8,64,64").load()
    spark.read.format("volume").option("path", p).option("rows", "voxels").load().where("z >= 3 AND y < 40")

Rows are (oz, oy, ox, sz, sy, sx, channels, dtype, data), or with rows=voxels (z, y, x, c0, c1, ...) of the voxels that are not 0 in
all channels. Only chunks that meet the box are read, and comparisons of z, y and x (of oz, oy and ox) with whole numbers
are turned into ranges of chunks before the scan is planned. A leading channel axis is kept as planes of the payload.
Compressors: none, zlib, gzip and zstd.

Writing takes rows of the first kind, whole chunks or parts of them (``write_chunks`` deals parts to their chunks):

* every chunk file is written under a temporary name and renamed, so that a killed or repeated task leaves whole chunks;
* ``append`` keeps what a part does not cover; the job's chunks count as done (``<dataset>_done``, one flag a chunk) only when
  all its tasks have ended, and a job that fails marks nothing and can be run again;
* ``overwrite`` writes a dataset beside the old one and takes its place in the end; a job that fails leaves the old one.
"""

from __future__ import annotations

import gzip
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

SCHEMA = "oz int, oy int, ox int, sz int, sy int, sx int, channels int, dtype string, data binary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str) -> bytes | None:
    store, p = _store(path)
    if store.get_file_info(p).type == fs.FileType.NotFound:
        return None
    with store.open_input_file(p) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    store, p = _store(path)
    store.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(p) as f:
        f.write(data)


def _put(path: str, data: bytes, temporary: str) -> None:
    """Under a temporary name first, so that readers and repeated tasks only ever see a whole file. The temporary folder is the
    job's: where it is gone, the job has ended, and a task that still runs fails here and changes nothing."""
    store, p = _store(path)
    part = f"{_store(temporary)[1]}/{uuid.uuid4().hex}"
    store.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, p)


def _folder(path: str) -> None:
    store, p = _store(path)
    store.create_dir(p, recursive=True)


def _drop(path: str) -> None:
    store, p = _store(path)
    if store.get_file_info(p).type == fs.FileType.Directory:
        store.delete_dir(p)


def _unpack(raw: bytes, compressor: dict | None) -> bytes:
    if compressor is None:
        return raw
    kind = compressor.get("id")
    if kind == "zlib":
        return zlib.decompress(raw)
    if kind == "gzip":
        return gzip.decompress(raw)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"compressor {kind!r} is not supported")


def metadata(path: str, dataset: str) -> dict:
    raw = _read(f"{path}/{dataset}/.zarray")
    if raw is None:
        raise KeyError(f"{dataset} is not in {path}")
    return json.loads(raw)


def attributes(path: str, dataset: str) -> dict:
    """offset and resolution, with their defaults."""
    raw = _read(f"{path}/{dataset}/.zattrs")
    found = json.loads(raw) if raw else {}
    return found | {"offset": found.get("offset", [0, 0, 0]), "resolution": found.get("resolution", [1, 1, 1])}


#: At most so many tasks; a task takes neighbouring chunks.
MOST_TASKS = 20_000


class _Chunks(InputPartition):
    """The chunks with numbers from first to last, as counted over ranges of chunk indices."""

    def __init__(self, first: int, last: int, ranges: list[range]):
        self.first, self.last, self.ranges = first, last, ranges

    def indices(self) -> Iterator[tuple[int, ...]]:
        for n in range(self.first, self.last):
            at = []
            for r in reversed(self.ranges):
                n, k = divmod(n, len(r))
                at.append(r[k])
            yield tuple(reversed(at))


def _grid(m: dict) -> list[int]:
    """Chunks along z, y and x."""
    return [-(-s // c) for s, c in zip(m["shape"][-3:], m["chunks"][-3:], strict=True)]


def _channels(m: dict) -> int:
    return m["shape"][0] if len(m["shape"]) == 4 else 1


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dataset = options["path"], options.get("dataset", "RAW")
        self.box = [int(x) for x in options["box"].split(",")] if options.get("box") else None
        self.voxels = options.get("rows") == "voxels"
        self.meta = metadata(self.path, self.dataset)
        #: Half-open ranges of voxels (rows=voxels) or of the chunks' first voxels, from the filters.
        self.least, self.most = [0, 0, 0], list(self.meta["shape"][-3:])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of an axis with a whole number narrow the ranges of chunks; those of voxels are met exactly, the
        rest is left to Spark."""
        axes = ["z", "y", "x"] if self.voxels else ["oz", "oy", "ox"]
        for f in filters:
            name = getattr(f, "attribute", ("",))[-1]
            value = getattr(f, "value", None)
            if name not in axes or not isinstance(value, int) and not (isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value)):
                yield f
                continue
            k, last = axes.index(name), None
            if isinstance(f, EqualTo):
                first, last = value, value + 1
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                first = value + isinstance(f, GreaterThan)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                first, last = 0, value + isinstance(f, LessThanOrEqual)
            elif isinstance(f, In):
                first, last = min(f.value), max(f.value) + 1
            else:
                yield f
                continue
            self.least[k] = max(self.least[k], first)
            self.most[k] = self.most[k] if last is None else min(self.most[k], last)
            if isinstance(f, In) or not self.voxels:
                yield f

    def partitions(self) -> list[InputPartition]:
        shape, chunks = self.meta["shape"], self.meta["chunks"]
        ranges = [range(-(-s // c)) for s, c in zip(shape, chunks, strict=True)]
        if self.box:
            lo, hi = self.box[:3], self.box[3:]
            for k in range(3):
                ranges[-3 + k] = range(max(0, lo[k] // chunks[-3 + k]), min(len(ranges[-3 + k]), -(-hi[k] // chunks[-3 + k])))
        for k in range(3):
            r, c = ranges[-3 + k], chunks[-3 + k]
            first = self.least[k] // c if self.voxels or self.box else -(-self.least[k] // c)
            ranges[-3 + k] = range(max(r.start, first), max(r.start, first, min(r.stop, -(-self.most[k] // c))))
        ranges = [range(1)] * (len(shape) == 4) + ranges[-3:]
        total = math.prod(map(len, ranges))
        step = max(1, -(-total // MOST_TASKS))
        return [_Chunks(a, min(total, a + step), ranges) for a in range(0, total, step)]

    def read(self, partition: _Chunks | None) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        for index in partition.indices() if partition else ():  # Spark reads a scan of no partitions as one of nothing
            for row in self._chunk(index):
                if self.voxels:
                    yield from self._spread(row)
                else:
                    yield row

    def _spread(self, row: tuple) -> Iterator[pa.RecordBatch]:
        """The voxels of a chunk that the filters let through."""
        o, size, channels = row[:3], row[3:6], row[6]
        a = np.frombuffer(row[8], np.dtype(row[7])).reshape(channels, *size)
        lo, hi = ([min(max(0, v - s), n) for v, s, n in zip(bound, o, size, strict=True)] for bound in (self.least, self.most))
        a = a[(slice(None), *[slice(i, j) for i, j in zip(lo, hi, strict=True)])]
        at = np.nonzero((a != 0).any(axis=0))
        columns = [pa.array((i + s + b).astype(np.int32)) for i, s, b in zip(at, o, lo, strict=True)]
        columns += [pa.array(a[c][at].astype(np.float64)) for c in range(channels)]
        if len(at[0]):
            yield pa.RecordBatch.from_arrays(columns, ["z", "y", "x", *[f"c{c}" for c in range(channels)]])

    def _chunk(self, index: tuple[int, ...]) -> Iterator[tuple]:
        m = self.meta
        shape, chunks, channels = m["shape"], m["chunks"], m["shape"][0] if len(m["shape"]) == 4 else 1
        sep = m.get("dimension_separator", ".")
        planes = []
        lead = range(-(-channels // chunks[0])) if len(shape) == 4 else [None]
        for c in lead:
            at = index if c is None else (c, *index[1:])
            raw = _read(f"{self.path}/{self.dataset}/{sep.join(map(str, at))}")
            full = np.full(chunks, m.get("fill_value") or 0, np.dtype(m["dtype"])) if raw is None else np.frombuffer(_unpack(raw, m.get("compressor")), np.dtype(m["dtype"])).reshape(chunks, order=m.get("order", "C"))
            planes.append(full if len(shape) == 4 else full[None])
        data = np.concatenate(planes)[:channels]
        o = [i * c for i, c in zip(index[-3:], chunks[-3:], strict=True)]
        e = [min(a + c, s) for a, c, s in zip(o, chunks[-3:], shape[-3:], strict=True)]
        lo, hi = ([max(a, b) for a, b in zip(o, self.box[:3], strict=True)], [min(a, b) for a, b in zip(e, self.box[3:], strict=True)]) if self.box else (o, e)
        if any(a >= b for a, b in zip(lo, hi, strict=True)):
            return
        part = data[(slice(None), *[slice(a - s, b - s) for a, b, s in zip(lo, hi, o, strict=True)])]
        yield (*lo, *[b - a for a, b in zip(lo, hi, strict=True)], channels, np.dtype(m["dtype"]).str, np.ascontiguousarray(part).tobytes())


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        if self.options.get("rows") != "voxels":
            return SCHEMA
        n = _channels(metadata(self.options["path"], self.options.get("dataset", "RAW")))
        return "z int, y int, x int, " + ", ".join(f"c{i} double" for i in range(n))

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), overwrite)


@dataclass
class Written(WriterCommitMessage):
    """Chunks (z, y, x) that a task wrote, as int32 triples."""

    keys: bytes


class VolumeWriter(DataSourceArrowWriter):
    """Chunks of one partition at a time; see the module's docstring for what holds if a job fails."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dataset, self.overwrite, self.job = options["path"], options.get("dataset", "RAW"), overwrite, uuid.uuid4().hex
        self.meta = metadata(self.path, self.dataset)
        self.target = f"{self.path}/.{self.dataset}-{self.job}" if overwrite else f"{self.path}/{self.dataset}"
        self.temporary = f"{self.path}/.tmp-{self.job}"
        _folder(self.temporary)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        m, done, key, block = self.meta, set(), None, None
        chunks, shape, channels = m["chunks"][-3:], m["shape"][-3:], _channels(m)
        for batch in iterator:
            for r in batch.to_pylist():
                o, size = [r[f"o{a}"] for a in "zyx"], [r[f"s{a}"] for a in "zyx"]
                data = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(channels, *size)
                hi = [min(a + n, s) for a, n, s in zip(o, size, shape, strict=True)]
                for k in np.ndindex(*[max(0, -(-h // c) - a // c) for a, h, c in zip(o, hi, chunks, strict=True)]):
                    now = tuple(i + a // c for i, a, c in zip(k, o, chunks, strict=True))
                    if now != key:
                        self._flush(key, block)
                        key, block = now, _held(self.target, m, now, channels)
                        done.add(now)
                    lo = [max(a, i * c) for a, i, c in zip(o, now, chunks, strict=True)]
                    end = [min(h, (i + 1) * c) for h, i, c in zip(hi, now, chunks, strict=True)]
                    to = tuple(slice(a - i * c, b - i * c) for a, b, i, c in zip(lo, end, now, chunks, strict=True))
                    block[(slice(None), *to)] = data[(slice(None), *[slice(a - s, b - s) for a, b, s in zip(lo, end, o, strict=True)])]
        self._flush(key, block)
        return Written(np.array(sorted(done), np.int32).tobytes())

    def _flush(self, key: tuple[int, ...] | None, block: np.ndarray | None) -> None:
        if key is not None:
            for name, raw in _files(self.meta, key, block):
                _put(f"{self.target}/{name}", raw, self.temporary)

    def commit(self, messages: list[Written | None]) -> None:
        keys = np.frombuffer(b"".join(m.keys for m in messages if m), np.int32).reshape(-1, 3)
        if self.overwrite:
            for name in (".zarray", ".zattrs"):
                raw = _read(f"{self.path}/{self.dataset}/{name}")
                if raw is not None:
                    _write(f"{self.target}/{name}", raw)
            _drop(f"{self.path}/{self.dataset}_done")
            _drop(f"{self.path}/{self.dataset}")
            store, p = _store(self.target)
            store.move(p, _store(f"{self.path}/{self.dataset}")[1])
        mark_done(self.path, self.dataset, keys, self.temporary)
        _drop(self.temporary)

    def abort(self, messages: list[Written | None]) -> None:
        _drop(self.temporary)
        if self.overwrite:
            _drop(self.target)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)


def to_voxels(chunks: DataFrame, names: tuple[str, ...] = ("v",), keep_zero: bool = False) -> DataFrame:
    """(z, y, x, one column per channel) of chunk rows; voxels that are 0 in all channels are left out unless wanted."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["channels"], r["sz"], r["sy"], r["sx"])
                at = np.nonzero(np.ones(a.shape[1:], bool) if keep_zero else (a != 0).any(axis=0))
                columns = [pa.array((i + r[o]).astype(np.int32)) for i, o in zip(at, ("oz", "oy", "ox"), strict=True)]
                columns += [pa.array(a[c][at].astype(np.float64)) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, ["z", "y", "x", *names])

    return chunks.mapInArrow(spread, "z int, y int, x int, " + ", ".join(f"{n} double" for n in names))


def create(path: str, dataset: str, shape: list[int], chunks: list[int], dtype: str, offset=(0, 0, 0), resolution=(1, 1, 1), compressor: str | None = "zlib") -> None:
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": np.dtype(dtype).str, "compressor": {"id": compressor, "level": 1} if compressor else None, "fill_value": 0, "order": "C", "filters": None}
    _write(f"{path}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    _write(f"{path}/{dataset}/.zarray", json.dumps(meta).encode())
    _write(f"{path}/{dataset}/.zattrs", json.dumps({"offset": list(offset), "resolution": list(resolution)}).encode())


def _held(folder: str, m: dict, k: tuple[int, ...] | list[int], channels: int) -> np.ndarray:
    """(channels, z, y, x) as it stands in the chunk files at k, the fill value where there are none."""
    chunks, out, sep = m["chunks"], [], m.get("dimension_separator", ".")
    for c in range(-(-channels // chunks[0])) if len(m["shape"]) == 4 else [None]:
        raw = _read(f"{folder}/{sep.join(map(str, k if c is None else (c, *k)))}")
        full = np.full(chunks, m.get("fill_value") or 0, np.dtype(m["dtype"])) if raw is None else np.frombuffer(_unpack(raw, m.get("compressor")), np.dtype(m["dtype"])).reshape(chunks, order=m.get("order", "C"))
        out.append(full if len(m["shape"]) == 4 else full[None])
    return np.concatenate(out)[:channels].copy()


def _files(m: dict, k: tuple[int, ...] | list[int], block: np.ndarray) -> Iterator[tuple[str, bytes]]:
    """(file name, contents) of the chunk files at k; files of a dataset with channels have whole groups of them."""
    chunks, kind, sep = m["chunks"], (m.get("compressor") or {}).get("id"), m.get("dimension_separator", ".")
    if len(m["shape"]) == 4:
        block = np.concatenate((block, np.zeros((-len(block) % chunks[0], *chunks[-3:]), block.dtype)))
    for index, data in [(k, block[0])] if len(m["shape"]) == 3 else [((c // chunks[0], *k), block[c : c + chunks[0]]) for c in range(0, len(block), chunks[0])]:
        raw = data.astype(np.dtype(m["dtype"]), copy=False).tobytes(order=m.get("order", "C"))
        if kind == "zstd":
            import zstandard

            raw = zstandard.ZstdCompressor(level=1).compress(raw)
        raw = zlib.compress(raw, 1) if kind == "zlib" else gzip.compress(raw, 1) if kind == "gzip" else raw
        yield sep.join(map(str, index)), raw


#: Flags in a file of the done map, along each axis.
DONE_EDGE = 128


def mark_done(path: str, dataset: str, keys: np.ndarray, temporary: str) -> None:
    """Set the flags of chunks (n, 3) in ``<dataset>_done``, a dataset of one flag a chunk; only the files of these flags are touched."""
    flags = f"{dataset}_done"
    if _read(f"{path}/{flags}/.zarray") is None:
        n = _grid(metadata(path, dataset))
        create(path, flags, n, [min(DONE_EDGE, k) for k in n], "|b1", compressor="zlib")
    m = metadata(path, flags)
    files = keys // np.array(m["chunks"], np.int32)
    for k in np.unique(files, axis=0) if len(keys) else []:
        block = _held(f"{path}/{flags}", m, k.tolist(), 1)
        own = (keys[(files == k).all(axis=1)] - k * m["chunks"]).T
        block[0][tuple(own)] = True
        for name, raw in _files(m, k.tolist(), block):
            _put(f"{path}/{flags}/{name}", raw, temporary)


def pending_chunks(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(kz, ky, kx) of the chunks that no finished job has written, read from the done map by tasks."""
    register(spark)
    m = metadata(path, dataset)
    if _read(f"{path}/{dataset}_done/.zarray") is None:
        n, i = _grid(m), F.col("id")
        whole = spark.range(math.prod(n))
        return whole.select(F.floor(i / (n[1] * n[2])).cast("int").alias("kz"), (F.floor(i / n[2]) % n[1]).cast("int").alias("ky"), (i % n[2]).cast("int").alias("kx"))

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.nonzero(~np.frombuffer(r["data"], bool).reshape(r["sz"], r["sy"], r["sx"]))
                yield pa.RecordBatch.from_arrays([pa.array((a + r[o]).astype(np.int32)) for a, o in zip(at, ("oz", "oy", "ox"), strict=True)], ["kz", "ky", "kx"])

    flags = spark.read.format("volume").option("path", path).option("dataset", f"{dataset}_done").load()
    return flags.mapInArrow(missing, "kz int, ky int, kx int")


def write_chunks(rows: DataFrame, path: str, dataset: str, overwrite: bool = False) -> None:
    """Write rows of boxes (the schema of the source) into a created dataset. A box is cut at chunk borders and its parts are dealt to
    their chunks, so that each chunk is written by one task; parts of a chunk that overlap are laid over each other by
    their origins. Rows must have the channels of the dataset; what lies outside its shape is left out."""
    m = metadata(path, dataset)
    chunks, shape = m["chunks"][-3:], m["shape"][-3:]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                o, size = [r[f"o{a}"] for a in "zyx"], [r[f"s{a}"] for a in "zyx"]
                data = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["channels"], *size)
                out = []
                for k, lo, hi in chunk_parts(o, size, shape, chunks):
                    part = data[(slice(None), *[slice(a - s, b - s) for a, b, s in zip(lo, hi, o, strict=True)])]
                    out.append((*k, *lo, *[b - a for a, b in zip(lo, hi, strict=True)], r["channels"], r["dtype"], part.tobytes()))
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int32()] * 10, pa.string(), pa.binary()], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["kz", "ky", "kx", "oz", "oy", "ox", "sz", "sy", "sx", "channels", "dtype", "data"])

    names = ["oz", "oy", "ox", "sz", "sy", "sx", "channels", "dtype", "data"]
    parts = rows.select(*names).mapInArrow(cut, "kz int, ky int, kx int, " + SCHEMA)
    dealt = parts.repartition("kz", "ky", "kx").sortWithinPartitions("kz", "ky", "kx", "oz", "oy", "ox").select(*names)
    register(rows.sparkSession)
    dealt.write.format("volume").mode("overwrite" if overwrite else "append").option("path", path).option("dataset", dataset).save()


def chunk_parts(origin: list[int], size: list[int], shape: list[int], chunks: list[int]) -> Iterator[tuple]:
    """(chunk, first voxel, end) of the parts of a box within the shape, one for each chunk that it meets."""
    first = [max(0, o) for o in origin]
    end = [min(o + n, s) for o, n, s in zip(origin, size, shape, strict=True)]
    if any(a >= b for a, b in zip(first, end, strict=True)):
        return
    lead = [a // c for a, c in zip(first, chunks, strict=True)]
    for i in np.ndindex(*[-(-b // c) - k for b, c, k in zip(end, chunks, lead, strict=True)]):
        k = [int(j) + n for j, n in zip(i, lead, strict=True)]
        yield k, [max(a, n * c) for a, n, c in zip(first, k, chunks, strict=True)], [min(b, (n + 1) * c) for b, n, c in zip(end, k, chunks, strict=True)]


def write_voxels(vox: DataFrame, path: str, dataset: str, names: tuple[str, ...] = ("v",)) -> int:
    """Write voxels into a created dataset, one task per chunk; voxels of a chunk that are not given keep their values, and
    writing the same voxels again leaves the same file. Files are renamed into place. Returns the chunks written."""
    m, temporary = metadata(path, dataset), f"{path}/.tmp-{uuid.uuid4().hex}"
    chunks = m["chunks"][-3:]
    ids = [F.floor(F.col(a) / c).cast("int").alias(f"k{a}") for a, c in zip("zyx", chunks, strict=True)]
    _folder(temporary)

    def store(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in table.column_names}
        k = [int(t[f"k{a}"][0]) for a in "zyx"]
        block = _held(f"{path}/{dataset}", m, k, len(names))
        at = tuple(t[a] - i * c for a, i, c in zip("zyx", k, chunks, strict=True))
        for c, n in enumerate(names):
            block[c][at] = t[n]
        files = list(_files(m, k, block))
        for name, raw in files:
            _put(f"{path}/{dataset}/{name}", raw, temporary)
        return pa.table({"n": pa.array([len(files)], pa.int64())})

    rows = vox.select(*ids, "z", "y", "x", *names).groupBy("kz", "ky", "kx").applyInArrow(store, "n long")
    n = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    _drop(temporary)
    return n


def values_at(vox: DataFrame, path: str, dataset: str, names: tuple[str, ...]) -> DataFrame:
    """vox (z, y, x, ...) with the values of a dataset's channels at its voxels.

    Voxels are dealt to the chunks that they lie in, and each of these chunks is read once, by the task that has its voxels; no
    other chunk is opened and no voxel of the dataset becomes a row of its own. Voxels outside the shape get nulls.
    """
    m = metadata(path, dataset)
    chunks, shape = m["chunks"][-3:], m["shape"][-3:]
    own = [c for c in vox.columns if c not in names]
    ids = [F.floor(F.col(a) / c).cast("int").alias(f"_k{a}") for a, c in zip("zyx", chunks, strict=True)]
    keys = [f"_k{a}" for a in "zyx"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(batch.schema.get_field_index(a)).to_numpy() for a in "zyx"])
            k = np.stack([batch.column(batch.schema.get_field_index(a)).to_numpy() for a in keys])
            inside = ((at >= 0) & (at < np.array(shape)[:, None])).all(axis=0)
            out = np.zeros((len(names), batch.num_rows))
            head = np.flatnonzero(np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(axis=0))))
            for a, b in zip(head, [*head[1:], batch.num_rows], strict=True):
                rows = np.arange(a, b)[inside[a:b]]
                if not len(rows):
                    continue
                now = tuple(int(v) for v in k[:, a])
                if now != key:
                    key, block = now, _held(f"{path}/{dataset}", m, now, len(names))
                spot = tuple(at[i][rows] - now[i] * chunks[i] for i in range(3))
                for c in range(len(names)):
                    out[c][rows] = block[c][spot]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in own] + [pa.array(v, mask=~inside) for v in out]
            yield pa.RecordBatch.from_arrays(columns, [*own, *names])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*vox.select(*own).schema, *[StructField(n, DoubleType()) for n in names]])
    return vox.select(*own, *ids).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(gather, schema)


#: Chunks that a task keeps while it reads boxes.
KEPT_CHUNKS = 64
#: Boxes that one task reads; their rows are too small for adaptive execution to tell how much is read for them.
BOXES_A_TASK = 1000


def read_boxes(boxes: DataFrame, path: str, dataset: str, size: tuple[int, int, int]) -> DataFrame:
    """boxes (oz, oy, ox and other columns) with channels, dtype and data: the dense contents of the box of this size, 0 beyond
    the volume. Boxes are dealt by place, so that neighbours share the chunks that a task has read."""
    m = metadata(path, dataset)
    chunks, shape, channels = m["chunks"][-3:], m["shape"][-3:], _channels(m)
    own = boxes.columns
    kind = np.dtype(m["dtype"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            at = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("oz", "oy", "ox")]
            for i, o in enumerate(zip(*at, strict=True)):
                out = np.zeros((channels, *size), kind)
                for k, lo, hi in chunk_parts(list(o), list(size), shape, chunks):
                    key = tuple(k)
                    if key not in kept:
                        if len(kept) >= KEPT_CHUNKS:
                            kept.pop(next(iter(kept)))
                        kept[key] = _held(f"{path}/{dataset}", m, key, channels)
                    part = kept[key][(slice(None), *[slice(a - n * c, b - n * c) for a, b, n, c in zip(lo, hi, k, chunks, strict=True)])]
                    out[(slice(None), *[slice(a - s, b - s) for a, b, s in zip(lo, hi, o, strict=True)])] = part
                row = batch.slice(i, 1)
                more = [pa.array([channels], pa.int32()), pa.array([kind.str]), pa.array([out.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[row.column(row.schema.get_field_index(c)) for c in own], *more], [*own, "channels", "dtype", "data"])

    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

    schema = StructType([*boxes.schema, StructField("channels", IntegerType()), StructField("dtype", StringType()), StructField("data", BinaryType())])
    near = [F.floor(F.col(f"o{a}") / c) for a, c in zip("zyx", chunks, strict=True)]
    parts = max(1, -(-boxes.count() // BOXES_A_TASK))
    return boxes.repartitionByRange(parts, *near).sortWithinPartitions(*near).mapInArrow(read, schema)
