"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by doc_id; each partition streams its ids into one payload file (a header,
then raw little-endian ids, 2 bytes each if the vocabulary allows) and writes one index file. The index maps a key
(doc_id and its occurrence number) to a slot by a minimal perfect hash: level by level, keys alone on their bit are
placed there and the rest go on to the next level; a key's slot is the rank of its bit. Slot arrays hold the offset,
length and a 32-bit fingerprint. The index is a file of fixed-width arrays, so one lookup reads a word and a rank a level (two
levels, mostly), a fingerprint, an offset, a length and one stretch of the payload, each at its place; a lookup of many
keys reads whole arrays instead. The manifest holds the range of ids of each shard, so ``lookup`` opens only the
shards that it needs. Files are written under a temporary name and renamed, so a repeated task leaves the same files.

Defined cases: null text counts as empty (its end id only); repeated doc_ids are kept, ordered by text and told apart
by occurrence; a null doc_id comes first; an empty table gives an empty store; only doc_id and text are stored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.tokens import encoder
from voxframe.storage import prepare

MAGIC = b"VXTOK1\x00\x00"
HEADER = 16
INDEX_MAGIC = b"VXIDX1\x00\x00"
#: Arrays of an index file, one after the other behind their lengths.
ARRAYS = {"sizes": "<i8", "words": "<u8", "ranks": "<i8", "offset": "<i8", "length": "<i8", "fingerprint": "<u4", "doc_ids": "<i8", "occurrence": "<i4"}
#: An array is read whole where more than one of so many entries is asked for.
READ_WHOLE = 64
LOOKUP_PARTS = 16
_U = np.uint64
NULL_ID = -(2**63)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def key_of(doc_ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return doc_ids.astype(np.int64).view(np.uint64) ^ mixed(occurrence, 77) * (occurrence > 0).astype(np.uint64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys. ``word_at`` and ``rank_at`` bring words of bits and their ranks."""

    def __init__(self, sizes: np.ndarray, word_at: Callable[[np.ndarray], np.ndarray], rank_at: Callable[[np.ndarray], np.ndarray]):
        self.sizes, self.word_at, self.rank_at = sizes, word_at, rank_at
        self.first = np.concatenate(([0], np.cumsum(sizes // 64))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 1.6) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        words, sizes, level = [np.zeros(0, np.uint64)], [], 0
        while len(keys):
            size = max(64, -(-int(len(keys) * load) // 64) * 64)
            at = (mixed(keys, level) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys, level = keys[~alone[at]], level + 1
        bits = np.concatenate(words)
        ranks = (np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)).astype(np.int64)
        made = cls(np.array(sizes, np.int64), bits.__getitem__, ranks.__getitem__)
        made.arrays = {"sizes": made.sizes, "words": bits, "ranks": ranks}
        return made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gets -1 or some slot (fingerprints tell)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            bit = (mixed(keys[left], level) % _U(size)).astype(np.int64)
            word = self.first[level] + bit // 64
            low = (bit % 64).astype(np.uint64)
            bits = self.word_at(word)
            there = (bits >> low) & _U(1) == 1
            below = np.bitwise_count(bits[there] & ((_U(1) << low[there]) - _U(1)))
            out[left[there]] = self.rank_at(word[there]) + below
            left = left[~there]
        return out


def _put(uri: str, data: bytes) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(part, path)


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Write the store and return its manifest, one entry per shard in doc_id order (also in manifest.json)."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = source.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}"
        store, path = fs.FileSystem.from_uri(f"{name}.bin")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        ids, lengths = [], []
        end = np.array([end_id], enc.dtype).tobytes()
        with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(MAGIC + bytes([enc.dtype.itemsize]) + bytes(HEADER - len(MAGIC) - 1))
            for batch in batches:
                own = batch.column(0).fill_null(NULL_ID).to_numpy()
                ids.append(own)
                for x in enc.encode(batch.column(1).to_pylist()):
                    f.write(x.tobytes() + end)
                    lengths.append(len(x) + 1)
        if not lengths:
            store.delete_file(part)
            return
        store.move(part, path)
        doc_ids, n = np.concatenate(ids), np.array(lengths, np.int64)
        fresh = np.concatenate(([True], doc_ids[1:] != doc_ids[:-1]))
        occurrence = np.arange(len(n)) - np.maximum.accumulate(np.where(fresh, np.arange(len(n)), 0))
        keys = key_of(doc_ids, occurrence)
        table = PerfectHash.build(keys)
        slot = table.slots(keys)
        place = np.empty(len(n), np.int64)
        place[slot] = np.arange(len(n))
        arrays = table.arrays | {
            "offset": (np.cumsum(n) - n)[place], "length": n[place], "fingerprint": (mixed(keys, 1001) >> _U(32)).astype(np.uint32)[place], "doc_ids": doc_ids, "occurrence": occurrence.astype(np.int32),
        }
        _put(f"{name}.idx", INDEX_MAGIC + np.array([len(arrays[k]) for k in ARRAYS], "<i8").tobytes() + b"".join(arrays[k].astype(t).tobytes() for k, t in ARRAYS.items()))
        told = {"shard": [shard], "docs": [len(n)], "tokens": [int(n.sum())], "lo": [int(doc_ids[0])], "hi": [int(doc_ids[-1])]}
        yield pa.RecordBatch.from_pydict(told, pa.schema([("shard", pa.int32()), *[(k, pa.int64()) for k in ("docs", "tokens", "lo", "hi")]]))

    rows = sorted(ordered.mapInArrow(write, "shard int, docs long, tokens long, lo long, hi long").collect(), key=lambda r: r["shard"])  # one per shard
    manifest, first = [], 0
    for r in rows:
        manifest.append({"name": f"{folder}/shard-{r['shard']:06d}", "docs": r["docs"], "tokens": r["tokens"], "first": first, "lo": r["lo"], "hi": r["hi"]})
        first += r["tokens"]
    _put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


class Shard:
    """Keyed access to one shard."""

    def __init__(self, name: str):
        store, path = fs.FileSystem.from_uri(f"{name}.idx")
        self.index = store.open_input_file(path)
        start = len(INDEX_MAGIC) + 8 * len(ARRAYS)
        head = self.index.read_at(start, 0)
        if head[: len(INDEX_MAGIC)] != INDEX_MAGIC:
            raise ValueError(f"{name}: not an index")
        self.arrays, self.held = {}, {}
        for (k, t), n in zip(ARRAYS.items(), np.frombuffer(head, "<i8", offset=len(INDEX_MAGIC)), strict=True):
            self.arrays[k] = (start, int(n), np.dtype(t))
            start += int(n) * self.arrays[k][2].itemsize
        self.hash = PerfectHash(self.whole("sizes"), lambda at: self.at("words", at), lambda at: self.at("ranks", at))
        self.file = store.open_input_file(path.removesuffix(".idx") + ".bin")
        head = self.file.read_at(HEADER, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name}: not a token shard")
        self.dtype = np.dtype(f"<u{head[len(MAGIC)]}")

    def whole(self, name: str) -> np.ndarray:
        if name not in self.held:
            start, n, kind = self.arrays[name]
            self.held[name] = np.frombuffer(self.index.read_at(n * kind.itemsize, start), kind)
        return self.held[name]

    def at(self, name: str, places: np.ndarray) -> np.ndarray:
        """Entries of an array: each read at its place, or from the whole array where many are asked for."""
        start, n, kind = self.arrays[name]
        if name in self.held or len(places) * READ_WHOLE > n:
            return self.whole(name)[places]
        w = kind.itemsize
        return np.frombuffer(b"".join(self.index.read_at(w, start + int(i) * w) for i in places), kind)

    def find(self, doc_ids: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key: hash, fingerprint, slot arrays."""
        keys = key_of(doc_ids, occurrence)
        slot = self.hash.slots(keys)
        found = slot >= 0
        found[found] = self.at("fingerprint", slot[found]) == (mixed(keys[found], 1001) >> _U(32)).astype(np.uint32)
        offset, length = np.zeros((2, len(keys)), np.int64)
        offset[found], length[found] = self.at("offset", slot[found]), self.at("length", slot[found])
        return found, offset, length

    def ids(self, offset: int, length: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(int(length) * w, HEADER + int(offset) * w), self.dtype)


def read_store(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, by keyed lookups in the files."""
    shards = [(m["name"], m["first"]) for m in manifest]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(name)
                doc_ids, occurrence = shard.whole("doc_ids"), shard.whole("occurrence")
                found, offset, length = shard.find(doc_ids, occurrence.astype(np.int64))
                if not found.all():
                    raise ValueError(f"{name}: a stored key is not found")
                for a in range(0, len(doc_ids), 2000):
                    own = [shard.ids(o, n).astype("<u4").tobytes() for o, n in zip(offset[a : a + 2000], length[a : a + 2000], strict=True)]
                    columns = [pa.array(doc_ids[a : a + 2000], mask=doc_ids[a : a + 2000] == NULL_ID), pa.array(first + offset[a : a + 2000]), pa.array(length[a : a + 2000]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    columns += [pa.array(own, pa.binary())] * with_ids
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] * with_ids)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    table = spark.createDataFrame(shards, "name string, first long")
    return table.repartition(max(1, len(shards))).mapInArrow(read, schema)


def lookup(wanted: DataFrame, manifest: list[dict], doc_id: str = "doc_id") -> DataFrame:
    """doc_id, occurrence, start, n_tokens and ids of the wanted documents, by keyed access: all that have the id, none if none has.

    Ids asked for several times (or null) are looked up once. Each id goes to its shard, found by bisection of the
    manifest's ranges; a shard's ids are dealt over ``LOOKUP_PARTS`` tasks, so that no shard is one task's alone.
    """
    spans = sorted((m["lo"], m["hi"], m["name"], m["first"]) for m in manifest)
    his = np.array([x[1] for x in spans], np.int64)
    ids = wanted.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id")).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            at = np.searchsorted(his, own)
            inside = np.flatnonzero(at < len(his))
            inside = inside[np.array([spans[i][0] for i in at[inside]], np.int64) <= own[inside]]
            yield pa.RecordBatch.from_arrays([pa.array(own[inside]), pa.array(at[inside].astype(np.int32))], ["id", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, -1
        for batch in batches:
            own, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(at):
                if k != number:
                    shard, number = Shard(spans[k][2]), k
                left, turn = own[at == k], 0
                while len(left):
                    found, offset, length = shard.find(left, np.full(len(left), turn, np.int64))
                    left, offset, length = left[found], offset[found], length[found]
                    for a in range(0, len(left), 2000):
                        cut = slice(a, a + 2000)
                        data = [shard.ids(o, n).astype("<u4").tobytes() for o, n in zip(offset[cut], length[cut], strict=True)]
                        columns = [pa.array(left[cut], mask=left[cut] == NULL_ID), pa.array([turn] * len(data), pa.int64()), pa.array(spans[k][3] + offset[cut]), pa.array(length[cut]), pa.array(data, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "occurrence", "start", "n_tokens", "ids"])
                    turn += 1

    routed = ids.mapInArrow(route, "id long, shard int").repartition("shard", F.pmod(F.xxhash64("id"), F.lit(LOOKUP_PARTS))).sortWithinPartitions("shard")
    return routed.mapInArrow(read, "doc_id long, occurrence long, start long, n_tokens long, ids binary")
