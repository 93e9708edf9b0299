"""Harmonic packing of documents' token ids into sequences of a fixed capacity.

A piece of length L belongs to the reciprocal class j = capacity // L, with L in (capacity / (j + 1), capacity / j],
and a bin of class j takes exactly j pieces, whatever the other classes do. Documents are cut so that classes lose
little: into pieces of the capacity's halves, quarters and so on (classes 1, 2, 4, ..., which fill a bin to the last
place), down to ``min_cut`` ids, and one rest below that. Workers cut, rank and count their own pieces; only the
counts per worker and class are then added up, so that the bins of a class go on across workers and each class has
one unfinished bin in the whole corpus. The unfinished bin of a power-of-two class is split into power-of-two
sequences, which need no padding.

Defined cases: null text counts as empty, and an empty document is one piece, its end id; repeated rows are packed
each on its own; an empty table gives an empty result; other columns pass through to every piece of their document,
but for columns that have the name of a result column, which are replaced (inner columns are prefixed ``_pack_``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from voxframe.llm.tokens import encoder
from voxframe.storage import written

CAPACITY, MIN_CUT, END_ID = 2048, 32, 1
RESULTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def cuts(n: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """Lengths of a document's pieces, largest first."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= min_cut:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, min_cut: int = MIN_CUT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns of docs but text, then start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with_ids, ``ids`` (little-endian unsigned 32-bit)."""
    if capacity & (capacity - 1) or min_cut & (min_cut - 1):
        raise ValueError("capacity and min_cut must be powers of two")
    kept = [c for c in docs.columns if c != text and c.lower() not in RESULTS]
    made = [StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "_pack_rank")]
    made += [StructField("_pack_part", IntegerType())] + [StructField("ids", BinaryType())] * with_ids
    source = docs.select(*kept, F.col(text).alias("_pack_text"))
    schema = StructType([*source.schema[:-1], *made])
    width = len(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ranks = encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            owner, rows, ids_out = [], [], []

            def flush(owner: list, rows: list, ids_out: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                take = pa.array(owner, pa.int32())
                columns = [batch.column(i).take(take) for i in range(width)]
                columns += [pa.array(x, pa.int64()) for x in np.array(rows, np.int64).reshape(-1, 5).T]
                columns.append(pa.array(np.full(len(rows), part, np.int32)))
                columns += [pa.array(ids_out, pa.binary())] * with_ids
                return pa.RecordBatch.from_arrays(columns, schema.names)

            for i, ids in enumerate(enc.encode(batch.column(width).to_pylist())):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                at = 0
                for size in cuts(len(ids), capacity, min_cut):
                    raw = ids[at : at + size].tobytes()
                    rank = ranks.get(size, 0)
                    ranks[size] = rank + 1
                    owner.append(i)
                    rows.append((at, size, zlib.crc32(raw), len(ids), rank))
                    if with_ids:
                        ids_out.append(raw)
                    at += size
                if len(rows) > 20_000:
                    yield flush(owner, rows, ids_out)
                    owner, rows, ids_out = [], [], []
            if rows:
                yield flush(owner, rows, ids_out)

    pieces = written(source.mapInArrow(cut, schema), "pieces")
    counts = pieces.groupBy("_pack_part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_pack_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_pack_part", "length", F.coalesce(before, F.lit(0)).alias("_pack_base"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one per length class
    classes, first = [], 0
    for size in sorted(totals, reverse=True):
        j = capacity // size
        full, rest = divmod(totals[size], j)
        shares = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if size & (size - 1) == 0 else [rest] * (rest > 0)
        classes.append((size, j, full, first, [sum(shares[:k]) for k in range(len(shares))]))
        first += full + len(shares)
    table = docs.sparkSession.createDataFrame(classes, "length long, _pack_j long, _pack_full long, _pack_first long, _pack_shares array<long>")
    df = pieces.join(bases, ["_pack_part", "length"]).join(F.broadcast(table), "length")  # at most log2(capacity) + min_cut rows
    rank = F.col("_pack_base") + F.col("_pack_rank")
    df = df.withColumn("_pack_bin", F.floor(rank / F.col("_pack_j"))).withColumn("_pack_slot", rank % F.col("_pack_j"))
    slot = F.col("_pack_slot")
    last = F.col("_pack_bin") >= F.col("_pack_full")
    starts = F.filter("_pack_shares", lambda s: s <= slot)
    return df.select(
        *kept,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_pack_first") + F.when(last, F.col("_pack_full") + F.size(starts) - 1).otherwise(F.col("_pack_bin"))).cast("long").alias("sequence_id"),
        (F.when(last, slot - F.array_max(starts)).otherwise(slot) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] * with_ids),
    )
