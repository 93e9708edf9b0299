"""Exact removal of repeated byte strings by a depth-limited, most-significant-digit radix sort of windows.

A window of ``length`` bytes starts at every byte that leaves room for it; two equal windows repeat. Windows are
ordered by digits, most significant first, and a group of one is dropped before the next digit is looked at:

1. the first digit of a window is its minimiser, the leftmost of its ``gram``-byte strings with the least hash. Equal
   windows have equal minimisers, and neighbouring windows share one, so a *run* of windows is one record;
2. the second digit is the whole span of the run. Runs with equal spans repeat in all their windows;
3. minimisers that stand in different spans (the borders of repeats) go on to the full depth: one run of each
   distinct span brings its bytes, and equal windows in them are the repeats that are left. A minimiser with up to
   ``SPANS_AT_ONCE`` distinct spans (a bounded group) is compared in place; one with more gives a record per window.

Otherwise groups are only counted with map-side partial aggregates and joined back on their key, so a string that a
third of all documents hold is never gathered in one task. Of exact copies one brings its bytes and its ranges; the rows
of a text with many copies are dealt out for the last join. Windows are compared by two 64-bit polynomial hashes at
every digit: that of the minimiser, and that of the span or of the window itself.

Defined cases: null text counts as empty; texts below ``length`` bytes lose nothing; repeated rows are repeats of each
other; an empty table gives an empty result; other columns pass through (inner columns are prefixed ``_rep_``), but for
columns that have the name of a result column, which are replaced; very long texts are worked off in pieces of ``PIECE``
bytes, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from voxframe.operators.keys import attach, dealt_anew
from voxframe.storage import discard, written

LENGTH, GRAM, PIECE, SPANS_AT_ONCE = 200, 64, 1 << 21, 20_000
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 2**64)
        _POWERS[:] = []
        for b in (_BASE, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class Hashes:
    """Hashes of any substrings of one text from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def fixed(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + _U(length))


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block-wise running minima."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimiser hash, span hash, first window, last window) of each run of windows with one minimiser."""
    h = Hashes(data)
    grams = h.fixed(gram)
    tagged = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(tagged, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    hi = np.concatenate((lo[1:], [len(at)])) - 1
    return grams[at[lo]], h.of(lo, hi + length), lo, hi


def collapsed(anchor: np.ndarray, run: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, run, times, ranges of each, lo, hi): the runs of one text by what they hold, each with its places; neighbouring
    places make one range. A text of one word over and over has one run."""
    order = np.lexsort((lo, run, anchor))
    anchor, run, lo, hi = anchor[order], run[order], lo[order], hi[order]
    head = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])))
    first = np.concatenate(([True], head[1:] | (lo[1:] > hi[:-1] + 1)))  # of a range
    start, at = np.flatnonzero(head), np.flatnonzero(first)
    last = np.concatenate((at[1:], [len(lo)])) - 1
    times = np.diff(np.concatenate((start, [len(lo)])))
    ranges = np.diff(np.concatenate((np.searchsorted(at, start), [len(at)])))
    return anchor[start], run[start], times, ranges, lo[at], hi[last]


RUNS = "key long, n int, times int, ranges array<struct<lo:int,hi:int>>"


def run_rows(texts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows (names[:2], key, n, times, ranges) of texts (key, n, collapsed runs)."""
    parts = [(a.view(np.int64), r.view(np.int64), np.full(len(a), key, np.int64), np.full(len(a), n, np.int32), times.astype(np.int32), ranges, lo, hi) for key, n, (a, r, times, ranges, lo, hi) in texts]
    *plain, sizes, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    places = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (lo, hi)], ["lo", "hi"])
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.RecordBatch.from_arrays([*[pa.array(x) for x in plain], pa.ListArray.from_arrays(offsets, places)], [*names[:2], "key", "n", "times", "ranges"])


def _pieces(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Pieces that share length - 1 bytes, so that each window is in exactly one."""
    step = max(PIECE, 2 * length)
    for a in range(0, max(1, n - length + 1), step):
        yield a, min(n, a + step + length - 1)


def _arrow(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """The columns of docs but text, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, ``kept_text`` (what remains)."""
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    source = docs.withColumn("_rep_bytes", F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    source = source.withColumn("_rep_key", F.xxhash64("_rep_bytes")).withColumn("_rep_n", F.octet_length("_rep_bytes").cast("int"))
    source = source.withColumn("_rep_id", F.xxhash64("_rep_key", "_rep_n"))
    work = source.select("_rep_bytes", "_rep_key", "_rep_n")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run that a text has, with all its places in the text."""
        for batch in batches:
            texts, held = [], 0
            for raw, key, n in zip(_arrow(batch, "_rep_bytes"), _arrow(batch, "_rep_key"), _arrow(batch, "_rep_n"), strict=True):
                if n < length:
                    continue
                data = np.frombuffer(raw, np.uint8)
                found = [(*runs(data[a:b], length, gram), a) for a, b in _pieces(n, length)]
                both = [np.concatenate([f[i] for f in found]) for i in (0, 1)] + [np.concatenate([f[i] + f[4] for f in found]) for i in (2, 3)]
                texts.append((key, n, collapsed(*both)))
                held += len(texts[-1][2][4])
                if held > 50_000:
                    yield run_rows(texts, ["anchor", "span"])
                    texts, held = [], 0
            if texts:
                yield run_rows(texts, ["anchor", "span"])

    records = written(work.where(F.col("_rep_n") >= length).mapInArrow(find_runs, "anchor long, span long, " + RUNS), "runs")
    again = records.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select(dealt_anew("anchor"))
    repeated = written(records.join(again, "anchor", "left_semi"), "repeated-runs")
    discard(records)

    one = F.struct("key", "n", F.col("ranges")[0]["lo"].alias("lo"), F.col("ranges")[0]["hi"].alias("hi"))
    spans = repeated.groupBy("anchor", "span").agg(F.sum("times").alias("c"), F.min(one).alias("rep"))
    # a range of neighbouring equal runs is as wide as it is long; one run has at most length - gram + 1 windows
    spans = written(spans.withColumn("rep", F.col("rep").withField("hi", F.least("rep.hi", F.col("rep.lo") + (length - gram)))), "spans")
    whole = repeated.join(spans.where("c > 1").select("anchor", "span"), ["anchor", "span"], "left_semi").select("key", "n", F.inline("ranges"))
    several = spans.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select(dealt_anew("anchor"), "k")
    borders = (
        spans.join(several, "anchor").select("anchor", "k", "rep.*")
        .groupBy("key", "n").agg(F.collect_set(F.struct("anchor", "k", "lo", "hi")).alias("_rep_at"))
    )
    on = [F.col("_rep_key") == F.col("key"), F.col("_rep_n") == F.col("n")]
    at = F.col("at")
    one_of_each = work.where(F.col("_rep_n") >= length).dropDuplicates(["_rep_key", "_rep_n"])  # copies of a text go before the shuffle
    deep = (
        one_of_each.join(borders, on)
        .select("_rep_bytes", "key", "n", F.explode("_rep_at").alias("at"))
        .select("key", "n", "at.anchor", "at.k", "at.lo", F.substr("_rep_bytes", at["lo"] + 1, at["hi"] - at["lo"] + length).alias("bytes"))
    )
    deep = written(deep, "borders")

    def windows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in its row, hash) of each window of a batch's spans."""
        raw = _arrow(batch, "bytes")
        sizes = np.array([len(x) for x in raw], np.int64)
        first = np.cumsum(sizes) - sizes
        count = sizes - (length - 1)
        row = np.repeat(np.arange(len(raw)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = first[row] + place
        return row, place, Hashes(np.frombuffer(b"".join(raw), np.uint8)).of(start, start + length)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal windows of the spans of each minimiser; rows come sorted by it."""

        def told(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, place, h = windows_of(batch)
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            row, place = row[times[back] > 1], place[times[back] > 1]
            head = np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))) if len(row) else np.zeros(0, bool)
            a = np.flatnonzero(head)
            b = np.concatenate((a[1:], [len(row)])) - 1 if len(a) else a
            key, n, lo = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "n", "lo"))
            return pa.RecordBatch.from_arrays(
                [pa.array(key[row[a]]), pa.array(n[row[a]]), pa.array((lo[row[a]] + place[a]).astype(np.int32)), pa.array((lo[row[a]] + place[b]).astype(np.int32))], ["key", "n", "lo", "hi"]
            )

        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held = pa.Table.from_batches(([*held.to_batches()] if held else []) + [batch]).combine_chunks()
            anchor = held.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield told(held.slice(0, cut).combine_chunks().to_batches()[0])
                held = held.slice(cut)
        if held:
            yield told(held.combine_chunks().to_batches()[0])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                row, place, h = windows_of(part)
                anchor, key, n, lo = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("anchor", "key", "n", "lo"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(anchor[row]), pa.array(key[row]), pa.array(n[row]), pa.array((lo[row] + place).astype(np.int32))], ["window", "anchor", "key", "n", "lo"]
                )

    few = deep.where(F.col("k") <= SPANS_AT_ONCE).select("anchor", "key", "n", "lo", "bytes")
    few = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "key long, n int, lo int, hi int")
    windows = deep.where(F.col("k") > SPANS_AT_ONCE).mapInArrow(spread, "window long, anchor long, key long, n int, lo int")
    same = windows.groupBy("window", "anchor").agg(F.count("*").alias("c")).where("c > 1").select(dealt_anew("window"), "anchor")
    single = windows.join(same, ["window", "anchor"], "left_semi").select("key", "n", "lo", F.col("lo").alias("hi"))
    text_id = F.xxhash64("key", "n").alias("_rep_of")
    held = repeated.where("ranges[0].lo = 0").groupBy(text_id).agg(F.count("*").alias("_rep_held"))  # a text's first run comes once a copy
    found = whole.unionByName(few).unionByName(single).groupBy(text_id).agg(F.collect_set(F.struct("lo", "hi", "n")).alias("_rep_at"))
    found = written(found.join(held, "_rep_of", "left").select("_rep_of", "_rep_at", F.coalesce("_rep_held", F.lit(1).cast("long")).alias("_rep_held")), "repeats")

    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    kept = [c for c in docs.columns if c != text and c.lower() not in results]
    extra = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
    schema = StructType([*docs.select(*kept).schema, *extra, *([StructField("kept_text", BinaryType())] if with_text else [])])
    width = len(kept)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, texts = [], [], []
            held, ranges = batch.column(width), batch.column(width + 2)
            first = ranges.offsets.to_numpy()
            los, his, sizes = (ranges.values.field(i).to_numpy() for i in range(3))
            for i, n in enumerate(_arrow(batch, "_rep_n")):
                raw, removed, edges = held[i].as_py(), 0, 0
                a, b = first[i], first[i + 1]
                own = a + np.flatnonzero(sizes[a:b] == n)
                if len(own):
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, los[own], 1)
                    np.subtract.at(step, his[own] + length, 1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed = int(gone.sum())
                    edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                counts.append((n, removed, edges))
                shas.append(hashlib.sha256(raw).hexdigest())
                texts.append(raw)
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array([x[i] for x in counts], pa.int64()) for i in range(3)] + [pa.array(shas, pa.string())]
            columns += [pa.array(texts, pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    joined = attach(source, found, "_rep_id", "_rep_of", "_rep_held", F.xxhash64(F.spark_partition_id())).select(*kept, "_rep_bytes", "_rep_n", "_rep_at")
    out = joined.mapInArrow(remove, schema)
    return out.withColumn("kept_text", F.decode("kept_text", "UTF-8")) if with_text else out
