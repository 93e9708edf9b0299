"""Removal of passages that occur elsewhere, by greedy factoring against indexed reference blocks (relative Lempel-Ziv).

Words are the runs of ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``length`` words on end. A window whose words also
start anywhere else repeats, and every word of it goes.

1. Every text is cut into *runs*: neighbouring windows that share their anchor, the leftmost of their strings of
   ``gram`` words with the least hash. Equal windows have equal anchors, so a match of ``length`` words can only lie in
   the reference block of its anchor, and no text needs to be held against the others. Runs with an anchor of their own
   have no such match anywhere and are dropped.
2. Runs with equal words factor as one phrase each: the one against the other.
3. The distinct runs of an anchor are its reference block. A block, or many small ones in one go, gets a suffix index
   that tells for each place the longest match elsewhere in the block. Each run is factored greedily from its first
   word: a factor is the longest match at its place, or a word that has none. Factors of ``length`` words or more are
   repeats as they are. A window in no single factor lies over a factor's boundary and is looked up in the index.
   A block of more than ``BLOCK_RUNS`` runs is cut on by whole windows, so that no task gathers it.

Groups are counted with map-side partial aggregates and joined back on their key. Of exact copies one brings its
words; rows of a text with many copies are dealt out for the last join. Runs are grouped by 64-bit polynomial hashes;
blocks compare the words themselves.

Defined cases: null text has no words; texts below ``length`` words lose nothing; repeated rows are repeats of each
other; an empty table gives an empty result; other columns pass through (inner columns are prefixed ``_rlz_``), but for
columns that have the name of a result column, which are replaced; very long texts are hashed in pieces of ``PIECE``
bytes and cut into runs in pieces of ``PIECE`` words, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from voxframe.llm.repeats import RUNS, Hashes, _arrow, _least, _powers, collapsed, run_rows
from voxframe.operators.keys import attach, dealt_anew
from voxframe.storage import discard, written

LENGTH, GRAM, PIECE, BLOCK_WORDS, BLOCK_RUNS = 35, 12, 1 << 20, 1 << 19, 20_000
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Rolling(Hashes):
    """Hashes of any runs of a sequence of whole numbers."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values * _U(2) + _U(1)) * self.up[: len(values)], out=self.sums[1:])


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, from pieces that are cut at white space."""
    data, parts, at = np.frombuffer(raw, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):  # a word is never cut
            gap = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + PIECE)
        piece = data[at:end]
        edge = np.diff(np.concatenate(([True], _SPACE[piece], [True])).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            parts.append(Hashes(piece).of(start, stop))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def runs(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the run's words, first window, last window) of each run of windows with one anchor."""
    h = Rolling(words)
    grams = h.fixed(gram)
    tagged = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(tagged, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    hi = np.concatenate((lo[1:], [len(at)])) - 1
    return grams[at[lo]], h.of(lo, hi + length), lo, hi


def longest_matches(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each place the length, up to ``depth``, of the longest string there that also starts at another place.

    The index is a suffix array by prefix doubling; the ranks of each doubling give the matches between its neighbours.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while width < depth:
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1
        rank = np.unique(rank * np.int64(n + 1) + later, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b, same = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    for k in reversed(range(len(levels))):
        i, j = a + same, b + same
        inside = (j < n) & (i < n)
        hit = np.zeros(len(same), bool)
        hit[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        # ranks of a doubling that runs over the end differ from those that do not, so a hit has its whole width
        same = np.where(hit & (same + (1 << k) <= depth), same + (1 << k), same)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, same)
    np.maximum.at(out, b, same)
    return out


def factors(match: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the greedy factors of the runs [start, end), all runs a step at a time."""
    places, lengths, at, stop = [], [], start.copy(), end
    while len(at):
        size = np.minimum(np.maximum(match[at], 1), stop - at)
        places.append(at)
        lengths.append(size)
        at = at + size
        open_ = at < stop
        at, stop = at[open_], stop[open_]
    return (np.concatenate(places), np.concatenate(lengths)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, last window) of the stretches of repeated windows in runs of words, each against all others."""
    ids: dict[bytes, int] = {}
    words = [x.split(b" ") for x in texts]
    size = np.array([len(w) for w in words], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
    symbols = np.empty(int((size + 1).sum()), np.int64)
    symbols[:] = -1
    symbols[np.setdiff1d(np.arange(len(symbols)), start + size, assume_unique=True)] = np.fromiter((ids.setdefault(w, len(ids)) for x in words for w in x), np.int64, int(size.sum()))
    symbols[start + size] = len(ids) + np.arange(len(texts))  # each run ends with a sign of its own
    match = longest_matches(symbols, int(size.max()))
    place, span = factors(match, start, start + size)
    long_ = span >= length
    step = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(step, place[long_], 1)
    np.subtract.at(step, (place + span - length + 1)[long_], 1)
    inside = np.cumsum(step[:-1]) > 0
    count = size - length + 1  # windows of each run
    window = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    row = np.repeat(np.arange(len(texts)), count)
    hit = inside[window]
    over = ~hit  # over a factor's boundary
    hit[over] = match[window[over]] >= length
    row, at = row[hit], (window - start[row])[hit]
    if not len(row):
        return row, at, at
    head = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(head)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first], at[first], at[last]


def remove_repeated_passages(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """The columns of docs but text, n_words, n_removed, kept_sha256 and, with_text, ``kept_text`` (kept words, one space between)."""
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    source = docs.withColumn("_rlz_bytes", F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    source = source.withColumn("_rlz_key", F.xxhash64("_rlz_bytes")).withColumn("_rlz_n", F.octet_length("_rlz_bytes").cast("int"))
    source = source.withColumn("_rlz_id", F.xxhash64("_rlz_key", "_rlz_n"))
    work = source.select("_rlz_bytes", "_rlz_key", "_rlz_n").where(F.col("_rlz_n") >= 2 * length - 1)  # so many words need as many bytes

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run that a text has, with all its places in the text."""
        for batch in batches:
            texts, held = [], 0
            for raw, key, n in zip(_arrow(batch, "_rlz_bytes"), _arrow(batch, "_rlz_key"), _arrow(batch, "_rlz_n"), strict=True):
                words = word_hashes(raw)
                found = [(*runs(words[a : a + PIECE + length - 1], length, gram), a) for a in range(0, len(words) - length + 1, PIECE)]
                if not found:
                    continue
                both = [np.concatenate([f[i] for f in found]) for i in (0, 1)] + [np.concatenate([f[i] + f[4] for f in found]) for i in (2, 3)]
                texts.append((key, n, collapsed(*both)))
                held += len(texts[-1][2][4])
                if held > 50_000:
                    yield run_rows(texts, ["anchor", "run"])
                    texts, held = [], 0
            if texts:
                yield run_rows(texts, ["anchor", "run"])

    records = written(work.mapInArrow(find_runs, "anchor long, run long, " + RUNS), "runs")
    again = records.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select(dealt_anew("anchor"))
    repeated = written(records.join(again, "anchor", "left_semi"), "repeated-runs")
    discard(records)

    one = F.struct("key", "n", F.col("ranges")[0]["lo"].alias("lo"), F.col("ranges")[0]["hi"].alias("hi"))
    distinct = repeated.groupBy("anchor", "run").agg(F.sum("times").alias("c"), F.min(one).alias("one"))
    # of a range of neighbouring runs with equal words, only the first is meant
    distinct = written(distinct.withColumn("one", F.col("one").withField("hi", F.least("one.hi", F.col("one.lo") + (length - gram)))), "distinct-runs")
    whole = repeated.join(distinct.where("c > 1").select(dealt_anew("anchor"), "run"), ["anchor", "run"], "left_semi").select("key", "n", F.inline("ranges"))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select(dealt_anew("anchor"), "k")
    wanted = distinct.join(several, "anchor").select("anchor", "k", "one.*").groupBy("key", "n").agg(F.collect_set(F.struct("anchor", "k", "lo", "hi")).alias("_rlz_at"))
    one_of_each = work.dropDuplicates(["_rlz_key", "_rlz_n"])  # copies of a text go before the shuffle
    texts = one_of_each.join(wanted, [F.col("_rlz_key") == F.col("key"), F.col("_rlz_n") == F.col("n")]).select("_rlz_bytes", "key", "n", "_rlz_at")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the wanted runs."""
        for batch in batches:
            at, rows, held = batch.column(3), [], 0
            first = at.offsets.to_numpy()
            anchors, ks, los, his = (at.values.field(i).to_numpy() for i in range(4))
            for i, (raw, key, n) in enumerate(zip(_arrow(batch, "_rlz_bytes"), _arrow(batch, "key"), _arrow(batch, "n"), strict=True)):
                words = raw.split()
                for j in range(first[i], first[i + 1]):
                    rows.append((anchors[j], ks[j], key, n, los[j], b" ".join(words[los[j] : his[j] + length])))
                    held += len(rows[-1][-1])
                if held > 1 << 22:
                    yield block_rows(rows)
                    rows, held = [], 0
            if rows:
                yield block_rows(rows)

    def block_rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "k", "key", "n", "lo", "words"])

    blocks = written(texts.mapInArrow(cut_out, "anchor long, k long, key long, n int, lo int, words binary"), "reference-blocks")

    def told(table: pa.Table) -> pa.RecordBatch:
        key, n, lo = (table.column(c).to_numpy() for c in ("key", "n", "lo"))
        run, a, b = repeated_windows(table.column("words").to_pylist(), length)
        return pa.RecordBatch.from_arrays([pa.array(key[run]), pa.array(n[run]), pa.array((lo[run] + a).astype(np.int32)), pa.array((lo[run] + b).astype(np.int32))], ["key", "n", "lo", "hi"])

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; whole blocks are factored together up to about BLOCK_WORDS words."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows * (2 * length - gram)
            if size >= BLOCK_WORDS:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield told(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = (table.num_rows - cut) * (2 * length - gram)
        if held:
            yield told(pa.Table.from_batches(held))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of a very large block, under a hash of its words."""
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                anchor, key, n, lo = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("anchor", "key", "n", "lo"))
                hashed = [Rolling(word_hashes(x)).fixed(length) for x in _arrow(part, "words")]
                count = np.array([len(h) for h in hashed])
                row = np.repeat(np.arange(len(hashed)), count)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                columns = [np.concatenate(hashed).view(np.int64), anchor[row], key[row], n[row], (lo[row] + place).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["window", "anchor", "key", "n", "lo"])

    few = blocks.where(F.col("k") <= BLOCK_RUNS).select("anchor", "key", "n", "lo", "words")
    few = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(factor, "key long, n int, lo int, hi int")
    windows = blocks.where(F.col("k") > BLOCK_RUNS).mapInArrow(spread, "window long, anchor long, key long, n int, lo int")
    same = windows.groupBy("window", "anchor").agg(F.count("*").alias("c")).where("c > 1").select(dealt_anew("window"), "anchor")
    single = windows.join(same, ["window", "anchor"], "left_semi").select("key", "n", "lo", F.col("lo").alias("hi"))
    text_id = F.xxhash64("key", "n").alias("_rlz_of")
    held = repeated.where("ranges[0].lo = 0").groupBy(text_id).agg(F.count("*").alias("_rlz_held"))  # a text's first run comes once a copy
    found = whole.unionByName(few).unionByName(single).groupBy(text_id).agg(F.collect_set(F.struct("lo", "hi", "n")).alias("_rlz_at"))
    found = written(found.join(held, "_rlz_of", "left").select("_rlz_of", "_rlz_at", F.coalesce("_rlz_held", F.lit(1).cast("long")).alias("_rlz_held")), "repeated-passages")
    discard(repeated)
    discard(distinct)
    discard(blocks)

    results = ("n_words", "n_removed", "kept_sha256", "kept_text")
    kept = [c for c in docs.columns if c != text and c.lower() not in results]
    extra = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    schema = StructType([*docs.select(*kept).schema, *extra, *([StructField("kept_text", StringType())] if with_text else [])])
    width = len(kept)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, texts = [], [], []
            raws, ranges = batch.column(width), batch.column(width + 2)
            first = ranges.offsets.to_numpy()
            los, his, sizes = (ranges.values.field(i).to_numpy() for i in range(3))
            for i, n in enumerate(_arrow(batch, "_rlz_n")):
                words = raws[i].as_py().split()
                total = len(words)
                own = first[i] + np.flatnonzero(sizes[first[i] : first[i + 1]] == n)
                if len(own):
                    step = np.zeros(total + 1, np.int32)
                    np.add.at(step, los[own], 1)
                    np.subtract.at(step, his[own] + length, 1)
                    words = list(compress(words, (np.cumsum(step[:-1]) == 0).tolist()))
                left = b" ".join(words)
                counts.append((total, total - len(words)))
                shas.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode("utf-8", "replace"))
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array([x[i] for x in counts], pa.int64()) for i in range(2)] + [pa.array(shas, pa.string())]
            columns += [pa.array(texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    joined = attach(source, found, "_rlz_id", "_rlz_of", "_rlz_held", F.xxhash64(F.spark_partition_id())).select(*kept, "_rlz_bytes", "_rlz_n", "_rlz_at")
    return joined.mapInArrow(remove, schema)
