"""Benchmark decontamination by latent semantic retrieval.

1. Documents are encoded once as ids of the benchmark's words (other words can neither match an item nor lie in the
   space that its items span); word statistics and the factorisation cover all passages of all documents.
2. A randomised singular value decomposition of the passage x word TF-IDF matrix A: every partition adds up
   A^T (A Omega) for its own passages; the left singular vectors of the sum span the latent space.
3. Windows of each document, of the items' size and at a quarter of it apart, are compared with the items' windows by
   cosine in that space. A window above ``min_cosine`` is a candidate. Words in more than ``max_share`` of the passages
   are left out of the space, be they stop words or the words of a frequent leak. Items of which a copy could then lack
   content words are not searched for in the space: every window whose surroundings share enough of such an item's
   words is a candidate, whatever the words' frequencies.
4. A candidate counts if the longest common subsequence of the item and the words around the window covers
   ``min_lcs`` of the item, or ``min_lcs_answer`` of it while the item's answer (its last sentence) is there in order.
   Items below ``min_exact_words`` words must be there word for word; items below ``min_words`` match nothing.

Benchmark items are taken to the workers in blocks of ``block_items``, a stated query set; documents are never joined.

Defined cases: null texts count as empty and match nothing; repeated rows are each reported; an empty table on either
side gives an empty result; repeated items are each reported; only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.arrays import array_sum
from voxframe.storage import discard, prepare, written

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class LeakParams:
    rank: int = 48
    oversample: int = 8
    passage_words: int = 64
    #: Words in a larger share of the passages are stop words, which the space leaves out (they count in the LCS).
    max_share: float = 0.01
    #: Content words that a window must have to be compared.
    min_content: int = 3
    min_cosine: float = 0.6
    min_lcs: float = 0.75
    min_lcs_answer: float = 0.6
    min_answer: float = 0.8
    min_words: int = 5
    min_exact_words: int = 10
    block_items: int = 5000
    #: Documents are worked off in stretches of this many words, which overlap by the largest region of an item.
    stretch_words: int = 20_000
    #: Items outside the space are looked for in pieces of this many words first (a multiple of 16).
    piece_words: int = 256


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """Words of the item's last sentence that has any."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    return parts[-1] if len(parts) > 1 else []


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, given as the bit positions of each word, and words."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(masks.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


def window_size(n: int) -> int:
    """Window for an item of n words: the largest power of two within it, from 8 to 64."""
    return min(64, max(8, 1 << (n.bit_length() - 1)))


def encoded(docs: DataFrame, vocabulary: dict[str, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, ids): a document's words as little-endian 32-bit ids, -1 for words that no item has."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            ids = [np.array(list(map(get, words_of(t), repeat(-1))), np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    return written(source.mapInArrow(encode, "doc_id long, key long, ids binary"), "encoded")


def _passages(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(word, passage) of each known word of a batch, and the number of passages."""
    words, at, n = [], [], 0
    for raw in batch.column(0).to_pylist():
        ids = np.frombuffer(raw, np.int32)
        known = np.flatnonzero(ids >= 0)
        words.append(ids[known])
        at.append(known // size + n)
        n += -(-len(ids) // size)
    return (np.concatenate(words), np.concatenate(at), n) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64), 0)


def latent_space(table: DataFrame, words: int, p: LeakParams = LeakParams()) -> np.ndarray:
    """words x rank matrix: each row is the word's IDF times its place in the latent space."""
    ids = table.select("ids")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(words + 1)
        for batch in batches:
            w, at, n = _passages(batch, p.passage_words)
            pairs = np.unique(at * words + w)
            out[:words] += np.bincount(pairs % words, minlength=words)
            out[words] += n
        return out

    df = array_sum(ids, frequencies, words + 1)
    idf = np.log((1 + df[words]) / (1 + df[:words])).astype(np.float32) + np.float32(0.01)
    idf[df[:words] > max(p.max_share * df[words], 1)] = 0  # stop words
    k = min(p.rank + p.oversample, words)
    omega = np.random.Generator(np.random.PCG64(20240229)).standard_normal((words, k)).astype(np.float32)

    def gather(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((words, k))
        weighted = omega * idf[:, None]
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                w, at, _ = _passages(batch.slice(a, 100), p.passage_words)
                w, at = w[idf[w] > 0], at[idf[w] > 0]
                if not len(w):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                dense = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
                pairs, tf = np.unique(dense * words + w, return_counts=True)
                norm = np.sqrt(np.bincount(pairs // words, (tf * idf[pairs % words]) ** 2, len(starts))).astype(np.float32)
                y = np.add.reduceat(weighted[w], starts, axis=0) / (norm * norm)[:, None]
                order = np.argsort(w, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(w[order]) != 0)))
                out[w[order][first]] += np.add.reduceat(y[dense[order]], first, axis=0)
        return out * idf[:, None]

    sums = array_sum(ids, gather, words * k).reshape(words, k)
    u, _, _ = np.linalg.svd(sums, full_matrices=False)
    return (u[:, : p.rank] * idf[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]], vocabulary: dict[str, int], space: np.ndarray, p: LeakParams):
        self.p, self.rows = p, []
        queries: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.content = np.append(np.abs(space).sum(axis=1) > 0, False)  # the last entry is that of id -1
        self.plain: list[tuple[int, bytes]] = []
        self.shared: list[int] = []
        least = min(p.min_lcs, p.min_lcs_answer)
        for item_id, text in rows:
            ids = [vocabulary[w] for w in words_of(text)]
            n = len(ids)
            if n < p.min_words:
                continue
            answer = [vocabulary[w] for w in answer_of(text)]
            self.rows.append((item_id, ids, masks_of(ids), masks_of(answer), len(answer)))
            size = window_size(n)
            own = 0
            if n >= p.min_exact_words and self.content[ids].sum() < (1 - least) * n + p.min_content:
                self.shared.append(len(self.rows) - 1)
                continue
            for a in {*range(0, max(1, n - size + 1), size // 2), max(0, n - size)}:
                part = np.array(ids[a : a + size])
                if self.content[part].sum() >= p.min_content + 1:
                    queries.setdefault(size, []).append((len(self.rows) - 1, space[part].sum(axis=0)))
                    own += 1
            if not own:
                self.plain.append((len(self.rows) - 1, np.array(ids, np.int32).tobytes()))
        self.queries = {s: (np.array([i for i, _ in q]), _unit(np.array([v for _, v in q])).T.copy()) for s, q in queries.items()}
        self.longest = max((len(r[1]) for r in self.rows), default=0)
        # (word, item, positions) of the shared items by word: word w has entries first[w] to first[w + 1]
        entries = sorted((w, k, m.bit_count()) for k, i in enumerate(self.shared) for w, m in self.rows[i][2].items())
        self.first = np.searchsorted([w for w, _, _ in entries], np.arange(len(self.content)))
        self.of = np.array([k for _, k, _ in entries], np.int64)
        self.times = np.array([c for _, _, c in entries], np.float64)
        self.needed = np.array([least * len(self.rows[i][1]) - 1e-9 for i in self.shared])

    def check(self, item: int, region: list[int]) -> tuple[float, bool] | None:
        _, ids, masks, answer, n_answer = self.rows[item]
        n, p = len(ids), self.p
        if n < p.min_exact_words:
            hit = any(region[i : i + n] == ids for i in range(len(region) - n + 1) if region[i] == ids[0])
            return (1.0, True) if hit else None
        share = lcs(masks, n, region) / n
        if share < min(p.min_lcs, p.min_lcs_answer):
            return None
        there = n_answer > 0 and lcs(answer, n_answer, region) >= p.min_answer * n_answer
        return (share, there) if share >= p.min_lcs or there else None

    def search(self, ids: np.ndarray, space: np.ndarray) -> dict[int, tuple[float, bool]]:
        """Best (share, answer found) of each item found in a document's ids."""
        found: dict[int, tuple[float, bool]] = {}
        overlap = 3 * self.longest + 64
        for a in range(0, max(1, len(ids)), self.p.stretch_words):
            self._stretch(ids[a : a + self.p.stretch_words + overlap], space, found)
        return found

    def _stretch(self, ids: np.ndarray, space: np.ndarray, found: dict[int, tuple[float, bool]]) -> None:
        n = len(ids)
        at = np.flatnonzero(self.content[ids])
        if len(at) >= self.p.min_content and self.queries:
            sums = np.zeros((len(at) + 1, space.shape[1]), np.float32)
            np.cumsum(space[ids[at]], axis=0, out=sums[1:])
        else:
            at = at[:0]
        for size, (items, vectors) in self.queries.items() if len(at) else ():
            start = np.arange(0, max(1, n - size + 1), size // 4)
            if start[-1] < n - size:
                start = np.append(start, n - size)
            first, last = np.searchsorted(at, start), np.searchsorted(at, start + size)
            full = last - first >= self.p.min_content
            start, first, last = start[full], first[full], last[full]
            if not len(start):
                continue
            window, query = np.nonzero(_unit(sums[last] - sums[first]) @ vectors >= self.p.min_cosine)
            done: dict[int, int] = {}
            for i, q in zip(window.tolist(), query.tolist(), strict=True):
                item = int(items[q])
                length = len(self.rows[item][1])
                lo, hi = max(0, int(start[i]) - length), min(n, int(start[i]) + size + length)
                if done.get(item, -1) >= int(start[i]):
                    continue
                done[item] = int(start[i]) + length // 4
                best = self.check(item, ids[lo:hi].tolist())
                if best and (item not in found or best > found[item]):
                    found[item] = best
        if self.shared:
            for a in range(0, n, self.p.piece_words):
                self._piece(ids, a, found)
        if self.plain:
            raw = ids.tobytes()
            for item, word_for_word in self.plain:
                i = raw.find(word_for_word)
                while i >= 0 and i % 4:
                    i = raw.find(word_for_word, i + 1)
                if i >= 0:
                    found[item] = (1.0, True)


    def _piece(self, ids: np.ndarray, a: int, found: dict[int, tuple[float, bool]]) -> None:
        """Shared items at the windows that start in one piece: the words that an item has in common with the piece, then
        their longest common subsequence, bound that of any window, so nothing is lost by looking at them first."""
        b = min(len(ids), a + self.p.piece_words)
        before = max(0, a - self.longest)
        piece = ids[before : b + 64 + self.longest]
        there = np.zeros(len(self.content), bool)
        there[piece] = True
        words = np.flatnonzero(there[:-1])
        first, count = self.first[words], self.first[words + 1] - self.first[words]
        total = int(count.sum())
        if not total:
            return
        entry = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
        common = np.bincount(self.of[entry], self.times[entry], len(self.shared))
        near = np.flatnonzero(common >= self.needed)
        if not len(near):
            return
        told = piece.tolist()
        for k in near.tolist():
            item = self.shared[k]
            _, own, masks, _, _ = self.rows[item]
            n, needed = len(own), self.needed[k]
            if lcs(masks, n, told) < needed:
                continue
            size = window_size(n)
            hits = np.concatenate(([0], np.cumsum([w in masks for w in told])))
            for start in range(a, b, size // 4):
                lo, hi = max(0, start - n) - before, min(start + size + n - before, len(told))
                if hits[hi] - hits[lo] < needed:
                    continue
                best = self.check(item, told[lo:hi])
                if best and (item not in found or best > found[item]):
                    found[item] = best


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, key, item_id, lcs_share, answer_found) of each document and item that is in it; key is the hash of the
    document's text."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, key long, item_id long, lcs_share double, answer_found boolean"
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    out, block = [], []

    def work_off(rows: list[tuple[int, str]]) -> None:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in rows for w in words_of(t)}))}
        if not vocabulary:
            return
        table = encoded(docs, vocabulary, doc_id, text)
        space = latent_space(table, len(vocabulary), p)
        shared = spark.sparkContext.broadcast((Items(rows, vocabulary, space, p), space))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some, places = shared.value
            for batch in batches:
                hits = []
                for d, key, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    for item, (share, there) in some.search(np.frombuffer(raw, np.int32), places).items():
                        hits.append((d, key, some.rows[item][0], share, there))
                if hits:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*hits, strict=True), kinds, strict=True)], ["doc_id", "key", "item_id", "lcs_share", "answer_found"])

        out.append(written(table.mapInArrow(search, schema), "leaks"))
        discard(table)

    for r in items.toLocalIterator():  # block by block: the driver holds one block of items at a time
        block.append((r["i"], r["t"]))
        if len(block) == p.block_items:
            work_off(block)
            block = []
    if block:
        work_off(block)
    result = spark.createDataFrame([], schema)
    for part in out:
        result = result.unionByName(part)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item."""
    keys = find_leaks(docs, benchmark, p, doc_id, text).select(F.col("key").alias("_leak_key")).distinct()
    return docs.join(keys, F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_leak_key"), "left_anti")
