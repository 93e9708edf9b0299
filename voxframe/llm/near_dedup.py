"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

* Shingles are five words (lower case, runs of letters and digits); a shorter text is one shingle. A shingle's weight
  is (1 + ln tf) * ln(1 + N / max(df, ``df_floor`` * N)). Document frequencies cover all documents; they are kept in a
  count-min sketch of fixed size, which is what every worker gets (two rows of ``sketch_width`` counters, whatever
  the corpus). Its error, about shingles per document / width of N, is far below the floor.
* Improved consistent weighted sampling (ICWS) takes ``bands`` * ``rows`` samples of each text. Texts with a total weight
  below ``split_weight`` draw each sample from all their shingles; longer texts deal their shingles to as many bins
  by hash and draw one sample from each bin (an empty bin takes its right neighbour's). Texts near the border are
  sampled both ways, so that no pair within the similarity is missed for it.
* Texts that agree in a band meet in a bucket. In each bucket the text with the most company in its buckets, its
  leader, is compared with the others, and links are contracted to components. Texts of one leader in different components
  can still be alike; which of them is told exactly by their differences from the leader (``common_needed``): two
  texts that are not both linked to the leader can only reach the similarity if they share differences of a certain
  weight, so each brings its rarest differences up to that weight and only texts that share one of these are compared.
  No pair of one leader's texts within the similarity is passed over, and texts that merely stem from one source are not
  compared with each other.
* Every link is verified by the weighted Jaccard similarity of the whole texts. Exact copies are one text throughout.

Defined cases: null text counts as empty; texts without a word are classes of their own; repeated rows fall in one
class; class_id is the least doc_id in the class (null if all are null); an empty table gives an empty result; other
columns pass through (inner columns are prefixed ``_nd_``), but for columns that have the name of a result column (class_id,
n_class, class_key), which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.arrays import array_sum
from voxframe.operators.components import connected_components
from voxframe.operators.keys import attach, dealt_anew
from voxframe.storage import discard, prepare, written

_U = np.uint64
_LETTERS: list[np.ndarray] = []
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_CHARACTERS_AT_ONCE = 1 << 15
_POINT = 0x9FB21C651E98DF25
_BASE = [pow(0x9E3779B97F4A7C15, k, 2**64) | 1 for k in range(1, 65)]


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 6
    df_floor: float = 0.1
    sketch_width: int = 1 << 16
    split_weight: float = 128.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def letters() -> np.ndarray:
    """For each code point, whether it is a letter or digit; made once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, at least; those of a common block are kept in the worker."""
    if n > _CHARACTERS_AT_ONCE or not _POWERS:
        made = tuple(np.cumprod(np.concatenate(([_U(1)], np.full(max(n, _CHARACTERS_AT_ONCE), x, np.uint64)))) for x in (_POINT, pow(_POINT, -1, 2**64)))
        if n > _CHARACTERS_AT_ONCE:
            return made
        _POWERS.append(made)
    return _POWERS[0]


def _hashes_of(lower: str) -> np.ndarray:
    codes = np.frombuffer(lower.encode("ascii"), np.uint8) if lower.isascii() else np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = letters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    power, inverse = _powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start])


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in order: polynomials over the code points of lower-case runs of letters and digits.

    Long texts are worked off in blocks that end between words, so that only the hashes grow with the text.
    """
    lower, at, out = (text or "").lower(), 0, [np.zeros(0, np.uint64)]
    while at < len(lower):
        end = at + _CHARACTERS_AT_ONCE
        while end < len(lower) and lower[end].isalnum():
            end += 1
        out.append(_hashes_of(lower[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : k + len(out)] * _U(_BASE[k])
    return np.unique(_mix(out), return_counts=True)


def _cells(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % _U(width)).astype(np.int64), ((h >> _U(32)) % _U(width)).astype(np.int64)


def weights(h: np.ndarray, tf: np.ndarray, sketch: np.ndarray, docs: int, p: NearParams) -> np.ndarray:
    a, b = _cells(h, p.sketch_width)
    df = np.maximum(np.minimum(sketch[0, a], sketch[1, b]), max(1.0, p.df_floor * docs))
    return (1 + np.log(tf)) * np.log(1 + docs / df)


def frequency_sketch(docs: DataFrame, p: NearParams = NearParams(), text: str = "text") -> tuple[np.ndarray, int]:
    """Count-min sketch of document frequencies over all documents, and their number."""
    width = p.sketch_width

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums, n = np.zeros((2, width), np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                h, _ = shingles(t, p.words)
                for row, cell in enumerate(_cells(h, width)):
                    np.add.at(sums[row], cell, 1)
                n += 1
        return np.concatenate((sums.ravel(), [n]))

    flat = array_sum(docs.select(text), count, 2 * width + 1)
    return flat[: 2 * width].reshape(2, width), int(flat[-1])


def _draw(h: np.ndarray, logw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ICWS for keys h (one per shingle and sample): the value to minimise and the step of the weight."""
    x, y = _mix(h), _mix(h ^ _U(0xA5A5A5A5F0F0F0F1))
    unit = 1.0 / (1 << 21)
    m = _U((1 << 21) - 1)
    u = [((v >> _U(s)) & m).astype(np.float32) * np.float32(unit) + np.float32(unit / 2) for v, s in ((x, 0), (x, 21), (x, 42), (y, 0), (y, 21))]
    r, logc, beta = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
    t = np.floor(logw / r + beta)
    return logc - r * (t - beta + 1), t


def _identity(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    return _mix(h + t.astype(np.int64).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def samples(h: np.ndarray, w: np.ndarray, k: int, binned: bool) -> np.ndarray:
    logw = np.log(w).astype(np.float32)
    if not binned:
        keys = h[:, None] ^ _mix(np.arange(1, k + 1, dtype=np.uint64))[None, :]
        value, step = _draw(keys, logw[:, None])
        least = np.argmin(value, axis=0), np.arange(k)
        return _identity(keys[least], step[least])
    value, step = _draw(h, logw)
    at = (_mix(h ^ _U(0x51ED270B0A1F39C1)) % _U(k)).astype(np.int64)
    order = np.lexsort((value, at))
    bins, first = np.unique(at[order], return_index=True)
    own = _identity(h[order[first]], step[order[first]])
    take = np.searchsorted(bins, np.arange(k)) % len(bins)
    return own[take]


def signatures(h: np.ndarray, w: np.ndarray, p: NearParams) -> list[np.ndarray]:
    """Band keys for each way in which the text is sampled."""
    total, rare, out = w.sum(), math.log(1 + 1 / p.df_floor), []
    for binned in (False, True):
        if total < p.split_weight * rare if not binned else total >= p.similarity * p.split_weight * rare:
            s = samples(h, w, p.bands * p.rows, binned).reshape(p.bands, p.rows)
            key = np.arange(p.bands, dtype=np.uint64) * _U(2) + _U(binned)
            for j in range(p.rows):
                key = _mix(key * _U(0x9E3779B97F4A7C15) + s[:, j])
            out.append(key.view(np.int64))
    return out


Weighed = tuple[np.ndarray, np.ndarray]


def similarity(a: Weighed, b: Weighed) -> tuple[float, float]:
    """Weighted Jaccard of two (ascending hashes, weights), and the weight that they share."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)), float(low)


def differences(a: Weighed, b: Weighed) -> Weighed:
    """What b has less and more than a, as (signed shingle keys, weights): the last bit of a key tells more from less."""
    keys = np.union1d(a[0], b[0])
    change = np.zeros(len(keys))
    change[np.searchsorted(keys, b[0])] += b[1]
    change[np.searchsorted(keys, a[0])] -= a[1]
    some = np.abs(change) > 1e-12
    return (keys[some] & ~_U(1)) | (change[some] > 0).astype(np.uint64), np.abs(change[some])


def common_needed(gap_x: Column, gap_y: Column, leader: Column, p: NearParams) -> Column:
    """Weight of common differences from their leader without which x and y cannot reach the similarity t.

    With weights X, Y and L of both texts and their leader, x shares L - less(x) with it. Then x and y share
    L - less(x) - less(y) + (weight of their common differences), which is t (X + Y) / (1 + t) at least if they are
    alike. With gap(x) = t (X + L) / (1 + t) - (L - less(x)), which is above 0 unless x is linked to the leader, the
    common differences weigh at least gap(x) + gap(y) + L (1 - t) / (1 + t), and that is above 0 if either gap is.
    """
    return (gap_x + gap_y + leader * ((1 - p.similarity) / (1 + p.similarity))) * (1 - 1e-9) - 1e-9


def _links(docs: DataFrame, keys: DataFrame, p: NearParams, text: str) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) of the distinct texts that share a bucket, and the verified links (u, v) among them."""
    spark = docs.sparkSession
    sketch, total = frequency_sketch(docs, p, text)
    shared = spark.sparkContext.broadcast((sketch, total))  # fixed size

    def weighed(t: str) -> Weighed:
        sk, n = shared.value
        h, tf = shingles(t, p.words)
        return h, weights(h, tf, sk, n, p)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, w = weighed(t)
                if len(h):
                    rows += [(key, x) for x in signatures(h, w, p)]
            columns = zip(*rows, strict=True) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.list_(pa.int64())), strict=True)], ["key", "bands"])

    signed = written(docs.select("_nd_key", text).mapInArrow(sign, "key long, bands array<long>"), "signatures")
    buckets = signed.select("key", F.explode("bands").alias("band")).distinct()
    shared_bands = buckets.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    met = written(buckets.join(shared_bands, "band").select("band", "key", "c"), "buckets")
    discard(signed)
    company = met.groupBy("key").agg(F.sum("c").alias("company"))
    best = F.max(F.struct("company", "key"))
    leaders = met.select("band", "key").join(company, "key").groupBy("band").agg(best.alias("m")).select(dealt_anew("band"), F.col("m.key").alias("leader"))
    stars = written(met.select("band", "key").join(leaders, "band").where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct(), "star-pairs")

    ids = met.select("key").distinct()
    first = keys.join(ids, F.col("_nd_key") == F.col("key")).select(F.col("_nd_key").alias("_nd_of"), F.col("_nd_first").alias("_nd_from"))
    texts = docs.select("_nd_key", "_nd_id", F.col(text).alias("t")).join(first, (F.col("_nd_key") == F.col("_nd_of")) & F.col("_nd_id").eqNullSafe(F.col("_nd_from")))
    texts = written(texts.select(F.col("_nd_key").alias("key"), "t").dropDuplicates(["key"]), "bucket-texts")
    ids = texts.select("key")

    def compare(with_differences: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, left = None, (np.zeros(0, np.uint64), np.zeros(0))
            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                values, what, much = [], [], []
                for i in range(len(a)):
                    if a[i] != last:
                        last, left = a[i], weighed(batch.column(2)[i].as_py())
                    right = weighed(batch.column(3)[i].as_py())
                    s, low = similarity(left, right)
                    values.append((s, low, float(left[1].sum()), float(right[1].sum())))
                    if with_differences:
                        e, d = differences(left, right)
                        what.append(e.view(np.int64))
                        much.append(d)
                columns = [batch.column(0), batch.column(1), *[pa.array([x[j] for x in values], pa.float64()) for j in range(4)]]
                names = ["u", "v", "s", "low", "wu", "wv"]
                if with_differences:
                    columns += [pa.array(what, pa.list_(pa.int64())), pa.array(much, pa.list_(pa.float64()))]
                    names += ["e", "d"]
                yield pa.RecordBatch.from_arrays(columns, names)

        return run

    def verified(pairs: DataFrame, name: str, with_differences: bool = False) -> DataFrame:
        one, two = texts.select(F.col("key").alias("_a"), F.col("t").alias("x")), texts.select(F.col("key").alias("_b"), F.col("t").alias("y"))
        joined = pairs.join(two, pairs["b"] == two["_b"]).select("a", "b", "y")
        joined = joined.join(one, joined["a"] == one["_a"]).select("a", "b", "x", "y")
        schema = "u long, v long, s double, low double, wu double, wv double" + (", e array<long>, d array<double>" if with_differences else "")
        return written(joined.mapInArrow(compare(with_differences), schema), name)

    compared = verified(stars, "stars", True)
    links = compared.where(F.col("s") >= p.similarity).select("u", "v")
    loops = ids.select(F.col("key").alias("u"), F.col("key").alias("v"))
    parts = written(connected_components(links.union(loops)), "components")

    share = p.similarity / (1 + p.similarity)
    of_leader = parts.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    of_text = parts.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    open_leaders = compared.select("u", "v").join(of_text, "v").join(of_leader, "u").where("cu <> cv").select("u").distinct()
    members = compared.join(open_leaders.select(dealt_anew("u")), "u", "left_semi").join(of_text, "v").join(of_leader.select(dealt_anew("u"), "cu"), "u")
    members = written(members.select("u", "v", "cv", (F.col("cv") != F.col("cu")).alias("apart"), "wu", ((F.col("wu") + F.col("wv")) * share - F.col("low")).alias("gap"), "e", "d"), "members")
    least = members.groupBy("u").agg(F.min("gap").alias("least"), F.min(F.when(F.col("apart"), F.col("gap"))).alias("least_apart")).select(dealt_anew("u"), "least", "least_apart")
    needs = common_needed(F.col("gap"), F.when(F.col("apart"), F.col("least")).otherwise(F.col("least_apart")), F.col("wu"), p)
    each = members.join(least, "u").select("u", "v", "cv", "apart", "wu", "gap", needs.alias("needs"), F.explode(F.arrays_zip("e", "d")).alias("x"))
    each = each.select("u", "v", "cv", "apart", "wu", "gap", "needs", "x.e", "x.d")
    often = members.select("u", F.explode("e").alias("e")).groupBy("u", "e").agg(F.count("*").alias("c")).where("c > 1").select(dealt_anew("u"), "e", "c")
    known = each.join(often, ["u", "e"])
    rarest = Window.partitionBy("u", "v").orderBy(F.desc("c"), F.desc("e")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    brought = known.withColumn("rest", F.sum("d").over(rarest)).where("rest >= needs").select("u", "e", "v", "cv", "apart", "wu", "gap", "rest")
    brought = written(brought, "brought")
    one = brought.where("apart").select("u", "e", "wu", F.col("v").alias("a"), F.col("cv").alias("ca"), F.col("gap").alias("ga"), F.col("rest").alias("ra"))
    two = brought.select("u", "e", F.col("v").alias("b"), F.col("cv").alias("cb"), F.col("gap").alias("gb"), F.col("rest").alias("rb"))
    alike = (F.col("ca") != F.col("cb")) & (F.least("ra", "rb") >= common_needed(F.col("ga"), F.col("gb"), F.col("wu"), p))
    rest = one.join(two, ["u", "e"]).where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(rest.join(stars, ["a", "b"], "left_anti"), "rest-pairs")
    more = written(verified(rest, "rest").where(F.col("s") >= p.similarity).select("u", "v"), "rest-links")
    if not more.isEmpty():
        links = links.union(more)
        parts = written(connected_components(links.union(loops)), "components")
    return parts, links


def _classified(docs: DataFrame, p: NearParams, doc_id: str, text: str) -> DataFrame:
    """docs plus _nd_class_id, _nd_n_class and _nd_class_key."""
    prepare(docs.sparkSession)
    source = docs.withColumn("_nd_key", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("_nd_id", F.col(doc_id).cast("long"))
    keys = written(source.groupBy("_nd_key").agg(F.min("_nd_id").alias("_nd_first"), F.count("*").alias("_nd_held")), "text-keys")
    parts, _ = _links(source, keys, p, text)
    placed = keys.join(parts, F.col("_nd_key") == F.col("node"), "left").select("_nd_key", "_nd_first", "_nd_held", F.coalesce("component", "_nd_key").alias("_nd_of"))
    placed = written(placed, "placed-texts")
    size = F.sum("_nd_held").alias("_nd_n")
    classes = written(placed.groupBy(F.col("_nd_of").alias("_nd_at")).agg(F.min("_nd_first").alias("_nd_least"), size, F.count("*").alias("_nd_texts")), "classes")
    known = attach(placed.select(F.col("_nd_key").alias("_nd_text"), "_nd_held", "_nd_of"), classes, "_nd_of", "_nd_at", "_nd_texts", F.xxhash64("_nd_text"))
    known = written(known.select("_nd_text", "_nd_held", "_nd_of", "_nd_least", "_nd_n"), "known-texts")
    out = attach(source, known, "_nd_key", "_nd_text", "_nd_held", F.xxhash64("_nd_id"))
    wordless = ~F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(r"[\p{L}\p{N}]")
    return out.select(
        *docs.columns,
        F.when(wordless, F.col("_nd_id")).otherwise(F.col("_nd_least")).alias("_nd_class_id"),
        F.when(wordless, F.lit(1).cast("long")).otherwise(F.col("_nd_n")).alias("_nd_n_class"),
        F.when(wordless, F.xxhash64(F.lit("wordless"), "_nd_key", "_nd_id")).otherwise(F.col("_nd_of")).alias("_nd_class_key"),
    )


def near_duplicates(docs: DataFrame, p: NearParams = NearParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs plus class_id, n_class (the number of rows in the class) and class_key (a hash that is the class's own)."""
    found = _classified(docs, p, doc_id, text)
    names = ("class_id", "n_class", "class_key")
    return found.select(*[c for c in docs.columns if c.lower() not in names], *[F.col(f"_nd_{c}").alias(c) for c in names])


def keep_one(docs: DataFrame, p: NearParams = NearParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, of those with its least doc_id."""
    found = _classified(docs, p, doc_id, text)
    return found.where(F.col(doc_id).cast("long").eqNullSafe(F.col("_nd_class_id"))).dropDuplicates(["_nd_class_key"]).select(*docs.columns)
