"""Hard negatives for contrastive training, by bit-sliced integer products.

A component x counts as the whole number floor(256 * x), and a score is the inner product of two rows. Anchors (rows
whose id ``anchor_every`` divides) are a query set against all rows: rows and anchors are dealt into a grid of cells of
about ``CELL`` rows by ``CELL`` anchors, and each cell is one task's work. Within it the bit-planes of the rows are
taken in most significant first: after the planes down to k, with a the anchor and p its product with floor(x / 2**k),

    2**k * p + (2**k - 1) * (sum of negative a)  <=  score  <=  2**k * p + (2**k - 1) * (sum of positive a)

and a candidate is dropped as soon as this interval lies outside all that its anchor still looks for, or below the last
place of a list that is full. The scores that are left at k = 0 are exact.

Two passes: the first ``positives`` rows of the anchor's own label; then, for each anchor and positive, the first
``negatives`` rows of other labels whose score lies from ``low`` to ``high`` hundredths of the positive's. A cell returns its
own first rows for each list, and a ranked window merges the cells.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part; rows that are
alike in id, label and vector count once; a shorter vector is filled up with zeros; an empty vector scores 0; components
are held to +-2**62 and scores to the range of a long (scores below 2**53 are exact, larger ones are compared as
doubles); an empty table, or one without anchors, gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.storage import written

CELL, LEAST_GROUPS, ROWS, ANCHORS, PAIRS = 4096, 16, 2048, 512, 1 << 15
SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(rows: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(uid, id, label, vec) of the rows that take part, alike rows once; vec are whole numbers."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = F.lit(2.0**62)
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, bound), -bound)))
    out = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    out = out.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), whole.alias("vec"))
    return out.dropDuplicates(["id", "label", "vec"]).select(F.xxhash64("id", "label", "vec").alias("uid"), "id", "label", "vec")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row a vector, filled up with zeros."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    flat, size = a.flatten().to_numpy(zero_copy_only=False), np.diff(a.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _first(group: np.ndarray, score: np.ndarray, key: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of each group, higher scores first, then smaller keys."""
    order = np.lexsort((key, -score, group))
    g = group[order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(head, np.diff(np.concatenate((head, [len(g)]))))
    return order[place < count]


def search(a: np.ndarray, x: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, count: int, barred) -> tuple[np.ndarray, ...]:
    """(anchor, list, row, score): for each anchor and list [low, high] the first ``count`` rows with a score in it.

    a: anchors by components; x: rows by components, with ids in ascending order; low, high: anchors by lists, floats;
    barred(anchors, rows): the pairs of these slices that do not count. Later rows win no ties, so that a list that is
    full only takes higher scores.
    """
    n, lists = low.shape
    held = [np.zeros(0, np.int64) for _ in range(4)]  # list, row, id, score
    most = int(np.abs(a).sum(axis=1, dtype=np.float64).max(initial=0)) * 2
    planes = int(np.maximum(x, -1 - x).max(initial=0)).bit_length()
    small = most * 2.0**planes
    kind = np.float32 if small < 2**24 else np.float64
    least = low.copy()  # what a candidate of each list needs
    pos, neg = np.maximum(a, 0).sum(axis=1, dtype=np.float64), np.minimum(a, 0).sum(axis=1, dtype=np.float64)
    af = a.astype(kind)
    step = 256
    at = 0
    while at < len(x):
        part = slice(at, min(len(x), at + step))
        at, step = part.stop, ROWS
        bits = [((x[part] >> k) & 1).astype(kind) for k in range(planes)]
        sign = (x[part] >> planes).astype(kind)
        new: list[tuple[np.ndarray, ...]] = []
        for first in range(0, n, ANCHORS):
            some = slice(first, min(n, first + ANCHORS))
            allowed = ~barred(some, part)

            def wanted(p: np.ndarray, k: int, i: np.ndarray | slice) -> np.ndarray:
                """Whether any list can still take a pair with product p after the planes down to k; i: the anchors of p's rows."""
                lo = np.ceil((least[i] - (2.0**k - 1) * pos[i][:, None]) / 2.0**k).astype(kind)
                hi = np.floor((high[i] - (2.0**k - 1) * neg[i][:, None]) / 2.0**k).astype(kind)
                out = np.zeros(p.shape, bool)
                for j in range(lists):
                    out |= (p >= lo[:, j].reshape(-1, *[1] * (p.ndim - 1))) & (p <= hi[:, j].reshape(-1, *[1] * (p.ndim - 1)))
                return out

            if small >= 2**53:  # beyond exact floats: whole numbers of any size
                i, r = np.nonzero(allowed)
                value = np.array([min(max(sum(int(u) * int(v) for u, v in zip(a[first + g], x[part.start + h], strict=True)), _LEAST), _MOST) for g, h in zip(i, r, strict=True)], object)
                i = i + first
            else:
                k, product = planes, af[some] @ sign.T
                alive = allowed
                while k:
                    k -= 1
                    product = 2 * product + af[some] @ bits[k].T
                    alive = allowed & wanted(product, k, some)
                    if np.count_nonzero(alive) * 16 < alive.size:
                        break
                i, r = np.nonzero(alive)
                value = product[i, r]
                i = i + first
                while k and len(i):  # few pairs are left: plane by plane for them alone
                    k -= 1
                    more = [np.einsum("ij,ij->i", af[i[b : b + PAIRS]], bits[k][r[b : b + PAIRS]]) for b in range(0, len(i), PAIRS)]
                    value = 2 * value + np.concatenate(more)
                    keep = wanted(value, k, i)
                    i, r, value = i[keep], r[keep], value[keep]
                value = value.astype(np.int64)
            for j in range(lists):
                fits = (value >= least[i, j]) & (value <= high[i, j])
                new.append((i[fits] * lists + j, r[fits] + part.start, ids[r[fits] + part.start], value[fits]))
        held = [np.concatenate((u, *v)) for u, v in zip(held, zip(*new, strict=True), strict=True)] if new else held
        kept = _first(held[0], held[3], held[2], count)
        held = [u[kept] for u in held]
        full = np.bincount(held[0], minlength=n * lists) >= count
        worst = np.full(n * lists, np.inf)
        np.minimum.at(worst, held[0], held[3].astype(np.float64))
        worst = np.where(full, worst + (1 if small < 2**53 else 0), -np.inf).reshape(n, lists)
        least = np.maximum(low, worst)
    return held[0] // lists, held[0] % lists, held[1], held[3]


def _tables(anchors: pa.Table, rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Table]:
    """Anchors, both matrices, and the rows in ascending order of their ids."""
    rows = rows.sort_by([("id", "ascending"), ("uid", "ascending")])
    width = max(int(np.diff(t.column("vec").combine_chunks().offsets.to_numpy()).max(initial=0)) if t.num_rows else 0 for t in (anchors.combine_chunks(), rows.combine_chunks()))
    return anchors, matrix(anchors.column("vec"), width), matrix(rows.column("vec"), width), rows


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def nearest_alike(anchors: pa.Table, rows: pa.Table, count: int = POSITIVES) -> pa.Table:
    """The first rows of each anchor's own label in a cell."""
    anchors, a, x, rows = _tables(anchors, rows)
    own, other = _numbers(anchors, "uid"), _numbers(rows, "uid")
    of, at, ids = _numbers(anchors, "label"), _numbers(rows, "label"), _numbers(rows, "id")
    out = []
    for label in np.intersect1d(of, at):
        i, r = np.flatnonzero(of == label), np.flatnonzero(at == label)
        open_ = np.full((len(i), 1), -np.inf), np.full((len(i), 1), np.inf)
        g, _, h, s = search(a[i], x[r], ids[r], *open_, count, lambda p, q: own[i][p][:, None] == other[r][q][None, :])  # noqa: B023
        out.append((own[i][g], ids[r][h], other[r][h], s))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "positive", "uid", "score"])


def nearest_others(anchors: pa.Table, rows: pa.Table, count: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> pa.Table:
    """The first rows of other labels within each positive's band in a cell; a list is (positive's uid, its score)."""
    anchors, a, x, rows = _tables(anchors, rows)
    own, of = _numbers(anchors, "uid"), _numbers(anchors, "label")
    ids, at = _numbers(rows, "id"), _numbers(rows, "label")
    lists = anchors.column("lists").to_pylist()
    width = max((len(p) for p in lists), default=0)
    lo, hi = np.full((len(lists), width), np.inf), np.full((len(lists), width), -np.inf)
    for i, p in enumerate(lists):
        for j, v in enumerate(p):  # low * score <= 100 * negative <= high * score, in whole numbers
            lo[i, j], hi[i, j] = -(-low * v["score"] // 100), high * v["score"] // 100
    i, j, r, s = search(a, x, ids, lo, hi, count, lambda p, q: of[p][:, None] == at[q][None, :])
    to = [lists[g][h] for g, h in zip(i, j, strict=True)]
    columns = [own[i], [v["uid"] for v in to], ids[r], _numbers(rows, "uid")[r], s.astype(np.int64)]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "list", "negative", "uid", "score"])


def hard_negatives(
    rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE, anchor_every: int = ANCHOR_EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    table = written(quantised(rows, key, label, vector, scale), "quantised")
    is_anchor = F.col("id") % anchor_every == 0
    size = table.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).first()  # one row
    groups, slots = max(LEAST_GROUPS, -(-size["n"] // CELL)), max(1, -(-size["a"] // CELL))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    cells = ["slot", "group"]

    def against_all(anchors: DataFrame, work, schema: str) -> DataFrame:
        own = lambda df: [F.col(c).alias(c) for c in df.columns]  # noqa: E731  both sides come from one table
        left = anchors.select(*own(anchors), dealt(slots).alias("slot"), every(groups).alias("group"))
        right = table.select(*own(table), dealt(groups).alias("group"), every(slots).alias("slot"))
        return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(work, schema)

    def ranked(found: DataFrame, by: list[str], key: str, count: int) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), key, "uid")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)

    anchors = table.where(is_anchor)
    alike = lambda left, right: nearest_alike(left, right, positives)
    best = ranked(against_all(anchors.select("uid", "label", "vec"), alike, "anchor long, positive long, uid long, score long"), ["anchor"], "positive", positives)
    best = written(best.select("anchor", "positive", "uid", "score"), "positives")
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("uid", "score"))).alias("lists"))
    with_lists = anchors.join(lists, F.col("uid") == F.col("anchor")).select("uid", "label", "vec", "lists")
    others = lambda left, right: nearest_others(left, right, negatives, low, high)
    found = ranked(against_all(with_lists, others, "anchor long, list long, negative long, uid long, score long"), ["anchor", "list"], "negative", negatives)
    out = found.select("anchor", "list", "negative", F.col("score").alias("negative_score"), "rank").join(best.select("anchor", F.col("uid").alias("list"), "positive", "score"), ["anchor", "list"])
    out = out.join(anchors.select(F.col("uid").alias("anchor"), "id"), "anchor")
    return out.select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score"
    )
