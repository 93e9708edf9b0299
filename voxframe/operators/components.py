"""Connected components of an edge table: solved within tasks, then by alternating star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.keys import dealt_anew
from voxframe.storage import discard, written

MAX_ROUNDS = 60


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v. A partial aggregate joined back, so a hub is never one group."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u"), F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    s = _with_least(both)
    return s.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _with_least(down)
    return s.select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def least_of_component(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the edges (u, v), ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = least[least]
            if (up == least).all():
                break
            least = up
    return nodes, nodes[least]


def _solved_by_task(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of each task's own edges: its component among those edges. A task holds what its
    partition holds, and neighbouring ids are dealt to one task, so that few components go across tasks."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            node, root = least_of_component(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for k in range(0, len(node), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 50_000]), pa.array(root[k : k + 50_000])], ["node", "root"])

    return edges.select("u", "v").repartitionByRange("u").mapInArrow(solve, "node long, root long")


def _star_rounds(now: DataFrame, max_rounds: int) -> DataFrame:
    """(u, component) of every node but the least of each component of the edges (u > v), which must be a written table."""
    state = None
    for _ in range(max_rounds):
        new = written(_small_star(_large_star(now)), "edges")
        after = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])  # one row
        discard(now)
        now = new
        if after == state:
            return now.groupBy("u").agg(F.min("v").alias("component"))
        state = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v; long); the component is its least node.

    Self-loops are allowed and keep a node without other edges. Each task first solves its own edges; nodes that came out with
    several roots link these, and only these links go through rounds of star contraction, about log(diameter) squared
    at most, each written to the shared folder. Without such links no round is needed.
    """
    solved = written(_solved_by_task(edges), "solved-edges")
    least = solved.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    split = least.where("least <> most").select(dealt_anew("node"), "least")
    links = solved.join(split, "node").where("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v")).distinct()
    links = written(links, "edges")
    if links.isEmpty():
        return least.select("node", F.col("least").alias("component"))
    across = _star_rounds(links, max_rounds)
    return least.join(across, F.col("least") == F.col("u"), "left").select("node", F.coalesce("component", "least").alias("component"))
