"""Exact greedy non-maximum suppression, solved within tiles of space."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.grid import POST
from voxframe.operators.keys import shuffled
from voxframe.storage import discard, written

#: Undecided rows that a tile has on average at first, and at most; tiles of undecided rows grow fourfold from round to round.
TILE_ROWS, MOST_ROWS, GROWTH = 20_000, 400_000, 4
OPEN, KEPT, GONE = 0, 1, 2
#: Cells and margins are so much wider than the radius, for rounding.
_WIDER = 1 + 1e-9


class Tile:
    """Rows of one tile in the order of the greedy pass, with what is known of each."""

    def __init__(self, radius: float, inclusive: bool):
        self.radius, self.inclusive = radius, inclusive
        self.cells: dict[tuple[int, ...], list[tuple[tuple[float, ...], int]]] = {}

    def state_of(self, at: tuple[float, ...], state: int, owned: bool) -> int:
        """GONE if a better row is surely kept and near; OPEN if one may be, or if the tile does not see all that is near; else
        KEPT. Rows that are gone are forgotten, so that what a tile holds is bounded by rows that are apart and open ones."""
        cell = tuple(math.floor(c / (self.radius * _WIDER)) for c in at)
        near_open = not owned
        if state == OPEN:
            for shift in product((-1, 0, 1), repeat=len(at)):
                for there, known in self.cells.get(tuple(a + b for a, b in zip(cell, shift, strict=True)), ()):
                    total = 0.0
                    for a, b in zip(there, at, strict=True):
                        total += (a - b) * (a - b)
                    if math.sqrt(total) < self.radius or self.inclusive and math.sqrt(total) <= self.radius:
                        if known == KEPT:
                            return GONE
                        near_open = True
            state = OPEN if near_open else KEPT
        self.cells.setdefault(cell, []).append((at, state))
        return state


def _round(rows: DataFrame, edge: float, corner: list[float], radius: float, inclusive: bool, columns: tuple[str, ...]) -> DataFrame:
    """(id, *columns, score, state) of the rows (state OPEN or KEPT) after each tile's greedy pass. A tile also sees the rows
    within the radius of its sides, whose own state is settled by their own tile."""
    tiles = [f"_t{i}" for i in range(len(columns))]
    owner = F.lit(True)
    seen = rows
    for t, c, first in zip(tiles, columns, corner, strict=True):
        place = lambda v, first=first: F.floor((v - first) / edge).cast("long")
        wide = radius * _WIDER + F.abs(F.col(c)) * 1e-12
        seen = seen.withColumn(t, F.explode(F.sequence(place(F.col(c) - wide), place(F.col(c) + wide))))
        owner = owner & (F.col(t) == place(F.col(c)))
    seen = seen.withColumn("_own", owner)
    names = rows.columns

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            value = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*tiles, *columns, "state", "_own")}
            owned, states = [], []
            for i, now in enumerate(zip(*[value[t] for t in tiles], strict=True)):
                if now != key:
                    key, tile = now, Tile(radius, inclusive)
                state = tile.state_of(tuple(value[c][i] for c in columns), value["state"][i], value["_own"][i])
                if value["_own"][i]:
                    owned.append(i)
                    states.append(state)
            out = batch.select([n for n in names if n != "state"]).take(pa.array(owned, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(states, pa.int32())], [*out.schema.names, "state"])

    ordered = [n for n in names if n != "state"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*ordered).dtypes) + ", state int"
    dealt = seen.repartition(*tiles).sortWithinPartitions(*tiles, F.desc("score"), "id")
    return dealt.mapInArrow(solve, schema)


def nms(det: DataFrame, radius: float, inclusive: bool = False, columns: tuple[str, ...] = POST, tile_rows: int = TILE_ROWS, later_first: bool = False) -> DataFrame:
    """Rows that a greedy pass by (score desc, id) would keep; with later_first the greater id goes first among equal scores.

    Space is cut into tiles. Each tile runs the greedy pass over its rows and those within the radius of its sides, best
    first, as far as the order allows: a row is gone once a better one that is surely kept is near, kept once no near
    better row can be, and stays open otherwise, which is only so behind a row of another tile. Open rows and the kept
    ones near them go into the next round, with larger tiles in other places. Of rows at one place only the
    best goes through the rounds, as it speaks for the others. Rows with a null score or place neither suppress nor are
    suppressed.
    """
    if radius <= 0:
        return det
    if later_first:
        back = nms(det.withColumn("id", -F.col("id")), radius, inclusive, columns, tile_rows)
        return back.withColumn("id", -F.col("id"))
    known = F.col("score").isNotNull()
    for c in columns:
        known = known & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    slim = det.where(known).select("id", "score", *[F.col(c).cast("double").alias(c) for c in columns])
    best = F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("m")
    rows = written(slim.groupBy(*columns).agg(best).select((-F.col("m.i")).alias("id"), *columns, "m.score", F.lit(OPEN).alias("state")), "suppression")
    spans = rows.agg(F.count("*").alias("n"), *[F.min(c).alias(f"l{c}") for c in columns], *[F.max(c).alias(f"h{c}") for c in columns]).first()  # one row
    left, dims = spans["n"], len(columns)
    if not left:
        return det
    low, sides = [spans[f"l{c}"] for c in columns], [max(spans[f"h{c}"] - spans[f"l{c}"], radius) for c in columns]
    space = math.prod(sides)
    edge = 4 * radius + (max(sides) if left <= tile_rows else (space * tile_rows / left) ** (1 / dims))
    kept, half = [], False
    while True:
        after = written(_round(rows, edge, [v - edge / 2 if half else v - radius for v in low], radius, inclusive, columns), "suppression")
        discard(rows)
        kept.append(after.where(F.col("state") == KEPT).select("id"))
        open_ = after.where(F.col("state") == OPEN)
        left = open_.count()
        if not left:
            break
        names = [f"_c{i}" for i in range(dims)]
        cells = [F.floor(F.col(c) / (radius * _WIDER)).cast("long").alias(n) for c, n in zip(columns, names, strict=True)]
        around = open_.select(*cells)
        for n in names:
            around = around.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
        near = after.where(F.col("state") == KEPT).select("*", *cells).join(shuffled(around.distinct()), names, "left_semi").drop(*names)
        rows = written(open_.unionByName(near), "suppression")
        half = not half
        if left * min(1.0, (edge * GROWTH) ** dims / space) <= MOST_ROWS:
            edge *= GROWTH
    keep = kept[0]
    for part in kept[1:]:
        keep = keep.unionByName(part)
    out = det.where(known).join(shuffled(keep.distinct()), "id", "left_semi")
    return out.unionByName(det.where(~known))
