"""Parts of objects around the peaks of their distance to the background: blocks of voxels that tell their neighbours what they
found, round by round, until nothing is new. No object is ever one group."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.kernels import GONE, KEPT, NO_HOLE, OPEN, flood, peak_states
from voxframe.operators.keys import attach, new_groups, shuffled, whole_groups
from voxframe.operators.ranking import global_index
from voxframe.operators.voxels import AXES, BLOCK, distances
from voxframe.storage import discard, written

KEYS = ("_kz", "_ky", "_kx")
#: Blocks that a task works off; their packed rows say too little of the work, and adaptive execution would put all into one task.
BLOCKS_A_TASK = 4
_PLACE = "_kz int, _ky int, _kx int"
#: From a block to its neighbours: all around it, or across its faces.
AROUND = [s for s in product((-1, 0, 1), repeat=3) if any(s)]
FACES = [s for s in AROUND if sum(map(abs, s)) == 1]

#: From a row of a block, and what its neighbours told it, to what it tells each of them (None: nothing).
Tell = Callable[[dict, list], list]


def _packed(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpacked(data: bytes, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype).reshape(shape).copy()


def _by_block(rows: DataFrame, block: tuple[int, int, int], margin: int) -> DataFrame:
    """A row (keys, g, comp, state) for each block with voxels of its own, of rows (comp, z, y, x, g, top): dense arrays that reach
    ``margin`` cells beyond the block, g 0 where there is no voxel, state OPEN where a voxel may be a peak."""
    shape = tuple(n + 2 * margin for n in block)
    names = list(KEYS)
    for k, a, n in zip(KEYS, AXES, block, strict=True):
        rows = rows.withColumn(k, F.explode(F.sequence(F.floor((F.col(a) - margin) / n).cast("int"), F.floor((F.col(a) + margin) / n).cast("int"))))

    def pack(table: pa.Table) -> pa.RecordBatch:
        value = {c: table.column(c).to_numpy() for c in table.column_names}
        heads = np.flatnonzero(new_groups(table, names))
        made = []
        for a, b in zip(heads, np.append(heads[1:], table.num_rows), strict=True):
            at = tuple(value[c][a:b].astype(np.int64) - value[k][a].astype(np.int64) * n + margin for c, k, n in zip(AXES, KEYS, block, strict=True))
            g, comp, state = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int8)
            g[at], comp[at] = value["g"][a:b], value["comp"][a:b]
            state[at] = np.where(4 * value["g"][a:b] >= value["top"][a:b], OPEN, 0)
            if g[tuple(slice(margin, margin + n) for n in block)].any():
                made.append({k: int(value[k][a]) for k in KEYS} | {"g": _packed(g), "comp": _packed(comp), "state": _packed(state)})
        kinds = [(k, pa.int32()) for k in KEYS] + [(c, pa.binary()) for c in ("g", "comp", "state")]
        return pa.RecordBatch.from_pylist(made, pa.schema(kinds))

    own = rows.select(*names, *AXES, "comp", "g", "top").repartition(*names).sortWithinPartitions(*names)
    return own.mapInArrow(whole_groups(names, pack, block[0] * block[1] * block[2]), f"{_PLACE}, g binary, comp binary, state binary")


def _tasks(blocks: DataFrame) -> int:
    return -(-blocks.count() // BLOCKS_A_TASK) or 1


def settled(blocks: DataFrame, tell: Tell, sides: list[tuple[int, int, int]]) -> DataFrame:
    """blocks plus ``heard``, what the neighbour on each side tells a block once no block has anything new to tell. In each round
    the blocks with news are worked off again, and tell a neighbour only what has changed for it."""
    names, tasks = blocks.columns, _tasks(blocks)
    opposite = [sides.index(tuple(-c for c in s)) for s in sides]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["heard", "told", "come"]).to_pylist()):
                new = [None] * len(sides)
                heard, told = row["heard"] or new, row["told"] or new
                if row["told"] is None or row["come"]:
                    heard = list(heard)
                    for item in row["come"] or ():
                        heard[item["side"]] = item["what"]
                    before, told = told, tell(batch.slice(i, 1).select(names).to_pylist()[0], heard)
                    new = [a if a != b else None for a, b in zip(told, before, strict=True)]
                own = batch.slice(i, 1).select(names)
                lists = [pa.array([v], pa.list_(pa.binary())) for v in (heard, told, new)]
                yield pa.RecordBatch.from_arrays([*own.columns, *lists], [*names, "heard", "told", "news"])

    schema = ", ".join(f"`{n}` {t}" for n, t in blocks.dtypes) + ", heard array<binary>, told array<binary>, news array<binary>"
    number = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_s") + 1)
    now = blocks.withColumns({"heard": F.lit(None).cast("array<binary>"), "told": F.lit(None).cast("array<binary>"), "come": F.lit(None).cast("array<struct<side:int,what:binary>>")})
    last = None
    while True:
        after = written(now.repartition(tasks, *KEYS).mapInArrow(work, schema), "blocks")
        if last is not None:
            discard(last)
        last = after
        sent = last.select(*KEYS, F.posexplode("news").alias("_s", "what")).where("what is not null")
        if sent.isEmpty():
            return last.drop("told", "news")
        beyond = [(F.col(k) + number([s[i] for s in sides])).alias(k) for i, k in enumerate(KEYS)]
        come = sent.select(*beyond, F.struct(number(opposite).alias("side"), "what").alias("_m")).groupBy(*KEYS).agg(F.collect_list("_m").alias("come"))
        now = last.drop("news").join(shuffled(come), list(KEYS), "left")


def peaks(blocks: DataFrame, block: tuple[int, int, int], distance: int) -> DataFrame:
    """(keys, comp, z, y, x, g) of the voxels that a greedy pass over each object keeps, highest first, then in raster order, each
    taking what is within ``distance`` along every axis. A block leaves open what hangs on a neighbour's open voxels."""
    m = max(distance, 1)
    shape = tuple(n + 2 * m for n in block)
    inside = tuple(slice(m, m + n) for n in block)
    seen = [tuple({-1: slice(0, m), 0: slice(m, m + n), 1: slice(m + n, None)}[c] for c, n in zip(s, block, strict=True)) for s in AROUND]
    shown = [tuple({-1: slice(m, 2 * m), 0: slice(m, m + n), 1: slice(n, m + n)}[c] for c, n in zip(s, block, strict=True)) for s in AROUND]

    def states(row: dict, heard: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, comp, state = _unpacked(row["g"], shape, np.int64), _unpacked(row["comp"], shape, np.int64), _unpacked(row["state"], shape, np.int8)
        for place, what in zip(seen, heard, strict=True):
            if what is not None:
                state[place] = _unpacked(what, state[place].shape, np.int8)
        return g, comp, peak_states(g, comp, state, inside, distance)

    def tell(row: dict, heard: list) -> list:
        state = states(row, heard)[2]
        return [_packed(state[place]) if (state[place] > OPEN).any() else None for place in shown]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g, comp, state = states(row, row["heard"])
                if (state[inside] == OPEN).any():
                    raise RuntimeError("peaks did not settle")
                at = np.nonzero(state[inside] == KEPT)
                place = [pa.array((a + row[k] * n).astype(np.int32)) for a, k, n in zip(at, KEYS, block, strict=True)]
                key = [pa.array(np.full(len(at[0]), row[k], np.int32)) for k in KEYS]
                yield pa.RecordBatch.from_arrays([*key, pa.array(comp[inside][at]), *place, pa.array(g[inside][at])], [*KEYS, "comp", *AXES, "g"])

    done = settled(blocks, tell, AROUND)
    return done.repartition(_tasks(blocks), *KEYS).mapInArrow(found, f"{_PLACE}, comp long, z int, y int, x int, g long")


def _told(layer: np.ndarray, keys: list[tuple]) -> bytes | None:
    """Keys of the cells of a layer, as lists without nesting, the innermost number last."""
    used, at = np.unique(layer, return_inverse=True)
    flat = []
    for code in used.tolist():
        key, numbers = keys[code] if code >= 0 else (), []
        while len(key) == 3:
            numbers += key[:2]
            key = key[2]
        flat.append(numbers + list(key))
    return zlib.compress(json.dumps([flat, at.ravel().tolist()]).encode(), 1) if any(flat) else None


def _read(what: bytes) -> tuple[list[tuple | None], np.ndarray]:
    """Keys, None for none, and the key's number for each cell of the layer."""
    flat, at = json.loads(zlib.decompress(what))
    keys: list[tuple | None] = []
    for numbers in flat:
        key = tuple(numbers[-2:]) or None
        for i in range(len(numbers) - 4, -1, -2):
            key = (numbers[i], numbers[i + 1], key)
        keys.append(key)
    return keys, np.array(at)


def basins(blocks: DataFrame, seeds: DataFrame, block: tuple[int, int, int], margin: int) -> DataFrame:
    """(z, y, x, seed) of all voxels of objects with a seed of seeds (keys, z, y, x, seed): the label that a flood from the seeds
    gives a voxel, in order of height, then of age, as ``kernels.watershed`` does. A block knows the flood's order at
    the cells across its faces from its neighbours, so that paths may go through any number of blocks."""
    full = tuple(n + 2 * margin for n in block)
    near = tuple(slice(margin - 1, margin + n + 1) for n in block)
    seen = [tuple({-1: 0, 0: slice(1, n + 1), 1: n + 1}[c] for c, n in zip(s, block, strict=True)) for s in FACES]
    shown = [tuple({-1: 1, 0: slice(1, n + 1), 1: n}[c] for c, n in zip(s, block, strict=True)) for s in FACES]
    inside = tuple(slice(1, n + 1) for n in block)
    cells = np.arange(np.prod([n + 2 for n in block])).reshape([n + 2 for n in block])

    def flooded(row: dict, heard: list) -> tuple[np.ndarray, list[tuple]]:
        g = _unpacked(row["g"], full, np.int64)[near]
        starts = [(tuple(s[a] - row[k] * n + 1 for a, k, n in zip(AXES, KEYS, block, strict=True)), s["seed"]) for s in row["seeds"] or ()]
        known: dict[tuple, list[int]] = {}
        for place, what in zip(seen, heard or [None] * len(FACES), strict=True):
            if what is not None:
                keys, at = _read(what)
                for key, cell in zip([keys[i] for i in at.tolist()], cells[place].ravel().tolist(), strict=True):
                    if key is not None:
                        known.setdefault(key, []).append(cell)
        return flood(g, inside, starts, known)

    def tell(row: dict, heard: list) -> list:
        code, keys = flooded(row, heard)
        return [_told(code[place], keys) for place in shown]

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, keys = flooded(row, row["heard"])
                own = []
                for key in keys:
                    while len(key) == 3:
                        key = key[2]
                    own.append(key[-1])
                at = np.nonzero(code[inside] >= 0)
                place = [pa.array((a + row[k] * n).astype(np.int32)) for a, k, n in zip(at, KEYS, block, strict=True)]
                yield pa.RecordBatch.from_arrays([*place, pa.array(np.array(own, np.int64)[code[inside][at]])], [*AXES, "seed"])

    own = seeds.groupBy(*KEYS).agg(F.collect_list(F.struct(*AXES, "seed")).alias("seeds"))
    filled = written(blocks.select(*KEYS, "g").join(shuffled(own), list(KEYS), "left"), "blocks")
    done = settled(filled, tell, FACES)
    return done.repartition(_tasks(blocks), *KEYS).mapInArrow(labels, "z int, y int, x int, seed long")


def parts(rows: DataFrame, distance: int, least: int, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(z, y, x, part) of the voxels of rows (comp, z, y, x, and the object's box z0, z1, ...), the number of the part around its
    distance peak that a voxel is in, as ``kernels.split_labels`` tells it of one object: -1 for parts of fewer than
    ``least`` voxels, unless all are; the object itself is part 0 if it fills its box or has one peak."""
    block = tuple(max(n, 2 * distance) for n in block)
    far = written(distances(rows.select("comp", *AXES, *[f"{a}{i}" for a in AXES for i in "01"])).select("comp", *AXES, "g"), "distances")
    top = written(far.groupBy("comp").agg(F.max("g").alias("top"), F.count("*").alias("_n")).withColumnRenamed("comp", "_object"), "tops")
    margin = max(distance, 1)
    held = attach(far.where(F.col("g") < NO_HOLE), top, "comp", "_object", "_n", F.xxhash64(*AXES))
    blocks = written(_by_block(held, block, margin), "blocks")
    seeds = written(global_index(peaks(blocks, block, distance), [F.asc("comp"), F.desc("g"), *map(F.asc, AXES)], "seed"), "seeds")
    found = written(basins(blocks, seeds, block, margin), "basins")
    sizes = found.groupBy("seed").agg(F.count("*").alias("_held"))
    sized = written(seeds.select("seed", "comp").join(shuffled(sizes), "seed"), "sizes")
    large = global_index(sized.where(F.col("_held") >= least), [F.asc("seed")], "_at")
    large = written(large.select("seed", "comp", "_at"), "large")
    # every object with seeds, and the number of its first large part, if any
    firsts = sized.groupBy("comp").agg(F.count("*").alias("_n")).join(shuffled(large.groupBy(F.col("comp").alias("_c")).agg(F.min("_at").alias("_first"))), F.col("comp") == F.col("_c"), "left")
    firsts = written(firsts.select(F.col("comp").alias("_object"), "_n", "_first"), "firsts")
    told = attach(sized.join(shuffled(large.select("seed", "_at")), "seed", "left"), firsts, "comp", "_object", "_n", F.col("seed"))
    part = F.when(F.col("_first").isNull(), 0).otherwise(F.coalesce(F.col("_at") - F.col("_first"), F.lit(-1))).cast("int")
    told = written(told.select(F.col("seed").alias("_seed"), "_held", part.alias("part")), "parts")
    filling = far.where(F.col("g") >= NO_HOLE).select(*AXES, F.lit(0).alias("part"))
    return attach(found, told, "seed", "_seed", "_held", F.xxhash64(*AXES)).select(*AXES, "part").unionByName(filling)
