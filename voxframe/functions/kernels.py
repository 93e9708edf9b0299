"""Array kernels for one component or block: distance transform, peaks, watershed, smoothing."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

#: More than any squared distance.
NO_HOLE = 1 << 60
#: Places to both sides that are compared for all runs at once.
NEAR = 8
#: What is known of a voxel that may be a peak.
OPEN, KEPT, GONE = 1, 2, 3
#: Before any height, in the order of a flood.
SEED = -(1 << 62)


def lower_envelope(g: list[int], left: bool, right: bool) -> list[int]:
    """For each place i of a run the least (i - j)**2 + g[j] over its places j and, with left or right, a 0 next to that end;
    in time linear in the run."""
    places: list[int] = []  # of the parabolas of the envelope, each from its start on
    values: list[int] = []
    starts: list[int] = []
    sources = [(-1, 0)] * left + [(i, v) for i, v in enumerate(g) if v < NO_HOLE] + [(len(g), 0)] * right
    for q, f in sources:
        start = 0
        while places:
            p = places[-1]
            start = -((values[-1] + p * p - f - q * q) // (2 * (q - p)))  # the first place where q is no higher than p
            if start > starts[-1]:
                break
            places.pop()
            values.pop()
            starts.pop()
            start = 0
        places.append(q)
        values.append(f)
        starts.append(start)
    if not places:
        return [NO_HOLE] * len(g)
    out, k = [], 0
    for i in range(len(g)):
        while k + 1 < len(places) and starts[k + 1] <= i:
            k += 1
        out.append((i - places[k]) ** 2 + values[k])
    return out


def least_in_runs(at: np.ndarray, g: np.ndarray, new: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The lower envelope of g over each run of neighbouring places (new marks the first of each). The cells next to a run's ends
    are 0 if they lie within lo..hi."""
    head = np.flatnonzero(new)
    end = np.concatenate((head[1:], [len(at)])) - 1
    left, right = at[head] > lo[head], at[end] < hi[end]
    run = np.cumsum(new) - 1
    before = np.where(left[run], (at - at[head][run] + 1) ** 2, NO_HOLE)
    after = np.where(right[run], (at[end][run] - at + 1) ** 2, NO_HOLE)
    out = np.minimum(np.minimum(before, after), g)
    known = np.zeros(len(head), bool)
    known[run[g < NO_HOLE]] = True  # with no g but NO_HOLE the ends are all there is
    for step in range(1, min(NEAR, int((end - head).max(initial=0))) + 1):
        same = run[step:] == run[:-step]
        for to, of in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            out[to] = np.where(same, np.minimum(out[to], g[of] + step * step), out[to])
    far = np.zeros(len(head), bool)
    far[run[out > (NEAR + 1) ** 2]] = True  # elsewhere no place further off is nearer
    for a, b, i, j in zip(*[v[known & far & (end - head > NEAR)].tolist() for v in (head, end, left, right)], strict=True):
        out[a : b + 1] = lower_envelope(g[a : b + 1].tolist(), i, j)
    return out


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each True voxel to the nearest False voxel of the array; inf if there is none."""
    g, shape = np.where(mask, np.int64(NO_HOLE), 0), mask.shape
    for axis in reversed(range(mask.ndim)):
        flat = np.moveaxis(g, axis, -1).reshape(-1, shape[axis])
        line, at = np.nonzero(flat)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)
            flat = flat.copy()
            flat[line, at] = least_in_runs(at, flat[line, at], new, np.zeros_like(at), np.full_like(at, shape[axis] - 1))
        g = np.moveaxis(flat.reshape([n for i, n in enumerate(shape) if i != axis] + [shape[axis]]), -1, axis)
    return np.where(g >= NO_HOLE, np.inf, np.sqrt(g.astype(np.float64)))


def local_peaks(dist: np.ndarray, min_distance: int, floor: float = 0.5) -> list[tuple[int, ...]]:
    """Highest voxels at least ``floor`` of the maximum, at more than min_distance (Chebyshev) from a better one;
    equal heights in raster order."""
    finite = np.where(np.isfinite(dist), dist, 0)
    top = finite.max(initial=0)
    if top <= 0:
        return []
    at = np.argwhere(finite >= floor * top)
    at = at[np.argsort(-finite[tuple(at.T)], kind="stable")]  # argwhere tells raster order
    taken = np.zeros(dist.shape, bool)
    kept: list[tuple[int, ...]] = []
    for p in map(tuple, at.tolist()):
        if not taken[p]:
            kept.append(p)
            taken[tuple(slice(max(a - min_distance, 0), a + min_distance + 1) for a in p)] = True
    return kept


def watershed(height: np.ndarray, seeds: list[tuple[int, ...]], mask: np.ndarray) -> np.ndarray:
    """Labels grown from the seeds in order of height (then age) over face neighbours in the mask. Voxels of one height wait in
    one queue in the order of their age, so that a voxel takes the same time in a mask of any size."""
    wide = np.pad(mask, 1)
    free = bytearray(wide.tobytes())  # in the mask and without a label
    steps = [n // wide.itemsize * sign for n in wide.strides for sign in (-1, 1)]
    levels, rank = np.unique(height[mask], return_inverse=True)
    level = np.zeros(wide.shape, np.int32)
    level[wide] = rank
    level, labels = level.ravel(), np.zeros(wide.size, np.int32)
    queues: list[deque[int]] = [deque() for _ in levels]
    waiting: list[int] = []  # heights with a queue that is not empty
    for i, p in enumerate(np.ravel_multi_index((np.array(seeds, np.int64).reshape(-1, mask.ndim) + 1).T, wide.shape).tolist(), 1):
        labels[p], free[p], h = i, 0, int(level[p])
        if not queues[h]:
            heapq.heappush(waiting, h)
        queues[h].append(p)
    while waiting:
        queue = queues[waiting[0]]
        if not queue:
            heapq.heappop(waiting)
            continue
        p = queue.popleft()
        own = labels[p]
        for step in steps:
            t = p + step
            if free[t]:
                free[t], labels[t], h = 0, own, int(level[t])
                if not queues[h] and h != waiting[0]:
                    heapq.heappush(waiting, h)
                queues[h].append(t)
    return labels.reshape(wide.shape)[tuple(slice(1, -1) for _ in mask.shape)]


def peak_states(dist: np.ndarray, comp: np.ndarray, state: np.ndarray, inside: tuple[slice, ...], min_distance: int) -> np.ndarray:
    """State after a greedy pass (as in ``local_peaks``, by squared distance, over voxels that are not 0) that knows nothing beyond the
    array: inside, a voxel is kept once no better one of its object that may be kept is near, gone once one that is kept is
    near, and open otherwise; outside, what is told of a voxel stands, and open ones may be seen to be gone."""
    state = state.copy()
    taken, doubted, own = np.zeros(state.shape, bool), np.zeros(state.shape, bool), np.zeros(state.shape, bool)
    own[inside] = True
    at = np.argwhere((state == OPEN) | (state == KEPT))
    at = at[np.argsort(-dist[tuple(at.T)], kind="stable")]
    for p in map(tuple, at.tolist()):
        now = state[p]
        if now == OPEN:
            if taken[p]:
                state[p] = GONE
                continue
            if own[p] and not doubted[p]:
                now = state[p] = KEPT
        around = tuple(slice(max(a - min_distance, 0), a + min_distance + 1) for a in p)
        (taken if now == KEPT else doubted)[around] |= comp[around] == comp[p]
    return state


def flood(dist: np.ndarray, inside: tuple[slice, ...], seeds: list[tuple[tuple[int, ...], int]], known: dict[tuple, list[int]]) -> tuple[np.ndarray, list[tuple]]:
    """The key of each voxel that a flood reaches (its number among the keys, else -1), and the keys, for an array (0: no voxel) with
    a border of one cell, of which ``known`` gives the cells by their keys.

    Keys sort as ``watershed``, by height -dist, labels voxels: a key is (the greatest height on the way, steps on this height,
    the key of the voxel that the way came from to this height), or at a seed (height, 0, (SEED, seed)). The first voxel
    reached at a height, or below it from it, goes before those further on; of equally many steps those go first
    whose height was reached first. Voxels with one key have one seed, so what else orders them does not matter to labels.
    """
    height, free = (-dist).ravel().tolist(), np.zeros(dist.shape, bool)
    free[inside] = dist[inside] > 0
    steps = [n // free.itemsize * sign for n in free.strides for sign in (-1, 1)]
    unseen = bytearray(free.tobytes()) + bytearray(max(steps))  # no step from the border leads out of it
    queues = {key: list(cells) for key, cells in known.items()}
    for at, seed in seeds:
        cell = int(np.ravel_multi_index(at, dist.shape))
        unseen[cell] = 0
        queues[height[cell], 0, (SEED, seed)] = [cell]
    waiting, keys, code = list(queues), [], np.full(dist.size, -1, np.int64)
    heapq.heapify(waiting)
    while waiting:
        key = heapq.heappop(waiting)
        queue, ahead = queues.pop(key), {}
        top, count, origin = key
        for p in queue:  # grows with the voxels below this height
            for step in steps:
                t = p + step
                if unseen[t]:
                    unseen[t], h = 0, height[t]
                    if h < top:
                        queue.append(t)
                        continue
                    if h not in ahead:
                        after = (top, count + 1, origin) if h == top else (h, 0, key)
                        if after not in queues:
                            queues[after] = []
                            heapq.heappush(waiting, after)
                        ahead[h] = queues[after]
                    ahead[h].append(t)
        code[queue] = len(keys)
        keys.append(key)
    return code.reshape(dist.shape), keys


def split_labels(mask: np.ndarray, min_peak_dist: int = 4, min_sub_size: int = 8) -> np.ndarray:
    """The number of the part around its distance peak that each voxel is in, from 0, and -1 for voxels of parts that are too small or
    outside the mask; the mask itself is part 0 if it has one peak or no part is large enough."""
    whole = np.where(mask, 0, -1).astype(np.int32)
    dist = distance_transform(mask)
    peaks = local_peaks(dist, min_peak_dist)
    if len(peaks) <= 1:
        return whole
    labels = watershed(-dist, peaks, mask)
    large = np.bincount(labels.ravel(), minlength=len(peaks) + 1)[1:] >= min_sub_size
    if not large.any():
        return whole
    return np.concatenate(([-1], np.where(large, np.cumsum(large) - 1, -1))).astype(np.int32)[labels]


def split_mask(mask: np.ndarray, min_peak_dist: int = 4, min_sub_size: int = 8) -> list[np.ndarray]:
    """Parts of a mask around its distance peaks; the mask itself if it has one peak or no part is large enough."""
    labels = split_labels(mask, min_peak_dist, min_sub_size)
    return [labels == i for i in range(labels.max() + 1)]


def elongation(mask: np.ndarray) -> float:
    """Ratio of the longest to the shortest axis of the ellipsoid with the mask's second moments, the shortest at least 1e-6."""
    p = np.argwhere(mask).astype(float)
    if len(p) < 2:
        return 0.0
    e = np.sort(np.linalg.eigvalsh(np.cov(p.T, bias=True)))
    return float(np.sqrt(20 * max(e[-1], 0.0)) / max(np.sqrt(20 * max(e[0], 0.0)), 1e-6))


def gaussian(values: np.ndarray, sigma: float, axis: int = -1, truncate: float = 4.0) -> np.ndarray:
    """1-D Gaussian along an axis; the edge value is repeated by reflection."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    a = np.moveaxis(values, axis, -1)
    padded = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(r, r)], mode="symmetric")
    out = sum(w[k] * padded[..., k : k + a.shape[-1]] for k in range(2 * r + 1))
    return np.moveaxis(out, -1, axis)


def displacement(shape: tuple[int, int, int], spacing: tuple[int, int, int], sigma: tuple[float, float, float], seed: int = 0) -> np.ndarray:
    """(3, z, y, x) smooth field from a coarse random grid, smoothed and enlarged by linear interpolation."""
    rng = np.random.default_rng(seed)
    grid = tuple(max(2, -(-s // c) + 1) for s, c in zip(shape, spacing, strict=True))
    out = []
    for s in sigma:
        f = rng.normal(0, s, grid) if s > 0 else np.zeros(grid)
        for axis, n in enumerate(shape):
            f = gaussian(f, 1.0, axis)
            x = np.linspace(0, f.shape[axis] - 1, n)
            lo = np.minimum(x.astype(int), f.shape[axis] - 2)
            w = (x - lo).reshape([-1 if k == axis else 1 for k in range(3)])
            f = np.take(f, lo, axis) * (1 - w) + np.take(f, lo + 1, axis) * w
        out.append(f)
    return np.stack(out)


def warp(volume: np.ndarray, field: np.ndarray, order: int = 1) -> np.ndarray:
    """Values of the volume at each voxel plus the field; linear or nearest, edges repeated."""
    at = np.indices(volume.shape) + field
    at = [np.clip(a, 0, n - 1) for a, n in zip(at, volume.shape, strict=True)]
    if order == 0:
        return volume[tuple(np.rint(a).astype(int) for a in at)]
    lo = [np.minimum(a.astype(int), max(n - 2, 0)) for a, n in zip(at, volume.shape, strict=True)]
    w = [a - b for a, b in zip(at, lo, strict=True)]
    out = np.zeros(volume.shape)
    for corner in range(8):
        k = [(corner >> i) & 1 for i in range(3)]
        weight = np.prod([x if b else 1 - x for x, b in zip(w, k, strict=True)], axis=0)
        out += weight * volume[tuple(np.minimum(a + b, n - 1) for a, b, n in zip(lo, k, volume.shape, strict=True))]
    return out
