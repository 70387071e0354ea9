"""Nearest neighbours and ball counts over points whose coordinates are ranks: each column holds the integers 0 to n - 1 once.

Distances of the k-th neighbours come from a balanced tree whose leaves all have the same number of points, so that a step is a few numpy calls over
all leaves, whatever the number of points. Points in a square over two columns are counted by a wavelet matrix: as many steps as n has bits.
"""

from __future__ import annotations

import numpy as np

#: Points of a leaf, and pairs of a point and a leaf that are compared at a time.
LEAF, PAIRS = 32, 1 << 13
#: A coordinate beyond all ranks, for the points that fill up the leaves.
FAR = 1 << 30


def _leaves(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers by leaf, n for a filling, and the points by leaf. Each cut halves the points of all nodes of a level along their widest columns."""
    n, d = points.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    size = -(-n // (1 << depth))
    at = np.minimum(np.arange(size << depth), n)
    x = np.concatenate([points.astype(np.int32), np.full((1, d), FAR, np.int32)])
    for level in range(depth):
        at = at.reshape(1 << level, -1)
        cells = x[at]
        widest = np.argmax(cells.max(1) - cells.min(1), 1)
        value = np.take_along_axis(cells, widest[:, None, None], 2)[:, :, 0]
        at = np.take_along_axis(at, np.argpartition(value, at.shape[1] // 2, 1), 1)
    at = at.reshape(1 << depth, -1)
    return at, x[at]


def kth_distances(points: np.ndarray, k: int) -> np.ndarray:
    """Each point's distance to its k-th neighbour (itself not counted), in the largest coordinate distance."""
    n, d = points.shape
    if not 1 <= k < n:
        raise ValueError(f"cannot find {k} neighbours among {n} points")
    at, x = _leaves(points, max(LEAF, 2 * (k + 1)))
    leaves, size = at.shape
    low, high = x.min(1), np.where(at[:, :, None] < n, x, -1).max(1)
    near = np.empty((leaves, size, min(k + 1, size)), np.int32)
    for lo in range(0, leaves, max(1, PAIRS // size)):
        some = x[lo : lo + max(1, PAIRS // size)]
        gap = np.abs(some[:, :, None, 0] - some[:, None, :, 0])
        for c in range(1, d):
            np.maximum(gap, np.abs(some[:, :, None, c] - some[:, None, :, c]), out=gap)
        near[lo : lo + len(some)] = np.partition(gap, near.shape[2] - 1, 2)[:, :, : near.shape[2]]
    bound = near.max(2) if near.shape[2] > k else np.full((leaves, size), FAR, np.int32)
    bound[at >= n] = 0
    # leaves that the balls of a leaf may reach: both halves of a node are asked as long as its box is near enough
    boxes = [(low, high)]
    while len(boxes[-1][0]) > 1:
        a, b = boxes[-1]
        boxes.append((np.minimum(a[::2], a[1::2]), np.maximum(b[::2], b[1::2])))
    real = np.where(at[:, :, None] < n, bound[:, :, None], 0)
    reach_low, reach_high = np.where(at[:, :, None] < n, x - real, FAR).min(1), np.where(at[:, :, None] < n, x + real, -FAR).max(1)
    mine, other = np.arange(leaves), np.zeros(leaves, np.int64)
    for a, b in reversed(boxes):
        meet = ((a[other] < reach_high[mine]) & (b[other] > reach_low[mine])).all(1)
        mine, other = mine[meet], other[meet]
        if len(a) < leaves:
            mine, other = np.repeat(mine, 2), (2 * other[:, None] + [0, 1]).ravel()
    mine, other = mine[mine != other], other[mine != other]
    flat, limit, rows = x.reshape(-1, d), bound.ravel(), at.ravel()
    columns = [np.ascontiguousarray(x[:, :, c]) for c in range(d)]
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(mine), PAIRS // size * 16):
        m, o = mine[lo : lo + PAIRS // size * 16], other[lo : lo + PAIRS // size * 16]
        gap = np.maximum(low[o, None] - x[m], x[m] - high[o, None]).max(2)
        i, j = np.nonzero(gap < bound[m])
        p, q = m[i] * size + j, o[i]
        for s in range(0, len(p), PAIRS):
            ps, qs = p[s : s + PAIRS], q[s : s + PAIRS]
            gap = np.abs(columns[0][qs] - flat[ps, 0, None])
            for c in range(1, d):
                np.maximum(gap, np.abs(columns[c][qs] - flat[ps, c, None]), out=gap)
            i, j = np.nonzero(gap < limit[ps, None])
            found.append((rows[ps[i]].astype(np.int64) << 32) | gap[i, j])
    out = np.empty(n + 1, np.int64)
    out[rows] = limit
    more = np.concatenate(found)
    if len(more):  # points with candidates outside their leaf: the k-th of these and the nearest in the leaf
        asked = np.zeros(n + 1, bool)
        asked[more >> 32] = True
        own = np.flatnonzero(asked[rows])
        inside = near.reshape(len(rows), -1)[own]
        every = np.sort(np.concatenate([more, ((rows[own].astype(np.int64) << 32)[:, None] | inside).ravel()]))
        first = np.flatnonzero(np.diff(every >> 32, prepend=-1))
        out[every[first] >> 32] = every[first + k] & 0xFFFFFFFF
    return out[:n]


def count_squares(x: np.ndarray, y: np.ndarray, eps: np.ndarray) -> np.ndarray:
    """How many points lie strictly inside eps[i] of point i in both columns, itself included (if eps[i] > 0)."""
    n = len(x)
    values = np.empty(n, np.int32)
    values[x] = y
    first, last = np.maximum(x - eps + 1, 0).astype(np.int32), np.minimum(x + eps, n).astype(np.int32)
    cut = np.concatenate([np.minimum(y + eps, n), np.maximum(y - eps + 1, 0)]).astype(np.int32)
    left, right = np.concatenate([first, first]), np.concatenate([np.maximum(first, last)] * 2)
    count = np.zeros(2 * n, np.int32)
    zeros = np.zeros(n + 1, np.int32)
    for bit in reversed(range(n.bit_length())):
        one = (values >> bit & 1).astype(bool)
        np.cumsum(~one, out=zeros[1:])
        a, b = zeros[left], zeros[right]
        up = (cut >> bit & 1).astype(bool)
        count += np.where(up, b - a, 0)
        left, right = np.where(up, zeros[n] + left - a, a), np.where(up, zeros[n] + right - b, b)
        values = np.concatenate([values[~one], values[one]])
    return (count[:n] - count[n:]).astype(np.int64)
