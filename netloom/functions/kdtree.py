"""Nearest neighbours and ball counts in the largest coordinate distance, over a matrix of points.

The tree halves the points at the median of the widest coordinate until few are left. Searches go leaf by leaf: all points of a
leaf walk the tree together, so that numpy compares blocks, and a branch whose box is too far for every one of them is left out.
"""

from __future__ import annotations

import numpy as np

LEAF = 48


class KDTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = np.asarray(points, float)
        if self.points.ndim != 2:
            raise ValueError("points are a matrix")
        n = len(self.points)
        self.order = np.arange(n)
        self.nodes: list[tuple[int, int, int, int, np.ndarray, np.ndarray]] = []  # start, end, left, right, low, high
        if n:
            self._build(0, n, max(1, leaf))

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        some = self.points[self.order[lo:hi]]
        low, high = (some.min(0), some.max(0)) if some.shape[1] else (np.zeros(0), np.zeros(0))
        me = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1, low, high))
        if hi - lo > leaf and some.shape[1] and (high > low).any():
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(some[:, int(np.argmax(high - low))], mid)]
            left, right = self._build(lo, lo + mid, leaf), self._build(lo + mid, hi, leaf)
            self.nodes[me] = (lo, hi, left, right, low, high)
        return me

    def _groups(self):
        """Rows of each leaf with the leaf's node; a leaf of many equal points in pieces."""
        for i, (lo, hi, left, _, _, _) in enumerate(self.nodes):
            if left < 0:
                for at in range(lo, hi, 4 * LEAF):
                    yield i, self.order[at : min(hi, at + 4 * LEAF)]

    @staticmethod
    def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Distance of each row to a box."""
        return np.maximum(np.maximum(low - x, x - high), 0).max(1, initial=0)

    def _near(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and rows of the k nearest points of each row of x, by distance, then row."""
        dist, rows = np.full((len(x), k), np.inf), np.full((len(x), k), len(self.points))
        box = (x.min(0), x.max(0)) if x.shape[1] else (np.zeros(0), np.zeros(0))

        def apart(node: int) -> float:
            low, high = self.nodes[node][4:]
            return float(np.maximum(np.maximum(low - box[1], box[0] - high), 0).max(initial=0))

        todo = [(0.0, 0)]
        while todo:
            gap, node = todo.pop()
            if gap > dist[:, -1].max():
                continue
            lo, hi, left, right, low, high = self.nodes[node]
            if left >= 0:
                todo += sorted([(apart(left), left), (apart(right), right)], reverse=True)  # the nearer one next
                continue
            live = np.flatnonzero(self._gap(x, low, high) <= dist[:, -1])
            for at in range(lo, hi, 64 * LEAF):
                there = np.sort(self.order[at : min(hi, at + 64 * LEAF)])
                if not len(live):
                    break
                d = np.abs(x[live, None] - self.points[there][None]).max(2, initial=0)
                both, ids = np.concatenate([dist[live], d], 1), np.concatenate([rows[live], np.broadcast_to(there, d.shape)], 1)
                best = np.lexsort((ids, both))[:, :k]
                dist[live], rows[live] = np.take_along_axis(both, best, 1), np.take_along_axis(ids, best, 1)
        return dist, rows

    def query(self, x: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Distances and row numbers of the k nearest points of each row of x; ties by row number."""
        if not 1 <= k <= len(self.points):
            raise ValueError(f"cannot find {k} of {len(self.points)} points")
        x = np.asarray(x, float)
        parts = [self._near(x[i : i + LEAF], k) for i in range(0, len(x), LEAF)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros((0, k)), np.zeros((0, k), int))

    def neighbours(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """query() of the tree's own points, each of which is its own nearest."""
        if not 1 <= k <= len(self.points):
            raise ValueError(f"cannot find {k} of {len(self.points)} points")
        dist, rows = np.empty((len(self.points), k)), np.empty((len(self.points), k), int)
        for _, some in self._groups():
            dist[some], rows[some] = self._near(self.points[some], k)
        return dist, rows

    def count_inside(self, eps: np.ndarray) -> np.ndarray:
        """How many points lie strictly inside eps[i] of point i, itself included (if eps[i] > 0)."""
        out = np.zeros(len(self.points), np.int64)
        for _, some in self._groups():
            x, e = self.points[some], np.asarray(eps, float)[some]
            todo = [(0, np.arange(len(some)))]
            while todo:
                node, live = todo.pop()
                lo, hi, left, right, low, high = self.nodes[node]
                y, r = x[live], e[live]
                live = live[self._gap(y, low, high) < r]
                y, r = x[live], e[live]
                whole = np.maximum(high - y, y - low).max(1, initial=0) < r
                out[some[live[whole]]] += hi - lo
                live = live[~whole]
                if not len(live):
                    continue
                if left >= 0:
                    todo += [(left, live), (right, live)]
                else:
                    d = np.abs(x[live, None] - self.points[self.order[lo:hi]][None]).max(2, initial=0)
                    out[some[live]] += (d < e[live, None]).sum(1)
        return out

    def count_near(self, x: np.ndarray, eps: np.ndarray) -> np.ndarray:
        """How many points lie strictly inside eps[i] of row i of x. Rows walk the tree in groups that lie together."""
        x, eps = np.asarray(x, float), np.asarray(eps, float)
        out = np.zeros(len(x), np.int64)
        for _, some in KDTree(x)._groups():
            todo = [(0, some)]
            while todo:
                node, live = todo.pop()
                lo, hi, left, right, low, high = self.nodes[node]
                live = live[self._gap(x[live], low, high) < eps[live]]
                whole = np.maximum(high - x[live], x[live] - low).max(1, initial=0) < eps[live]
                out[live[whole]] += hi - lo
                live = live[~whole]
                if not len(live):
                    continue
                if left >= 0:
                    todo += [(left, live), (right, live)]
                else:
                    d = np.abs(x[live, None] - self.points[self.order[lo:hi]][None]).max(2, initial=0)
                    out[live] += (d < eps[live, None]).sum(1)
        return out
