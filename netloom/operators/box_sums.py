"""Sums of normal kernels over many rows in work that grows with points and rows, not with their pairs.

Whitened space is cut into boxes of side 2. With point b + u in a box around b, row c + v in a box around c and delta = b - c, a kernel is
exp(-|delta|^2 / 2 - delta.u - |u|^2 / 2) exp(delta.v - |v|^2 / 2) exp(u.v), and no coordinate of u or v exceeds 1, so ORDER powers give the last factor to a
relative error below 1e-12 whatever the distance. A pair of boxes thus needs ORDER^d moments of its rows; all terms are positive, so the whole sum has that
relative error too, for outliers as well. Boxes that together add less than 1e-13 of a sum are passed over, by a bound from their corners. Boxes of few
rows, and boxes of few points, are summed up row by row.

Shares below a point (a distribution function) have a normal distribution function in the first coordinate; it is interpolated at Chebyshev
nodes of both boxes, to an error below 1e-12 of the sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from netloom.functions.special import log_sum_exp, normal_cdf

#: Powers of a coordinate, Chebyshev nodes, logarithm of what may be left out, and the most columns that boxes take.
ORDER, NODES, LEFT_OUT, MAX_COLUMNS = 16, 18, 30.0, 2
#: Rows from which boxes pay, points of a box from which its moments are worth their making, cells of a temporary matrix, cells of kept moments.
MANY, WORTH, CELLS, KEPT = 512, 16, 2_000_000, 32_000_000
#: Beyond this sum of a delta's coordinates the factors of a kernel might leave the range of doubles.
FAR = 300.0
ETA = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)


def exponents(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log kernels of whitened points and training rows, without the constant."""
    d2 = (p**2).sum(1)[:, None] + (t**2).sum(1)[None] - 2 * p @ t.T
    return -0.5 * np.maximum(d2, 0)


def powers(x: np.ndarray) -> np.ndarray:
    """1, x, x^2, ...: a row for each number."""
    out = np.empty((len(x), ORDER))
    out[:, 0] = 1
    for i in range(1, ORDER):
        np.multiply(out[:, i - 1], x, out=out[:, i])
    return out


FACTORIALS = np.array([math.factorial(i) for i in range(ORDER)], float)


def interpolation(x: np.ndarray) -> np.ndarray:
    """What each node's value counts at x: Chebyshev polynomials, which are orthogonal over the nodes."""
    k = np.arange(NODES)
    at_nodes = np.cos(k[:, None] * np.arccos(ETA)[None]) * np.where(k == 0, 1.0, 2.0)[:, None] / NODES
    return np.cos(k[None] * np.arccos(np.clip(x, -1, 1))[:, None]) @ at_nodes


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


class Plain:
    """Every pair of a point and a row."""

    def __init__(self, t: np.ndarray, log_weight: np.ndarray, share: bool = False):
        self.t, self.w, self.share = t, log_weight, share

    def logs(self, p: np.ndarray) -> np.ndarray:
        step, out = max(1, CELLS // max(1, len(self.t))), np.full(len(p), -np.inf)
        if len(self.t):
            for i in range(0, len(p), step):
                out[i : i + step] = log_sum_exp(pairs(p[i : i + step], self.t, self.w, self.share), 1)
        return out


def pairs(p: np.ndarray, t: np.ndarray, log_weight: np.ndarray, share: bool) -> np.ndarray:
    if not share:
        return exponents(p, t) + log_weight
    with np.errstate(divide="ignore"):
        below = np.log(normal_cdf(p[:, :1] - t[:, 0][None]))
    return exponents(p[:, 1:], t[:, 1:]) + log_weight + below


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the boxes that rows lie in, the rows in order of their boxes, and where each box starts."""
    cut, of = np.floor(x / 2), np.zeros(len(x), np.int64)
    for c in range(x.shape[1]):
        values, place = np.unique(cut[:, c], return_inverse=True)
        of = np.unique(of * len(values) + place, return_inverse=True)[1]
    order = np.argsort(of, kind="stable")
    start = np.concatenate([[0], np.bincount(of).cumsum()])
    return 2 * cut[order[start[:-1]]] + 1, order, start


class BoxSums:
    """Logarithms of sums at whitened points over whitened rows `t` with log weights: of normal kernels or (`share`) of kernels of all but the
    first column times the normal distribution function in the first. Moments are made for the boxes that points lie in, and kept."""

    def __init__(self, t: np.ndarray, log_weight: np.ndarray, share: bool = False):
        self.share, self.first = share, int(share)  # kernels are over the columns from `first` on
        self.centre, order, self.start = _boxes(t)
        self.t, self.w = t[order], log_weight[order]
        each = range(len(self.centre))
        self.rows = np.diff(self.start)
        self.low = np.minimum.reduceat(self.t, self.start[:-1])
        self.high = np.maximum.reduceat(self.t, self.start[:-1])
        self.total = np.array([log_sum_exp(self.w[self.start[s] : self.start[s + 1]]) for s in each])
        self.width = (NODES if share else ORDER) * ORDER ** (t.shape[1] - 1)
        self.light = self.rows <= self.width // 16
        self.moments: dict[tuple, tuple] = {}
        self.shares: dict[tuple, tuple] = {}
        self.phi: dict[float, np.ndarray] = {}
        self.cells = 0

    def reach(self, b: np.ndarray) -> list[np.ndarray]:
        """For boxes around b the boxes of rows that count."""
        f, out = self.first, []
        step = max(1, CELLS // len(self.centre))
        for i in range(0, len(b), step):
            near, far = 0.0, 0.0
            for c in range(f, b.shape[1]):
                lo, hi = self.low[:, c][None] - (b[i : i + step, c, None] + 1), (b[i : i + step, c, None] - 1) - self.high[:, c][None]
                near = near + np.maximum(np.maximum(lo, hi), 0) ** 2
                far = far + (1 + np.maximum(np.abs(self.low[:, c][None] - b[i : i + step, c, None]), np.abs(self.high[:, c][None] - b[i : i + step, c, None]))) ** 2
            shape = np.zeros((len(b[i : i + step]), len(self.centre)))
            sure, most = self.total - 0.5 * far + shape, self.total - 0.5 * near + shape
            good = most >= sure.max(1, keepdims=True) - LEFT_OUT - math.log(len(self.centre))
            out += [np.flatnonzero(g) for g in good]
        return out

    def make(self, b: np.ndarray) -> None:
        """Moments of the rows in reach for boxes around each row of b."""
        f = self.first
        reach = self.reach(b)
        heavy, direct = [], []
        for centre, some in zip(b, reach, strict=True):
            far = np.abs(centre[f:] - self.centre[some, f:]).sum(1) > FAR
            plain = self.light[some] | far
            heavy.append(some[~plain])
            direct.append(some[plain])
        place = [np.empty((len(h), self.width)) for h in heavy]
        scale = [np.empty(len(h)) for h in heavy]
        asks: dict[int, list[tuple[int, int]]] = {}
        for i, h in enumerate(heavy):
            for j, s in enumerate(h.tolist()):
                asks.setdefault(s, []).append((i, j))
        for s, who in asks.items():
            delta = b[[i for i, _ in who], f:] - self.centre[s, f:]
            lo, hi = self.low[s, f:] - self.centre[s, f:], self.high[s, f:] - self.centre[s, f:]
            ends = range(self.start[s], self.start[s + 1], max(1, CELLS // max(self.width, len(who))))
            # no exponent is above this bound
            top = np.maximum(delta * lo, delta * hi).sum(1) + self.w[self.start[s] : self.start[s + 1]].max()
            got = np.zeros((len(who), self.width))
            for at in ends:
                rows = slice(at, min(self.start[s + 1], at + ends.step))
                v = self.t[rows] - self.centre[s]
                basis = interpolation(v[:, 0]) if self.share else powers(v[:, 0]) / FACTORIALS
                for c in range(1, v.shape[1]):
                    basis = products(basis, powers(v[:, c]) / FACTORIALS)
                got += np.exp(v[:, f:] @ delta.T - top + (self.w[rows] - 0.5 * (v[:, f:] ** 2).sum(1))[:, None]).T @ basis
            for (i, j), m, size in zip(who, got, top, strict=True):
                place[i][j], scale[i][j] = m, size
        for i, centre in enumerate(b):
            rows = np.concatenate([np.arange(self.start[s], self.start[s + 1]) for s in direct[i]]) if len(direct[i]) else np.zeros(0, int)
            self.moments[tuple(centre[f:].tolist())] = (heavy[i], place[i], scale[i], rows)
            self.cells += place[i].size

    def strips(self, b: np.ndarray) -> tuple:
        """The kept moments of the box around b, as (offsets, coefficients, log scales, rows): for shares, the moments of all boxes of equal offset
        after the normal distribution function took them to this box's nodes."""
        heavy, m, scale, rows = self.moments[tuple(b[self.first :].tolist())]
        if not self.share:
            return b - self.centre[heavy], m, scale, rows
        key = tuple(b.tolist())
        if key not in self.shares:
            offset, of = np.unique(b[1:] - self.centre[heavy, 1:], axis=0, return_inverse=True) if len(heavy) else (np.zeros((0, len(b) - 1)), np.zeros(0, int))
            of = of.ravel()
            top = np.full(len(offset), -np.inf)
            np.maximum.at(top, of, scale)
            got = np.zeros((len(offset), NODES, self.width // NODES))
            for j, s in enumerate(heavy.tolist()):
                gap = b[0] - self.centre[s, 0]
                phi = self.phi.get(gap)
                if phi is None:
                    phi = self.phi[gap] = normal_cdf(gap + ETA[:, None] - ETA[None])
                got[of[j]] += math.exp(scale[j] - top[of[j]]) * (phi @ m[j].reshape(NODES, -1))
            self.shares[key] = (offset, got.reshape(len(offset), self.width), top, rows)
            self.cells += got.size
        return self.shares[key]

    def at(self, b: np.ndarray, p: np.ndarray) -> np.ndarray:
        delta, coefficients, scale, rows = self.strips(b)
        out, f = np.empty(len(p)), self.first
        step = max(1, CELLS // max(self.width, len(rows)))
        for i in range(0, len(p), step):
            x = p[i : i + step]
            u = x - b
            parts = []
            if len(delta):
                basis = interpolation(u[:, 0]) if self.share else powers(u[:, 0])
                for c in range(1, u.shape[1]):
                    basis = products(basis, powers(u[:, c]))
                with np.errstate(divide="ignore"):
                    value = np.log(np.maximum(basis @ coefficients.T, 0))
                value += scale - 0.5 * (delta**2).sum(1) - u[:, f:] @ delta.T
                parts.append(log_sum_exp(value, 1) - 0.5 * (u[:, f:] ** 2).sum(1))
            if len(rows):
                parts.append(log_sum_exp(pairs(x, self.t[rows], self.w[rows], self.share), 1))
            out[i : i + step] = np.logaddexp.reduce(parts) if parts else -np.inf
        return out

    def logs(self, p: np.ndarray) -> np.ndarray:
        out = np.empty(len(p))
        if not len(p):
            return out
        centre, order, start = _boxes(p)
        own = np.ascontiguousarray(centre[:, self.first :])
        _, first, of = np.unique(own, axis=0, return_index=True, return_inverse=True)
        of = of.ravel()
        if self.cells > KEPT:
            self.moments, self.shares, self.phi, self.cells = {}, {}, {}, 0
        many = np.bincount(of, np.diff(start), minlength=len(first))
        known = np.array([tuple(own[i].tolist()) in self.moments for i in first])
        make = first[~known & (many >= WORTH)]
        # the moments of a few boxes at a time
        for i in range(0, len(make), 256):
            self.make(centre[make[i : i + 256]])
        known |= many >= WORTH
        for i in range(len(centre)):
            if known[of[i]]:
                rows = order[start[i] : start[i + 1]]
                out[rows] = self.at(centre[i], p[rows])
        rest = np.flatnonzero(~known[of])
        if len(rest):
            for i, some in zip(rest.tolist(), self.reach(centre[rest]), strict=True):
                rows = order[start[i] : start[i + 1]]
                there = np.concatenate([np.arange(self.start[s], self.start[s + 1]) for s in some])
                out[rows] = Plain(self.t[there], self.w[there], self.share).logs(p[rows])
        return out


def kernel_sums(t: np.ndarray, log_weight: np.ndarray | None = None, share: bool = False) -> Plain | BoxSums:
    """Sums over whitened rows, by boxes where these pay."""
    w = np.zeros(len(t)) if log_weight is None else np.asarray(log_weight, float)
    boxed = len(t) >= MANY and 1 <= t.shape[1] <= MAX_COLUMNS and np.isfinite(t).all() and np.isfinite(w).all()
    return BoxSums(t, w, share) if boxed else Plain(t, w, share)


def finite(sums: Callable[[np.ndarray], np.ndarray], p: np.ndarray) -> np.ndarray:
    """The sums of finite points; NaN for others."""
    out, ok = np.full(len(p), np.nan), np.isfinite(p).all(1)
    out[ok] = sums(p[ok])
    return out
