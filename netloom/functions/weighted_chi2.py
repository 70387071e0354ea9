"""Tails of weighted sums of chi-square variables with one degree of freedom each: Hall-Buckley-Eagleson and Lindsay-Pilla-Basak."""

from __future__ import annotations

import math

import numpy as np

from netloom.functions.special import gamma_sf


def hbe_complement(weights: np.ndarray, x: float) -> float:
    """A gamma variable matched to the first three cumulants."""
    w = np.asarray(weights, float)
    k1, k2, k3 = w.sum(), 2 * (w**2).sum(), 8 * (w**3).sum()
    nu = 8 * k2**3 / k3**2
    return gamma_sf(math.sqrt(2 * nu / k2) * (x - k1) + nu, nu / 2, 2.0)


def _moments(weights: np.ndarray, n: int) -> np.ndarray:
    """Raw moments 0..n from cumulants 2^(r-1) (r-1)! sum w^r."""
    kappa = [0.0] + [2.0 ** (r - 1) * math.factorial(r - 1) * float((weights**r).sum()) for r in range(1, n + 1)]
    m = [1.0]
    for r in range(1, n + 1):
        m.append(sum(math.comb(r - 1, i - 1) * kappa[i] * m[r - i] for i in range(1, r + 1)))
    return np.array(m)


def _scaled(m: np.ndarray, lam: float) -> np.ndarray:
    """Moments divided by those of a gamma variable's scale-free part: prod_{i<r} (1 + i lam)."""
    out, div = [m[0]], 1.0
    for r in range(1, len(m)):
        div *= 1 + (r - 1) * lam
        out.append(m[r] / div)
    return np.array(out)


def _matrix(m: np.ndarray, lam: float, size: int) -> np.ndarray:
    d = _scaled(m, lam)
    return np.array([[d[i + j] for j in range(size)] for i in range(size)])


def lpb4_complement(weights: np.ndarray, x: float) -> float:
    """A mixture of four gamma variables matched to eight moments. ValueError if the moments admit none."""
    w = np.asarray(weights, float)
    m = _moments(w, 8)
    lam = m[2] / m[1] ** 2 - 1
    for size in (3, 4, 5):
        sign = lambda v: float(np.linalg.det(_matrix(m, v, size)))  # noqa: B023, E731
        lo, hi = 0.0, lam
        flo, fhi = sign(lo), sign(hi)
        if not (math.isfinite(flo) and math.isfinite(fhi)) or flo * fhi > 0:
            raise ValueError("no root for the common shape")
        for _ in range(200):
            mid = (lo + hi) / 2
            if hi - lo < 1e-14 * max(1.0, hi):
                break
            if flo * sign(mid) > 0:
                lo = mid
            else:
                hi = mid
        lam = (lo + hi) / 2
    d = _scaled(m, lam)
    # the polynomial orthogonal to 1, t, t^2, t^3 under the matched moments
    a = np.array([[d[i + j] for j in range(4)] for i in range(4)])
    coef = np.linalg.solve(a, -d[4:8])
    mu = np.roots(np.concatenate([[1.0], coef[::-1]])).real
    share = np.linalg.solve(np.vander(mu, 4, increasing=True).T, d[:4])
    if not (np.isfinite(mu).all() and np.isfinite(share).all()) or (mu <= 0).any() or lam <= 0:
        raise ValueError("moments admit no mixture")
    return float(sum(s * gamma_sf(x, 1 / lam, u * lam) for s, u in zip(share, mu, strict=True)))
