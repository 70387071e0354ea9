"""Special functions and distribution tails that p-values and Bayesian scores need, without scipy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

EPS = np.finfo(float).eps
#: Smallest variance or delta that counts as different from zero.
TOL = math.sqrt(EPS)
TINY = 1e-300


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    return 1.0 - gamma_q(a, x) if x >= a + 1 else _gamma_series(a, x)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if a <= 0 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    return 1.0 - _gamma_series(a, x) if x < a + 1 else _gamma_fraction(a, x)


def _gamma_series(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    for _ in range(100_000):
        k += 1
        term *= x / k
        total += term
        if abs(term) < abs(total) * EPS / 4:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > TINY else TINY)
            c = 1 + num / c
            c = c if abs(c) > TINY else TINY
            h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def gamma_sf(x: float, shape: float, scale: float) -> float:
    return gamma_q(shape, x / scale)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_i(df / 2, 0.5, df / (df + t * t))


def digamma(x: np.ndarray | float) -> np.ndarray | float:
    """Recurrence up to 6, then the asymptotic series."""
    v = np.array(x, float, copy=True)
    out = np.zeros_like(v)
    while (low := v < 10).any():
        out = np.where(low, out - 1 / np.where(low, v, 1), out)
        v = np.where(low, v + 1, v)
    i2 = 1 / (v * v)
    out = out + np.log(v) - 0.5 / v - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132))))
    return float(out) if np.ndim(x) == 0 else out


erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2)).astype(float)


def log_sum_exp(a: np.ndarray, axis: int = -1) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def nelder_mead(f: Callable[[list[np.ndarray]], list[float]], start: np.ndarray, ftol: float = 1e-4, xtol: float = 1e-4, limit: int = 1000, ahead: bool = False) -> tuple[np.ndarray, float]:
    """Downhill simplex with the usual coefficients (1, 2, 1/2, 1/2). `f` values many points at once; with `ahead` all that a step may ask for
    are valued together, which pays where a call is dear and more points in it are not."""
    d = len(start)
    pts = [np.array(start, float)]
    for i in range(d):
        p = np.array(start, float)
        p[i] = p[i] * 1.05 if p[i] else 0.00025
        pts.append(p)
    vals = list(f(pts))
    for _ in range(limit * d):
        order = np.argsort(vals, kind="stable")
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if max(abs(v - vals[0]) for v in vals) <= ftol * (1 + abs(vals[0])) and max(np.abs(p - pts[0]).max() for p in pts) <= xtol * (1 + np.abs(pts[0]).max()):
            break
        centre = np.mean(pts[:-1], axis=0)
        move = {k: centre + k * (centre - pts[-1]) for k in (1.0, 2.0, 0.5, -0.5)}
        known = dict(zip(move, f(list(move.values())), strict=True)) if ahead else {}
        value = lambda k: known[k] if k in known else f([move[k]])[0]  # noqa: B023, E731
        fr = value(1.0)
        if fr < vals[0]:
            fe = value(2.0)
            pts[-1], vals[-1] = (move[2.0], fe) if fe < fr else (move[1.0], fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = move[1.0], fr
        else:
            k = 0.5 if fr < vals[-1] else -0.5
            fc = value(k)
            if fc < min(fr, vals[-1]):
                pts[-1], vals[-1] = move[k], fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0], *f(pts[1:])]
    best = int(np.argmin(vals))
    return pts[best], vals[best]
