"""Seeded samples: chains of normals, dependent categories, and both."""

import numpy as np
import pandas as pd


def normal(n, seed=0):
    """A chain with a shortcut: a drives b, b drives c, and a, b and c drive d."""
    r = np.random.default_rng(seed)
    a = 10 * r.standard_normal(n) / 7 - 1
    b = 0.8 * a + 1.2 * r.standard_normal(n)
    c = 6 + 2 * b - 0.7 * a + 0.6 * r.standard_normal(n)
    d = 0.4 * c - 1.5 * b + 2.2 * a - 3 + 0.9 * r.standard_normal(n)
    return pd.DataFrame({"a": a, "b": b, "c": c, "d": d})


def with_nulls(df, k=40, seed=1):
    r, out = np.random.default_rng(seed), df.copy()
    for c in out.columns:
        out.loc[r.choice(len(out), k, replace=False), c] = None if out[c].dtype == object else np.nan
    return out


def categories(n, seed=0):
    """Three categories: B copies a coin for A's first level and is never b3 for its second; C tells whether A and B agree, with errors."""
    r = np.random.default_rng(seed)
    first = r.random(n) < 0.6
    u = r.random(n)
    b = np.select([first & (u < 0.5), first & (u < 0.8), first, u < 0.35], ["b1", "b2", "b3", "b1"], "b2")
    right = r.random(n) < 0.85
    c = np.where((first == (b != "b2")) == right, "c1", "c2")
    return pd.DataFrame({"A": np.where(first, "a1", "a2"), "B": b, "C": c})


def hybrid(n, seed=0):
    """Categories A and B, an independent X, and Y with a line and a level for each configuration."""
    r, df = np.random.default_rng(seed + 1000), categories(n, seed)
    x = 2 + 1.5 * r.standard_normal(n)
    level = 4 * (df["A"] == "a2").to_numpy() - 2.5 * (df["B"] == "b2").to_numpy() + 5 * (df["B"] == "b3").to_numpy()
    slope = np.where(df["A"] == "a1", 1.1, 0.7)
    return df[["A", "B"]].assign(X=x, Y=level + slope * x + 0.6 * r.standard_normal(n))


def lstsq(df, y, xs):
    d = df[[y, *xs]].dropna()
    m = np.column_stack([np.ones(len(d)), *[d[x] for x in xs]])
    b = np.linalg.lstsq(m, d[y].to_numpy(), rcond=None)[0]
    rss = ((d[y] - m @ b) ** 2).sum()
    return b, rss / (len(d) - len(xs) - 1)


def normal_logpdf(x, mu, var):
    return -0.5 * (x - mu) ** 2 / var - 0.5 * np.log(2 * np.pi * var)
