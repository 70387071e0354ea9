"""Draws of dynamic networks: many series at a time, each row depending on the last."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from netloom.operators.factors import CKDE, CLinearGaussianCPD, DiscreteFactor, Factor, HCKDE, LinearGaussianCPD
from netloom.operators.temporal import temporal_name

#: Series of a block, which are drawn together, rows of them that are passed on at a time, and rows of a task's blocks, which it draws one after another.
BLOCK, ROWS, TASK_ROWS = 256, 65_536, 1 << 18


def codes(f: Factor, column: str, values: np.ndarray) -> np.ndarray:
    at = {v: i for i, v in enumerate(f.domains[column])}
    return np.array([at.get(v, -1) for v in values], np.int64)


def draw(f: Factor | None, cells: dict[str, np.ndarray], n: int, rng: np.random.Generator) -> np.ndarray:
    """n values given n rows of evidence; NaN (None for a discrete factor) where the evidence is missing or its configuration has no factor."""
    if isinstance(f, LinearGaussianCPD):
        mean = np.full(n, float(f.beta[0]))
        for b, e in zip(f.beta[1:], f.evidence(), strict=True):
            mean = mean + b * cells[e]
        return mean + math.sqrt(f.variance) * rng.standard_normal(n)
    if isinstance(f, CKDE):
        return f.sample_arrays({e: cells[e] for e in f.evidence()}, rng.random(n), rng.standard_normal(n))
    if isinstance(f, DiscreteFactor):
        u, at = rng.random(n), [codes(f, e, cells[e]) for e in f.evidence()]
        p = np.exp(f.logprob)[(slice(None), *at)] if at else np.repeat(np.exp(f.logprob)[:, None], n, 1)
        total = p.cumsum(0)
        k = np.minimum((total < u * total[-1]).sum(0), len(p) - 1)
        out = np.array(f.domains[f.variable()], object)[k]
        out[np.any([a < 0 for a in at], axis=0) if at else np.zeros(n, bool)] = None
        return out
    if isinstance(f, (CLinearGaussianCPD, HCKDE)):
        out = np.full(n, np.nan)
        at = np.stack([codes(f, c, cells[c]) for c in f.discrete], 1)
        for cfg in np.unique(at, axis=0):
            rows = np.flatnonzero((at == cfg).all(1))
            own = f.factors.get(tuple(int(x) for x in cfg))
            if own is not None:
                out[rows] = draw(own, {c: v[rows] for c, v in cells.items()}, len(rows), rng)
        return out
    raise ValueError(f"{type(f).__name__} cannot be drawn row by row")


def drawn(model, n: int, series: int, rng: np.random.Generator) -> Iterator[dict[str, np.ndarray]]:
    """The n rows of some series, row by row: the static network gives the first m, oldest first, the transition network the rest."""
    m, variables = model.markovian_order(), model.variables()
    first: dict[str, np.ndarray] = {}
    for v in model.static_bn().topological_sort():
        first[v] = draw(model.static_bn().cpd(v), first, series, rng)
    past = [{v: first[temporal_name(v, m - i)] for v in variables} for i in range(m)]
    yield from past[:n]
    order = model.transition_bn().topological_sort()
    for _ in range(n - m):
        now = {temporal_name(v, k): past[-k][v] for v in variables for k in range(1, m + 1)}
        for v in order:
            now[v] = draw(model.transition_bn().cpd(v), now, series, rng)
        past = [*past[1:], {v: now[temporal_name(v, 0)] for v in variables}]
        yield past[-1]


def draw_series(spark: SparkSession, model, n: int, series: int, seed: int, text: set[str]) -> DataFrame:
    """(series, t, variables): n rows of each series. A task draws some blocks of series; a block's random numbers depend on the seed and the block only,
    so a repeated task draws the same, whatever the number of tasks; nothing but the model goes through the driver."""
    if n < 0 or series < 0:
        raise ValueError("a negative sample size")
    variables = model.variables()
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    names = ["series", "t", *variables]
    types = [pa.int64(), pa.int64(), *[pa.string() if v in text else pa.float64() for v in variables]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(shared.value)
        for b in batches:
            for block in b.column(0).to_pylist():
                ids = np.arange(block * BLOCK, min(series, (block + 1) * BLOCK))
                held: list[list[np.ndarray]] = []
                for t, row in enumerate(drawn(model, n, len(ids), np.random.Generator(np.random.Philox(key=[seed % (1 << 64), block])))):
                    held.append([ids, np.full(len(ids), t), *[row[v] for v in variables]])
                    if len(held) * len(ids) >= ROWS:
                        yield packed(held)
                        held = []
                if held:
                    yield packed(held)

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(whole, types, strict=True)], names)

    blocks = -(-series // BLOCK)
    kinds = ", ".join(f"`{v}` {'string' if v in text else 'double'}" for v in variables)
    tasks = max(-(-series * n // TASK_ROWS), 2 * spark.sparkContext.defaultParallelism)
    return spark.range(0, blocks, 1, max(1, min(blocks, tasks))).mapInArrow(run, f"series long, t long, {kinds}")
