"""Nearest-neighbour mutual information of any number of rows.

Ranks come from one range shuffle. A k-d tree over a sample cuts the space into cells of similar numbers of points, and a cell is a group of a
job. The distance to the k-th neighbour is found in a point's own cell first; points whose ball leaves the cell ask the cells that it
touches, and the answers are merged. Ball counts in the spaces of some of the columns go the same way, over cells of those spaces; the
space of a single column needs none, since ranks are evenly spaced. Neither the driver nor a task sees more than a cell and the tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.kdtree import KDTree
from netloom.functions.special import digamma
from netloom.operators.durable import checkpointed
from netloom.operators.stats import rank_data, ranked
from netloom.sources.dataset import Dataset

#: Points of a cell, and sampled points for each cell.
CELL, SAMPLED = 20_000, 40


class Cells:
    """A space cut at medians of a sample until there are enough cells; the outer ones are unbounded."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # column and value of the cut, left and right; -1 and the cell's number for a leaf
        self.count = 0
        self._cut(sample, max(1, cells))

    def _cut(self, sample: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, self.count, 0))
        if cells > 1 and len(sample) > 1:
            c = int(np.argmax(sample.max(0) - sample.min(0)))
            v = float(np.median(sample[:, c]))
            left = sample[:, c] < v
            if left.any():
                a, b = self._cut(sample[left], cells // 2), self._cut(sample[~left], cells - cells // 2)
                self.nodes[me] = (c, v, a, b)
                return me
        self.count += 1
        return me

    def touched(self, x: np.ndarray, eps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Cells with the rows of x whose open ball of eps reaches into them; with eps 0 the cell that a row lies in."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            c, v, a, b = self.nodes[node]
            if c < 0:
                yield a, rows
                continue
            gap = x[rows, c] - v
            todo += [(a, rows[(gap < 0) | (gap < eps[rows])]), (b, rows[(gap >= 0) | (-gap < eps[rows])])]


def _cells(points: DataFrame, cols: Sequence[str], n: int) -> Cells:
    many = -(-n // CELL)
    size = SAMPLED * many
    rows = points.select(*cols).orderBy(F.xxhash64("_i")).limit(size) if many > 1 else None
    return Cells(np.array([tuple(r) for r in rows.collect()], float).reshape(-1, len(cols)) if rows is not None else np.zeros((0, len(cols))), many)


def _dealt(rows: DataFrame, cols: Sequence[str], cells: Cells, eps: str | None = None, own: bool = True) -> DataFrame:
    """The rows with `cell`: the one they lie in, or each that the ball of column `eps` touches (but their own, unless `own`)."""
    names = rows.columns
    at = [names.index(c) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy() for i in at]) if len(b) else np.zeros((0, len(at)))
            e = np.zeros(len(x)) if eps is None else b.column(names.index(eps)).to_numpy()
            home = np.full(len(x), -1)
            if not own:
                for cell, some in cells.touched(x, np.zeros(len(x))):
                    home[some] = cell
            for cell, some in cells.touched(x, e):
                some = some[home[some] != cell]
                if len(some):
                    part = b.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(some), cell, np.int32))], [*names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, cell int")


def _asked(points: DataFrame, queries: DataFrame, cols: Sequence[str], answer: Callable[[KDTree, np.ndarray, np.ndarray], pa.Array], kind: str) -> DataFrame:
    """(_i, a): what each cell's points answer to the queries (_i, columns, _eps) dealt to it."""
    arrow = pa.list_(pa.float64()) if kind.startswith("array") else pa.int64()

    def cell(p: pa.Table, q: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return pa.table({"_i": pa.array([], pa.int64()), "a": pa.array([], arrow)})
        x, y = (np.column_stack([t.column(c).to_numpy() for c in cols]) for t in (p, q))
        return pa.table({"_i": q.column("_i"), "a": answer(KDTree(x), y, q.column("_eps").to_numpy())})

    return points.groupBy("cell").cogroup(queries.groupBy("cell")).applyInArrow(cell, f"_i long, a {kind}")


def distances(points: DataFrame, cols: Sequence[str], k: int, n: int) -> DataFrame:
    """(_i, columns, _eps): each point's distance to its k-th neighbour, in the largest coordinate distance."""
    cells = _cells(points, cols, n)
    home = _dealt(points, cols, cells)

    def near(t: pa.Table) -> pa.Table:
        x = np.column_stack([t.column(c).to_numpy() for c in cols])
        m = min(k + 1, len(x))
        d = np.full((len(x), k + 1), np.inf)
        d[:, :m] = KDTree(x).neighbours(m)[0]
        lists = pa.ListArray.from_arrays(np.arange(0, d.size + 1, k + 1, dtype=np.int32), d.ravel())
        return pa.table({"_i": t.column("_i")} | {c: t.column(c) for c in cols} | {"_eps": d[:, k], "a": lists})

    first = checkpointed(home.groupBy("cell").applyInArrow(near, "_i long, " + ", ".join(f"{c} double" for c in cols) + ", _eps double, a array<double>"))
    if cells.count < 2:
        return first.drop("a")

    def nearest(tree: KDTree, y: np.ndarray, eps: np.ndarray) -> pa.Array:
        d = tree.query(y, min(k, len(tree.points)))[0]
        return pa.array([row[row < e] for row, e in zip(d, eps, strict=True)], pa.list_(pa.float64()))

    more = _asked(home.select("_i", *cols, "cell"), _dealt(first.drop("a"), cols, cells, "_eps", own=False), cols, nearest, "array<double>")
    best = first.select("_i", "a").unionByName(more).groupBy("_i").agg(F.element_at(F.sort_array(F.flatten(F.collect_list("a"))), k + 1).alias("_eps"))
    return first.select("_i", *cols).join(best, "_i")


def inside(balls: DataFrame, cols: Sequence[str], n: int, output: str) -> DataFrame:
    """(_i, output): the points strictly inside the ball of `_eps` of each point, itself included, over some of the columns."""
    if len(cols) == 1:
        r = F.col(cols[0])
        return balls.select("_i", (F.least(1 + r, "_eps") + F.least(n - r, "_eps") - 1).alias(output))
    cells = _cells(balls, cols, n)
    some = balls.select("_i", *cols, "_eps")
    count = lambda tree, y, eps: pa.array(tree.count_near(y, eps))
    got = _asked(_dealt(some.select("_i", *cols), cols, cells), _dealt(some, cols, cells, "_eps"), cols, count, "long")
    return got.groupBy("_i").agg(F.sum("a").cast("double").alias(output))


def ranked_points(data: Dataset, cols: Sequence[str]) -> DataFrame:
    """(_i, c0, c1, ...): the ranks of the valid rows in each column, ties by the other columns; _i is a row's place."""
    rows = data.df.where(Dataset.valid(cols)).select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = rows.columns
    placed = checkpointed(ranked(rows, names[0], names[1:], "_i"))
    return checkpointed(rank_data(Dataset(placed, names), ["_i"]).df)


def information(points: DataFrame, columns: int, k: int, n: int) -> float:
    """Mutual information of the first two columns given the others."""
    cols = [f"c{i}" for i in range(columns)]
    z = cols[2:]
    balls = checkpointed(distances(points, cols, k, n))
    terms = {"x": ["c0", *z], "y": ["c1", *z]} | ({"z": z} if z else {})
    out = balls.select("_i")
    for name, some in terms.items():
        out = out.join(inside(balls, some, n, name), "_i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [float(np.sum(digamma(b.column(b.schema.get_field_index(t)).to_numpy()))) for t in terms] if len(b) else [0.0] * len(terms)
            yield pa.RecordBatch.from_pydict({"s": [(s[2] if z else 0.0) - s[0] - s[1]]})

    mean = out.mapInArrow(run, "s double").agg(F.sum("s")).first()[0] / n
    return float(digamma(k) + mean + (0.0 if z else digamma(n)))


def permuted(points: DataFrame, columns: int, n: int, neighbours: int, seed: int, number: int, local: Callable) -> DataFrame:
    """The points with new ranks c0: any order without other columns; else each takes the value of a near point in these, chosen cell by cell."""
    cols = [f"c{i}" for i in range(columns)]
    if columns == 2:
        mixed = points.withColumn("_h", F.xxhash64("_i", F.lit(seed), F.lit(number)))
        return ranked(mixed, "_h", ["_i"], "_n").withColumn("c0", F.col("_n").cast("double")).drop("_h", "_n")
    z = cols[2:]
    cells = _cells(points, z, n)

    def cell(t: pa.Table) -> pa.Table:
        x = np.column_stack([t.column(c).to_numpy() for c in z])
        order = np.argsort(t.column("_i").to_numpy(), kind="stable")
        own = t.column("c0").to_numpy()[order]
        s = min(neighbours, len(x) - 1)
        near = KDTree(x[order]).neighbours(s + 1)[1]
        new = np.empty(len(x))
        new[order] = local(own, near, np.random.default_rng([seed, number, t.column("cell")[0].as_py()]))
        return t.set_column(t.schema.get_field_index("c0"), "c0", pa.array(new)).drop_columns(["cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    got = checkpointed(_dealt(points, z, cells).groupBy("cell").applyInArrow(cell, schema))
    return ranked(got, "c0", ["_i"], "_n").withColumn("c0", F.col("_n").cast("double")).drop("_n")
