"""Kernel sums over training rows that are a table.

Scored points and training rows are dealt to blocks of bounded size by hash, and a cell pairs a block of points with a block of training
rows. Points meet every training block that concerns them: copies of a point are one point and copies of a training row one row with a
weight, so what is paired are different rows only. A cell gives a logarithm of a sum for each of its points, and the cells of a point
add up. Neither the driver nor a task holds more than its block, and the result goes back to the rows by the points' values.

Points and training rows may belong to groups (configurations of discrete parents), which meet only their own, and to folds, which meet only
others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.special import log_sum_exp
from netloom.operators.box_sums import MAX_COLUMNS, exponents, finite, kernel_sums
from netloom.operators.durable import checkpointed
from netloom.operators.stats import col

#: Rows of a block of points and of training rows where boxes sum (operators.box_sums) and where every pair is looked at, fewest points of a block, cells of
#: a distance tile.
POINTS, TRAINING, PAIR_POINTS, PAIR_TRAINING, FEWEST, TILE = 1 << 18, 1 << 19, 1 << 14, 1 << 16, 1 << 12, 2_000_000
LOG_2PI = math.log(2 * math.pi)


@dataclass
class Kernel:
    """A normal kernel over d columns with the rows' mean (for centring), its bandwidth (a matrix, or a vector of variances) and the number of rows."""

    mean: np.ndarray
    bandwidth: np.ndarray
    n: int
    root: np.ndarray = field(init=False)
    log_root: float = field(init=False)

    def __post_init__(self):
        self.root = np.sqrt(self.bandwidth) if self.bandwidth.ndim == 1 else np.linalg.cholesky(self.bandwidth)
        self.log_root = float(np.log(self.root if self.root.ndim == 1 else np.diag(self.root)).sum())

    def white(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        return x / self.root if self.root.ndim == 1 else np.linalg.solve(self.root, x.T).T

    def constant(self) -> float:
        return -self.log_root - 0.5 * len(self.mean) * LOG_2PI - math.log(self.n)

    def marginal(self) -> Kernel:
        """Without the first column."""
        h = self.bandwidth[1:, 1:] if self.bandwidth.ndim == 2 else self.bandwidth[1:]
        return Kernel(self.mean[1:], h, self.n)

    def conditional(self) -> tuple[np.ndarray, float]:
        """Regression of the first column on the others inside a kernel, and its deviation."""
        h = self.bandwidth
        k = np.linalg.solve(h[1:, 1:], h[1:, 0]) if len(h) > 1 else np.zeros(0)
        return k, math.sqrt(max(h[0, 0] - h[0, 1:] @ k, 0.0))


class Density:
    """Log density: one sum. `over(kernel, rows, log weights)` gives the function from points to the logs of their sums, which keeps what
    it found out about the rows."""

    terms = 1

    def over(self, k: Kernel, t: np.ndarray, log_weight: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        s = kernel_sums(k.white(t), log_weight)
        return lambda p: finite(s.logs, k.white(p))[:, None]

    def result(self, k: Kernel, logs: np.ndarray) -> np.ndarray:
        return logs[:, 0] + k.constant()


class Conditional(Density):
    """Log density of the first column given the others: the sums of the joint and of the marginal kernel."""

    terms = 2

    def over(self, k, t, log_weight):
        joint = super().over(k, t, log_weight)
        if len(k.mean) == 1:
            return lambda p: np.concatenate([joint(p), np.zeros((len(p), 1))], 1)
        marginal = super().over(k.marginal(), t[:, 1:], log_weight)
        return lambda p: np.concatenate([joint(p), marginal(p[:, 1:])], 1)

    def result(self, k, logs):
        if len(k.mean) == 1:
            return logs[:, 0] + k.constant()
        return logs[:, 0] + k.constant() - logs[:, 1] - k.marginal().constant()


class Distribution:
    """Conditional distribution function of the first column: kernels weighted by the evidence, with and without their share below the point."""

    terms = 2

    def over(self, k: Kernel, t: np.ndarray, log_weight: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        b, sd = k.conditional()
        m = k.marginal() if len(b) else None

        def white(x: np.ndarray) -> np.ndarray:
            """What is left of the first column in its deviations, and the whitened evidence."""
            left = (x[:, :1] - k.mean[0] - ((x[:, 1:] - k.mean[1:]) @ b)[:, None]) / sd
            return left if m is None else np.concatenate([left, m.white(x[:, 1:])], 1)

        t = white(t)
        below = kernel_sums(t, log_weight, share=True)
        if m is None:
            whole = log_sum_exp(log_weight) if len(t) else -np.inf
            return lambda p: np.column_stack([finite(below.logs, white(p)), np.full(len(p), whole)])
        evidence = kernel_sums(t[:, 1:], log_weight)

        def logs(p: np.ndarray) -> np.ndarray:
            p = white(p)
            return np.column_stack([finite(below.logs, p), finite(evidence.logs, p[:, 1:])])

        return logs

    def result(self, k: Kernel, logs: np.ndarray) -> np.ndarray:
        return np.exp(logs[:, 0] - logs[:, 1])


def fold_sums(what, kernels: dict, group: int, p: np.ndarray, p_fold: np.ndarray | None, t: np.ndarray, t_fold: np.ndarray | None, log_weight: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Logs of the sums of each point of one group over training rows of the group; with folds over those of other folds, by the kernel of
    the point's fold. NaN where the group (and fold) has no kernel. `kept` holds the sums over the same rows from one call to the next."""
    out, kept = np.full((len(p), what.terms), np.nan), {} if kept is None else kept
    for f in [None] if p_fold is None else np.unique(p_fold).tolist():
        k = kernels.get((group, f))
        if k is None:
            continue
        rows = slice(None) if f is None else np.flatnonzero(p_fold == f)
        if (group, f) not in kept:
            use = slice(None) if f is None else t_fold != f
            kept[group, f] = what.over(k, t[use], log_weight[use]) if len(log_weight[use]) else None
        over = kept[group, f]
        out[rows] = -np.inf if over is None else over(p[rows])
    return out


def finished(what, kernels: dict, group: np.ndarray, fold: np.ndarray | None, logs: np.ndarray) -> np.ndarray:
    """Results from the whole sums, by each row's kernel; NaN where there is none."""
    out = np.full(len(logs), np.nan)
    code = group if fold is None else group * (int(fold.max(initial=0)) + 1) + fold
    for c in np.unique(code).tolist():
        rows = np.flatnonzero(code == c)
        k = kernels.get((int(group[rows[0]]), None if fold is None else int(fold[rows[0]])))
        if k is not None:
            out[rows] = what.result(k, logs[rows])
    return out


def _named(df: DataFrame, columns: Sequence[str], group: Column | None, fold: Column | None) -> DataFrame:
    values = [col(c) + F.lit(0.0) for c in columns]  # -0 becomes 0
    return df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)], (F.lit(0) if group is None else group).cast("int").alias("g"), (F.lit(-1) if fold is None else fold).cast("int").alias("f"))


class TrainingTable:
    """Training rows as a table of different rows (v0, ..., g, f) with their weight w."""

    def __init__(self, df: DataFrame, columns: Sequence[str], group: Column | None = None, fold: Column | None = None):
        named = _named(df, columns, group, fold).na.drop()
        self.d, self.folds = len(columns), fold is not None
        self.rows = named.groupBy(*named.columns).agg(F.count("*").alias("w"))
        self._sizes: dict[int, int] | None = None

    def expanded(self, names: Sequence[str]) -> DataFrame:
        """The rows as often as they occur."""
        each = self.rows.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w"))))
        return each.select(*[F.col(f"v{i}").alias(n) for i, n in enumerate(names)])

    def sizes(self) -> dict[int, int]:
        """Different rows by group."""
        if self._sizes is None:
            self._sizes = {r[0]: r[1] for r in self.rows.groupBy("g").count().collect()}
        return self._sizes


def _meet(points: DataFrame, training: TrainingTable, cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by: Sequence[str] = (), boxed: bool = True) -> DataFrame:
    """cell(points, training rows) of every pair of blocks of one group. Points are dealt by their values, or by the columns `by`. `boxed`: the cell sums by
    boxes, if the columns allow it."""
    spark, d = points.sparkSession, training.d
    many = {r[0]: r[1] for r in points.groupBy("g").count().collect()}
    boxed = boxed and d <= MAX_COLUMNS
    most, rows = (POINTS, TRAINING) if boxed else (min(POINTS, PAIR_POINTS), min(TRAINING, PAIR_TRAINING))
    # blocks are small enough for every core to get some
    most = max(1, min(most, max(FEWEST, -(-sum(many.values()) // (2 * spark.sparkContext.defaultParallelism)))))
    # one row a group: how many blocks its points and its training rows make
    split = [(g, -(-many.get(g, 1) // most), -(-n // rows)) for g, n in training.sizes().items()]
    cells = max(1, min(sum(a * c for _, a, c in split), 10_000))
    split = spark.createDataFrame(split, "g int, a long, c long")
    split = F.broadcast(split) if len(training.sizes()) <= 100_000 else split
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(1 << 40))
    values = [f"v{i}" for i in range(d)]
    p = points.join(split, "g").withColumn("pa", place(by or values) % F.col("a")).withColumn("tc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).drop("a", "c")
    t = training.rows.join(split, "g").withColumn("tc", place(values) % F.col("c")).withColumn("pa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1))).drop("a", "c")
    # the number of partitions is given, since cells are much work for few bytes
    p, t = (x.repartition(cells, "g", "pa", "tc").groupBy("g", "pa", "tc") for x in (p, t))
    return p.cogroup(t).applyInArrow(cell, schema)


def _matrix(t: pa.Table, d: int) -> np.ndarray:
    return np.column_stack([t.column(f"v{i}").to_numpy() for i in range(d)]) if t.num_rows else np.zeros((0, d))


def _log_sum(c: str) -> Column:
    """Logarithm of the sum of the exponentials in an array column."""
    top = F.array_max(c)
    rest = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(c)))
    return F.when(top == float("-inf"), top).otherwise(top + F.log(rest))


def score_against(df: DataFrame, columns: Sequence[str], training: TrainingTable, what, kernels: dict, output: str, group: Column | None = None, fold: Column | None = None) -> DataFrame:
    """`df` with the result of `what` in `output`; null for rows with a null, of no group, or whose group (and fold) has no kernel."""
    d, key = training.d, [f"v{i}" for i in range(training.d)]
    points = _named(df, columns, group, fold).na.drop().distinct()
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((what, kernels)))
    folds, logs = training.folds, [f"l{i}" for i in range(what.terms)]
    doubles = ", ".join(f"{c} double" for c in key)

    def cell(p: pa.Table, t: pa.Table) -> pa.Table:
        what, kernels = cloudpickle.loads(shared.value)
        if not p.num_rows or not t.num_rows:
            return pa.table({c: pa.array([], pa.float64()) for c in [*key, *logs]} | {c: pa.array([], pa.int32()) for c in ("g", "f")}).select([*key, "g", "f", *logs])
        fold_of = lambda x: x.column("f").to_numpy() if folds else None
        got = fold_sums(what, kernels, int(p.column("g")[0].as_py()), _matrix(p, d), fold_of(p), _matrix(t, d), fold_of(t), np.log(t.column("w").to_numpy().astype(float)))
        return pa.table({c: p.column(c) for c in [*key, "g", "f"]} | {c: pa.array(got[:, i]) for i, c in enumerate(logs)})

    parts = _meet(points, training, cell, f"{doubles}, g int, f int, " + ", ".join(f"{c} double" for c in logs))
    # the sums of a point's cells: as many numbers as there are training blocks
    both = parts.groupBy(*key, "g", "f").agg(*[F.collect_list(c).alias(c) for c in logs])
    whole = both.select(*key, "g", "f", *[_log_sum(c).alias(c) for c in logs])

    def finish(batches):
        what, kernels = cloudpickle.loads(shared.value)
        for b in batches:
            n = len(key)
            g, f = b.column(n).to_numpy(), b.column(n + 1).to_numpy() if folds else None
            r = finished(what, kernels, g, f, np.column_stack([b.column(n + 2 + i).to_numpy(zero_copy_only=False) for i in range(len(logs))])) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 2], pa.array(r, pa.float64(), mask=np.isnan(r))], [*key, "g", "f", "_r"])

    scores = whole.mapInArrow(finish, f"{doubles}, g int, f int, _r double")
    named = df.withColumn("_k", F.struct(*[(col(c) + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)], (F.lit(0) if group is None else group).cast("int").alias("g"), (F.lit(-1) if fold is None else fold).cast("int").alias("f")))
    out = named.join(scores.withColumn("_k", F.struct(*key, "g", "f")).select("_k", F.col("_r").alias(output)), "_k", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{output}`"))


def fold_total(df: DataFrame, columns: Sequence[str], what, kernels: dict, group: Column | None, fold: Column, small: Callable[[int, int], bool]) -> float:
    """Sum over the rows of `what` under a fit to the other folds, in one pass: each row has the sums over training rows of other folds by its own
    fold's kernel. `small(rows, columns)` says whether the rows may be a matrix that every task gets; else blocks of them meet."""
    d = len(columns)
    named = _named(df, columns, group, fold).na.drop()
    if not small(named.count(), d + 2):
        got = score_against(df, columns, TrainingTable(df, columns, group, fold), what, kernels, "_r", group, fold)
        return float(got.agg(F.sum("_r")).first()[0] or 0.0)
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((what, kernels, named.toArrow())))

    def run(batches):
        what, kernels, t = cloudpickle.loads(shared.value)
        train, tg, tf = _matrix(t, d), t.column("g").to_numpy(), t.column("f").to_numpy()
        total, kept = 0.0, {}
        for b in batches:
            p, g, f = np.column_stack([b.column(i).to_numpy() for i in range(d)]), b.column(d).to_numpy(), b.column(d + 1).to_numpy()
            for one in np.unique(g).tolist():
                own, rows = np.flatnonzero(tg == one), np.flatnonzero(g == one)
                logs = fold_sums(what, kernels, one, p[rows], f[rows], train[own], tf[own], np.zeros(len(own)), kept)
                total += float(np.nansum(finished(what, kernels, g[rows], f[rows], logs)))
        yield pa.RecordBatch.from_pydict({"total": [total]})

    # few bytes may be much work; rows that lie together ask the same boxes
    spread = named.repartitionByRange(named.sparkSession.sparkContext.defaultParallelism, *named.columns)
    out = float(spread.mapInArrow(run, "total double").agg(F.sum("total")).first()[0] or 0.0)
    shared.destroy()
    return out


def noise(i: np.ndarray, rows: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel numbers for pairs of draws (numbers) and training rows (their values): a function of both, whatever block they meet in."""

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    with np.errstate(over="ignore"):
        own = np.zeros(len(rows), np.uint64)
        for c in range(rows.shape[1]):
            own = mixed(own * np.uint64(3) + np.ascontiguousarray(rows[:, c]).view(np.uint64))
        pair = mixed(mixed(i.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))[:, None] + own[None])
    u = ((pair >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def sample_against(df: DataFrame, evidence: Sequence[str], training: TrainingTable, kernels: dict, output: str, seed: int, group: Column | None = None) -> DataFrame:
    """`df` with a draw of the kernels' first column given the evidence in `output`. The kernel of a draw is the one of largest log weight
    plus Gumbel noise, which blocks can find apart."""
    d = training.d
    rows = checkpointed(df.withColumn("_i", F.monotonically_increasing_id()).withColumn("_z", F.randn(seed + 1)))
    points = rows.select(F.col("_i"), F.lit(0.0).alias("v0"), *[(col(e) + F.lit(0.0)).alias(f"v{i + 1}") for i, e in enumerate(evidence)], (F.lit(0) if group is None else group).cast("int").alias("g"), F.lit(-1).alias("f")).na.drop()
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(kernels))
    out = ["_i", "best", "mean"]

    def cell(p: pa.Table, t: pa.Table) -> pa.Table:
        k = cloudpickle.loads(shared.value).get((int((p if p.num_rows else t).column("g")[0].as_py()), None))
        if k is None or not p.num_rows or not t.num_rows:
            return pa.table({"_i": pa.array([], pa.int64()), "best": pa.array([], pa.float64()), "mean": pa.array([], pa.float64())})
        x, y, w, i = _matrix(p, d), _matrix(t, d), np.log(t.column("w").to_numpy().astype(float)), p.column("_i").to_numpy()
        b, _ = k.conditional()
        best, mean = np.empty(len(x)), np.empty(len(x))
        step = max(1, TILE // len(y))
        m = k.marginal() if len(b) else None
        for at in range(0, len(x), step):
            s = slice(at, at + step)
            score = w + noise(i[s], y, seed)
            if m is not None:
                score = score + exponents(m.white(x[s, 1:]), m.white(y[:, 1:]))
            j = score.argmax(1)
            best[s] = score[np.arange(len(j)), j]
            mean[s] = y[j, 0] + (x[s, 1:] - y[j, 1:]) @ b
        return pa.table({"_i": i, "best": best, "mean": mean}).select(out)

    # draws of equal evidence are different points, so their numbers deal them
    found = _meet(points, training, cell, "_i long, best double, mean double", ["_i"], False).groupBy("_i").agg(F.max_by("mean", "best").alias("_m"))
    sds = {g: k.conditional()[1] for (g, _), k in kernels.items()}
    code = (F.lit(0) if group is None else group).cast("int")
    table = df.sparkSession.createDataFrame([(int(g), float(s)) for g, s in sds.items()] or [(0, 0.0)], "_g int, _sd double")
    got = rows.withColumn("_g", code).join(F.broadcast(table) if len(sds) <= 100_000 else table, "_g", "left").join(found, "_i", "left")
    return got.withColumn(output, F.col("_m") + F.col("_sd") * F.col("_z")).drop("_i", "_z", "_g", "_m", "_sd")


def pair_table_sums(training: TrainingTable, scales: Sequence[np.ndarray]) -> list[float]:
    """For each scale (a Cholesky factor or a vector of deviations) the sum over unordered pairs of training rows of the normal kernel without
    its constant. Blocks meet in a triangle: block a with block c >= a, each pair of rows once."""
    n, d = sum(training.sizes().values()), training.d
    blocks = -(-n // (TRAINING if d <= MAX_COLUMNS else min(TRAINING, PAIR_TRAINING)))
    here = F.pmod(F.xxhash64(*[f"v{i}" for i in range(d)]), F.lit(blocks))
    rows = training.rows.withColumn("b", here)
    left = rows.withColumn("c", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1).cast("long")))).withColumn("a", F.col("b"))
    right = rows.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b")))).withColumn("c", F.col("b"))
    names = [f"s{i}" for i in range(len(scales))]
    roots = [np.asarray(s, float) for s in scales]

    def cell(p: pa.Table, t: pa.Table) -> pa.Table:
        sums = np.zeros(len(roots))
        if p.num_rows and t.num_rows:
            x, y, u, w = _matrix(p, d), _matrix(t, d), p.column("w").to_numpy().astype(float), t.column("w").to_numpy().astype(float)
            same = p.column("a")[0].as_py() == p.column("c")[0].as_py()
            centre = y.mean(0)
            for k, root in enumerate(roots):
                white = lambda m, root=root: (m - centre) / root if root.ndim == 1 else np.linalg.solve(root, (m - centre).T).T
                total = float(u @ np.exp(kernel_sums(white(y), np.log(w)).logs(white(x))))
                # inside a block each pair is there twice, and a row with itself u * u times instead of u * (u - 1) / 2
                sums[k] = (total - u.sum()) / 2 if same else total
        return pa.table({c: pa.array([v]) for c, v in zip(names, sums, strict=True)})

    got = left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(cell, ", ".join(f"{c} double" for c in names))
    return [float(v or 0.0) for v in got.agg(*[F.sum(c) for c in names]).first()]
