"""Independence tests: partial correlation, chi-square, hybrid mutual information, nearest-neighbour mutual information and
random Fourier features. Statistics come from Spark; p-values and small algebra are the driver's."""

from __future__ import annotations

import itertools
import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.kdtree import KDTree
from netloom.functions.rank_points import count_squares, kth_distances
from netloom.functions.special import TOL, chi2_sf, digamma, t_two_sided
from netloom.functions.weighted_chi2 import hbe_complement, lpb4_complement
from netloom.operators import neighbours
from netloom.operators.durable import checkpointed
from netloom.operators.kde import training_matrix
from netloom.operators.stats import Moments, SuffStats, col, median_distance
from netloom.operators.temporal import DynamicDataFrame
from netloom.sources.dataset import Dataset


#: Tasks' sums meet in so many groups before they meet by set.
MEETING = 64


def as_list(z: str | Sequence[str] | None) -> list[str]:
    return [] if z is None else [z] if isinstance(z, str) else list(z)


class IndependenceTest(ABC):
    """Subclass with variables and pvalue."""

    @abstractmethod
    def variables(self) -> list[str]: ...

    @abstractmethod
    def pvalue(self, x: str, y: str, z: str | Sequence[str] | None = None) -> float: ...

    def pvalues(self, triples: Sequence[tuple[str, str, Sequence[str]]]) -> list[float]:
        """Many tests at once; tests that read data for each call override it to batch them."""
        return [self.pvalue(*t) for t in triples]

    def variable_names(self) -> list[str]:
        return self.variables()

    def num_variables(self) -> int:
        return len(self.variables())

    def name(self, i: int) -> str:
        return self.variables()[i]

    def has_variables(self, names) -> bool:
        return set([names] if isinstance(names, str) else names) <= set(self.variables())


class TestTable(IndependenceTest):
    """Tests that are known already, as rows (x, y, z, p): learners read them, whoever computed them. With `behind`, a test that is not there is
    done by that test object and becomes a row."""

    def __init__(self, variables: Sequence[str], rows=(), behind: IndependenceTest | None = None):
        self._variables, self.behind = list(variables), behind
        rows = rows.select("x", "y", "z", "p").collect() if isinstance(rows, DataFrame) else rows
        self.known = {self._key(x, y, z): (x, y, sorted(z), p) for x, y, z, p in rows}

    @staticmethod
    def _key(x: str, y: str, z: Sequence[str]) -> tuple[frozenset, frozenset]:
        return frozenset((x, y)), frozenset(as_list(z))

    @classmethod
    def recording(cls, test: IndependenceTest) -> TestTable:
        return cls(test.variable_names(), (), test)

    def variables(self):
        return list(self._variables)

    def pvalue(self, x, y, z=None):
        return self.pvalues([(x, y, as_list(z))])[0]

    def pvalues(self, triples):
        new = {self._key(*t): t for t in triples if self._key(*t) not in self.known}
        if new:
            if self.behind is None:
                raise KeyError(f"the table lacks the test {next(iter(new.values()))}")
            for t, p in zip(new.values(), self.behind.pvalues(list(new.values())), strict=True):
                self.known[self._key(*t)] = (t[0], t[1], sorted(as_list(t[2])), p)
        return [self.known[self._key(*t)][3] for t in triples]

    def table(self, spark) -> DataFrame:
        """The rows (x, y, z, p), x before y."""
        rows = [(*sorted((x, y)), z, float(p)) for x, y, z, p in self.known.values()]
        return spark.createDataFrame(rows, "x string, y string, z array<string>, p double")


class _DataTest(IndependenceTest):
    def __init__(self, data):
        self.data = Dataset.of(data)
        self.stats = SuffStats(self.data)


class LinearCorrelation(_DataTest):
    """t test of the partial correlation, n - 2 - |Z| degrees of freedom."""

    def __init__(self, data):
        super().__init__(data)
        if len(self.data.continuous) < 2:
            raise ValueError("partial correlation needs two continuous columns")

    def variables(self):
        return list(self.data.continuous)

    def correlation(self, x, y, z=None) -> tuple[float, float]:
        """Partial correlation and degrees of freedom."""
        z = as_list(z)
        m = self.stats.moments([x, y, *z])
        df = m.n - 2 - len(z)
        cov = m.cov
        if z:
            w, v = np.linalg.eigh(cov)
            keep = w > w[-1] * len(w) * np.finfo(float).eps
            inv = (v[:, keep] / w[keep]) @ v[:, keep].T
            r = -inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1]) if inv[0, 0] > 0 and inv[1, 1] > 0 else 0.0
        else:
            s = math.sqrt(cov[0, 0] * cov[1, 1])
            r = cov[0, 1] / s if s >= TOL * TOL else 0.0
        return float(np.clip(r, -1, 1)), df

    def pvalue(self, x, y, z=None):
        r, df = self.correlation(x, y, z)
        if df <= 0:
            return math.nan
        return t_two_sided(r * math.sqrt(df) / math.sqrt(1 - r * r) if abs(r) < 1 else math.inf, df)

    def pvalues(self, triples):
        self.stats.prefetch([[x, y, *z] for x, y, z in triples])
        return super().pvalues(triples)


class ChiSquare(_DataTest):
    """Pearson's test, (rx - 1)(ry - 1) prod rz degrees of freedom."""

    def variables(self):
        return list(self.data.discrete)

    def statistic(self, x, y, z=None) -> tuple[float, int]:
        z = as_list(z)
        c = self.stats.counts([x, y, *z]).astype(float)
        rx, ry = c.shape[:2]
        c = c.reshape(rx, ry, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            e = c.sum(1, keepdims=True) * c.sum(0, keepdims=True) / c.sum((0, 1), keepdims=True)
            stat = np.nansum(np.where(e > 0, (c - e) ** 2 / e, 0))
        return float(stat), (rx - 1) * (ry - 1) * c.shape[2]

    def pvalue(self, x, y, z=None):
        stat, df = self.statistic(x, y, z)
        return 1.0 if stat < TOL or df == 0 else chi2_sf(stat, df)


def gaussian_entropy(cov: np.ndarray) -> float:
    d = len(cov)
    if not d:
        return 0.0
    sign, logdet = np.linalg.slogdet(cov)
    return 0.5 * d * (1 + math.log(2 * math.pi)) + 0.5 * logdet if sign > 0 else -math.inf


class MutualInformation(_DataTest):
    """Mixed discrete and Gaussian mutual information, 2 N MI against chi-square. A configuration of too few rows for its covariance makes
    the value NaN, and with it the p-value (learners keep the edge)."""

    def __init__(self, data, asymptotic_df: bool = True):
        super().__init__(data)
        self.asymptotic_df = asymptotic_df

    def variables(self):
        return self.data.columns

    def _levels(self, discrete: Sequence[str], cont: Sequence[str]):
        """Moments by configuration, and a function that gives those of a coarser grouping over fewer columns."""
        if discrete:
            base = self.stats.grouped(discrete, cont) if cont else {k: Moments([], int(v), np.zeros(0), np.zeros((0, 0))) for k, v in np.ndenumerate(self.stats.counts(discrete)) if v}
        else:
            base = {(): self.stats.moments(cont)}

        def level(by: Sequence[str], cols: Sequence[str]) -> dict[tuple, Moments]:
            at, out = [list(discrete).index(b) for b in by], {}
            for k, m in base.items():
                key = tuple(k[i] for i in at)
                m = m.take(cols)
                out[key] = out[key] + m if key in out else m
            return out

        return sum(m.n for m in base.values()), level

    @staticmethod
    def _entropy(groups: dict[tuple, Moments], n: int) -> float:
        """Sum of p h over groups."""
        total = 0.0
        for m in groups.values():
            if not m.cols:
                continue
            if m.n <= 1:
                return math.nan
            h = gaussian_entropy(m.cov)
            if math.isinf(h):
                return math.nan
            total += m.n / n * h
        return total

    @staticmethod
    def _plogp(groups: dict[tuple, Moments], n: int) -> float:
        return sum(m.n / n * math.log(m.n / n) for m in groups.values() if m.n)

    def mi(self, x: str, y: str, z: str | Sequence[str] | None = None) -> float:
        return self._mi(x, y, as_list(z))[0]

    def _mi(self, x, y, z) -> tuple[float, int]:
        d = self.data
        zd, zc = [v for v in z if d.is_discrete(v)], [v for v in z if not d.is_discrete(v)]
        if d.is_discrete(y) and not d.is_discrete(x):
            x, y = y, x
        dx, dy = d.is_discrete(x), d.is_discrete(y)
        disc = ([x] if dx else []) + ([y] if dy else []) + zd
        cont = ([] if dx else [x]) + ([] if dy else [y]) + zc
        n, level = self._levels(disc, cont)
        h = lambda by, cols: self._entropy(level(by, cols), n)
        if dx and dy:
            p = lambda by: self._plogp(level(by, []), n)
            v = p([x, y, *zd]) - p([x, *zd]) - p([y, *zd]) + p(zd)
            if zc:
                v += -h([x, y, *zd], zc) + h([x, *zd], zc) + h([y, *zd], zc) - h(zd, zc)
                v = max(v, 0.0) if not math.isnan(v) else v
        elif dx:
            v = -h([x, *zd], [y, *zc]) + h([x, *zd], zc) + h(zd, [y, *zc]) - h(zd, zc)
            v = max(v, 0.0) if not math.isnan(v) else v
        else:
            v = h(zd, [x, *zc]) + h(zd, [y, *zc]) - h(zd, [x, y, *zc]) - h(zd, zc)
            v = max(v, 0.0) if not math.isnan(v) else v
        return float(v), n

    def df(self, x: str, y: str, z: str | Sequence[str] | None = None) -> int:
        d, z = self.data, as_list(z)
        zc = sum(not d.is_discrete(v) for v in z)
        llz = math.prod(d.cardinality(v) for v in z if d.is_discrete(v))
        dx, dy = d.is_discrete(x), d.is_discrete(y)
        if dx and dy:
            extra = zc * (zc + 3) // 2 if self.asymptotic_df else zc * (zc + 1) // 2
            return (d.cardinality(x) - 1) * (d.cardinality(y) - 1) * llz * (1 + extra)
        if dx or dy:
            r = d.cardinality(x if dx else y)
            return (r - 1) * llz * (zc + 2 if self.asymptotic_df else zc + 1)
        return llz

    def pvalue(self, x, y, z=None):
        v, n = self._mi(x, y, as_list(z))
        return math.nan if math.isnan(v) else chi2_sf(2 * n * v, self.df(x, y, z)) if v > 0 else 1.0


# ---------------------------------------------------------------- nearest neighbours


def ranks(v: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
    out = np.empty(len(v))
    tie = np.arange(len(v)) if rng is None else rng.permutation(len(v))
    out[np.lexsort((tie, v))] = np.arange(len(v))
    return out


def knn_mi(x: np.ndarray, y: np.ndarray, z: np.ndarray | None, k: int) -> float:
    """x, y: ranks; z: ranks as columns."""
    n = len(x)
    r = np.column_stack([x, y] if z is None else [x, y, z]).astype(np.int64)
    eps = kth_distances(r, k)
    inside = lambda c: np.minimum(1 + c, eps) + np.minimum(n - c, eps) - 1
    if r.shape[1] == 2:
        return float(digamma(k) + digamma(n) - np.mean(digamma(inside(r[:, 0])) + digamma(inside(r[:, 1]))))
    if r.shape[1] == 3:
        nz, nxz, nyz = inside(r[:, 2]), count_squares(r[:, 0], r[:, 2], eps), count_squares(r[:, 1], r[:, 2], eps)
    else:
        nz, nxz, nyz = (KDTree(c).count_inside(eps) for c in (r[:, 2:], np.delete(r, 1, 1), r[:, 1:]))
    return float(digamma(k) + np.mean(digamma(nz) - digamma(nxz) - digamma(nyz)))


class KMutualInformation(_DataTest):
    """Nearest-neighbour mutual information on ranks with a permutation p-value. Up to MAX_ROWS rows, the statistic and its permutations are tasks of
    the executors over one broadcast of the rows; more rows are dealt to cells of their space (operators.neighbours), one permutation after
    another. Local permutations then choose among neighbours of the same cell."""

    MAX_ROWS = 1_000_000

    def __init__(self, data, k: int, seed: int | None = None, shuffle_neighbors: int = 5, samples: int = 1000):
        super().__init__(data)
        self.k, self.seed, self.shuffle_neighbors, self.samples = k, 0 if seed is None else seed, shuffle_neighbors, samples
        self.in_cells = self.data.num_rows > self.MAX_ROWS
        if k >= self.data.num_rows:
            raise ValueError("k must be smaller than the number of rows")

    def variables(self):
        return list(self.data.continuous)

    def _matrix(self, cols: Sequence[str]) -> np.ndarray:
        m = training_matrix(self.data, cols)
        return m[np.lexsort(m.T[::-1])]

    def _statistics(self, x, y, z, samples: int) -> DataFrame:
        """(i, mi): the statistic of the rows as they are (i = -1) and of `samples` permutations."""
        m = self._matrix([x, y, *as_list(z)])
        k, seed, spark, s = self.k, self.seed, self.data.df.sparkSession, min(self.shuffle_neighbors, len(m) - 1)
        shared = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, near = shared.value, None
            r = np.column_stack([ranks(c) for c in m.T])
            for b in batches:
                for i in b.column(0).to_pylist():
                    first, rng = r[:, 0], np.random.default_rng([seed, i + 1])
                    if i >= 0 and m.shape[1] == 2:
                        first = rng.permutation(first)
                    elif i >= 0:
                        if near is None:
                            near = nearest_rows(m[:, 2:], s + 1)
                        first = local_permutation(first, near, rng)
                    v = knn_mi(first, r[:, 1], r[:, 2:], k)
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "mi": pa.array([v], pa.float64())})

        parts = min(samples + 1, 4 * spark.sparkContext.defaultParallelism)
        return spark.range(-1, samples, 1, parts).mapInArrow(run, "i long, mi double")

    def _cells(self, x, y, z, samples: int) -> tuple[float, int]:
        """The statistic, and how many permutations reach it."""
        cols = [x, y, *as_list(z)]
        points = neighbours.ranked_points(self.data, cols)
        n = points.count()
        base, reached = neighbours.information(points, len(cols), self.k, n), 0
        for i in range(samples):
            other = checkpointed(neighbours.permuted(points, len(cols), n, self.shuffle_neighbors, self.seed, i, local_permutation))
            reached += neighbours.information(other, len(cols), self.k, n) >= base
        return base, reached

    def mi(self, x, y, z=None) -> float:
        return self._cells(x, y, z, 0)[0] if self.in_cells else self._statistics(x, y, z, 0).first()["mi"]

    def pvalue(self, x, y, z=None):
        if self.in_cells:
            return self._cells(x, y, z, self.samples)[1] / self.samples
        row = self._statistics(x, y, z, self.samples).agg(F.max(F.when(F.col("i") < 0, F.col("mi"))).alias("base"), F.collect_list(F.when(F.col("i") >= 0, F.col("mi"))).alias("all")).first()
        return sum(v >= row["base"] for v in row["all"]) / self.samples


def local_permutation(x: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each row takes the value of a z-neighbour that no other row has taken, or a taken one with noise of less than half a rank; then re-ranked."""
    n = len(x)
    out, used, values, options = np.empty(n), bytearray(n), x.tolist(), near.tolist()
    for i in rng.permutation(n).tolist():
        own = options[i]
        for k in rng.permutation(len(own)).tolist():
            j = own[k]
            if not used[j]:
                used[j] = 1
                out[i] = values[j]
                break
        else:
            out[i] = values[j] + rng.random() - 0.5
    return ranks(out, rng)


def nearest_rows(z: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row, ties by row number. Of equal rows only the first k can be among them, so only these are searched, once
    for each different row."""
    different, kind = np.unique(z, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    start = np.searchsorted(kind[order], np.arange(len(different)))
    first = np.sort(order[np.arange(len(z)) - start[kind[order]] < k])
    return first[KDTree(z[first]).query(different, k)[1]][kind]


# ---------------------------------------------------------------- random Fourier features


@dataclass
class _Spectrum:
    """One test's columns with their means and deviations, and its random features: (columns, weights, phases) of x, y and z."""

    cols: list[str]
    mean: np.ndarray
    sd: np.ndarray
    maps: list[tuple[list[str], np.ndarray, np.ndarray]]

    def features(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        """Of the rows that are valid in all columns."""
        a = np.column_stack([cells[c] for c in self.cols])
        a = (a[~np.isnan(a).any(1)] - self.mean) / self.sd
        return np.concatenate([math.sqrt(2) * np.cos(a[:, [self.cols.index(c) for c in g]] @ w + b) for g, w, b in self.maps], 1)


def co_moments(df: DataFrame, needed: Sequence[str], features: Sequence[Callable[[dict[str, np.ndarray]], np.ndarray]]) -> list[Moments]:
    """Moments of many sets of features in one pass over the rows: each task adds up its own, their sums meet in groups of tasks and then by
    set, so that one matrix a set reaches the driver, whatever the number of rows and tasks."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(list(features)))
    schema = "i int, salt int, n long, mean binary, sse binary"

    def row(i: int, salt: int, m: Moments) -> pa.RecordBatch:
        cells = (pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([m.n], pa.int64()), pa.array([m.mean.tobytes()]), pa.array([m.sse.tobytes()]))
        return pa.RecordBatch.from_arrays(list(cells), ["i", "salt", "n", "mean", "sse"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        functions = cloudpickle.loads(shared.value)
        for b in batches:
            cells = {c: b.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(needed)}
            for i, f in enumerate(functions):
                x = f(cells)
                if len(x):
                    mean = x.mean(0)
                    m = Moments([""] * x.shape[1], len(x), mean, (x - mean).T @ (x - mean))
                    total[i] = total[i] + m if i in total else m
        for i, m in total.items():
            yield row(i, TaskContext.get().partitionId() % MEETING, m)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            for r in b.to_pylist():
                mean = np.frombuffer(r["mean"])
                m = Moments([""] * len(mean), r["n"], mean, np.frombuffer(r["sse"]).reshape(len(mean), -1))
                if now is not None and now != (r["i"], r["salt"]):
                    yield row(*now, held)
                    held = None
                now, held = (r["i"], r["salt"]), m if held is None else held + m
        if now is not None:
            yield row(*now, held)

    out = df.select(*[col(c).alias(c) for c in needed]).mapInArrow(add_up, schema)
    out = out.repartition("i", "salt").sortWithinPartitions("i", "salt").mapInArrow(meet, schema)
    out = out.withColumn("salt", F.lit(0)).repartition("i").sortWithinPartitions("i").mapInArrow(meet, schema)
    got = {r["i"]: r for r in out.collect()}
    shared.destroy()
    found = []
    for i in range(len(features)):
        mean = np.frombuffer(got[i]["mean"]) if i in got else np.zeros(0)
        found.append(Moments([""] * len(mean), got[i]["n"], mean, np.frombuffer(got[i]["sse"]).reshape(len(mean), -1)) if i in got else Moments.empty([]))
    return found


class RCoT(_DataTest):
    """Randomised conditional correlation test. Many tests share two passes over the rows, BATCH of them at a time: one for the co-moments of
    the features, one for those of the residuals' products. A task holds the matrices of one batch, and so does the driver."""

    BATCH = 128
    #: First rows of the order that kernel widths are taken from (500 valid ones are used).
    HEAD = 2000

    def __init__(self, data, random_fourier_xy: int = 5, random_fourier_z: int = 100, seed: int | None = None):
        super().__init__(data)
        if len(self.data.continuous) < 2:
            raise ValueError("RCoT needs two continuous columns")
        self.f_xy, self.f_z, self.seed = random_fourier_xy, random_fourier_z, 0 if seed is None else seed
        self._first: np.ndarray | None = None

    def variables(self):
        return list(self.data.continuous)

    def _head(self) -> np.ndarray:
        """The first HEAD rows in order (without order_by: of the hash of the columns), all continuous columns."""
        if self._first is None:
            cols = self.data.continuous
            order = self.data.order_by or [F.xxhash64(*[col(c) for c in cols]), *[col(c) for c in cols]]
            rows = self.data.df.orderBy(*order).limit(self.HEAD).select(*[col(c) for c in cols]).collect()
            self._first = np.array([tuple(np.nan if v is None else v for v in r) for r in rows], float).reshape(len(rows), len(cols))
        return self._first

    def _width(self, cols: Sequence[str], mean: np.ndarray, sd: np.ndarray, group: Sequence[str]) -> float:
        """Median distance of the first 500 rows that are valid in `cols`, over the z-scores of `group`."""
        at = [self.data.continuous.index(c) for c in cols]
        head = self._head()
        valid = head[~np.isnan(head[:, at]).any(1)][:500]
        if len(valid) < 500 and len(head) == self.HEAD:  # many nulls: a job of its own
            view = self.data.with_df(self.data.df.where(Dataset.valid(cols)))
            scale = {c: (m, s) for c, m, s in zip(cols, mean, sd, strict=True)}
            return median_distance(view.with_df(view.df.withColumns({c: (col(c) - scale[c][0]) / scale[c][1] for c in group})), group)
        x = (valid[:, at] - mean) / sd
        x = x[:, [list(cols).index(c) for c in group]]
        if len(x) < 2:
            return 1.0
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]
        return float(np.median(d)) or 1.0

    def _spectrum(self, x: str, y: str, z: list[str], maps=None) -> _Spectrum | None:
        """None if x or y is constant; constant columns of z are left out."""
        m = self.stats.moments(list(dict.fromkeys([x, y, *z])))
        var = dict(zip(m.cols, np.diag(m.cov), strict=True))
        if not (var[x] >= TOL and var[y] >= TOL):
            return None
        z = [c for c in z if var[c] >= TOL]
        m = m.take(list(dict.fromkeys([x, y, *z])))
        sd = np.sqrt(np.diag(m.cov))
        if maps is None:
            rng = np.random.default_rng(self.seed)
            groups = [([x], self.f_xy), ([y], self.f_xy)] + ([(z, self.f_z)] if z else [])
            maps = [(g, rng.standard_normal((len(g), f)) / self._width(m.cols, m.mean, sd, g), rng.uniform(0, 2 * math.pi, f)) for g, f in groups]
        return _Spectrum(m.cols, m.mean, sd, maps)

    def _partial(self, s: _Spectrum, m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Deviations of the features, partial correlations of those of x and y, and what z's features explain of them."""
        sd = np.sqrt(np.diag(m.sse) / (m.n - 1))
        sd = np.where(sd > 0, sd, 1.0)
        c = m.sse / (m.n - 1) / np.outer(sd, sd)
        i, j = s.maps[0][1].shape[1], s.maps[0][1].shape[1] + s.maps[1][1].shape[1]
        if len(s.maps) < 3:
            return sd, c[:i, i:j], None
        zz = c[j:, j:] + 1e-10 * np.eye(len(c) - j)
        coef = np.linalg.solve(zz, c[j:, :j])
        return sd, c[:i, i:j] - c[:i, j:] @ coef[:, i:], coef

    def statistics(self, specs: Sequence[_Spectrum]) -> list[tuple[float, np.ndarray]]:
        """For each test n times the squared partial correlations of the features, and the second moments of the residuals' products."""
        needed = list(dict.fromkeys(c for s in specs for c in s.cols))
        first = co_moments(self.data.df, needed, [s.features for s in specs])
        solved = [self._partial(s, m) for s, m in zip(specs, first, strict=True)]

        def products(s: _Spectrum, m: Moments, sd: np.ndarray, coef: np.ndarray | None) -> Callable:
            i, j = s.maps[0][1].shape[1], s.maps[0][1].shape[1] + s.maps[1][1].shape[1]

            def f(cells: dict[str, np.ndarray]) -> np.ndarray:
                x = (s.features(cells) - m.mean) / sd
                r = x[:, :j] - (x[:, j:] @ coef if coef is not None else 0.0)
                return (r[:, :i, None] * r[:, None, i:]).reshape(len(r), i * (j - i))

            return f

        second = co_moments(self.data.df, needed, [products(s, m, sd, coef) for s, m, (sd, _, coef) in zip(specs, first, solved, strict=True)])
        return [(m.n * float((part**2).sum()), m2.sse / m2.n + np.outer(m2.mean, m2.mean)) for m, m2, (_, part, _) in zip(first, second, solved, strict=True)]

    def _tail(self, stat: float, second: np.ndarray, conditional: bool) -> float:
        w = np.linalg.eigvalsh(second)
        w = w[w > 1e-12]
        if not len(w):
            return 1.0
        if len(w) < 4 or self.f_z == 1 and conditional:
            p = hbe_complement(w, stat)
        else:
            try:
                p = lpb4_complement(w, stat)
            except (ValueError, np.linalg.LinAlgError, OverflowError):
                p = hbe_complement(w, stat)
        return min(1.0, max(0.0, p)) if math.isfinite(p) else hbe_complement(w, stat)

    def pvalues(self, triples):
        triples = [(x, y, as_list(z)) for x, y, z in triples]
        self.stats.prefetch([list(dict.fromkeys([x, y, *z])) for x, y, z in triples])
        specs = [self._spectrum(*t) for t in triples]
        out = [1.0] * len(triples)
        todo = [i for i, s in enumerate(specs) if s is not None]
        for k in range(0, len(todo), self.BATCH):
            some = todo[k : k + self.BATCH]
            for i, (stat, second) in zip(some, self.statistics([specs[i] for i in some]), strict=True):
                out[i] = self._tail(stat, second, len(specs[i].maps) > 2)
        return out

    def pvalue(self, x, y, z=None):
        return self.pvalues([(x, y, as_list(z))])[0]


# ---------------------------------------------------------------- dynamic


class DynamicIndependenceTest:
    kind: type[IndependenceTest]

    def __init__(self, data, *args, markovian_order: int = 1, order_by: Sequence[str] | None = None, **kwargs):
        self.slices = data if isinstance(data, DynamicDataFrame) else DynamicDataFrame(data, markovian_order, order_by)
        self._static = self.kind(self.slices.static_df(), *args, **kwargs)
        self._transition = self.kind(self.slices.transition_df(), *args, **kwargs)

    def variables(self) -> list[str]:
        return list(self.slices.variables)

    def variable_names(self) -> list[str]:
        return self.variables()

    def num_variables(self) -> int:
        return len(self.slices.variables)

    def name(self, i: int) -> str:
        return self.slices.variables[i]

    def has_variables(self, names) -> bool:
        return set([names] if isinstance(names, str) else names) <= set(self.slices.variables)

    @property
    def markovian_order(self) -> int:
        return self.slices.m

    def static_tests(self) -> IndependenceTest:
        return self._static

    def transition_tests(self) -> IndependenceTest:
        return self._transition


class DynamicLinearCorrelation(DynamicIndependenceTest):
    kind = LinearCorrelation


class DynamicChiSquare(DynamicIndependenceTest):
    kind = ChiSquare


class DynamicMutualInformation(DynamicIndependenceTest):
    kind = MutualInformation


class DynamicKMutualInformation(DynamicIndependenceTest):
    kind = KMutualInformation


class DynamicRCoT(DynamicIndependenceTest):
    kind = RCoT


def subsets_of(items: Sequence[str], k: int):
    return itertools.combinations(items, k)
