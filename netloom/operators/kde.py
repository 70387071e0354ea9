"""Kernel densities: full and diagonal bandwidth, bandwidth selectors, and scoring of all rows. Training rows of up to MAX_TRAINING_BYTES are a
matrix that scoring broadcasts; beyond, they stay a table, which points meet in blocks (operators.blocks)."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.special import nelder_mead
from netloom.operators import blocks
from netloom.operators.box_sums import BoxSums, Plain, finite, kernel_sums
from netloom.operators.durable import checkpointed
from netloom.operators.stats import Moments, SuffStats, col
from netloom.sources.dataset import Dataset

#: Bytes of training rows that the driver holds and broadcasts (beyond, they stay a table); bytes of one pass's scorers; training rows from which
#: the scored rows are spread over all cores.
MAX_TRAINING_BYTES, MAX_SCORER_BYTES, SPREAD_ROWS = 64 << 20, 1 << 30, 4096
LOG_2PI = math.log(2 * math.pi)


class SingularCovarianceData(ValueError):
    """The data have no invertible covariance."""


def is_positive_definite(m: np.ndarray) -> bool:
    if not np.isfinite(m).all():
        return False
    w = np.linalg.eigvalsh(m)
    return bool(w[0] > w[-1] * len(w) * np.finfo(float).eps)


def checked(m: Moments) -> Moments:
    d = len(m.cols)
    if m.n <= d or not is_positive_definite(m.cov):
        raise SingularCovarianceData(f"covariance of {m.cols} over {m.n} rows is singular")
    return m


class BandwidthSelector(ABC):
    """Subclass with both methods to plug in a rule. `data` is a Dataset, `variables` the columns."""

    @abstractmethod
    def bandwidth(self, data: Dataset, variables: Sequence[str]) -> np.ndarray: ...

    @abstractmethod
    def diag_bandwidth(self, data: Dataset, variables: Sequence[str]) -> np.ndarray: ...

    def of(self, data: Dataset, variables: Sequence[str], x: np.ndarray | None, diagonal: bool) -> np.ndarray:
        return self.diag_bandwidth(data, variables) if diagonal else self.bandwidth(data, variables)


class FromMoments(BandwidthSelector):
    """Rules that need the rows' moments only: full() and diagonal()."""

    def bandwidth(self, data, variables):
        return self.full(checked(SuffStats(Dataset.of(data)).moments(variables)))

    def diag_bandwidth(self, data, variables):
        return self.diagonal(checked(SuffStats(Dataset.of(data)).moments(variables)))

    def of(self, data, variables, x, diagonal):
        if x is not None:
            mean = x.mean(0)
            m = checked(Moments(list(variables), len(x), mean, (x - mean).T @ (x - mean)))
            return self.diagonal(m) if diagonal else self.full(m)
        return super().of(data, variables, x, diagonal)


class NormalReferenceRule(FromMoments):
    def full(self, m: Moments) -> np.ndarray:
        d = len(m.cols)
        return (4 / (m.n * (d + 2))) ** (2 / (d + 4)) * m.cov

    def diagonal(self, m: Moments) -> np.ndarray:
        d, var = len(m.cols), np.diag(m.cov)
        delta = m.cov / var[:, None]
        inv = np.linalg.inv(delta)
        k = 4 * d * math.sqrt(abs(np.linalg.det(delta))) / (2 * np.trace(inv @ inv) + np.trace(inv) ** 2)
        return (k / m.n) ** (2 / (d + 4)) * var


class ScottsBandwidth(FromMoments):
    def full(self, m: Moments) -> np.ndarray:
        return m.n ** (-2 / (len(m.cols) + 4)) * m.cov

    def diagonal(self, m: Moments) -> np.ndarray:
        return m.n ** (-2 / (len(m.cols) + 4)) * np.diag(m.cov)


def training_rows(data: Dataset, variables: Sequence[str]) -> int:
    return data.df.where(Dataset.valid(variables)).count()


def is_small(n: int, columns: int) -> bool:
    """Whether so many training rows may be a matrix on the driver."""
    return 8 * n * columns <= MAX_TRAINING_BYTES


def training_matrix(data: Dataset, variables: Sequence[str]) -> np.ndarray:
    """Valid rows as a matrix on the driver, within MAX_TRAINING_BYTES."""
    n = training_rows(data, variables)
    if not is_small(n, len(variables)):
        raise ValueError(f"{n} training rows exceed {MAX_TRAINING_BYTES} bytes")
    t = data.df.where(Dataset.valid(variables)).select(*[col(v).alias(str(i)) for i, v in enumerate(variables)]).toArrow()
    return np.column_stack([t.column(i).to_numpy() for i in range(len(variables))]) if n else np.zeros((0, len(variables)))


def pair_sums(x: np.ndarray, scales: Sequence[np.ndarray]) -> list[float]:
    """For each scale (a Cholesky factor or a vector of deviations): sum over i < j of the normal kernel without its constant, of a matrix."""
    x, out = x - x.mean(0) if len(x) else x, []
    for s in scales:
        w = np.linalg.solve(s, x.T).T if s.ndim == 2 else x / s
        # every pair is there twice, and each row with itself
        out.append((float(np.exp(kernel_sums(w).logs(w)).sum()) - len(w)) / 2)
    return out


class UCVScorer:
    """N times the unbiased cross-validation criterion of bandwidths. A dataset stays a table whose row blocks meet in pairs, one job for any number
    of bandwidths; a matrix `x` is summed up where it is."""

    def __init__(self, data, variables: Sequence[str], x: np.ndarray | None = None):
        self.x, self.d = x, len(variables)
        self.table = blocks.TrainingTable(Dataset.of(data).df, variables) if x is None else None
        if self.table is not None:
            self.table.rows = checkpointed(self.table.rows)  # every step of a search reads it
        self.n: int | None = None if x is None else len(x)

    def scores(self, roots: Sequence[np.ndarray]) -> list[float]:
        """Of bandwidths given by their Cholesky factors or vectors of deviations."""
        if self.n is None:
            self.n = int(self.table.rows.agg(F.sum("w")).first()[0] or 0)
        scales = [s * f for s in roots for f in (math.sqrt(2), 1.0)]
        sums = pair_sums(self.x, scales) if self.table is None else blocks.pair_table_sums(self.table, scales)
        out = []
        for s, s2, s1 in zip(roots, sums[::2], sums[1::2], strict=True):
            c1 = -0.5 * self.d * LOG_2PI - float(np.log(np.diag(s) if s.ndim == 2 else s).sum())
            c2 = c1 - 0.5 * self.d * math.log(2)
            out.append(math.exp(c2) + 2 * s2 * math.exp(c2) / self.n - 4 * s1 * math.exp(c1) / (self.n - 1))
        return out

    def score_diagonal(self, variances: Sequence[float]) -> float:
        return self.scores([np.sqrt(np.asarray(variances, float))])[0]

    def score_unconstrained(self, h: np.ndarray) -> float:
        return self.scores([np.linalg.cholesky(np.asarray(h, float))])[0]


class UCV(BandwidthSelector):
    """Unbiased cross-validation, minimised from the normal reference by the simplex method. Bandwidths whose determinant leaves
    the start's by more than a factor 1000 don't count. All bandwidths that a step may ask for are scored together."""

    RANGE = 1e3

    def bandwidth(self, data, variables):
        return self.of(Dataset.of(data), variables, None, False)

    def diag_bandwidth(self, data, variables):
        return self.of(Dataset.of(data), variables, None, True)

    def of(self, data, variables, x, diagonal):
        scorer = UCVScorer(data, variables, x)
        start = NormalReferenceRule().of(data, variables, x, diagonal)
        d = len(variables)
        low = np.tril_indices(d)
        base = float(start.prod()) if diagonal else float(np.linalg.det(start))

        def root_of(v: np.ndarray) -> np.ndarray:
            """The factor of the bandwidth; row by row of positive diagonal."""
            if diagonal:
                return np.abs(v)
            root = np.zeros((d, d))
            root[low] = v
            return root * np.where(np.diag(root) < 0, -1.0, 1.0)

        def valid(root: np.ndarray) -> bool:
            size = float((root**2).prod()) if diagonal else float(np.diag(root).prod() ** 2)
            return base / self.RANGE <= size <= base * self.RANGE and (diagonal or is_positive_definite(root @ root.T))

        def goals(points: Sequence[np.ndarray]) -> list[float]:
            roots = [root_of(p) for p in points]
            good = [i for i, r in enumerate(roots) if valid(r)]
            out = [math.inf] * len(points)
            for i, s in zip(good, scorer.scores([roots[i] for i in good]) if good else [], strict=True):
                out[i] = s
            return out

        found = root_of(nelder_mead(goals, np.sqrt(start) if diagonal else np.linalg.cholesky(start)[low], ahead=x is None)[0])
        return found**2 if diagonal else found @ found.T


class KDE:
    """Gaussian kernel density with a full bandwidth matrix."""

    diagonal = False

    def __init__(self, variables: Sequence[str], bandwidth_selector: BandwidthSelector | None = None):
        if not variables:
            raise ValueError("a density needs variables")
        self._variables, self.selector = list(variables), bandwidth_selector or NormalReferenceRule()
        self.x: np.ndarray | None = None
        self.table: blocks.TrainingTable | None = None
        self._sums: Plain | BoxSums | None = None  # of the training rows; made where points are scored
        self._n, self._mean = 0, np.zeros(0)
        self._bandwidth: np.ndarray | None = None
        self._width: str | None = None

    def variables(self) -> list[str]:
        return list(self._variables)

    def fitted(self) -> bool:
        return self.x is not None or self.table is not None

    def _check(self) -> None:
        if not self.fitted():
            raise ValueError("the density is not fitted")

    def fit(self, data, as_table: bool = False) -> KDE:
        """Fit to a matrix of the training rows, or (always with `as_table`) to the table that they are."""
        data = Dataset.of(data)
        data.raise_has_columns(self._variables)
        data.same_type(*self._variables)
        self._width = data.df.schema[self._variables[0]].dataType.typeName()
        if not as_table and is_small(training_rows(data, self._variables), len(self._variables)):
            return self.fit_matrix(training_matrix(data, self._variables), data)
        return self.fit_table(data, SuffStats(data).moments(self._variables))

    def fit_matrix(self, x: np.ndarray, data: Dataset | None = None, bandwidth: np.ndarray | None = None) -> KDE:
        self.x, self.table, self._sums = np.asarray(x, float), None, None
        self._n, self._mean = len(self.x), self.x.mean(0) if len(self.x) else np.zeros(len(self._variables))
        self.bandwidth = self.selector.of(data, self._variables, self.x, self.diagonal) if bandwidth is None else bandwidth
        return self

    def fit_table(self, data: Dataset, m: Moments, bandwidth: np.ndarray | None = None) -> KDE:
        """Fit to rows that stay a table; `m` are their moments."""
        self.x, self.table = None, blocks.TrainingTable(data.df, self._variables)
        self._n, self._mean = m.n, m.mean
        if bandwidth is None and isinstance(self.selector, FromMoments):
            bandwidth = self.selector.diagonal(checked(m)) if self.diagonal else self.selector.full(checked(m))
        self.bandwidth = self.selector.of(data, self._variables, None, self.diagonal) if bandwidth is None else bandwidth
        return self

    def kernel(self) -> blocks.Kernel:
        return blocks.Kernel(self._mean, self._bandwidth, self._n)

    @property
    def bandwidth(self) -> np.ndarray:
        return self._bandwidth

    @bandwidth.setter
    def bandwidth(self, h: np.ndarray) -> None:
        h = np.asarray(h, float)
        d = len(self._variables)
        if h.shape != ((d,) if self.diagonal else (d, d)):
            raise ValueError(f"a bandwidth of shape {h.shape} for {d} variables")
        self._bandwidth, self._sums = h, None
        if self.diagonal:
            if (h <= 0).any():
                raise ValueError("bandwidths must be positive")
            self._root = np.sqrt(h)
            self._log_root = float(np.log(self._root).sum())
        else:
            self._root = np.linalg.cholesky(h)
            self._log_root = float(np.log(np.diag(self._root)).sum())

    def num_instances(self) -> int:
        self._check()
        return self._n

    def data_type(self) -> str:
        return self._width or "double"

    def dataset(self, spark=None) -> DataFrame:
        """The training rows."""
        self._check()
        if self.x is None:
            return self.table.expanded(self._variables)
        from pyspark.sql import SparkSession

        spark = spark or SparkSession.active()
        return spark.createDataFrame(pa.table({v: self.x[:, i] for i, v in enumerate(self._variables)}))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return x / self._root if self.diagonal else np.linalg.solve(self._root, x.T).T

    def log_kernels(self, points: np.ndarray) -> np.ndarray:
        """Log kernel values without the constant: points by training rows."""
        t, p = self.whiten(self.x), self.whiten(points)
        d2 = (p**2).sum(1)[:, None] + (t**2).sum(1)[None] - 2 * p @ t.T
        return -0.5 * np.maximum(d2, 0)

    def log_constant(self) -> float:
        return -self._log_root - 0.5 * len(self._variables) * LOG_2PI - math.log(self._n)

    def logl_matrix(self, points: np.ndarray) -> np.ndarray:
        """Log density of each point; NaN where a coordinate is NaN. Centring on the training mean keeps the squares small."""
        self._check()
        if self.x is None:
            raise ValueError("the training rows are a table: score with logl()")
        if self._sums is None:
            self._sums = kernel_sums(self.whiten(self.x - self._mean))
        return finite(self._sums.logs, self.whiten(points - self._mean)) + self.log_constant()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sums": None}

    def scorers(self) -> dict[str, Callable]:
        return {"logl": lambda cols: self.logl_matrix(np.column_stack([cols[v] for v in self._variables]))}

    def logl(self, data, output: str = "logl") -> DataFrame:
        """The rows with their log density; null for rows with a null."""
        self._check()
        data = Dataset.of(data)
        data.raise_has_columns(self._variables)
        if self._width and data.df.schema[self._variables[0]].dataType.typeName() != self._width:
            raise ValueError("fitted on another float width")
        if self.x is None:
            return blocks.score_against(data.df, self._variables, self.table, blocks.Density(), {(0, None): self.kernel()}, output)
        return score_rows(data.df, self._variables, {output: self.scorers()["logl"]}, spread=len(self.x) > SPREAD_ROWS)

    def slogl(self, data) -> float:
        return self.logl(data, "_l").agg(F.sum("_l")).first()[0] or 0.0

    def save(self, filename: str) -> str:
        from netloom.sources.serialization import save

        return save(self, filename)


class ProductKDE(KDE):
    """Gaussian kernels with a bandwidth for each variable."""

    diagonal = True


def score_rows(df: DataFrame, needed: Sequence[str], scorers: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]], texts: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """Adds one double column for each scorer in a single pass of Arrow batches. A scorer takes the needed columns (doubles with NaN for
    null; `texts` as object arrays) and gives an array; NaN becomes null. The scorers travel as one broadcast. `spread`: rows are
    dealt to all cores first, since a file of few rows is one task."""
    from pyspark import cloudpickle
    from pyspark.sql.types import DoubleType, StructField, StructType

    data = cloudpickle.dumps(scorers)
    if len(data) > MAX_SCORER_BYTES:
        raise ValueError(f"the scorers of one pass hold {len(data)} bytes, more than {MAX_SCORER_BYTES} together; score fewer nodes at a time")
    shared = df.sparkSession.sparkContext.broadcast(data)
    names, at = [*df.columns, *scorers], {c: df.columns.index(c) for c in [*needed, *texts]}
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in scorers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = cloudpickle.loads(shared.value)
        for b in batches:
            cols = {c: b.column(i).to_numpy(zero_copy_only=False).astype(object if c in texts else float) for c, i in at.items()}
            added = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (np.asarray(f(cols), float) for f in functions.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names)

    if spread and not df.isStreaming:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.mapInArrow(run, schema)
