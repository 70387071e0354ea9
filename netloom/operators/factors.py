"""Conditional distributions: linear-Gaussian, discrete, conditional kernel density, and one of them for each discrete configuration."""

from __future__ import annotations

import functools
import itertools
import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.special import TOL, log_sum_exp, normal_cdf
from netloom.operators.blocks import Conditional, Distribution, Kernel, TrainingTable, sample_against, score_against
from netloom.operators.kde import KDE, SPREAD_ROWS, BandwidthSelector, SingularCovarianceData, is_small, score_rows, training_matrix, training_rows
from netloom.operators.stats import Moments, SuffStats, col, linear_fit
from netloom.sources.dataset import Dataset

LOG_2PI = math.log(2 * math.pi)
#: Table cells that become an array literal; larger ones are joined (a table of the domains' size).
MAX_LITERAL = 512


class Assignment:
    """Values of variables, text or number; order doesn't matter."""

    def __init__(self, values: dict[str, str | float] | None = None):
        self._values = dict(values or {})

    def value(self, variable: str):
        return self._values[variable]

    def has_variables(self, variables: str | Iterable[str]) -> bool:
        return all(v in self._values for v in ([variables] if isinstance(variables, str) else variables))

    def insert(self, variable: str, value: str | float) -> None:
        self._values[variable] = value

    def remove(self, variable: str) -> None:
        self._values.pop(variable, None)

    def size(self) -> int:
        return len(self._values)

    def empty(self) -> bool:
        return not self._values

    def items(self):
        return self._values.items()

    def __eq__(self, other) -> bool:
        return isinstance(other, Assignment) and self._values == other._values

    def __hash__(self) -> int:
        return hash(frozenset(self._values.items()))

    def __repr__(self) -> str:
        return "[" + ", ".join(f"{k} = {v}" for k, v in sorted(self._values.items())) + "]"


class Args(tuple):
    def __new__(cls, *args):
        return super().__new__(cls, args)


class Kwargs(dict):
    pass


class Arguments:
    """Constructor arguments by (node, type), node or type, looked up in that order. Values: Args, Kwargs, or (Args, Kwargs)."""

    def __init__(self, values: dict | None = None):
        self.values = dict(values or {})

    def args(self, node: str, node_type: FactorType) -> tuple[tuple, dict]:
        for key in ((node, node_type), node, node_type):
            if key in self.values:
                v = self.values[key]
                if isinstance(v, Kwargs):
                    return (), dict(v)
                if isinstance(v, Args):
                    return tuple(v), {}
                return tuple(v[0]), dict(v[1])
        return (), {}


class FactorType(ABC):
    """A kind of factor. Subclass with new_factor to plug in one's own; types are equal by class."""

    @abstractmethod
    def new_factor(self, model, variable: str, evidence: Sequence[str], *args, **kwargs) -> Factor: ...

    def __eq__(self, other) -> bool:
        return type(self) is type(other)

    def __hash__(self) -> int:
        return hash(type(self).__qualname__)

    def __repr__(self) -> str:
        return type(self).__name__

    def __str__(self) -> str:
        return type(self).__name__


def _discrete_evidence(model, evidence: Sequence[str]) -> list[str]:
    return [e for e in evidence if model is not None and model.node_type(e) == DiscreteFactorType()]


class LinearGaussianCPDType(FactorType):
    def new_factor(self, model, variable, evidence, *args, **kwargs):
        d = _discrete_evidence(model, evidence)
        return CLinearGaussianCPD(variable, evidence, d, *args, **kwargs) if d else LinearGaussianCPD(variable, evidence, *args, **kwargs)


class CKDEType(FactorType):
    def new_factor(self, model, variable, evidence, *args, **kwargs):
        d = _discrete_evidence(model, evidence)
        return HCKDE(variable, evidence, d, *args, **kwargs) if d else CKDE(variable, evidence, *args, **kwargs)


class DiscreteFactorType(FactorType):
    def new_factor(self, model, variable, evidence, *args, **kwargs):
        return DiscreteFactor(variable, evidence, *args, **kwargs)


class UnknownFactorType(FactorType):
    """A node whose type is found from the data."""

    def new_factor(self, model, variable, evidence, *args, **kwargs):
        raise ValueError(f"the type of {variable} is unknown")


class Factor(ABC):
    """P(variable | evidence). Implement type, fitted, fit, and either logl_column or attach_logl."""

    def __init__(self, variable: str, evidence: Sequence[str] = ()):
        self._variable, self._evidence = variable, list(evidence)

    def variable(self) -> str:
        return self._variable

    def evidence(self) -> list[str]:
        return list(self._evidence)

    @abstractmethod
    def type(self) -> FactorType: ...

    @abstractmethod
    def fitted(self) -> bool: ...

    @abstractmethod
    def fit(self, data) -> Factor: ...

    def fit_from(self, stats: SuffStats) -> Factor:
        """Fit from statistics that are there already, if this kind of factor can."""
        return self.fit(stats.data)

    def data_type(self) -> str:
        return "double"

    def _check(self) -> None:
        if not self.fitted():
            raise ValueError(f"{self} is not fitted")

    def attach_logl(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, self.logl_column())

    def logl_column(self) -> Column:
        raise NotImplementedError

    def heavy(self) -> bool:
        """Whether a scored row is much work."""
        return False

    def scorer(self) -> tuple[list[str], list[str], Callable] | None:
        """(real columns, text columns, function) if rows are scored in Arrow batches."""
        return None

    def logl(self, data, output: str = "logl") -> DataFrame:
        """The rows with their log-likelihood, null where the factor's columns have a null."""
        self._check()
        data = Dataset.of(data)
        data.raise_has_columns(self._variable, self._evidence)
        return self.attach_logl(data.df, output)

    def slogl(self, data) -> float:
        return self.logl(data, "_l").agg(F.sum("_l")).first()[0] or 0.0

    def cdf(self, data, output: str = "cdf") -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no cdf")

    def sample(self, n: int, evidence_values: DataFrame | None = None, seed: int | None = None) -> DataFrame:
        """n draws in a column named as the variable, next to the evidence if there is any."""
        self._check()
        if n < 0:
            raise ValueError("a negative sample size")
        if self._evidence and evidence_values is None:
            raise ValueError(f"sampling {self._variable} needs values of {self._evidence}")
        df = SparkSession.active().range(n).drop("id") if evidence_values is None else evidence_values
        if evidence_values is None:
            df = SparkSession.active().range(n).select(F.lit(0).alias("_row"))
        out = self.attach_sample(df, 0 if seed is None else seed)
        return out.drop("_row")

    def attach_sample(self, df: DataFrame, seed: int) -> DataFrame:
        raise NotImplementedError

    def save(self, filename: str) -> str:
        from netloom.sources.serialization import save

        return save(self, filename)

    def __str__(self) -> str:
        return f"[{type(self).__name__}] P({self._variable}{' | ' + ', '.join(self._evidence) if self._evidence else ''})"


# ---------------------------------------------------------------- linear-Gaussian


@dataclass
class LinearGaussianParams:
    beta: np.ndarray
    variance: float


def gaussian_logl(y: Column, mu: Column, variance: Column | float) -> Column:
    v = F.lit(float(variance)) if isinstance(variance, (int, float)) else variance
    return -0.5 * (y - mu) * (y - mu) / v - 0.5 * F.log(v) - 0.5 * LOG_2PI


class LinearGaussianCPD(Factor):
    """Normal with mean beta_0 + sum beta_i x_i. The variance is RSS / (n - p - 1)."""

    def __init__(self, variable: str, evidence: Sequence[str] = (), beta: Sequence[float] | None = None, variance: float | None = None):
        super().__init__(variable, evidence)
        self._beta = None if beta is None else np.asarray(beta, float)
        self._variance = None if variance is None else float(variance)
        if self._beta is not None and len(self._beta) != len(self._evidence) + 1:
            raise ValueError(f"{len(self._beta)} coefficients for {len(self._evidence)} parents")
        if self._variance is not None and self._variance <= 0:
            raise ValueError("the variance must be positive")

    def type(self):
        return LinearGaussianCPDType()

    def fitted(self):
        return self._beta is not None and self._variance is not None

    @property
    def beta(self) -> np.ndarray:
        return self._beta

    @beta.setter
    def beta(self, v) -> None:
        v = np.asarray(v, float)
        if len(v) != len(self._evidence) + 1:
            raise ValueError("wrong number of coefficients")
        self._beta = v

    @property
    def variance(self) -> float:
        return self._variance

    @variance.setter
    def variance(self, v: float) -> None:
        if v <= 0:
            raise ValueError("the variance must be positive")
        self._variance = float(v)

    def fit(self, data):
        return self.fit_from(SuffStats(Dataset.of(data)))

    def fit_from(self, stats):
        f = linear_fit(stats.moments([*self._evidence, self._variable]), self._variable, self._evidence)
        self._beta, self._variance = f.beta, f.variance
        return self

    def mean_column(self) -> Column:
        mu = F.lit(float(self._beta[0]))
        for b, e in zip(self._beta[1:], self._evidence, strict=True):
            mu = mu + float(b) * col(e)
        return mu

    def logl_column(self):
        return gaussian_logl(col(self._variable), self.mean_column(), self._variance)

    def cdf(self, data, output="cdf"):
        self._check()
        b, v, ev, y = self._beta, self._variance, self._evidence, self._variable
        f = lambda c: normal_cdf((c[y] - b[0] - sum(k * c[e] for k, e in zip(b[1:], ev, strict=True))) / math.sqrt(v))
        return score_rows(Dataset.of(data).df, [y, *ev], {output: f})

    def attach_sample(self, df, seed):
        return df.withColumn(self._variable, self.mean_column() + F.randn(seed) * math.sqrt(self._variance))

    def __str__(self):
        head = f"[LinearGaussianCPD] P({self._variable}{' | ' + ', '.join(self._evidence) if self._evidence else ''}) = "
        return head + ("not fitted" if not self.fitted() else f"N({' + '.join(f'{b:.3f}' + (f'*{e}' if e else '') for b, e in zip(self._beta, ['', *self._evidence], strict=True))}, {self._variance:.3f})")


# ---------------------------------------------------------------- discrete


@dataclass
class DiscreteFactorParams:
    logprob: np.ndarray


def conditional_log_table(counts: np.ndarray) -> np.ndarray:
    """log P(first axis | other axes); a configuration without rows is uniform, a zero cell minus infinity."""
    total = counts.sum(axis=0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.log(counts) - np.log(total)
    return np.where(total > 0, t, -math.log(counts.shape[0]))


class _Table:
    """Numbers by discrete configuration, put next to rows as an array literal or by a join with the whole (domain-sized) table."""

    @staticmethod
    def index(domains: dict[str, list[str]], cols: Sequence[str]) -> tuple[Column, int]:
        at, size = F.lit(0), 1
        for c in cols:
            pos = F.nullif(F.array_position(F.array(*[F.lit(v) for v in domains[c]]), F.col(f"`{c}`")), F.lit(0)) - 1
            at, size = at + pos * size, size * len(domains[c])
        return at.cast("int"), size

    @staticmethod
    def attach(df: DataFrame, domains, cols, values: dict[str, np.ndarray]) -> DataFrame:
        """Adds the columns of `values` (each an array over `cols` in order); NaN becomes null."""
        at, size = _Table.index(domains, cols)
        flat = {k: np.asarray(v, float).ravel(order="F") for k, v in values.items()}
        if size <= MAX_LITERAL:
            lit = lambda x: F.lit(None).cast("double") if math.isnan(x) else F.lit(float(x))
            return df.withColumn("_at", at).withColumns({k: F.get(F.array(*[lit(x) for x in v]), F.col("_at")) for k, v in flat.items()}).drop("_at")
        rows = [(i, *[None if math.isnan(v[i]) else float(v[i]) for v in flat.values()]) for i in range(size)]
        table = df.sparkSession.createDataFrame(rows, "_at int, " + ", ".join(f"`{k}` double" for k in flat))
        return df.withColumn("_at", at).join(F.broadcast(table) if size <= 100_000 else table, "_at", "left").drop("_at")


class DiscreteFactor(Factor):
    """Conditional probability table over the domains."""

    def __init__(self, variable: str, evidence: Sequence[str] = ()):
        super().__init__(variable, evidence)
        self.domains: dict[str, list[str]] = {}
        self.logprob: np.ndarray | None = None

    def type(self):
        return DiscreteFactorType()

    def fitted(self):
        return self.logprob is not None

    def data_type(self):
        return "string"

    def fit(self, data):
        return self.fit_from(SuffStats(Dataset.of(data)))

    def fit_from(self, stats):
        cols = [self._variable, *self._evidence]
        for c in cols:
            if not stats.data.is_discrete(c):
                raise ValueError(f"{c} is not discrete")
        self.domains = {c: list(stats.data.discrete[c]) for c in cols}
        self.logprob = conditional_log_table(stats.counts(cols))
        return self

    def check_domains(self, data: Dataset) -> None:
        """Error unless the data have the same categories in the same order."""
        for c, v in self.domains.items():
            if c in data.discrete and data.discrete[c] != v and not set(data.discrete[c]) <= set(v):
                raise ValueError(f"categories of {c} differ from those of the fit")

    def logl(self, data, output="logl"):
        self._check()
        given = Dataset.of(data)
        self.check_domains(given)
        return super().logl(given, output)

    def attach_logl(self, df, output):
        return _Table.attach(df, self.domains, [self._variable, *self._evidence], {output: self.logprob})

    def attach_sample(self, df, seed):
        cum = np.exp(self.logprob).cumsum(0)
        ev = self._evidence
        df = df.withColumn("_u", F.rand(seed))
        names = [f"_c{i}" for i in range(len(cum) - 1)]
        df = _Table.attach(df, self.domains, ev, {n: c for n, c in zip(names, cum[:-1], strict=True)}) if names else df
        pick = F.lit(self.domains[self._variable][-1])
        for n, v in reversed(list(zip(names, self.domains[self._variable], strict=False))):
            pick = F.when(F.col("_u") < F.col(n), F.lit(v)).otherwise(pick)
        return df.withColumn(self._variable, pick).drop("_u", *names)

    def __str__(self):
        if not self.fitted():
            return super().__str__() + " not fitted"
        p = np.exp(self.logprob)
        lines = [super().__str__(), " | ".join([*self._evidence, *self.domains[self._variable]])]
        for cfg in itertools.product(*[range(len(self.domains[e])) for e in self._evidence]):
            lines.append(" | ".join([*[self.domains[e][i] for e, i in zip(self._evidence, cfg, strict=True)], *[f"{x:.3f}" for x in p[(slice(None), *cfg)]]]))
        return "\n".join(lines)


class MLE:
    """Maximum-likelihood estimation of a factor's parameters: MLE(LinearGaussianCPDType()).estimate(data, variable, evidence)."""

    def __init__(self, factor_type: FactorType):
        if factor_type not in (LinearGaussianCPDType(), DiscreteFactorType()):
            raise ValueError(f"no estimator for {factor_type}")
        self.factor_type = factor_type

    def estimate(self, data, variable: str, evidence: Sequence[str] = ()):
        f = self.factor_type.new_factor(None, variable, evidence).fit(data)
        return LinearGaussianParams(f.beta, f.variance) if isinstance(f, LinearGaussianCPD) else DiscreteFactorParams(f.logprob)


# ---------------------------------------------------------------- conditional kernel density


class CKDE(Factor):
    """Joint over marginal kernel density; the marginal uses the evidence block of the joint bandwidth."""

    def __init__(self, variable: str, evidence: Sequence[str] = (), bandwidth_selector: BandwidthSelector | None = None):
        super().__init__(variable, evidence)
        self._joint = KDE([variable, *evidence], bandwidth_selector)
        self._marg = KDE(list(evidence)) if evidence else None
        self._below: Callable | None = None  # sums of the training rows for the distribution function; made where points are scored

    def type(self):
        return CKDEType()

    def fitted(self):
        return self._joint.fitted()

    def data_type(self):
        return self._joint.data_type()

    def kde_joint(self) -> KDE:
        return self._joint

    def kde_marg(self) -> KDE | None:
        return self._marg

    def num_instances(self) -> int:
        return self._joint.num_instances()

    def fit(self, data, as_table: bool = False):
        data, cols = Dataset.of(data), [self._variable, *self._evidence]
        if not as_table and is_small(training_rows(data, cols), len(cols)):
            return self.fit_matrix(training_matrix(data, cols), data)
        return self.fit_table(data, SuffStats(data).moments(cols))

    def fit_table(self, data: Dataset, m: Moments):
        """Fit to rows that stay a table."""
        self._joint.fit_table(data, m)
        if self._marg is not None:
            self._marg.fit_table(data, m.take(self._evidence), self._joint.bandwidth[1:, 1:])
        return self

    def fit_matrix(self, x: np.ndarray, data: Dataset | None = None):
        self._joint.fit_matrix(x, data)
        self._below = None
        if self._marg is not None:
            self._marg.fit_matrix(x[:, 1:], data, self._joint.bandwidth[1:, 1:])
        return self

    def logl_arrays(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        x = np.column_stack([cols[c] for c in [self._variable, *self._evidence]])
        out = self._joint.logl_matrix(x)
        if self._marg is not None:
            out = out - np.where(np.isnan(x[:, 0]), np.nan, self._marg.logl_matrix(x[:, 1:]))
        return out

    def heavy(self) -> bool:
        return self._joint.x is not None and len(self._joint.x) > SPREAD_ROWS

    def scorer(self):
        return None if self._joint.x is None else ([self._variable, *self._evidence], [], self.logl_arrays)

    def _against(self, df, what, output):
        return score_against(df, [self._variable, *self._evidence], self._joint.table, what, {(0, None): self._joint.kernel()}, output)

    def attach_logl(self, df, output):
        if self._joint.x is None:
            return self._against(df, Conditional(), output)
        return score_rows(df, [self._variable, *self._evidence], {output: self.logl_arrays}, spread=self.heavy())

    def _conditional(self) -> tuple[np.ndarray, float]:
        """Regression of the variable on the evidence inside a kernel, and its deviation."""
        h = self._joint.bandwidth
        k = np.linalg.solve(h[1:, 1:], h[1:, 0]) if self._marg is not None else np.zeros(0)
        return k, math.sqrt(max(h[0, 0] - h[0, 1:] @ k, 0.0))

    def cdf_arrays(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        x = np.column_stack([cols[c] for c in [self._variable, *self._evidence]])
        what, kernel = Distribution(), self._joint.kernel()
        if self._below is None:
            self._below = what.over(kernel, self._joint.x, np.zeros(len(self._joint.x)))
        return what.result(kernel, self._below(x))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_below": None}

    def cdf(self, data, output="cdf"):
        self._check()
        if self._joint.x is None:
            return self._against(Dataset.of(data).df, Distribution(), output)
        return score_rows(Dataset.of(data).df, [self._variable, *self._evidence], {output: self.cdf_arrays}, spread=self.heavy())

    def sample_arrays(self, cols: dict[str, np.ndarray], u: np.ndarray, z: np.ndarray) -> np.ndarray:
        """A draw for each row from a uniform (which kernel) and a normal number (where in it)."""
        k, sd = self._conditional()
        t = self._joint.x
        if self._marg is None:
            return t[np.minimum((u * len(t)).astype(int), len(t) - 1), 0] + sd * z
        ev = np.column_stack([cols[e] for e in self._evidence])
        out = np.full(len(u), np.nan)
        ok = np.flatnonzero(~np.isnan(ev).any(1))
        step = max(1, 1_000_000 // len(t))
        for lo in range(0, len(ok), step):
            i = ok[lo : lo + step]
            w = self._marg.log_kernels(ev[i])
            c = np.exp(w - log_sum_exp(w, 1)[:, None]).cumsum(1)
            j = np.minimum((c < u[i][:, None] * c[:, -1:]).sum(1), len(t) - 1)
            out[i] = t[j, 0] + ((ev[i] - t[j, 1:]) * k).sum(1) + sd * z[i]
        return out

    def attach_sample(self, df, seed):
        if self._joint.x is None:
            return sample_against(df, self._evidence, self._joint.table, {(0, None): self._joint.kernel()}, self._variable, seed)
        df = df.withColumn("_u", F.rand(seed)).withColumn("_z", F.randn(seed + 1))
        return score_rows(df, [*self._evidence, "_u", "_z"], {self._variable: lambda c: self.sample_arrays(c, c["_u"], c["_z"])}).drop("_u", "_z")


# ---------------------------------------------------------------- one factor per discrete configuration


class _ByConfiguration(Factor):
    """Base factors keyed by the codes of the discrete evidence; a configuration without enough data has None."""

    base: type[Factor]

    def __init__(self, variable: str, evidence: Sequence[str], discrete: Sequence[str] | None = None, *args, per_assignment: dict[Assignment, tuple] | None = None, **kwargs):
        super().__init__(variable, evidence)
        self.discrete = list(discrete) if discrete is not None else None
        self.args, self.kwargs, self.per_assignment = args, kwargs, per_assignment or {}
        self.domains: dict[str, list[str]] = {}
        self.factors: dict[tuple[int, ...], Factor | None] | None = None

    def fitted(self):
        return self.factors is not None

    @property
    def continuous(self) -> list[str]:
        return [e for e in self._evidence if e not in self.discrete]

    def _start(self, data: Dataset) -> None:
        if self.discrete is None:
            self.discrete = [e for e in self._evidence if data.is_discrete(e)]
        self.domains = {c: list(data.discrete[c]) for c in self.discrete}

    def configurations(self) -> Iterable[tuple[int, ...]]:
        return itertools.product(*[range(len(self.domains[c])) for c in self.discrete])

    def assignment(self, cfg: tuple[int, ...]) -> Assignment:
        return Assignment({c: self.domains[c][i] for c, i in zip(self.discrete, cfg, strict=True)})

    def new_base(self, cfg: tuple[int, ...]) -> Factor:
        args = self.per_assignment.get(self.assignment(cfg), self.args)
        return self.base(self._variable, self.continuous, *args, **self.kwargs)

    def conditional_factor(self, assignment: Assignment) -> Factor | None:
        self._check()
        return self.factors[tuple(self.domains[c].index(assignment.value(c)) for c in self.discrete)]


class CLinearGaussianCPD(_ByConfiguration):
    """A regression for each configuration of the discrete parents. Without rows, with a variance near 0 or an infinite one there is none."""

    base = LinearGaussianCPD

    def type(self):
        return LinearGaussianCPDType()

    def fit(self, data):
        return self.fit_from(SuffStats(Dataset.of(data)))

    def fit_from(self, stats):
        self._start(stats.data)
        got = stats.grouped(self.discrete, [*self.continuous, self._variable])
        self.factors = {}
        for cfg in self.configurations():
            self.factors[cfg] = None
            if cfg in got:
                f = linear_fit(got[cfg], self._variable, self.continuous)
                if TOL <= f.variance < math.inf:
                    self.factors[cfg] = self.new_base(cfg)
                    self.factors[cfg]._beta, self.factors[cfg]._variance = f.beta, f.variance
        return self

    def _tables(self) -> dict[str, np.ndarray]:
        shape = tuple(len(self.domains[c]) for c in self.discrete)
        out = {f"_b{i}": np.full(shape, np.nan) for i in range(len(self.continuous) + 1)} | {"_v": np.full(shape, np.nan)}
        for cfg, f in self.factors.items():
            if f is not None:
                for i, b in enumerate(f.beta):
                    out[f"_b{i}"][cfg] = b
                out["_v"][cfg] = f.variance
        return out

    def _with_mean(self, df: DataFrame) -> tuple[DataFrame, Column, list[str]]:
        t = self._tables()
        df = _Table.attach(df, self.domains, self.discrete, t)
        mu = F.col("_b0")
        for i, e in enumerate(self.continuous):
            mu = mu + F.col(f"_b{i + 1}") * col(e)
        return df, mu, list(t)

    def attach_logl(self, df, output):
        df, mu, extra = self._with_mean(df)
        return df.withColumn(output, gaussian_logl(col(self._variable), mu, F.col("_v"))).drop(*extra)

    def attach_sample(self, df, seed):
        df, mu, extra = self._with_mean(df)
        return df.withColumn(self._variable, mu + F.randn(seed) * F.sqrt("_v")).drop(*extra)


class HCKDE(_ByConfiguration):
    """A conditional kernel density for each configuration of the discrete parents. Training rows beyond the bound of a matrix stay one table, whose
    configurations meet their own points in blocks."""

    base = CKDE
    table: TrainingTable | None = None

    def type(self):
        return CKDEType()

    def fit(self, data, as_table: bool = False):
        data = Dataset.of(data)
        self._start(data)
        cols = [self._variable, *self.continuous]
        self.factors, self.table = dict.fromkeys(self.configurations()), None
        rows = data.df.where(Dataset.valid([*cols, *self.discrete]))
        if as_table or not is_small(rows.count(), len(cols) + len(self.discrete)):
            return self._fit_table(data, rows, cols)
        coded = rows.select(*[col(c).alias(c) for c in cols], *[data.code(c).cast("double").alias(f"_g{i}") for i, c in enumerate(self.discrete)])
        m = training_matrix(Dataset(coded, coded.columns), coded.columns)
        code = m[:, len(cols) :].astype(int)
        for cfg in self.configurations():
            x = m[(code == np.array(cfg)).all(1), : len(cols)]
            if len(x):
                try:
                    self.factors[cfg] = self.new_base(cfg).fit_matrix(x)
                except (SingularCovarianceData, np.linalg.LinAlgError):
                    pass
        return self

    def _number(self) -> Column:
        """A row's configuration as the number by which kernels are kept."""
        return _Table.index(self.domains, self.discrete)[0]

    def _numbers(self) -> dict[tuple[int, ...], int]:
        out, step = {}, [math.prod(len(self.domains[c]) for c in self.discrete[:i]) for i in range(len(self.discrete))]
        for cfg in self.configurations():
            out[cfg] = sum(i * s for i, s in zip(cfg, step, strict=True))
        return out

    def _fit_table(self, data: Dataset, rows: DataFrame, cols: list[str]):
        self.table = TrainingTable(rows, cols, self._number())
        for cfg, m in SuffStats(data).grouped(self.discrete, cols).items():
            own = rows.where(functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`") == self.domains[c][i] for c, i in zip(self.discrete, cfg, strict=True)]))
            try:
                self.factors[cfg] = self.new_base(cfg).fit_table(Dataset(own, cols), m)
            except (SingularCovarianceData, np.linalg.LinAlgError):
                pass
        return self

    def kernels(self) -> dict[tuple[int, None], Kernel]:
        numbers = self._numbers()
        return {(numbers[cfg], None): f._joint.kernel() for cfg, f in self.factors.items() if f is not None}

    def _by_rows(self, cols: dict[str, np.ndarray], f: Callable[[Factor, dict[str, np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
        n = len(next(iter(cols.values())))
        out = np.full(n, np.nan)
        for cfg, factor in self.factors.items():
            if factor is not None:
                rows = np.flatnonzero(np.logical_and.reduce([cols[c] == self.domains[c][i] for c, i in zip(self.discrete, cfg, strict=True)]))
                if len(rows):
                    out[rows] = f(factor, {k: v[rows] for k, v in cols.items()}, rows)
        return out

    def logl_arrays(self, cols):
        return self._by_rows(cols, lambda f, c, _: f.logl_arrays(c))

    def heavy(self) -> bool:
        return any(f is not None and f.heavy() for f in self.factors.values())

    def scorer(self):
        return None if self.table is not None else ([self._variable, *self.continuous], list(self.discrete), self.logl_arrays)

    def attach_logl(self, df, output):
        if self.table is not None:
            return score_against(df, [self._variable, *self.continuous], self.table, Conditional(), self.kernels(), output, self._number())
        return score_rows(df, [self._variable, *self.continuous], {output: self.logl_arrays}, self.discrete, self.heavy())

    def attach_sample(self, df, seed):
        if self.table is not None:
            return sample_against(df, self.continuous, self.table, self.kernels(), self._variable, seed, self._number())
        df = df.withColumn("_u", F.rand(seed)).withColumn("_z", F.randn(seed + 1))
        draw = lambda cols: self._by_rows(cols, lambda f, c, _: f.sample_arrays(c, c["_u"], c["_z"]))
        return score_rows(df, [*self.continuous, "_u", "_z"], {self._variable: draw}, self.discrete).drop("_u", "_z")
