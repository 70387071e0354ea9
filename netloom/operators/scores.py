"""Decomposable network scores. A score's sufficient statistics are collected once for each null pattern, so a search costs few jobs."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from netloom.functions.special import TOL
from netloom.operators import blocks
from netloom.operators.factors import CKDE, HCKDE, Arguments, DiscreteFactorType, FactorType, LinearGaussianCPDType
from netloom.operators.kde import FromMoments, SingularCovarianceData, checked, is_small
from netloom.operators.models import DISCRETE, LG, UNKNOWN
from netloom.operators.split import CrossValidation, HoldOut
from netloom.operators.stats import Moments, SuffStats, linear_fit, moment_columns, moments_from
from netloom.operators.temporal import DynamicDataFrame
from netloom.sources.dataset import Dataset

LOG_2PI = math.log(2 * math.pi)


class Score(ABC):
    """Subclass with has_variables, compatible_bn and local_score; local_score_node_type is needed by searches over node types."""

    def data(self) -> Dataset | None:
        return None

    @abstractmethod
    def has_variables(self, variables) -> bool: ...

    @abstractmethod
    def compatible_bn(self, model) -> bool: ...

    @abstractmethod
    def local_score(self, model, variable: str, evidence: Sequence[str] | None = None) -> float: ...

    def local_score_node_type(self, model, node_type: FactorType, variable: str, evidence: Sequence[str]) -> float:
        raise NotImplementedError

    def score(self, model) -> float:
        return sum(self.local_score(model, n) for n in model.nodes())

    def prefetch(self, model, families: Sequence[tuple[str, Sequence[str]]]) -> None:
        """A hint: these local scores will be asked for."""


class _DataScore(Score):
    def __init__(self, data):
        self._data = Dataset.of(data)
        self.stats = SuffStats(self._data)

    def data(self):
        return self._data

    def has_variables(self, variables):
        return self._data.has_columns(*([variables] if isinstance(variables, str) else variables))

    def compatible_bn(self, model):
        return self.has_variables(model.joint_nodes())

    def local_score(self, model, variable, evidence=None):
        evidence = model.parents(variable) if evidence is None else list(evidence)
        return self.local_score_node_type(model, model.underlying_node_type(self._data, variable), variable, evidence)

    def _discrete(self, model, evidence: Sequence[str]) -> list[str]:
        return [e for e in evidence if model.underlying_node_type(self._data, e) == DISCRETE]

    def prefetch(self, model, families):
        self.stats.prefetch([[v, *ev] for v, ev in families if all(self._data.is_continuous(c) for c in (v, *ev))])


def gaussian_bic(m: Moments, variable: str, evidence: Sequence[str]) -> float:
    f, n, p = linear_fit(m, variable, evidence), m.n, len(evidence)
    if f.variance < TOL or math.isinf(f.variance):
        return -math.inf
    return 0.5 * (1 + p - n) - 0.5 * n * LOG_2PI - 0.5 * n * math.log(f.variance) - 0.5 * math.log(n) * (p + 2)


class BIC(_DataScore):
    """Linear-Gaussian, conditional linear-Gaussian and discrete nodes."""

    def local_score_node_type(self, model, node_type, variable, evidence):
        d = self._discrete(model, evidence)
        if node_type == DISCRETE:
            if len(d) != len(evidence):
                raise ValueError(f"{variable} is discrete and has continuous parents")
            return self.discrete(variable, evidence)
        if node_type == LG:
            return self.conditional_gaussian(variable, evidence, d) if d else gaussian_bic(self.stats.moments([variable, *evidence]), variable, evidence)
        raise ValueError(f"BIC has no score for {node_type}")

    def discrete(self, variable: str, evidence: Sequence[str]) -> float:
        c = self.stats.counts([variable, *evidence]).astype(float)
        c = c.reshape(c.shape[0], -1)
        total = c.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(c > 0, c * (np.log(c) - np.log(total)), 0).sum()
        n = c.sum()
        return float(ll - 0.5 * math.log(n) * (c.shape[0] - 1) * c.shape[1])

    def conditional_gaussian(self, variable: str, evidence: Sequence[str], discrete: Sequence[str]) -> float:
        cont = [e for e in evidence if e not in discrete]
        total, n = 0.0, 0
        for m in self.stats.grouped(discrete, [variable, *cont]).values():
            f = linear_fit(m, variable, cont)
            if f.variance < TOL or math.isinf(f.variance):
                return -math.inf
            total += 0.5 * (1 + len(cont) - m.n) - 0.5 * m.n * LOG_2PI - 0.5 * m.n * math.log(f.variance)
            n += m.n
        configs = math.prod(self._data.cardinality(d) for d in discrete)
        return total - 0.5 * math.log(n) * configs * (len(cont) + 2)


class BGe(_DataScore):
    """Bayesian Gaussian equivalent. Linear-Gaussian nodes with continuous parents only."""

    def __init__(self, data, iss_mu: float = 1.0, iss_w: float | None = None, nu: Sequence[float] | None = None):
        super().__init__(data)
        d = len(self._data.continuous)
        self.iss_mu, self.iss_w = float(iss_mu), float(d + 2 if iss_w is None else iss_w)
        if self.iss_w <= d - 1:
            raise ValueError("iss_w must exceed the number of variables minus one")
        self.nu = None if nu is None else dict(zip(self._data.continuous, nu, strict=True))

    def local_score_node_type(self, model, node_type, variable, evidence):
        if node_type != LG or self._discrete(model, evidence):
            raise ValueError("BGe needs linear-Gaussian nodes")
        return self.of(variable, evidence, len(model.joint_nodes()))

    def of(self, variable: str, evidence: Sequence[str], size: int) -> float:
        m, p = self.stats.moments([variable, *evidence]), len(evidence)
        n, am, aw = m.n, self.iss_mu, self.iss_w
        t = am * (aw - size - 1) / (am + 1)
        nu = m.mean if self.nu is None else np.array([self.nu[c] for c in m.cols])
        r = t * np.eye(p + 1) + m.sse + n * am / (n + am) * np.outer(m.mean - nu, m.mean - nu)
        out = 0.5 * (math.log(am) - math.log(n + am)) + math.lgamma(0.5 * (n + aw - size + p + 1)) - math.lgamma(0.5 * (aw - size + p + 1)) - 0.5 * n * math.log(math.pi)
        out += 0.5 * (aw - size + 2 * p + 1) * math.log(t)
        out -= 0.5 * (n + aw - size + p + 1) * np.linalg.slogdet(r)[1]
        if p:
            out += 0.5 * (n + aw - size + p) * np.linalg.slogdet(r[1:, 1:])[1]
        return float(out)


class BDe(_DataScore):
    """Bayesian Dirichlet equivalent with uniform prior. Discrete nodes only."""

    def __init__(self, data, iss: float = 1.0):
        super().__init__(data)
        self.iss = float(iss)

    def local_score_node_type(self, model, node_type, variable, evidence):
        if node_type != DISCRETE or len(self._discrete(model, evidence)) != len(evidence):
            raise ValueError("BDe needs discrete nodes")
        return self.of(variable, evidence)

    def of(self, variable: str, evidence: Sequence[str]) -> float:
        c = self.stats.counts([variable, *evidence]).reshape(self._data.cardinality(variable), -1)
        r, q = c.shape
        alpha = self.iss / (r * q)
        values, times = np.unique(c, return_counts=True)
        out = -r * q * math.lgamma(alpha) + sum(k * math.lgamma(v + alpha) for v, k in zip(values.tolist(), times.tolist(), strict=True))
        values, times = np.unique(c.sum(0), return_counts=True)
        return float(out + sum(k * (math.lgamma(r * alpha) - math.lgamma(r * alpha + v)) for v, k in zip(values.tolist(), times.tolist(), strict=True)))


def gaussian_test_logl(train: Moments, test: Moments, variable: str, evidence: Sequence[str]) -> float:
    """Log-likelihood of test rows, from moments alone, under the regression fitted to training rows."""
    f = linear_fit(train, variable, evidence)
    t = test.take([variable, *evidence])
    w = np.concatenate([[1.0], -f.beta[1:]])
    bias = t.mean @ w - f.beta[0]
    rss = w @ t.sse @ w + t.n * bias * bias
    if f.variance <= 0 or math.isinf(f.variance):
        return -math.inf if f.variance <= 0 else math.nan
    return float(-0.5 * rss / f.variance - 0.5 * t.n * (math.log(f.variance) + LOG_2PI))


class _SplitScore(_DataScore):
    """Scores by fitting on one part and scoring another. Linear-Gaussian families without discrete parents are answered from moments
    by part: one job for all of them."""

    def __init__(self, data, construction_args: Arguments | None = None):
        super().__init__(data)
        self.args = construction_args or Arguments()
        self._by_part: dict[tuple[str, ...], dict[int, Moments]] = {}
        self._kept: dict = {}

    def _parts(self) -> tuple:
        """(frame, part column) over all rows."""
        raise NotImplementedError

    def _part_moments(self, cols: Sequence[str]) -> dict[int, Moments]:
        key = tuple(sorted(cols))
        whole = tuple(sorted(self._data.continuous))
        ask = whole if self._data.null_free(whole) else key
        if ask not in self._by_part:
            frame, part = self._parts()
            rows = frame.groupBy(part).agg(*moment_columns(ask)).collect()
            self._by_part[ask] = {int(r[0]): moments_from(r, ask) for r in rows}
        return {k: m.take(cols) for k, m in self._by_part[ask].items()}

    def _factor(self, model, node_type, variable, evidence):
        a, k = self.args.args(variable, node_type)
        return node_type.new_factor(_Typed(model, self._data), variable, list(evidence), *a, **k)

    def _plain_gaussian(self, model, node_type, evidence) -> bool:
        return node_type == LG and not self._discrete(model, evidence)


class _Typed:
    """A model whose unknown node types are read from the data."""

    def __init__(self, model, data: Dataset):
        self.model, self.data = model, data

    def node_type(self, n: str) -> FactorType:
        t = self.model.node_type(n)
        return t if t != UNKNOWN else self.model.underlying_node_type(self.data, n)


class CVLikelihood(_SplitScore):
    """Sum over k folds of the log-likelihood of the fold under a fit to the others."""

    def __init__(self, data, k: int = 10, seed: int | None = None, construction_args: Arguments | None = None, key: Sequence[str] | None = None):
        super().__init__(data, construction_args)
        self.cv = CrossValidation(self._data, k, seed, key=key)
        self.cv.rows = self.cv.rows.persist()

    def _parts(self):
        return self.cv.frame(), "fold"

    def _group(self, discrete: Sequence[str]):
        """A row's configuration as a number, the first column fastest."""
        at, size = F.lit(0), 1
        for c in discrete:
            at, size = at + self._data.code(c) * size, size * self._data.cardinality(c)
        return at

    def _kernels(self, factor, cols: Sequence[str]) -> dict | None:
        """The kernel of each configuration and fold, fitted to the other folds' moments, which one job finds; None for factors that are no kernel
        densities, or whose bandwidths need more than moments. A configuration with too few rows has none."""
        if type(factor) not in (CKDE, HCKDE):
            return None
        discrete = list(getattr(factor, "discrete", None) or [])
        real = [c for c in cols if c not in discrete]
        codes = [self._data.code(c).alias(f"g{i}") for i, c in enumerate(discrete)]
        own = {}
        for cfg in factor.configurations() if discrete else [()]:
            own[cfg] = (factor.new_base(cfg) if discrete else factor)._joint.selector
        if not all(isinstance(x, FromMoments) for x in own.values()):
            return None
        rows = self.cv.frame().where(Dataset.valid(cols)).groupBy(*codes, "fold").agg(*moment_columns(real)).collect()
        parts = {(tuple(r[f"g{i}"] for i in range(len(discrete))), r["fold"]): moments_from(r, real) for r in rows}
        sizes, out = [math.prod(self._data.cardinality(c) for c in discrete[:i]) for i in range(len(discrete))], {}
        for (cfg, fold) in parts:
            train = Moments.empty(real)
            for (other, f), m in parts.items():
                if other == cfg and f != fold:
                    train = train + m
            try:
                h = own[cfg].full(checked(train))
                out[sum(i * s for i, s in zip(cfg, sizes, strict=True)), fold] = blocks.Kernel(train.mean, h, train.n)
            except (SingularCovarianceData, np.linalg.LinAlgError):
                if not discrete:
                    raise
        return out

    def local_score_node_type(self, model, node_type, variable, evidence):
        key = (node_type, variable, tuple(sorted(evidence)), tuple(sorted(self._discrete(model, evidence))))
        if key not in self._kept:
            cols = [variable, *evidence]
            if self._plain_gaussian(model, node_type, evidence):
                parts = self._part_moments(cols)
                total = 0.0
                for k, test in parts.items():
                    train = Moments.empty(cols)
                    for j, m in parts.items():
                        train = train + m if j != k else train
                    total += gaussian_test_logl(train, test, variable, evidence)
            elif (kernels := self._kernels(factor := self._factor(model, node_type, variable, evidence), cols)) is not None:
                discrete = list(getattr(factor, "discrete", None) or [])
                valid = self.cv.frame().where(Dataset.valid(cols))
                real = [c for c in cols if c not in discrete]
                total = blocks.fold_total(valid, real, blocks.Conditional(), kernels, self._group(discrete) if discrete else None, F.col("fold"), is_small)
            else:
                view = self.cv.loc(*cols)
                total = 0.0
                for train, test in view:
                    total += self._factor(model, node_type, variable, evidence).fit(train).slogl(test)
            self._kept[key] = total
        return self._kept[key]


class HoldoutLikelihood(_SplitScore):
    """Log-likelihood of a test part under a fit to the rest."""

    def __init__(self, data, test_ratio: float = 0.2, seed: int | None = None, construction_args: Arguments | None = None, key: Sequence[str] | None = None):
        super().__init__(data, construction_args)
        self.holdout = HoldOut(self._data, test_ratio, seed, key=key)
        self.holdout.rows = self.holdout.rows.persist()

    def training_data(self) -> Dataset:
        return self.holdout.training_data()

    def test_data(self) -> Dataset:
        return self.holdout.test_data()

    def _parts(self):
        return self.holdout.frame(), F.col("is_test").cast("int")

    def local_score_node_type(self, model, node_type, variable, evidence):
        key = (node_type, variable, tuple(sorted(evidence)), tuple(sorted(self._discrete(model, evidence))))
        if key not in self._kept:
            if self._plain_gaussian(model, node_type, evidence):
                parts = self._part_moments([variable, *evidence])
                self._kept[key] = gaussian_test_logl(parts[0], parts[1], variable, evidence)
            else:
                f = self._factor(model, node_type, variable, evidence).fit(self.training_data().loc(variable, list(evidence)))
                self._kept[key] = f.slogl(self.test_data().loc(variable, list(evidence)))
        return self._kept[key]


class ValidatedScore(Score):
    """A score with a second, held-out one: vlocal_score, vscore."""

    @abstractmethod
    def vlocal_score(self, model, variable: str, evidence: Sequence[str] | None = None) -> float: ...

    def vlocal_score_node_type(self, model, node_type, variable, evidence) -> float:
        raise NotImplementedError

    def vscore(self, model) -> float:
        return sum(self.vlocal_score(model, n) for n in model.nodes())


class ValidatedLikelihood(ValidatedScore):
    """Cross-validation on the training part of a hold-out split, whose test part validates."""

    def __init__(self, data, test_ratio: float = 0.2, k: int = 10, seed: int | None = None, construction_args: Arguments | None = None, key: Sequence[str] | None = None):
        self.holdout = HoldoutLikelihood(data, test_ratio, seed, construction_args, key)
        self.cv = CVLikelihood(self.holdout.training_data(), k, seed, construction_args, key)

    def data(self):
        return self.holdout.training_data()

    def training_data(self) -> Dataset:
        return self.holdout.training_data()

    def validation_data(self) -> Dataset:
        return self.holdout.test_data()

    def has_variables(self, variables):
        return self.cv.has_variables(variables)

    def compatible_bn(self, model):
        return self.cv.compatible_bn(model)

    def local_score(self, model, variable, evidence=None):
        return self.cv.local_score(model, variable, evidence)

    def local_score_node_type(self, model, node_type, variable, evidence):
        return self.cv.local_score_node_type(model, node_type, variable, evidence)

    def vlocal_score(self, model, variable, evidence=None):
        return self.holdout.local_score(model, variable, evidence)

    def vlocal_score_node_type(self, model, node_type, variable, evidence):
        return self.holdout.local_score_node_type(model, node_type, variable, evidence)


class DynamicScore(ABC):
    @abstractmethod
    def static_score(self) -> Score: ...

    @abstractmethod
    def transition_score(self) -> Score: ...

    def has_variables(self, variables) -> bool:
        names = [variables] if isinstance(variables, str) else variables
        return all(v in self.slices.variables for v in names)


class _Dynamic(DynamicScore):
    kind: type[Score]

    def __init__(self, data, *args, markovian_order: int = 1, order_by: Sequence[str] | None = None, **kwargs):
        self.slices = data if isinstance(data, DynamicDataFrame) else DynamicDataFrame(data, markovian_order, order_by)
        self._static = self.kind(self.slices.static_df(), *args, **kwargs)
        self._transition = self.kind(self.slices.transition_df(), *args, **kwargs)

    def static_score(self):
        return self._static

    def transition_score(self):
        return self._transition


class DynamicBIC(_Dynamic):
    kind = BIC


class DynamicBGe(_Dynamic):
    kind = BGe


class DynamicBDe(_Dynamic):
    kind = BDe


class DynamicCVLikelihood(_Dynamic):
    kind = CVLikelihood


class DynamicHoldoutLikelihood(_Dynamic):
    kind = HoldoutLikelihood


class DynamicValidatedLikelihood(_Dynamic):
    kind = ValidatedLikelihood
