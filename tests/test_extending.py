"""Users' own classes in every place that takes one."""

import numpy as np
import pytest
from helpers import normal
from pyspark.sql import functions as F

from netloom.api import KDE, AddArc, BandwidthSelector, BayesianNetworkType, Dataset, Factor, FactorType, GreedyHillClimbing, HeterogeneousBN, IndependenceTest, LinearGaussianCPDType, Operator, OperatorSet, PC, Score, load


class LaplaceType(FactorType):
    def new_factor(self, model, variable, evidence, *args, **kwargs):
        return Laplace(variable, evidence)


class Laplace(Factor):
    """Around the median, without evidence."""

    def __init__(self, variable, evidence=()):
        super().__init__(variable, evidence)
        self.at = self.scale = None

    def type(self):
        return LaplaceType()

    def fitted(self):
        return self.at is not None

    def fit(self, data):
        df = Dataset.of(data).df.dropna(subset=[self.variable()])
        self.at = df.agg(F.median(self.variable())).first()[0]
        self.scale = df.agg(F.avg(F.abs(F.col(self.variable()) - self.at))).first()[0]
        return self

    def logl_column(self):
        return -F.abs(F.col(self.variable()) - self.at) / self.scale - F.log(F.lit(2 * self.scale))

    def attach_sample(self, df, seed):
        u = F.rand(seed) - 0.5
        return df.withColumn(self.variable(), self.at - self.scale * F.signum(u) * F.log(1 - 2 * F.abs(u)))


class OwnType(BayesianNetworkType):
    def default_node_type(self):
        return LaplaceType()

    def can_have_arc(self, model, source, target):
        return False


def test_own_factor_in_a_network(spark, tmp_path):
    pdf = normal(200)
    m = HeterogeneousBN([LaplaceType()], ["a", "b"]).fit(pdf)
    at = pdf["a"].median()
    s = (pdf["a"] - at).abs().mean()
    assert m.cpd("a").slogl(pdf) == pytest.approx((-(pdf["a"] - at).abs() / s - np.log(2 * s)).sum())
    assert m.slogl(pdf) == pytest.approx(m.cpd("a").slogl(pdf) + m.cpd("b").slogl(pdf))
    assert m.sample(30, 1).count() == 30 and load(m.save(str(tmp_path / "m"), True)).fitted()
    own = OwnType().new_bn(["a", "b"])
    with pytest.raises(ValueError):
        own.add_arc("a", "b")
    assert own.fit(pdf).fitted() and LaplaceType() == LaplaceType() != LinearGaussianCPDType()


class Fixed(BandwidthSelector):
    def bandwidth(self, data, variables):
        return np.eye(len(variables))

    def diag_bandwidth(self, data, variables):
        return np.ones(len(variables))


def test_own_bandwidth(spark):
    assert (KDE(["a", "b"], Fixed()).fit(normal(30)).bandwidth == np.eye(2)).all()


class Chain(IndependenceTest):
    def variables(self):
        return ["a", "b", "c"]

    def pvalue(self, x, y, z=None):
        return 1.0 if {x, y} == {"a", "c"} and z and "b" in z else 0.0


def test_own_test():
    g = PC().estimate(Chain())
    assert sorted(map(sorted, g.edges())) == [["a", "b"], ["b", "c"]]


class OnlyAB(OperatorSet):
    def __init__(self):
        super().__init__()
        self.done = False

    def cache_scores(self, model, score):
        self.local_score_cache(model, score)

    def find_max(self, model, tabu=None):
        return None if self.done else AddArc("a", "b", 1.0)

    def update_scores(self, model, score, changed):
        self.done = True


class Flat(Score):
    def has_variables(self, variables):
        return True

    def compatible_bn(self, model):
        return True

    def local_score(self, model, variable, evidence=None):
        return 0.0


class Nothing(Operator):
    def apply(self, model):
        pass

    def nodes_changed(self, model):
        return []


def test_own_operators():
    from netloom.api import GaussianNetwork

    m = GreedyHillClimbing().estimate(OnlyAB(), Flat(), GaussianNetwork(["a", "b"]))
    assert m.arcs() == [("a", "b")]
    assert Nothing(1.0) == Nothing(2.0) and str(Nothing(1.0)).startswith("Nothing")
