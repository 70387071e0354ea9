import math

import numpy as np
import pandas as pd
import pytest
from helpers import categories, hybrid, lstsq, normal, normal_logpdf, with_nulls

from netloom.functions.special import normal_cdf
from netloom.operators.factors import CKDE, HCKDE, MLE, Arguments, Args, Assignment, CLinearGaussianCPD, DiscreteFactor, DiscreteFactorType, Kwargs, LinearGaussianCPD, LinearGaussianCPDType
from netloom.operators import blocks, kde
from netloom.operators.kde import KDE, NormalReferenceRule, ProductKDE, ScottsBandwidth, SingularCovarianceData, UCV, UCVScorer
from netloom.sources.dataset import Dataset


def scored(f, pdf, what="logl"):
    pdf = pdf.assign(_i=np.arange(len(pdf)))
    return getattr(f, what)(Dataset.of(pdf)).toPandas().sort_values("_i")[what].to_numpy(float)


def gauss(d, h):
    return np.exp(-0.5 * np.einsum("...i,ij,...j", d, np.linalg.inv(h), d)) / math.sqrt(np.linalg.det(2 * math.pi * h))


@pytest.mark.parametrize("xs", [[], ["a"], ["a", "b"], ["c", "a", "b"]])
def test_linear_gaussian(spark, xs):
    pdf, test = with_nulls(normal(400)), with_nulls(normal(60, 9), 5)
    f = LinearGaussianCPD("d", xs).fit(pdf)
    b, v = lstsq(pdf, "d", xs)
    assert np.allclose(f.beta, b) and f.variance == pytest.approx(v)
    mu = b[0] + sum(k * test[x] for k, x in zip(b[1:], xs, strict=True))
    want = normal_logpdf(test["d"], mu, v).to_numpy(float) if xs else normal_logpdf(test["d"], b[0], v).to_numpy(float)
    assert np.allclose(scored(f, test), want, equal_nan=True)
    assert f.slogl(test) == pytest.approx(np.nansum(want))
    assert np.allclose(scored(f, test, "cdf"), normal_cdf(((test["d"] - mu) / math.sqrt(v)).to_numpy(float)), equal_nan=True)


def test_linear_gaussian_parameters():
    f = LinearGaussianCPD("y", ["x"], [1, 2], 4)
    assert f.fitted() and "1.000 + 2.000*x" in str(f)
    for bad in ({"beta": [1], "variance": 1}, {"beta": [1, 2], "variance": 0}):
        with pytest.raises(ValueError):
            LinearGaussianCPD("y", ["x"], **bad)
    with pytest.raises(ValueError):
        LinearGaussianCPD("y").logl(None)
    assert MLE(LinearGaussianCPDType()).estimate(normal(50), "b", ["a"]).beta.shape == (2,)


def test_sampling(spark):
    x = LinearGaussianCPD("x", [], [3.0], 4.0).sample(20000, seed=1).toPandas()["x"]
    assert abs(x.mean() - 3) < 0.1 and abs(x.var() - 4) < 0.25
    f = DiscreteFactor("A").fit(categories(5000))
    assert abs((f.sample(8000, seed=2).toPandas()["A"] == "a1").mean() - 0.6) < 0.03
    pdf = normal(300)
    k = CKDE("b", ["a"]).fit(pdf)
    got = k.sample(300, Dataset.of(pdf[["a"]]).df, 3).toPandas()
    assert abs(np.corrcoef(got["a"], got["b"])[0, 1] - np.corrcoef(pdf["a"], pdf["b"])[0, 1]) < 0.15
    with pytest.raises(ValueError):
        k.sample(5)


def test_discrete(spark):
    pdf = with_nulls(categories(500))
    d = Dataset.of(pdf, discrete={"A": ["a1", "a2", "a3"]})
    f = DiscreteFactor("C", ["A", "B"]).fit(d)
    x = pdf.dropna()
    for i, c in enumerate(["c1", "c2"]):
        for j, a in enumerate(["a1", "a2", "a3"]):
            for k, b in enumerate(["b1", "b2", "b3"]):
                n = ((x.A == a) & (x.B == b)).sum()
                want = 0.5 if n == 0 else ((x.A == a) & (x.B == b) & (x.C == c)).sum() / n
                assert math.exp(f.logprob[i, j, k]) == pytest.approx(want)
    l = scored(f, pdf)
    assert np.isnan(l).sum() == len(pdf) - len(x) and f.slogl(d) == pytest.approx(np.nansum(l))
    assert "0.500" in str(f) and MLE(DiscreteFactorType()).estimate(d, "A").logprob.shape == (3,)
    with pytest.raises(ValueError):
        f.logl(pd.DataFrame({"A": ["zz"], "B": ["b1"], "C": ["c1"]}))


def test_conditional_linear_gaussian(spark):
    pdf = hybrid(600)
    f = CLinearGaussianCPD("Y", ["A", "X", "B"]).fit(pdf)
    l, want = scored(f, pdf), np.full(len(pdf), np.nan)
    for (a, b), g in pdf.groupby(["A", "B"]):
        k, v = lstsq(g, "Y", ["X"])
        want[g.index] = normal_logpdf(g["Y"], k[0] + k[1] * g["X"], v)
        assert np.allclose(f.conditional_factor(Assignment({"A": a, "B": b})).beta, k)
    assert np.allclose(l, want)
    assert f.conditional_factor(Assignment({"A": "a2", "B": "b3"})) is None
    assert f.sample(600, Dataset.of(pdf[["A", "X", "B"]]).df, 1).count() == 600


def test_conditional_kernel_density_by_configuration(spark):
    pdf = hybrid(300)
    f = HCKDE("Y", ["X", "A"]).fit(pdf)
    l = scored(f, pdf)
    for a, g in pdf.groupby("A"):
        one = CKDE("Y", ["X"]).fit(g.reset_index(drop=True))
        assert np.allclose(l[g.index], scored(one, g.reset_index(drop=True)))
    assert f.sample(300, Dataset.of(pdf[["X", "A"]]).df, 1).count() == 300


@pytest.mark.parametrize("cols", [["a"], ["a", "b"], ["d", "a", "b"]])
def test_kde(spark, cols):
    pdf, test = normal(150), with_nulls(normal(80, 3), 5)
    for k, d in ((KDE(cols).fit(pdf), False), (ProductKDE(cols).fit(pdf), True)):
        h = np.diag(k.bandwidth) if d else k.bandwidth
        x, t = pdf[cols].to_numpy(), test[cols].to_numpy(float)
        want = np.log(gauss(t[:, None] - x[None], h).mean(1))
        got = scored(k, test)
        assert np.allclose(got, want, equal_nan=True) and k.slogl(test) == pytest.approx(np.nansum(want))
    n, c = len(pdf), pdf[cols].cov().to_numpy()
    p = len(cols)
    assert np.allclose(NormalReferenceRule().bandwidth(pdf, cols), (4 / (n * (p + 2))) ** (2 / (p + 4)) * c)
    assert np.allclose(ScottsBandwidth().bandwidth(pdf, cols), n ** (-2 / (p + 4)) * c)
    assert np.allclose(ScottsBandwidth().diag_bandwidth(pdf, cols), n ** (-2 / (p + 4)) * np.diag(c))


def test_kde_guards(spark):
    pdf = normal(40)
    pdf["a2"] = 2 * pdf["a"]
    with pytest.raises(SingularCovarianceData):
        KDE(["a", "a2"]).fit(pdf)
    with pytest.raises(SingularCovarianceData):
        KDE(["a", "b"]).fit(pdf[:2])
    with pytest.raises(ValueError):
        KDE([])
    with pytest.raises(ValueError):
        KDE(["a"]).logl(pdf)
    k = KDE(["a"]).fit(pdf)
    with pytest.raises(ValueError):
        k.logl(pdf.astype("float32"))
    assert k.num_instances() == 40 and k.dataset(spark).count() == 40
    far = pd.DataFrame({"a": [1e3]})
    assert np.isfinite(scored(k, far)).all()


def test_ckde(spark):
    pdf, test = normal(200), normal(30, 5)
    f = CKDE("c", ["a", "b"]).fit(pdf)
    cols = ["c", "a", "b"]
    h, x, t = f.kde_joint().bandwidth, pdf[cols].to_numpy(), test[cols].to_numpy()
    joint, marg = gauss(t[:, None] - x[None], h).mean(1), gauss(t[:, None, 1:] - x[None, :, 1:], h[1:, 1:])
    assert np.allclose(scored(f, test), np.log(joint) - np.log(marg.mean(1)))
    k = np.linalg.solve(h[1:, 1:], h[1:, 0])
    sd = math.sqrt(h[0, 0] - h[0, 1:] @ k)
    mean = x[None, :, 0] + (t[:, None, 1:] - x[None, :, 1:]) @ k
    want = (normal_cdf((t[:, :1] - mean) / sd) * marg).sum(1) / marg.sum(1)
    assert np.allclose(scored(f, test, "cdf"), want)
    g = CKDE("c", ["b", "a"]).fit(pdf)
    assert np.allclose(scored(f, test), scored(g, test))
    u = CKDE("a").fit(pdf)
    assert np.allclose(scored(u, test, "cdf"), normal_cdf((test[["a"]].to_numpy() - pdf["a"].to_numpy()[None]) / math.sqrt(u.kde_joint().bandwidth[0, 0])).mean(1))


def test_ucv(spark):
    pdf = normal(60)
    x, n = pdf[["a", "b"]].to_numpy(), 60
    h = np.array([[0.1, 0.02], [0.02, 0.9]])
    d = x[:, None] - x[None]
    off = ~np.eye(n, dtype=bool)
    want = gauss(np.zeros(2), 2 * h) + gauss(d, 2 * h)[off].sum() / n - 2 * gauss(d, h)[off].sum() / (n - 1)
    sc = UCVScorer(pdf, ["a", "b"])
    assert sc.score_unconstrained(h) == pytest.approx(want)
    assert sc.score_diagonal([0.1, 0.9]) == pytest.approx(sc.score_unconstrained(np.diag([0.1, 0.9])))
    best = UCV().diag_bandwidth(pdf, ["a", "b"])
    assert sc.score_diagonal(best) <= sc.score_diagonal(NormalReferenceRule().diag_bandwidth(pdf, ["a", "b"])) + 1e-9
    full = UCV().bandwidth(pdf, ["a", "b"])
    assert sc.score_unconstrained(full) <= sc.score_unconstrained(NormalReferenceRule().bandwidth(pdf, ["a", "b"])) + 1e-9


def test_arguments_and_assignments():
    t = LinearGaussianCPDType()
    a = Arguments({"x": Args(1), t: Kwargs(k=2), ("y", t): (Args(3), Kwargs(z=4))})
    assert a.args("x", t) == ((1,), {}) and a.args("y", t) == ((3,), {"z": 4}) and a.args("q", t) == ((), {"k": 2}) and Arguments().args("q", t) == ((), {})
    p, q = Assignment({"a": "x", "b": 1.0}), Assignment({"b": 1.0, "a": "x"})
    assert p == q and hash(p) == hash(q) and p.size() == 2 and p.has_variables(["a", "b"]) and not p.empty()
    p.remove("a")
    assert p != q and p.value("b") == 1.0


# ---------------------------------------------------------------- training rows as a table


@pytest.fixture
def tables(monkeypatch):
    """Every training set is too large for a matrix, and blocks are small."""
    monkeypatch.setattr(kde, "MAX_TRAINING_BYTES", 0)
    monkeypatch.setattr(blocks, "POINTS", 16)
    monkeypatch.setattr(blocks, "TRAINING", 50)


def copied(n=180):
    """Rows of which a third are one row, with nulls."""
    pdf = normal(n)[["a", "b", "c"]]
    pdf.loc[: n // 3, ["a", "b", "c"]] = pdf.loc[0, ["a", "b", "c"]].to_numpy()
    pdf.loc[n - 3, "b"] = np.nan
    return pdf


def both_ways(monkeypatch, fit, score):
    """What a factor fitted to a table and one fitted to a matrix give."""
    small = fit()
    with monkeypatch.context() as m:
        m.setattr(kde, "MAX_TRAINING_BYTES", 0)
        m.setattr(blocks, "POINTS", 16)
        m.setattr(blocks, "TRAINING", 50)
        large = fit()
        return score(small), score(large), large


@pytest.mark.parametrize("kind", [KDE, ProductKDE])
def test_densities_of_a_table(spark, monkeypatch, kind):
    pdf, test = copied(), normal(40, 5)[["a", "b", "c"]]
    test = pd.concat([test, pdf.head(5), test.head(3)])
    test.loc[test.index[4], "a"] = np.nan
    few, many, f = both_ways(monkeypatch, lambda: kind(["a", "b"]).fit(pdf), lambda k: np.sort(np.nan_to_num(k.logl(Dataset.of(test)).toPandas()["logl"].to_numpy(float), nan=9)))
    assert np.allclose(few, many) and f.x is None and f.num_instances() == 179 and f.dataset().count() == 179 and len(many) == 48
    with pytest.raises(ValueError):
        f.logl_matrix(np.zeros((1, 2)))


@pytest.mark.parametrize("evidence", [[], ["a", "b"]])
def test_ckde_of_a_table(spark, monkeypatch, evidence):
    pdf, test = copied(), normal(40, 5)[["a", "b", "c"]]
    fit = lambda: CKDE("c", evidence).fit(pdf)
    for what in ("logl", "cdf"):
        few, many, f = both_ways(monkeypatch, fit, lambda k: getattr(k, what)(Dataset.of(test)).orderBy("c").toPandas()[what].to_numpy(float))
        assert np.allclose(few, many)
    assert f.scorer() is None
    ev = None if not evidence else spark.createDataFrame(pd.concat([test[["a", "b"]].head(1)] * 3000))
    draws = f.sample(3000, ev, seed=3).toPandas()["c"].to_numpy()
    again = CKDE("c", evidence).fit(pdf).sample(3000, ev, seed=8).toPandas()["c"].to_numpy()
    assert len(draws) == 3000 and abs(draws.mean() - again.mean()) < 5 * again.std() / math.sqrt(1500) and np.allclose(np.quantile(draws, [0.25, 0.5, 0.75]), np.quantile(again, [0.25, 0.5, 0.75]), atol=0.35 * again.std())


def test_hckde_of_a_table_with_a_hot_configuration(spark, monkeypatch):
    pdf = copied(240)
    pdf["d"] = np.where(np.arange(240) % 10 == 0, "x", "y")  # y has 90 % of the rows
    pdf["e"] = np.where(np.arange(240) == 5, "one", "more")  # a configuration of one row has no factor
    test = pdf.sample(60, random_state=1).reset_index(drop=True)
    test["i"] = np.arange(60)
    fit = lambda: HCKDE("c", ["a", "d", "e"], ["d", "e"]).fit(Dataset.of(pdf))
    few, many, f = both_ways(monkeypatch, fit, lambda k: k.logl(Dataset.of(test)).orderBy("i").toPandas()["logl"].to_numpy(float))
    assert np.allclose(few, many, equal_nan=True) and f.table is not None and f.factors[0, 0] is not None
    assert f.conditional_factor(Assignment({"d": "y", "e": "more"})).num_instances() > 150
    got = f.sample(60, spark.createDataFrame(test[["a", "d", "e"]].dropna()), seed=1).toPandas()
    assert len(got) == len(test.dropna(subset=["a"])) and got["c"].notna().sum() >= 50


def test_ucv_of_a_table_is_that_of_its_matrix(spark, tables):
    pdf = copied(150).dropna()
    data, x = Dataset.of(pdf), pdf[["a", "b"]].to_numpy()
    table, matrix = UCVScorer(data, ["a", "b"]), UCVScorer(None, ["a", "b"], x)
    roots = [np.array([0.3, 0.8]), np.linalg.cholesky(np.array([[0.2, 0.05], [0.05, 0.7]]))]
    assert np.allclose(table.scores(roots), matrix.scores(roots))
    far = normal(70)[["a"]]
    assert UCV().diag_bandwidth(Dataset.of(far), ["a"]) == pytest.approx(UCV().of(None, ["a"], far.to_numpy(), True), rel=1e-3)
