import math

import numpy as np
import pandas as pd
import pytest
from helpers import categories, hybrid, lstsq, normal, normal_logpdf, with_nulls

from netloom.operators.factors import CKDEType, DiscreteFactor, DiscreteFactorType, LinearGaussianCPD, LinearGaussianCPDType
from netloom.operators.models import CLGNetwork, CLGNetworkType, ConditionalGaussianNetwork, DiscreteBN, DynamicGaussianNetwork, GaussianNetwork, HeterogeneousBN, HomogeneousBN, KDENetwork, SemiparametricBN
from netloom.operators.scores import BDe, BGe, BIC, CVLikelihood, DynamicBIC, HoldoutLikelihood, ValidatedLikelihood
from netloom.operators.split import CrossValidation, HoldOut
from netloom.sources.dataset import Dataset
from netloom.sources.serialization import SaveModel, load

LG, KERNEL, DISCRETE = LinearGaussianCPDType(), CKDEType(), DiscreteFactorType()


def logl(m, pdf, out="logl"):
    return m.logl(Dataset.of(pdf.assign(_i=np.arange(len(pdf))))).toPandas().sort_values("_i")[out].to_numpy(float)


def test_gaussian_network(spark):
    pdf = with_nulls(normal(300), 10)
    m = GaussianNetwork(["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("b", "c")])
    with pytest.raises(ValueError):
        m.logl(pdf)
    m.fit(pdf)
    total, rows = 0.0, np.zeros(len(pdf))
    for v in "abcd":
        xs = m.parents(v)
        b, s2 = lstsq(pdf, v, xs)
        l = normal_logpdf(pdf[v], b[0] + sum(k * pdf[x] for k, x in zip(b[1:], xs, strict=True)), s2).to_numpy(float)
        total, rows = total + np.nansum(l), rows + l
    assert np.allclose(logl(m, pdf), rows, equal_nan=True) and m.slogl(pdf) == pytest.approx(total)
    s = m.sample(100, 1, ordered=True)
    assert s.columns == ["a", "b", "c", "d"] and s.count() == 100
    first = m.cpd("b")
    m.remove_arc("b", "c")
    assert not m.fitted()
    m.fit(pdf)
    assert m.cpd("b") is first and m.cpd("c").evidence() == ["a"]
    with pytest.raises(ValueError):
        m.add_cpds([LinearGaussianCPD("c", ["d"], [0, 1], 1)])
    with pytest.raises(ValueError):
        m.add_cpds([DiscreteFactor("a")])


def test_semiparametric_rules_and_scores(spark):
    pdf = normal(150)
    pdf["K"] = np.where(np.arange(150) % 2, "x", "y")
    m = SemiparametricBN(["a", "b", "K"], [("a", "b"), ("K", "b")], [("a", KERNEL)])
    m.fit(pdf)
    assert m.node_type("b") == LG and m.node_type("K") == DISCRETE
    with pytest.raises(ValueError):
        m.add_arc("a", "K")
    m.set_node_type("b", KERNEL)
    assert not m.fitted()
    m.fit(pdf)
    parts = sum(m.cpd(n).slogl(pdf) for n in m.nodes())
    assert m.slogl(pdf) == pytest.approx(parts) and np.nansum(logl(m, pdf)) == pytest.approx(parts)
    assert m.sample(50, 1).count() == 50


def test_other_networks(spark):
    pdf = hybrid(200)
    c = CLGNetwork(["A", "X", "Y"], [("A", "Y"), ("X", "Y")]).fit(pdf)
    assert c.slogl(pdf) == pytest.approx(sum(c.cpd(n).slogl(pdf) for n in "AXY"))
    with pytest.raises(ValueError):
        c.add_arc("X", "A")
    d = DiscreteBN(arcs=[("A", "B")]).fit(categories(200))
    assert d.sample(10, 1).count() == 10
    k = KDENetwork(["X", "Y"], [("X", "Y")]).fit(pdf)
    assert k.slogl(pdf) == pytest.approx(k.cpd("X").slogl(pdf) + k.cpd("Y").slogl(pdf))
    assert HomogeneousBN(LG, ["X", "Y"], [("X", "Y")]).fit(pdf).fitted()
    h = HeterogeneousBN({"continuous": [KERNEL, LG], "discrete": [DISCRETE]}, ["A", "X"]).fit(pdf)
    assert h.node_type("X") == KERNEL and h.node_type("A") == DISCRETE
    with pytest.raises(ValueError):
        GaussianNetwork(["a"]).set_node_type("a", KERNEL)


def test_conditional_network(spark):
    pdf = normal(120)
    m = ConditionalGaussianNetwork(["c", "d"], ["a", "b"], [("a", "c"), ("c", "d"), ("b", "d")]).fit(pdf)
    ev = Dataset.of(pdf[["a", "b"]]).df
    assert m.sample(ev, 1).columns == ["c", "d"] and m.sample(ev, 1, concat_evidence=True, ordered=True).columns == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        m.sample(5)
    with pytest.raises(ValueError):
        m.add_arc("c", "a")
    whole = GaussianNetwork(["a", "b", "c", "d"], [("a", "c")]).fit(pdf)
    part = whole.conditional_bn(["c", "d"], ["a", "b"])
    assert part.fitted() and part.slogl(pdf) == pytest.approx(whole.cpd("c").slogl(pdf) + whole.cpd("d").slogl(pdf))


def test_dynamic_network(spark):
    pdf = normal(80)[["a", "b"]]
    pdf["t"] = np.arange(80)
    d = Dataset.of(pdf, order_by=["t"])
    m = DynamicGaussianNetwork(["a", "b"], 2)
    m.static_bn().add_arc("a_t_2", "a_t_1")
    m.transition_bn().add_arc("a_t_1", "a_t_0")
    m.transition_bn().add_arc("b_t_2", "b_t_0")
    m.fit(d)
    got = m.logl(d).toPandas().sort_values("t")["logl"].to_numpy()
    st = pd.DataFrame({f"{v}_t_{k}": pdf[v].to_numpy()[2 - k : 81 - k] if k else None for v in "ab" for k in (1, 2)})
    row0 = sum(normal_logpdf(pdf[v][0], *_mean_var(m.static_bn().cpd(f"{v}_t_2"))) for v in "ab")
    assert got[0] == pytest.approx(row0) and len(got) == 80 and len(st) == 79
    f = m.transition_bn().cpd("a_t_0")
    want = normal_logpdf(pdf["a"][5], f.beta[0] + f.beta[1] * pdf["a"][4], f.variance)
    g = m.transition_bn().cpd("b_t_0")
    want += normal_logpdf(pdf["b"][5], g.beta[0] + g.beta[1] * pdf["b"][3], g.variance)
    assert got[5] == pytest.approx(want) and m.slogl(d) == pytest.approx(got.sum())
    s = m.sample(25, 3)
    assert s.columns == ["t", "a", "b"] and s.count() == 25
    m.add_variable("c")
    assert m.contains_variable("c") and m.transition_bn().contains_node("c_t_0")
    m.remove_variable("c")
    with pytest.raises(ValueError):
        DynamicGaussianNetwork(["a"], 0)


def _mean_var(f):
    return f.beta[0], f.variance


def test_bic(spark):
    pdf = with_nulls(normal(200), 8)
    for xs in ([], ["a"], ["a", "b", "c"]):
        x = pdf[["d", *xs]].dropna()
        b, v = lstsq(pdf, "d", xs)
        n, p = len(x), len(xs)
        ll = normal_logpdf(x["d"], b[0] + sum(k * x[c] for k, c in zip(b[1:], xs, strict=True)), v).sum()
        m = GaussianNetwork(list("abcd"), [(c, "d") for c in xs])
        assert BIC(pdf).local_score(m, "d") == pytest.approx(ll - 0.5 * math.log(n) * (p + 2))
    cat = categories(300)
    s = BIC(cat)
    ll = sum(n * math.log(n / (cat.B == b).sum()) for (c, b), n in cat.groupby(["C", "B"]).size().items())
    assert s.local_score(DiscreteBN(arcs=[("B", "C")]), "C") == pytest.approx(ll - 0.5 * math.log(300) * 1 * 3)
    pdf = hybrid(300)
    total = -0.5 * math.log(300) * 3 * 3
    for _, g in pdf.groupby("B"):
        b, v = lstsq(g, "Y", ["X"])
        total += normal_logpdf(g["Y"], b[0] + b[1] * g["X"], v).sum()
    m = CLGNetwork(["B", "X", "Y"], [("B", "Y"), ("X", "Y")])
    assert BIC(pdf).local_score(m, "Y") == pytest.approx(total)
    assert BIC(pdf).score(m) == pytest.approx(sum(BIC(pdf).local_score(m, n) for n in m.nodes()))


def test_bde_and_bge_are_score_equivalent(spark):
    cat, pdf = categories(200), normal(150)
    ab, ba = DiscreteBN(["A", "B"], [("A", "B")]), DiscreteBN(["A", "B"], [("B", "A")])
    assert BDe(cat, 2).score(ab) == pytest.approx(BDe(cat, 2).score(ba))
    g = BGe(pdf[["a", "b"]])
    ab, ba = GaussianNetwork(["a", "b"], [("a", "b")]), GaussianNetwork(["a", "b"], [("b", "a")])
    assert g.score(ab) == pytest.approx(g.score(ba)) and g.score(ab) > g.score(GaussianNetwork(["a", "b"]))
    # Dirichlet evidence by sequential prediction
    alpha, seen, want = 1 / 2, {"a1": 0, "a2": 0}, 0.0
    for i, v in enumerate(cat["A"]):
        want += math.log((seen[v] + alpha) / (i + 1))
        seen[v] += 1
    assert BDe(cat).of("A", []) == pytest.approx(want)
    with pytest.raises(ValueError):
        BDe(hybrid(50)).local_score(CLGNetwork(["X"]), "X")
    with pytest.raises(ValueError):
        BGe(hybrid(50)).local_score(CLGNetwork(["A"]), "A")


@pytest.mark.parametrize("kernel", [False, True])
def test_split_likelihoods(spark, kernel):
    pdf = normal(90)[["a", "b"]]
    pdf["id"] = np.arange(90)
    d = Dataset.of(pdf, order_by=["id"])
    m = (KDENetwork if kernel else GaussianNetwork)(["a", "b"], [("a", "b")])
    fit = lambda t: m.node_type("b").new_factor(m, "b", ["a"]).fit(t)
    want = sum(fit(tr.loc("a", "b")).slogl(te.loc("a", "b")) for tr, te in CrossValidation(d, 5, 3))
    assert CVLikelihood(d, 5, 3).local_score(m, "b") == pytest.approx(want)
    h = HoldOut(d, 0.2, 3)
    assert HoldoutLikelihood(d, 0.2, 3).local_score(m, "b") == pytest.approx(fit(h.training_data()).slogl(h.test_data()))
    v = ValidatedLikelihood(d, 0.2, 4, 3)
    assert v.vlocal_score(m, "b") == pytest.approx(fit(h.training_data()).slogl(h.test_data()))
    assert v.vscore(m) == pytest.approx(sum(v.vlocal_score(m, n) for n in m.nodes()))


def test_dynamic_score(spark):
    pdf = normal(60)[["a", "b"]]
    pdf["t"] = np.arange(60)
    s = DynamicBIC(Dataset.of(pdf, order_by=["t"]), markovian_order=1)
    assert s.has_variables(["a", "b"]) and s.static_score().has_variables("a_t_1") and s.transition_score().has_variables(["a_t_0", "b_t_1"])


def test_saving(spark, tmp_path):
    pdf = normal(60)
    m = GaussianNetwork(["a", "b"], [("a", "b")]).fit(pdf)
    bare, full = load(m.save(str(tmp_path / "m"))), load(m.save(str(tmp_path / "n.pickle"), True))
    assert not bare.fitted() and bare.arcs() == m.arcs() and full.slogl(pdf) == pytest.approx(m.slogl(pdf))
    k = KDENetwork(["a"]).fit(pdf)
    assert load(k.save(str(tmp_path / "k"), True)).slogl(pdf) == pytest.approx(k.slogl(pdf))
    f = CLGNetwork(["A", "X"], [("A", "X")]).fit(hybrid(60)).cpd("X")
    assert load(f.save(str(tmp_path / "f"))).slogl(hybrid(60)) == pytest.approx(f.slogl(hybrid(60)))
    assert load(m.graph().save(str(tmp_path / "g"))).arcs() == [("a", "b")]
    d = DynamicGaussianNetwork(["a"], 1)
    assert load(d.save(str(tmp_path / "d"))).variables() == ["a"]
    SaveModel(str(tmp_path / "steps")).call(m, None, None, 3)
    assert (tmp_path / "steps" / "000003.pickle").exists()
    assert CLGNetworkType() == CLGNetworkType() and LG == LinearGaussianCPDType() and hash(LG) == hash(LinearGaussianCPDType())


def test_streams(spark, tmp_path):
    from netloom.streaming.scoring import StreamingMoments, score_stream

    pdf = normal(60)
    for i in range(3):
        spark.createDataFrame(pdf[20 * i : 20 * i + 20]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a double, b double, c double, d double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    m = GaussianNetwork(["a", "b"], [("a", "b")]).fit(pdf)
    score_stream(m, stream, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / str(n))), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "*")).agg({"logl": "sum"}).first()[0] == pytest.approx(m.slogl(pdf))
    s = StreamingMoments(["a", "b"])
    s.start(stream, str(tmp_path / "c2")).awaitTermination()
    again = StreamingMoments(["a", "b"], s.folder)  # as after a restart
    for kept in (s, again):
        assert kept.moments.n == 60 and np.allclose(kept.moments.cov, pdf[["a", "b"]].cov())
    for _ in range(2):  # a repeated batch replaces itself
        again.update(spark.createDataFrame(pdf[:20]), 1000)
    assert again.moments.n == 80 and StreamingMoments(["a"]).moments.n == 0
