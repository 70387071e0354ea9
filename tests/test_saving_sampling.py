"""Models in folders of shared file systems, and draws of many series."""

import json

import numpy as np
import pandas as pd
import pytest
from helpers import hybrid, normal

from netloom.operators import blocks, kde
from netloom.operators.factors import CKDE, HCKDE, CKDEType
from netloom.operators.graph import Dag, PartiallyDirectedGraph
from netloom.operators.kde import KDE, ProductKDE, ScottsBandwidth
from netloom.operators.models import CLGNetwork, DiscreteBN, DynamicCLGNetwork, DynamicDiscreteBN, DynamicGaussianNetwork, DynamicSemiparametricBN, GaussianNetwork, SemiparametricBN
from netloom.sources.dataset import Dataset
from netloom.sources.serialization import load, save


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    return tmp_path_factory.mktemp("models")


@pytest.fixture(scope="module")
def shared(spark, place):
    """A file system that only Spark's readers open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.box.link./models", f"file://{place}")
    return "viewfs://box/models"


def networks():
    g, h = normal(200), hybrid(300)
    gauss = GaussianNetwork(["a", "b", "c"], [("a", "b"), ("b", "c")]).fit(g)
    semi = SemiparametricBN(["a", "b", "c"], [("a", "b")], [("b", CKDEType())]).fit(g)
    clg = CLGNetwork(["A", "B", "X", "Y"], [("A", "X"), ("X", "Y"), ("A", "B")]).fit(Dataset.of(h))
    disc = DiscreteBN(["A", "B"], [("A", "B")]).fit(Dataset.of(h[["A", "B"]]))
    return [(gauss, g), (semi, g), (clg, h), (disc, h)]


def test_networks_through_a_shared_folder(spark, shared):
    for i, (m, data) in enumerate(networks()):
        uri = save(m, f"{shared}/m{i}", include_cpd=True)
        back = load(uri)
        assert type(back) is type(m) and back.arcs() == m.arcs() and back.nodes() == m.nodes() and not m.include_cpd
        d = Dataset.of(data)
        assert back.slogl(d) == m.slogl(d)
        assert not load(save(m, f"{shared}/m{i}")).fitted()  # replaced by one without factors
    dynamic = DynamicGaussianNetwork(["a"], 2)
    assert load(save(dynamic, f"{shared}/d")).markovian_order() == 2
    g = Dag(["x", "y"], [("x", "y")])
    assert load(save(g, f"{shared}/g")).arcs() == [("x", "y")]
    p = PartiallyDirectedGraph(["x", "y", "z"], [("x", "y")], [("y", "z")])
    assert load(save(p, f"{shared}/p")).edges() == p.edges()


def test_densities_and_training_tables_through_a_shared_folder(spark, shared, monkeypatch):
    pdf, test = normal(300), normal(20, 4)
    d = Dataset.of(test)
    rows = lambda f: np.sort(f.logl(d).toPandas()["logl"].to_numpy())
    monkeypatch.setattr("netloom.sources.folder.CELLS", 100)  # the matrix is a table of its own
    few = ProductKDE(["a", "b"], ScottsBandwidth()).fit(pdf)
    assert np.allclose(rows(load(save(few, f"{shared}/few"))), rows(few))
    monkeypatch.setattr(kde, "MAX_TRAINING_BYTES", 0)
    monkeypatch.setattr(blocks, "TRAINING", 100)
    for i, f in enumerate((KDE(["a", "b"]).fit(pdf), CKDE("c", ["a"]).fit(pdf))):
        back = load(save(f, f"{shared}/t{i}"))
        assert np.allclose(rows(back), rows(f)) and back.num_instances() == 300
    h = hybrid(200)
    f = HCKDE("Y", ["X", "A"], ["A"]).fit(Dataset.of(h))
    back = load(save(f, f"{shared}/h"))
    assert back.slogl(Dataset.of(h)) == pytest.approx(f.slogl(Dataset.of(h)))


def test_a_folder_names_classes_of_this_package_only(spark, shared, place):
    save(Dag(["x"]), f"{shared}/bad")
    file = place / "bad" / "model.json"
    data = json.loads(file.read_text())
    data["model"]["class"] = "os:system"
    (place / "bad" / ".model.json.crc").unlink()
    file.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        load(f"{shared}/bad")
    with pytest.raises(TypeError):
        save(object(), f"{shared}/none")


def series_of(n=400):
    r = np.random.default_rng(2)
    x = [0.0, 0.5]
    for _ in range(n - 2):
        x.append(1 + 0.6 * x[-1] - 0.3 * x[-2] + 0.5 * r.normal())
    return pd.DataFrame({"t": np.arange(n), "x": x})


def test_many_series_side_by_side(spark):
    """An autoregression's draws keep its law; every series is its own, and partitioning changes nothing."""
    m = DynamicGaussianNetwork(["x"], 2)
    for k in (1, 2):
        m.transition_bn().add_arc(f"x_t_{k}", "x_t_0")
    m.static_bn().add_arc("x_t_2", "x_t_1")
    m.fit(Dataset.of(series_of(), order_by=["t"]))
    out = m.sample(60, seed=5, series=700)
    got = out.toPandas().sort_values(["series", "t"])
    assert len(got) == 700 * 60 and got["series"].nunique() == 700 and (got.groupby("series")["t"].max() == 59).all()
    assert got.equals(m.sample(60, seed=5, series=700).repartition(3).toPandas().sort_values(["series", "t"]).set_index(got.index)) and not m.include_cpd
    x = got["x"].to_numpy().reshape(700, 60)
    y, a, b = x[:, 2:].ravel(), x[:, 1:-1].ravel(), x[:, :-2].ravel()
    fit = np.linalg.lstsq(np.column_stack([np.ones(len(y)), a, b]), y, rcond=None)[0]
    f = m.transition_bn().cpd("x_t_0")
    at = {e: k for k, e in enumerate(f.evidence())}
    want = [f.beta[0], f.beta[1 + at["x_t_1"]], f.beta[1 + at["x_t_2"]]]
    assert np.allclose(fit, want, atol=0.03) and abs(np.std(y - np.column_stack([np.ones(len(y)), a, b]) @ fit) ** 2 / f.variance - 1) < 0.05
    one = m.sample(10, seed=1).toPandas()
    assert list(one.columns) == ["t", "x"] and list(one["t"]) == list(range(10))
    assert m.sample(0).count() == 0 and len(m.sample(1).collect()) == 1
    with pytest.raises(ValueError):
        m.sample(-1)


def test_series_of_other_factors(spark):
    r = np.random.default_rng(3)
    n = 500
    s = np.where(r.random(n) < 0.3, "p", "q")
    pdf = pd.DataFrame({"t": np.arange(n), "s": s, "v": np.where(s == "p", 5.0, -5.0) + r.normal(size=n)})
    d = Dataset.of(pdf, order_by=["t"])
    disc = DynamicDiscreteBN(["s"], 1).fit(Dataset.of(pdf[["t", "s"]], order_by=["t"]))
    got = disc.sample(200, seed=1, series=300).toPandas()
    assert abs((got["s"] == "p").mean() - (s == "p").mean()) < 0.02
    clg = DynamicCLGNetwork(["s", "v"], 1)
    clg.transition_bn().add_arc("s_t_0", "v_t_0")
    clg.static_bn().add_arc("s_t_1", "v_t_1")
    got = clg.fit(d).sample(20, seed=2, series=400).toPandas()
    assert ((got["v"] > 0) == (got["s"] == "p")).mean() > 0.999
    semi = DynamicSemiparametricBN(["v"], 1)
    semi.transition_bn().set_node_type("v_t_0", CKDEType())
    got = semi.fit(Dataset.of(pdf[["t", "v"]], order_by=["t"])).sample(30, seed=2, series=200).toPandas()
    assert len(got) == 6000 and abs(got["v"].mean() - pdf["v"].mean()) < 0.6
