import itertools
import math

import numpy as np
import pandas as pd
import pytest
from helpers import categories, hybrid, normal, with_nulls

from netloom.functions.special import chi2_sf, digamma, t_two_sided
from netloom.operators.constraint import SepSets
from netloom.operators.factors import CKDEType, LinearGaussianCPDType
from netloom.operators.graph import Dag, PartiallyDirectedGraph
from netloom.operators import independence, neighbours
from netloom.operators.independence import ChiSquare, DynamicLinearCorrelation, IndependenceTest, KMutualInformation, LinearCorrelation, MutualInformation, RCoT, TestTable, knn_mi, ranks
from netloom.operators.learn import DMMHC, MMHC, MMPC, PC, Callback, GreedyHillClimbing, check_restrictions, hc
from netloom.operators.models import CLGNetworkType, DiscreteBNType, GaussianNetwork, GaussianNetworkType, SemiparametricBN, SemiparametricBNType
from netloom.operators.scores import BIC, DynamicBIC, Score
from netloom.operators.search import AddArc, ArcOperatorSet, ChangeNodeType, ChangeNodeTypeSet, FlipArc, LocalScoreCache, OperatorPool, OperatorTabuSet, RemoveArc
from netloom.sources.dataset import Dataset


def test_partial_correlation(spark):
    pdf = with_nulls(normal(200), 5)
    t = LinearCorrelation(pdf)
    for z in ([], ["c"], ["c", "d"]):
        x = pdf[["a", "b", *z]].dropna()
        m = np.column_stack([np.ones(len(x)), *[x[c] for c in z]])
        ra, rb = (x[v] - m @ np.linalg.lstsq(m, x[v], rcond=None)[0] for v in "ab")
        r, df = np.corrcoef(ra, rb)[0, 1], len(x) - 2 - len(z)
        assert t.pvalue("a", "b", z) == pytest.approx(t_two_sided(r * math.sqrt(df / (1 - r * r)), df), rel=1e-6)
    with pytest.raises(ValueError):
        LinearCorrelation(pdf[["a"]])


def test_chi_square(spark):
    pdf = categories(300)
    t = ChiSquare(pdf)
    c = pd.crosstab(pdf.A, pdf.C).to_numpy()
    e = c.sum(1, keepdims=True) * c.sum(0, keepdims=True) / c.sum()
    assert t.pvalue("A", "C") == pytest.approx(chi2_sf(((c - e) ** 2 / e).sum(), 1))
    stat = 0.0
    for _, g in pdf.groupby("B"):
        c = pd.crosstab(g.A, g.C).to_numpy()
        e = c.sum(1, keepdims=True) * c.sum(0, keepdims=True) / c.sum()
        stat += np.nansum((c - e) ** 2 / e)
    assert t.statistic("A", "C", "B") == (pytest.approx(stat), 3)


def entropy(*cols):
    p = pd.concat(cols, axis=1).value_counts(normalize=True).to_numpy()
    return -(p * np.log(p)).sum()


def test_mutual_information(spark):
    cat = categories(400)
    t = MutualInformation(cat)
    assert t.mi("A", "C") == pytest.approx(entropy(cat.A) + entropy(cat.C) - entropy(cat.A, cat.C))
    assert t.mi("A", "C", "B") == pytest.approx(entropy(cat.A, cat.B) + entropy(cat.C, cat.B) - entropy(cat.A, cat.B, cat.C) - entropy(cat.B))
    pdf = hybrid(400)
    t = MutualInformation(pdf)
    h = lambda d: 0.5 * d.shape[1] * (1 + math.log(2 * math.pi)) + 0.5 * np.linalg.slogdet(np.atleast_2d(d.cov()))[1]
    by = lambda g, c: sum(len(x) / 400 * h(x[c]) for _, x in pdf.groupby(g))
    assert t.mi("A", "Y") == t.mi("Y", "A") == pytest.approx(h(pdf[["Y"]]) - by("A", ["Y"]))
    assert t.mi("X", "Y") == pytest.approx(-0.5 * math.log(1 - np.corrcoef(pdf.X, pdf.Y)[0, 1] ** 2))
    assert t.mi("A", "Y", ["B", "X"]) == pytest.approx(max(0, -by(["A", "B"], ["Y", "X"]) + by(["A", "B"], ["X"]) + by("B", ["Y", "X"]) - by("B", ["X"])))
    assert t.mi("X", "Y", "A") == pytest.approx(by("A", ["X"]) + by("A", ["Y"]) - by("A", ["X", "Y"]))
    assert t.df("A", "B") == 2 and t.df("A", "B", "X") == 6 and t.df("A", "Y", ["B", "X"]) == 9 and t.df("X", "Y", "B") == 3
    assert MutualInformation(pdf, False).df("A", "B", "X") == 4 and t.pvalue("A", "Y") < 1e-6
    lone = pd.DataFrame({"A": ["x", "y", "y", "y"], "Y": [1.0, 2.0, 3.0, 5.0]})
    assert math.isnan(MutualInformation(lone).pvalue("A", "Y"))


def test_nearest_neighbours(spark):
    pdf = normal(120)
    x, y = ranks(pdf.a.to_numpy()), ranks(pdf.b.to_numpy())
    k, n, total = 4, 120, 0.0
    for i in range(n):
        d = np.maximum(abs(x - x[i]), abs(y - y[i]))
        e = np.sort(d)[k]
        total += digamma(int((abs(x - x[i]) < e).sum())) + digamma(int((abs(y - y[i]) < e).sum()))
    assert knn_mi(x, y, None, k) == pytest.approx(digamma(k) + digamma(n) - total / n)
    t = KMutualInformation(pdf, 4, 1, 5, 40)
    assert t.pvalue("b", "c") <= 0.05
    ind = pd.DataFrame(np.random.default_rng(3).normal(size=(100, 3)), columns=list("xyz"))
    t = KMutualInformation(ind, 4, 1, 5, 40)
    assert t.pvalue("x", "y") > 0.02 and t.pvalue("x", "y", "z") > 0.02
    with pytest.raises(ValueError):
        KMutualInformation(ind, 100)


@pytest.mark.parametrize("z", [[], ["z"], ["z", "u"]])
def test_nearest_neighbours_in_cells(spark, monkeypatch, z):
    """Rows dealt to cells give the statistic of one matrix; ties, copies and nulls included."""
    r = np.random.default_rng(6)
    n = 1200
    pdf = pd.DataFrame({"x": r.normal(size=n), "z": r.integers(0, 6, n).astype(float), "u": r.normal(size=n)})
    pdf["y"] = pdf["x"] * 0.5 + pdf["z"] + r.normal(size=n)
    pdf.loc[:299] = pdf.loc[0].to_numpy()
    pdf.loc[::97, "x"] = np.nan
    d = Dataset.of(pdf)
    want = KMutualInformation(d, 5).mi("x", "y", z)
    monkeypatch.setattr(KMutualInformation, "MAX_ROWS", 100)
    monkeypatch.setattr(neighbours, "CELL", 150)
    t = KMutualInformation(d, 5, seed=3, samples=3)
    assert t.in_cells and t.mi("x", "y", z) == pytest.approx(want, rel=1e-9)
    if len(z) < 2:  # without the ties of z, whose ranks follow x
        loose = Dataset.of(pdf.assign(z=pdf["z"] + r.normal(size=n)).iloc[300:])
        assert KMutualInformation(loose, 5, seed=3, samples=3).pvalue("x", "y", z) == 0.0


def test_random_features(spark):
    r = np.random.default_rng(0)
    z = r.normal(size=600)
    pdf = pd.DataFrame({"x": z + 0.3 * r.normal(size=600), "y": z**2 + 0.3 * r.normal(size=600), "z": z, "u": r.normal(size=600), "k": 1.0})
    t = RCoT(pdf, seed=2)
    assert t.pvalue("x", "y") < 0.01 and t.pvalue("x", "u") > 0.01 and t.pvalue("x", "y", "z") > 0.001 and t.pvalue("x", "k") == 1
    assert t.pvalue("x", "y", ["z", "u"]) >= 0


def test_random_features_of_many_tests_at_once(spark, monkeypatch):
    """A level of tests takes two passes, and its figures are those of numpy on the same features; nulls leave out a test's own rows only."""
    r = np.random.default_rng(1)
    z = r.normal(size=900)
    pdf = pd.DataFrame({"x": z + r.normal(size=900), "y": z**2 + r.normal(size=900), "z": z, "u": r.normal(size=900)})
    pdf.loc[::7, "u"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    triples = [("x", "y", []), ("x", "y", ["z"]), ("x", "u", ["z"]), ("z", "u", ["x", "y"]), ("u", "y", [])]
    t = RCoT(df, 4, 9, seed=3)
    passes, plain = [], independence.co_moments
    monkeypatch.setattr(independence, "co_moments", lambda *a: passes.append(len(a[2])) or plain(*a))
    got = t.pvalues(triples)
    assert passes == [5, 5]
    monkeypatch.setattr(RCoT, "BATCH", 2)
    assert np.allclose(t.pvalues(triples), got) and np.allclose([RCoT(df, 4, 9, seed=3).pvalue(*x) for x in triples], got)
    for x, y, zs in triples:
        s = t._spectrum(x, y, zs)
        f = s.features({c: pdf[c].to_numpy() for c in s.cols})
        f = (f - f.mean(0)) / f.std(0, ddof=1)
        a, b, c = f[:, :4], f[:, 4:8], f[:, 8:]
        if zs:
            k = np.linalg.solve(np.cov(c.T) + 1e-10 * np.eye(9), np.cov(f.T)[8:, :8])
            a, b = a - c @ k[:, :4], b - c @ k[:, 4:]
        stat, second = t.statistics([s])[0]
        p = (a[:, :, None] * b[:, None]).reshape(len(f), -1)
        assert np.allclose(second, p.T @ p / len(f))
        part = np.cov(f.T)[:4, 4:8] - (np.cov(f.T)[:4, 8:] @ k[:, 4:] if zs else 0.0)
        assert np.isclose(stat, len(f) * (part**2).sum())


class Separation(IndependenceTest):
    """Separation in a known graph, counting how often it is asked."""

    def __init__(self, arcs):
        self.g, self.asked = Dag(sorted({x for a in arcs for x in a}), arcs), []

    def variables(self):
        return self.g.nodes()

    def pvalue(self, x, y, z=None):
        """By reachability along paths that z does not block."""
        z = set([z] if isinstance(z, str) else z or [])
        opens = set(z)
        for v in z:
            opens |= {a for a in self.g.nodes() if self.g.has_path(a, v)}
        seen, todo = set(), [(x, "up")]
        while todo:
            v, way = todo.pop()
            if (v, way) in seen:
                continue
            seen.add((v, way))
            if v == y:
                return 0.0
            if way == "up" and v not in z:
                todo += [(p, "up") for p in self.g.parents(v)] + [(c, "down") for c in self.g.children(v)]
            elif way == "down":
                todo += [(c, "down") for c in self.g.children(v)] if v not in z else []
                todo += [(p, "up") for p in self.g.parents(v)] if v in opens else []
        return 1.0

    def pvalues(self, triples):
        self.asked.append(len(triples))
        return [self.pvalue(*t) for t in triples]


ARCS = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "f"), ("f", "e")]


@pytest.mark.parametrize("learner", [PC, MMPC])
def test_learners_ask_for_many_tests_at_once(learner):
    """The class of a known graph, in few calls, none for a single test of many."""
    o = Separation(ARCS)
    g = learner().estimate(o)
    want = o.g.to_pdag()
    assert {frozenset(x) for x in [*g.arcs(), *g.edges()]} == {frozenset(x) for x in ARCS}
    assert set(g.arcs()) == set(want.arcs()) and {frozenset(e) for e in g.edges()} == {frozenset(e) for e in want.edges()}
    assert len(o.asked) <= 20 and sum(o.asked) > 2 * len(o.asked)


def test_a_table_of_tests_stands_for_its_test(spark):
    o = Separation(ARCS)
    t = TestTable.recording(o)
    first = PC().estimate(t)
    rows = t.table(spark)
    asked = len(o.asked)
    again = PC().estimate(TestTable(o.variables(), rows))
    assert set(again.arcs()) == set(first.arcs()) and len(o.asked) == asked and rows.columns == ["x", "y", "z", "p"] and rows.where("x > y").count() == 0
    with pytest.raises(KeyError):
        TestTable(["a", "b"], []).pvalue("a", "b")
    pc = PC()
    pc.estimate(o, use_sepsets=True)
    assert ("a", "b", [], 1.0) in pc.sepset_rows() and all(o.pvalue(a, b, z) == 1 for a, b, z, _ in pc.sepset_rows())


# ---------------------------------------------------------------- search


def test_operators():
    m = GaussianNetwork(["a", "b", "c"])
    op = AddArc("a", "b", 1.0)
    op.apply(m)
    assert m.has_arc("a", "b") and op.opposite(m) == RemoveArc("a", "b", -1.0) and op == AddArc("a", "b", 5.0) and hash(op) == hash(AddArc("a", "b", 5.0)) and op != AddArc("b", "a", 1.0)
    f = FlipArc("a", "b", 1.0)
    f.apply(m)
    assert m.has_arc("b", "a") and f.nodes_changed(m) == ["a", "b"] and f.opposite(m) == FlipArc("b", "a", -1.0)
    s = SemiparametricBN(["a"], node_types=[("a", LinearGaussianCPDType())])
    c = ChangeNodeType("a", CKDEType(), 1.0)
    back = c.opposite(s)
    c.apply(s)
    assert s.node_type("a") == CKDEType() and back.node_type() == LinearGaussianCPDType()
    t = OperatorTabuSet()
    t.insert(op)
    assert t.contains(AddArc("a", "b", 9)) and not t.contains(f)
    t.clear()
    assert t.empty()


def brute(score, model, blacklist=(), limit=0):
    best = None
    now = {n: score.local_score(model, n) for n in model.nodes()}
    for a, b in itertools.permutations(model.nodes(), 2):
        for kind in (AddArc, RemoveArc, FlipArc):
            m = model.clone()
            try:
                if kind is AddArc:
                    if m.has_arc(a, b) or m.has_arc(b, a) or (a, b) in blacklist:
                        continue
                    m.add_arc(a, b)
                elif kind is RemoveArc:
                    if not m.has_arc(a, b):
                        continue
                    m.remove_arc(a, b)
                else:
                    if not m.has_arc(a, b) or (b, a) in blacklist:
                        continue
                    m.flip_arc(a, b)
            except ValueError:
                continue
            if limit and any(m.num_parents(n) > limit for n in m.nodes()):
                continue
            d = sum(score.local_score(m, n) - now[n] for n in (a, b))
            if best is None or d > best:
                best = d
    return best


@pytest.mark.parametrize("limit,blacklist", [(0, ()), (1, ()), (0, (("b", "d"), ("d", "b")))])
def test_best_operator_equals_brute_force(spark, limit, blacklist):
    s, m = BIC(normal(300)), GaussianNetwork(list("abcd"))
    ops = ArcOperatorSet(blacklist, (), limit)
    ops.cache_scores(m, s)
    for _ in range(4):
        op, want = ops.find_max(m), brute(s, m, blacklist, limit)
        if op is None or op.delta() < 1e-8:
            assert want is None or want < 1e-6
            break
        assert op.delta() == pytest.approx(want)
        op.apply(m)
        for n in op.nodes_changed(m):
            ops.cache.update_local_score(m, s, n)
        ops.update_scores(m, s, op.nodes_changed(m))
    c = LocalScoreCache()
    c.cache_local_scores(m, s)
    assert c.sum() == pytest.approx(s.score(m)) == pytest.approx(ops.cache.sum())


def test_directions_that_differ_by_rounding_go_by_their_names():
    for noise in (1e-4, -1e-4):
        ops = ArcOperatorSet()
        ops._toggle = {("z", "x"): 1e6 + noise, ("x", "z"): 1e6, ("y", "z"): 9e5}
        best = ops.find_max(GaussianNetwork(["x", "y", "z"]))
        assert best == AddArc("x", "z", 0.0)


def test_type_operators(spark):
    pdf = normal(120)[["a", "b"]]
    pdf["a"] = np.exp(3 * (pdf["a"] - 3))
    from netloom.operators.scores import CVLikelihood

    m = SemiparametricBN(["a", "b"], node_types=[("a", LinearGaussianCPDType()), ("b", LinearGaussianCPDType())])
    s, ops = CVLikelihood(pdf, 3, 1), ChangeNodeTypeSet()
    ops.cache_scores(m, s)
    op = ops.find_max(m)
    assert op == ChangeNodeType("a", CKDEType(), 0)
    ops = ChangeNodeTypeSet(type_whitelist=[("a", LinearGaussianCPDType())])
    ops.cache_scores(m, s)
    assert ops.find_max(m) == ChangeNodeType("b", CKDEType(), 0)
    pool = OperatorPool([ArcOperatorSet(), ChangeNodeTypeSet()])
    pool.set_type_blacklist([("a", CKDEType()), ("b", CKDEType())])
    pool.cache_scores(m, s)
    assert isinstance(pool.find_max(m), AddArc)
    with pytest.raises(ValueError):
        ChangeNodeTypeSet().cache_scores(GaussianNetwork(["a"]), s)


class Steps(Callback):
    def __init__(self):
        self.seen = []

    def call(self, model, operator, score, num_iter):
        self.seen.append((operator, num_iter))


def test_hill_climbing(spark):
    pdf, steps = normal(500), Steps()
    s = BIC(pdf)
    m = hc(pdf, GaussianNetworkType(), callback=steps)
    assert s.score(m) >= s.score(GaussianNetwork(list("abcd"), [("a", "b"), ("b", "c"), ("c", "d")])) and steps.seen[0] == (None, 0) and steps.seen[-1][0] is None
    assert brute(s, m) < 1e-6
    assert hc(pdf, GaussianNetworkType(), max_iters=1).num_arcs() == 1 and hc(pdf, GaussianNetworkType(), epsilon=1e9).num_arcs() == 0
    first = hc(pdf, GaussianNetworkType(), max_iters=1).arcs()[0]
    assert hc(pdf, GaussianNetworkType(), max_iters=1, arc_blacklist=[first]).arcs() == [first[::-1]]
    assert hc(pdf, GaussianNetworkType(), arc_whitelist=[("d", "a")]).has_arc("d", "a")
    assert hc(pdf, GaussianNetworkType(), max_indegree=1, score="bge").num_arcs() <= 3
    assert hc(pdf, GaussianNetworkType(), score="cv-lik", num_folds=3, seed=1, max_iters=2).num_arcs() == 2
    with pytest.raises(ValueError):
        hc(pdf, GaussianNetworkType(), score="nope")
    with pytest.raises(ValueError):
        hc(pdf, GaussianNetworkType(), arc_blacklist=[("a", "b")], arc_whitelist=[("a", "b")])


def test_hill_climbing_of_other_types(spark):
    assert hc(categories(400), DiscreteBNType()).num_arcs() >= 1
    m = hc(hybrid(300), CLGNetworkType())
    assert m.has_arc("A", "Y") and m.has_arc("B", "Y")
    pdf = normal(90)[["a", "b"]]
    m = hc(pdf, SemiparametricBNType(), seed=0, num_folds=2, patience=1, max_iters=3)
    assert set(m.nodes()) == {"a", "b"} and not m.has_unknown_node_types()


class OwnScore(Score):
    def has_variables(self, variables):
        return True

    def compatible_bn(self, model):
        return True

    def local_score(self, model, variable, evidence=None):
        ev = model.parents(variable) if evidence is None else evidence
        return float(("a" in ev) * (variable == "b")) - 0.1 * len(ev)


class Oracle(IndependenceTest):
    """d-separation in a known graph."""

    def __init__(self, dag):
        self.dag = dag

    def variables(self):
        return self.dag.nodes()

    def pvalue(self, x, y, z=None):
        z = set([] if z is None else [z] if isinstance(z, str) else z)
        keep, stack = set(), [x, y, *z]
        while stack:
            n = stack.pop()
            if n not in keep:
                keep.add(n)
                stack += self.dag.parents(n)
        near = {n: set() for n in keep}
        for n in keep:
            p = self.dag.parents(n)
            for a in p:
                near[a].add(n)
                near[n].add(a)
            for a, b in itertools.combinations(p, 2):
                near[a].add(b)
                near[b].add(a)
        seen, stack = {x}, [x]
        while stack:
            for m in near[stack.pop()] - seen - z:
                seen.add(m)
                stack.append(m)
        return 0.0 if y in seen else 1.0


def test_own_score_and_restrictions():
    m = GreedyHillClimbing().estimate(ArcOperatorSet(), OwnScore(), GaussianNetwork(["a", "b", "c"]))
    assert m.arcs() == [("a", "b")]
    ab, aw, eb, ew = check_restrictions("abc", [("a", "b"), ("b", "a")], [], [("b", "c")], [])
    assert frozenset("ab") in eb and ("b", "c") in ab and not aw and not ew
    assert check_restrictions("abc", [("a", "b")], [], [], [("a", "b")])[1] == {("b", "a")}
    with pytest.raises(ValueError):
        check_restrictions("ab", [], [("a", "b"), ("b", "a")])
    s = SepSets()
    s.put("a", "b", ["c"], 0.5)
    assert s.of("b", "a") == (frozenset("c"), 0.5)


def random_dags():
    from netloom.operators.graph import Dag

    r = np.random.default_rng(7)
    for _ in range(12):
        n = list("abcdef")
        yield Dag(n, [(a, b) for a, b in itertools.combinations(n, 2) if r.random() < 0.4])


def test_constraint_learners_recover_the_class_from_an_oracle():
    for g in random_dags():
        want = g.to_pdag()
        for sep in (True, False):
            got = PC().estimate(Oracle(g), use_sepsets=sep, ambiguous_threshold=0.5)
            assert set(got.arcs()) == set(want.arcs()) and {frozenset(e) for e in got.edges()} == {frozenset(e) for e in want.edges()}
        got = MMPC().estimate(Oracle(g))
        skeleton = lambda p: {frozenset(x) for x in [*p.arcs(), *p.edges()]}
        assert skeleton(got) >= skeleton(want)


def test_constraint_learners_with_data_and_lists(spark):
    pdf = normal(400)
    t = LinearCorrelation(pdf)
    g = PC().estimate(t, edge_blacklist=[("a", "b")], arc_whitelist=[("d", "c")])
    assert isinstance(g, PartiallyDirectedGraph) and not g.has_connection("a", "b") and g.has_arc("d", "c")
    c = PC().estimate_conditional(t, ["c", "d"], ["a", "b"])
    assert not c.has_connection("a", "b") and all(x in "ab" for x, _ in c.interface_arcs())
    assert MMPC().estimate(t, edge_whitelist=[("a", "d")]).has_connection("a", "d")
    assert MMPC().estimate_conditional(t, ["c", "d"], ["a", "b"]).num_joint_nodes() == 4
    for bad in ({"alpha": 0}, {"alpha": 1}, {"ambiguous_threshold": 2}):
        with pytest.raises(ValueError):
            PC().estimate(t, **bad)


def test_hybrid_learners(spark):
    pdf = normal(400)
    t, s = LinearCorrelation(pdf), BIC(pdf)
    m = MMHC().estimate(t, ArcOperatorSet(), s)
    skeleton = {frozenset(x) for g in [MMPC().estimate(t)] for x in [*g.arcs(), *g.edges()]}
    assert {frozenset(a) for a in m.arcs()} <= skeleton and m.num_arcs() >= 2
    c = MMHC().estimate_conditional(t, ArcOperatorSet(), s, ["c", "d"], ["a", "b"])
    assert all(b in "cd" for _, b in c.arcs())
    pdf = normal(200)[["a", "b"]]
    pdf["b"] = pdf["b"] + 2 * pdf["a"].shift(1).fillna(3)
    pdf["t"] = np.arange(200)
    d = Dataset.of(pdf, order_by=["t"])
    m = DMMHC().estimate(DynamicLinearCorrelation(d, markovian_order=2), ArcOperatorSet(), DynamicBIC(d, markovian_order=2), markovian_order=2)
    assert m.transition_bn().has_arc("a_t_1", "b_t_0") and not any(int(a[-1]) < int(b[-1]) for a, b in m.static_bn().arcs())


def test_cmiknn_query_takes_a_thousand_permutations(spark):
    from netloom.plans.catalogue import QUERIES

    ps = [r["p"] for r in QUERIES["cmiknn_pvalue"](spark, "/root/testdata/sf0.01").collect()]
    assert any(abs(40 * p - round(40 * p)) > 1e-6 for p in ps)
