import datetime as dt

import numpy as np
import pytest
from helpers import categories, hybrid, lstsq, normal, with_nulls
from pyspark.sql import functions as F

from netloom.operators import stats as S
from netloom.operators import temporal
from netloom.operators.split import CrossValidation, HoldOut
from netloom.operators.temporal import DynamicDataFrame
from netloom.sources.dataset import Dataset, from_arrow


def test_moments_follow_the_null_rule(spark):
    pdf = with_nulls(normal(500))
    d = Dataset.of(pdf)
    st = S.SuffStats(d)
    for cols in (["a"], ["a", "b"], ["b", "d", "a"], ["a", "b", "c", "d"]):
        x = pdf[cols].dropna()
        m = st.moments(cols)
        assert m.n == len(x) and np.allclose(m.mean, x.mean()) and np.allclose(m.cov, x.cov())
    assert d.null_count("a", "b") == 500 - len(pdf[["a", "b"]].dropna())


def test_one_job_without_nulls(spark):
    st = S.SuffStats(Dataset.of(normal(200)))
    st.prefetch([["a", "b"], ["c"], ["b", "c", "d"]])
    st.moments(["d", "a"])
    assert st.jobs == 1


def test_moments_pool():
    x = np.random.default_rng(0).normal(1e6, 1, (300, 2))
    parts = [S.Moments(["a", "b"], len(p), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0))) for p in np.split(x, [17, 120])]
    total = S.Moments.empty(["a", "b"])
    for p in parts:
        total = total + p
    assert np.allclose(total.cov, np.cov(x.T))


def test_linear_fit_and_its_degenerate_cases(spark):
    pdf = normal(400)
    pdf["k"], pdf["a2"] = 7.0, 2 * pdf["a"]
    st = S.SuffStats(Dataset.of(pdf))
    for xs in ([], ["a"], ["a", "b"], ["a", "b", "c"]):
        b, v = lstsq(pdf, "d", xs)
        f = S.linear_fit(st.moments([*xs, "d"]), "d", xs)
        assert np.allclose(f.beta, b) and f.variance == pytest.approx(v)
    f = S.linear_fit(st.moments(["k", "a", "d"]), "d", ["k", "a"])
    assert f.beta[1] == 0 and f.beta[2] == pytest.approx(lstsq(pdf, "d", ["a"])[0][1])
    assert S.linear_fit(st.moments(["a", "a2", "d"]), "d", ["a", "a2"]).beta[2] == 0
    tiny = S.SuffStats(Dataset.of(normal(3)))
    assert S.linear_fit(tiny.moments(["a", "b", "c"]), "c", ["a", "b"]).variance == np.inf


def test_counts_are_dense_over_the_domain(spark):
    pdf = categories(600)
    d = Dataset.of(pdf, discrete={"A": ["a1", "a2", "a3"]})
    st = S.SuffStats(d)
    c = st.counts(["B", "A"])
    assert c.shape == (3, 3) and c[:, 2].sum() == 0 and c.sum() == 600
    assert c[2, 0] == ((pdf.B == "b3") & (pdf.A == "a1")).sum() and c[2, 1] == 0
    assert (st.counts(["A", "B"]) == c.T).all() and (st.counts(["A"]) == c.sum(0)).all()
    assert sorted(r["n"] for r in S.joint_counts(d, "B", ["A"]).collect()) == sorted(c.ravel().tolist())
    with pytest.raises(ValueError):
        S.SuffStats(Dataset.of(pdf, discrete={"A": ["a1"]})).counts(["A"])


def test_grouped_moments(spark):
    pdf = hybrid(700)
    d = Dataset.of(pdf)
    for (i, j), m in S.SuffStats(d).grouped(["B", "A"], ["Y", "X"]).items():
        x = pdf[(pdf.B == d.discrete["B"][i]) & (pdf.A == d.discrete["A"][j])][["Y", "X"]]
        assert m.n == len(x) and np.allclose(m.cov, x.cov())


def test_views(spark):
    pdf = with_nulls(normal(100), 10)
    pdf["id"] = np.arange(100)
    pdf["flat"] = 2.0
    d = Dataset.of(pdf, order_by=["id"])
    z = S.normalize(d).df.toPandas().sort_values("id")
    assert np.allclose(z["a"], (pdf["a"] - pdf["a"].mean()) / pdf["a"].std(), equal_nan=True) and (z["flat"] == 0).all()
    r = S.rank_data(d.loc("a", "id"), ["id"]).df.toPandas().sort_values("id")["a"]
    assert np.allclose(r, pdf["a"].rank(method="first") - 1, equal_nan=True)
    assert d.filter_null("a").df.count() == 90 and d.slice(10, 5).df.count() == 5
    assert d.loc(["a", "b"]).columns == ["a", "b"] and d.loc(0).columns == ["a"] and not d.has_columns("zz")
    with pytest.raises(ValueError):
        d.loc("zz")
    import pyarrow as pa

    assert from_arrow(pa.table({"x": pa.array(["p", "q"]).dictionary_encode()}), spark).count() == 2


def test_cross_validation(spark):
    pdf = with_nulls(normal(103), 3)
    pdf["id"] = np.arange(103)
    cv = CrossValidation(Dataset.of(pdf, order_by=["id"]), 10, 5)
    n = len(pdf.dropna())
    rows = cv.frame().select("id", "fold").toPandas()
    sizes = rows.groupby("fold").size()
    assert len(rows) == n and rows["id"].is_unique and sizes.max() - sizes.min() <= 1 and list(sizes) == sorted(sizes, reverse=True)
    train, test = cv.fold(2)
    assert train.df.count() + test.df.count() == n
    again = CrossValidation(Dataset.of(pdf, order_by=["id"]), 10, 5).frame().select("id", "fold").toPandas()
    assert dict(rows.values) == dict(again.values)
    assert CrossValidation(Dataset.of(pdf, order_by=["id"]), 10, 5, include_null=True).n == 103
    for k in (1, 0, 104):
        with pytest.raises(ValueError):
            CrossValidation(Dataset.of(pdf, order_by=["id"]), k)


def test_hold_out(spark):
    pdf = normal(50)
    pdf["id"] = np.arange(50)
    h = HoldOut(Dataset.of(pdf, order_by=["id"]), 0.25, 1)
    a, b = (set(x.df.toPandas()["id"]) for x in (h.training_data(), h.test_data()))
    assert len(b) == 13 and a | b == set(range(50)) and not a & b
    for r in (0, 1, -0.5, 0.001):
        with pytest.raises(ValueError):
            HoldOut(Dataset.of(pdf, order_by=["id"]), r)


def test_time_slices(spark):
    pdf = normal(30)[["a", "b"]]
    pdf["t"] = np.arange(30)
    s = DynamicDataFrame(Dataset.of(pdf.sample(frac=1, random_state=1), order_by=["t"]), 2)
    x = s.transition_df().df.toPandas().sort_values("t")
    assert len(x) == 28
    for k in range(3):
        assert np.allclose(x[f"a_t_{k}"], pdf["a"].to_numpy()[2 - k : 30 - k])
    st = s.static_df().df.toPandas().sort_values("t")
    assert len(st) == 29 and np.allclose(st["b_t_2"], pdf["b"].to_numpy()[:29]) and np.allclose(st["b_t_1"], pdf["b"].to_numpy()[1:])
    assert s.temporal_slice(2).df.count() == 28 and s.loc(("a", 1), ("b", 0)).columns == ["a_t_1", "b_t_0"]
    with pytest.raises(ValueError):
        s.temporal_slice(3)
    with pytest.raises(ValueError):
        DynamicDataFrame(Dataset.of(pdf, order_by=["t"]), 0)


def test_take_by_position(spark):
    rows = [(i * 7 % 50, None if i % 9 == 0 else float(i)) for i in range(50)]
    d = Dataset.of(spark.createDataFrame(rows, "k long, x double"), order_by=["k"])
    want = sorted(rows)
    got = d.take([3, 49, 3, 0]).df.orderBy("_take").collect()
    assert [(r["k"], r["x"]) for r in got] == [want[3], want[49], want[3], want[0]]
    assert [r["k"] for r in d.take(spark.createDataFrame([(2,), (1,)], "p int").coalesce(1)).df.orderBy("_take").collect()] == [2, 1]
    for bad in ([50], [-1]):
        with pytest.raises(IndexError):
            d.take(bad)


def test_ranges_hold_all_order_columns(spark):
    """A column of one value is dealt by its ties, and positions are those of a sort."""
    rows = [(1.0 if i % 3 else float(i % 5), i * 37 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "v double, k long")
    for n in (1, 2, 7, 40):
        part = df.select(S.Ranges(df, ["v", "k"], n).number().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in part) < 3 * 1000 / n
        at = {(r["v"], r["k"]): r["r"] for r in S.ranked(df, "v", ["k"], "r", n).collect()}
        assert [x for x, _ in sorted(at.items(), key=lambda x: x[1])] == sorted(rows)


@pytest.mark.parametrize("n", [1, 3, 4, 200])
def test_lags_across_ranges(spark, n):
    """The rows before a range come along, also when a range has fewer than the order asks for."""
    rng = np.random.default_rng(n)
    ts = rng.permutation(n).tolist()
    df = spark.createDataFrame([(t, float(t * t), f"e{t % 3}") for t in ts], "t long, x double, e string")
    got = temporal.lagged(df, [("x0", "x", 0), ("x2", "x", 2), ("e3", "e", 3)], ["t"], first=2)
    assert sorted(map(tuple, got.collect())) == [(t, float(t * t), float((t - 2) ** 2), f"e{(t - 3) % 3}" if t > 2 else None) for t in range(2, n)]
    assert "SinglePartition" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("compiled", [2000, 10])
def test_many_bounds(spark, monkeypatch, compiled):
    """A tree of three levels and a search of batches give the number of bounds below a row; nulls first, NaN last, ties by the other keys."""
    monkeypatch.setattr(S, "COMPILED", compiled)
    monkeypatch.setattr(S, "FANOUT", 8)
    rows = [(i * 7919 % 6000, float(i % 11) if i % 13 else None, f"é{i % 7}", dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i * 31 % 999)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, x double, c string, at timestamp").withColumn("x", F.when(F.col("k") % 17 == 0, float("nan")).otherwise(F.col("x")))
    for order in (["k"], ["x", "k"], ["c", "k"], ["at", "k"], ["x", "c", "at", "k"]):
        r = S.Ranges(df, order, 700)
        assert len(r.bounds) > 600 and r.compiled == (compiled > 700)
        got = df.select(*order, r.number().alias("p")).orderBy(*order).collect()
        parts = [x["p"] for x in got]
        assert parts == sorted(parts) and max(parts) == len(r.bounds) and max(np.bincount(parts)) < 40
    whole = S.ranked(df.select("x", "k").na.drop(), "x", ["k"], "r", 700).collect()
    assert [x["r"] for x in sorted(whole, key=lambda x: (x["x"], x["k"]))] == list(range(len(whole)))


@pytest.mark.parametrize("sizes", [{"hot": 180, "b": 1, "c": 2, "d": 7}, {"only": 90}, {"a": 1}])
def test_lags_within_series_that_many_ranges_share(spark, sizes):
    """A long series is cut like the rest, and no lag or position crosses from one series to another."""
    rows = [(s, t, float(1000 * i + t)) for i, (s, n) in enumerate(sizes.items()) for t in range(n)]
    df = spark.createDataFrame(rows, "s string, t long, x double").repartition(3)
    frame = temporal.DynamicDataFrame(Dataset.of(df, order_by=["t"]), 3, series=["s"])
    have = {(s, t): x for s, t, x in rows}
    got = {(r["s"], r["t"]): (r["x_t_0"], r["x_t_1"], r["x_t_3"]) for r in frame.transition_df().df.collect()}
    assert got == {(s, t): (x, have[s, t - 1], have[s, t - 3]) for s, t, x in rows if t >= 3}
    static = {(r["s"], r["t"]): (r["x_t_1"], r["x_t_3"]) for r in frame.static_df().df.collect()}
    assert static == {(s, t): (x, have[s, t - 2]) for s, t, x in rows if t >= 2}
    parts = frame.layout.rows().where("s = 'hot'").groupBy("_part").count().count() if "hot" in sizes else 2
    assert parts > 1 and temporal.DynamicDataFrame(frame.data, 2, ["t"], ["s"]).layout is frame.layout


def test_ranks_of_all_columns_at_once(spark):
    """One range layout for all columns; nulls stay, other columns come along, and the number of jobs does not grow with the columns."""
    rng = np.random.default_rng(4)
    cols = {c: rng.integers(0, 20, 300).astype(float) for c in "abcde"}
    rows = [(i, f"n{i % 3}", None if i % 4 == 0 else [i], *[None if (i + k) % 11 == 0 else float(v[i]) for k, v in enumerate(cols.values())]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, l array<long>, " + ", ".join(f"{c} double" for c in cols))
    out = S.rank_data(Dataset.of(df, order_by=["id"]), ["id"])
    assert out.df.columns == df.columns
    got = {r["id"]: r for r in out.df.collect()}
    for k, c in enumerate(cols):
        order = sorted((r[3 + k], r[0]) for r in rows if r[3 + k] is not None)
        want = {i: float(n) for n, (_, i) in enumerate(order)}
        assert {i: r[c] for i, r in got.items() if r[c] is not None} == want
    assert all(got[r[0]]["name"] == r[1] and got[r[0]]["l"] == r[2] for r in rows)
    jobs = []
    for names in (["a"], list(cols)):
        spark.sparkContext.setJobGroup(f"ranks{len(names)}", "")
        S.rank_data(Dataset.of(df.select("id", *names), order_by=["id"]), ["id"])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ranks{len(names)}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]
