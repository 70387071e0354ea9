"""Queries of the operators that work in blocks, ranges and batches, with their SQL: test statistics, densities over training tables, bandwidth
scores, cross-validated kernel scores, lags within series, tables of tests and directions."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from netloom.operators.durable import checkpointed
from netloom.operators.factors import CKDE, HCKDE
from netloom.operators.independence import DynamicLinearCorrelation, KMutualInformation, LinearCorrelation, RCoT, TestTable
from netloom.operators.kde import KDE, NormalReferenceRule, UCVScorer
from netloom.operators.learn import DMMHC, PC, hc
from netloom.operators.models import DynamicGaussianNetwork, GaussianNetworkType, KDENetwork
from netloom.operators.scores import CVLikelihood, DynamicBIC
from netloom.operators.search import ArcOperatorSet
from netloom.operators.temporal import DynamicDataFrame, lagged
from netloom.plans.catalogue import DISC, FOLD, ORACLE_SQL as SHOWN, PRICE, QTY, customers, lineitem, score_row, suppliers, table
from netloom.sources.dataset import Dataset

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- random features with fixed weights

#: Weights and phases of two features for each of x, y and z.
WEIGHTS, PHASES = ((0.7, -1.1), (0.4, 1.3), (0.9, -0.5)), ((0.3, 2.0), (1.0, 4.0), (2.5, 5.5))


def _rcot_sql() -> str:
    names = [f"{v}{i}" for v in "xyz" for i in range(2)]
    feature = {f"{v}{i}": f"cos({WEIGHTS[k][i]} * ({v} - a{v}) / s{v} + {PHASES[k][i]})" for k, v in enumerate("xyz") for i in range(2)}
    pairs = ", ".join(f"corr({a}, {b}) AS {a}{b}" for i, a in enumerate(names) for b in names[i + 1 :])
    det = "((1 + 1e-10) * (1 + 1e-10) - z0z1 * z0z1)"
    parts = []
    for a in ("x0", "x1"):
        for b in ("y0", "y1"):
            inner = f"({a}z0 * ((1 + 1e-10) * {b}z0 - z0z1 * {b}z1) + {a}z1 * ((1 + 1e-10) * {b}z1 - z0z1 * {b}z0)) / {det}"
            parts.append(f"pow({a}{b} - {inner}, 2)")
    return f"""WITH r AS (SELECT l_extendedprice AS x, l_quantity AS y, l_discount AS z FROM lineitem), m AS (SELECT count(*) AS n, {", ".join(f"avg({v}) AS a{v}, stddev_samp({v}) AS s{v}" for v in "xyz")} FROM r),
f AS (SELECT n, {", ".join(f"{e} AS {k}" for k, e in feature.items())} FROM r, m), c AS (SELECT any_value(n) AS n, {pairs} FROM f) SELECT round(n * ({" + ".join(parts)}), 5) AS stat FROM c"""


@query("rcot_statistic", _rcot_sql())
def rcot_statistic(spark, sf):
    """The statistic of price and quantity given discount, for fixed features."""
    t = RCoT(lineitem(spark, sf, [PRICE, QTY, DISC]))
    maps = [([c], np.array([w]), np.array(b)) for c, w, b in zip((PRICE, QTY, DISC), WEIGHTS, PHASES, strict=True)]
    stat, _ = t.statistics([t._spectrum(PRICE, QTY, [DISC], maps)])[0]
    return spark.createDataFrame([(round(stat, 5),)], "stat double")


# ---------------------------------------------------------------- nearest neighbours in cells

#: Ranks with ties by the whole row, digamma of whole numbers, and the distance to the fifth neighbour over the columns {d}.
KNN = """WITH r AS (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey, s_nationkey) - 1 AS x, row_number() OVER (ORDER BY s_suppkey, s_acctbal, s_nationkey) - 1 AS y, row_number() OVER (ORDER BY s_nationkey, s_acctbal, s_suppkey) - 1 AS z, count(*) OVER () AS n FROM supplier),
psi AS (SELECT 1 AS m, -0.5772156649015329 AS v UNION ALL SELECT x + 2, sum(1.0 / (x + 1)) OVER (ORDER BY x) - 0.5772156649015329 FROM r),
two AS (SELECT * FROM (SELECT p.*, greatest(abs(p.x - q.x), abs(p.y - q.y)) AS eps, row_number() OVER (PARTITION BY p.x ORDER BY greatest(abs(p.x - q.x), abs(p.y - q.y))) AS k FROM r p, r q) WHERE k = 6),
three AS (SELECT * FROM (SELECT p.*, greatest(abs(p.x - q.x), abs(p.y - q.y), abs(p.z - q.z)) AS eps, row_number() OVER (PARTITION BY p.x ORDER BY greatest(abs(p.x - q.x), abs(p.y - q.y), abs(p.z - q.z))) AS k FROM r p, r q) WHERE k = 6),
a AS (SELECT avg(u.v + w.v) AS s, any_value(n) AS n FROM two JOIN psi u ON u.m = least(1 + x, eps) + least(n - x, eps) - 1 JOIN psi w ON w.m = least(1 + y, eps) + least(n - y, eps) - 1),
b AS (SELECT p.x, count_if(abs(p.z - q.z) < eps) AS nz, count_if(abs(p.z - q.z) < eps AND abs(p.x - q.x) < eps) AS nxz, count_if(abs(p.z - q.z) < eps AND abs(p.y - q.y) < eps) AS nyz FROM three p, r q GROUP BY p.x),
c AS (SELECT avg(u.v - w.v - t.v) AS s FROM b JOIN psi u ON u.m = nz JOIN psi w ON w.m = nxz JOIN psi t ON t.m = nyz)
SELECT 'a,b' AS test, round(k.v + l.v - s, 8) AS mi FROM a, psi k, psi l WHERE k.m = 5 AND l.m = n UNION ALL SELECT 'a,b|c', round(k.v + s, 8) FROM c, psi k WHERE k.m = 5"""


@query("knn_information", KNN)
def knn_information(spark, sf):
    """The statistics of the whole supplier table by cells, without permutations."""
    df = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("a"), F.col("s_suppkey").cast("double").alias("b"), F.col("s_nationkey").cast("double").alias("c"))
    t = KMutualInformation(Dataset.of(df), 5)
    t.in_cells = True
    return spark.createDataFrame([("a,b", round(t.mi("a", "b"), 8)), ("a,b|c", round(t.mi("a", "b", "c"), 8))], "test string, mi double")


# ---------------------------------------------------------------- densities over training rows that stay a table


@query("kde_logl_table", SHOWN["kde_logl_2d"])
def kde_logl_table(spark, sf):
    return KDE(["x", "y"]).fit(suppliers(spark, sf), as_table=True).logl(customers(spark, sf)).select("c_custkey", F.round("logl", 6).alias("logl"))


@query("ckde_logl_table", SHOWN["ckde_logl"])
def ckde_logl_table(spark, sf):
    return CKDE("x", ["y"]).fit(suppliers(spark, sf), as_table=True).logl(customers(spark, sf)).select("c_custkey", F.round("logl", 6).alias("logl"))


HCKDE_SQL = """WITH s AS (SELECT s_acctbal AS x, CASE WHEN s_suppkey % 10 = 0 THEN 'few' ELSE 'most' END AS g FROM supplier), h AS (SELECT g, sqrt(pow(4.0 / (3.0 * count(*)), 0.4) * var_samp(x)) AS h, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT c_custkey, -0.5 * pow((c_acctbal - x) / h, 2) AS e, h, n FROM customer JOIN s ON s.g = CASE WHEN c_custkey % 10 = 0 THEN 'few' ELSE 'most' END JOIN h ON h.g = s.g)
SELECT c_custkey, round(max(e) + ln(sum(exp(e - m))) - ln(any_value(n)) - ln(any_value(h)) - 0.5 * ln(2 * pi()), 6) AS logl FROM (SELECT *, max(e) OVER (PARTITION BY c_custkey) AS m FROM k) GROUP BY 1"""


@query("hckde_logl_table", HCKDE_SQL)
def hckde_logl_table(spark, sf):
    """One configuration has nine tenths of the rows."""
    group = lambda c: F.when(F.col(c) % 10 == 0, "few").otherwise("most").alias("g")
    train = Dataset.of(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("x"), group("s_suppkey")))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), group("c_custkey"))
    return HCKDE("x", ["g"], ["g"]).fit(train, as_table=True).logl(rows).select("c_custkey", F.round("logl", 6).alias("logl"))


GRID = (0.25, 0.5, 0.8, 1.0, 1.5, 3.0)


@query("ucv_grid", "WITH s AS (SELECT s_suppkey AS i, s_acctbal AS x FROM supplier), h AS (SELECT f, f * pow(4.0 / (3.0 * count(*)), 0.4) * var_samp(x) AS v, count(*) AS n FROM s, (VALUES " + ", ".join(f"({f})" for f in GRID) + ") AS g(f) GROUP BY f), p AS (SELECT f, sum(exp(-0.25 * (a.x - b.x) * (a.x - b.x) / v)) AS s2, sum(exp(-0.5 * (a.x - b.x) * (a.x - b.x) / v)) AS s1 FROM s a JOIN s b ON a.i < b.i, h GROUP BY f) SELECT CAST(f AS DOUBLE) AS factor, round((1 / sqrt(4 * pi() * v) + 2 * s2 / sqrt(4 * pi() * v) / n - 4 * s1 / sqrt(2 * pi() * v) / (n - 1)) * 1e6, 4) AS ucv, rank() OVER (ORDER BY 1 / sqrt(4 * pi() * v) + 2 * s2 / sqrt(4 * pi() * v) / n - 4 * s1 / sqrt(2 * pi() * v) / (n - 1)) = 1 AS best FROM h JOIN p USING (f)")
def ucv_grid(spark, sf):
    """Six bandwidths scored by one job over pairs of blocks, and which of them is best."""
    d = suppliers(spark, sf)
    base = NormalReferenceRule().diag_bandwidth(d, ["x"])
    got = UCVScorer(d, ["x"]).scores([np.sqrt(f * base) for f in GRID])
    return spark.createDataFrame([(f, round(v * 1e6, 4), v == min(got)) for f, v in zip(GRID, got, strict=True)], "factor double, ucv double, best boolean")


# ---------------------------------------------------------------- cross-validated kernel scores

CUSTOMER_FOLDS = f"""WITH s AS (SELECT c_custkey, c_acctbal AS x, CAST(c_custkey % 97 AS DOUBLE) AS y, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':7'), c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
t AS (SELECT c_custkey, x, y, {FOLD.replace("10", "5")} AS fold FROM s)"""


@query("cv_likelihood_ckde", CUSTOMER_FOLDS + """, h AS (SELECT k AS fold, pow(count(*), -1.0 / 3) AS f, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, count(*) AS n FROM t, range(5) AS r(k) WHERE fold <> k GROUP BY 1),
g AS (SELECT fold, f * a AS a, f * b AS b, f * c AS c, f * f * (a * c - b * b) AS d, n FROM h),
q AS (SELECT p.c_custkey, p.x - u.x AS dx, p.y - u.y AS dy, a, b, c, d FROM t p JOIN g USING (fold) JOIN t u ON u.fold <> p.fold),
e AS (SELECT c_custkey, -0.5 * (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / d AS e, -0.5 * dy * dy / c AS u, d, c FROM q), m AS (SELECT c_custkey, max(e) AS me, max(u) AS mu FROM e GROUP BY 1),
l AS (SELECT c_custkey, any_value(me) + ln(sum(exp(e - me))) - 0.5 * ln(any_value(d)) - (any_value(mu) + ln(sum(exp(u - mu))) - 0.5 * ln(any_value(c))) - 0.5 * ln(2 * pi()) AS logl FROM e JOIN m USING (c_custkey) GROUP BY 1)
SELECT round(avg(logl), 6) AS score FROM l""")
def cv_likelihood_ckde(spark, sf):
    """Five folds of the customers; each is scored under a conditional density of the others."""
    d = Dataset.of(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y")), order_by=["c_custkey"])
    return score_row(spark, d, CVLikelihood(d, 5, 7, key=["c_custkey"]).local_score(KDENetwork(["x", "y"], [("y", "x")]), "x"))


# ---------------------------------------------------------------- series


@query("lags_within_series", "SELECT * FROM (SELECT user_id, event_id, round(value, 6) AS now, round(lag(value, 1) OVER w, 6) AS before, round(lag(value, 2) OVER w, 6) AS earlier FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w > 2)")
def lags_within_series(spark, sf):
    df = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    d = DynamicDataFrame(Dataset.of(df, columns=["user_id", "value"], order_by=["ts", "event_id"]), 2, series=["user_id"])
    r = lambda k: F.round(f"value_t_{k}", 6)
    return d.transition_df().df.select("user_id", "event_id", r(0).alias("now"), r(1).alias("before"), r(2).alias("earlier"))


@query("dbn_series_slope", "SELECT 2 * (SELECT count(*) FROM events) AS rows, round(regr_slope(y, x), 1) AS slope FROM (SELECT w AS y, lag(w) OVER (ORDER BY ts, event_id) AS x FROM (SELECT ts, event_id, value + coalesce(lag(value) OVER (ORDER BY ts, event_id), 0) AS w FROM events))")
def dbn_series_slope(spark, sf):
    """A network of one variable learned from the sums of two events in a row; the slope of its own draws, many series of 20 rows, is that of the
    events."""
    d = moving(spark, sf)
    m = DynamicGaussianNetwork(["w"], 1)
    m.transition_bn().add_arc("w_t_1", "w_t_0")
    n = d.df.count()
    out = checkpointed(m.fit(d.loc("w", d.order_by)).sample(20, seed=4, series=n // 10))
    lags = DynamicDataFrame(Dataset.of(out, columns=["w", "series"], order_by=["t"]), 1, series=["series"]).transition_df().df
    return lags.agg(F.round(F.regr_slope("w_t_0", "w_t_1"), 1).alias("slope")).select(F.lit(out.count()).alias("rows"), "slope")


def moving(spark, sf) -> Dataset:
    """w: an event's value and the one before added up, so that w depends on the last w; v does not."""
    e = table(spark, sf, "events").select("ts", "event_id", "value", (F.col("user_id") % 7).cast("double").alias("v"))
    e = lagged(e, [("value", "value", 0), ("before", "value", 1), ("v", "v", 0)], ["ts", "event_id"])
    e = e.withColumn("w", F.col("value") + F.coalesce("before", F.lit(0.0))).drop("value", "before")
    return Dataset.of(checkpointed(e), order_by=["ts", "event_id"])  # read by every later step, and its lags are a shuffle and a sort


# ---------------------------------------------------------------- tables of tests, separating sets, directions

#: Two-sided 0.1 % point of the normal law: with thousands of rows the t law's is the same to three digits.
CRITICAL, ALPHA = 3.2905, 0.001
COLLIDER = """WITH r AS (SELECT l_quantity AS x, 100 * l_tax AS y, l_quantity / 5 + 100 * l_tax + 100 * l_discount AS z FROM lineitem), c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r),
t AS (SELECT 'x' AS x, 'y' AS y, '' AS z, xy AS r, n - 2 AS df FROM c UNION ALL SELECT 'x', 'z', '', xz, n - 2 FROM c UNION ALL SELECT 'y', 'z', '', yz, n - 2 FROM c
UNION ALL SELECT 'x', 'y', 'z', (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), n - 3 FROM c UNION ALL SELECT 'x', 'z', 'y', (xz - xy * yz) / sqrt((1 - xy * xy) * (1 - yz * yz)), n - 3 FROM c
UNION ALL SELECT 'y', 'z', 'x', (yz - xy * xz) / sqrt((1 - xy * xy) * (1 - xz * xz)), n - 3 FROM c), i AS (SELECT *, abs(r) * sqrt(df / (1 - r * r)) < """ + str(CRITICAL) + """ AS free FROM t),
gone AS (SELECT x, y, min(z) AS z FROM i WHERE free GROUP BY 1, 2), edges AS (SELECT DISTINCT x, y FROM i ANTI JOIN gone USING (x, y)), near AS (SELECT x AS a, y AS b FROM edges UNION ALL SELECT y, x FROM edges)"""
COLLIDER_ARCS = COLLIDER + ", triple AS (SELECT m.a AS mid, gone.x AS p, gone.y AS q FROM near m JOIN near o ON m.a = o.a AND m.b < o.b JOIN gone ON gone.x = m.b AND gone.y = o.b WHERE NOT gone.z = m.a) SELECT p AS a, mid AS b FROM triple UNION ALL SELECT q, mid FROM triple"


def collider(spark, sf) -> Dataset:
    """z is made of x, y and noise of its own; x and y have nothing to do with each other."""
    return Dataset.of(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (100 * F.col("l_tax")).alias("y"), (F.col("l_quantity") / 5 + 100 * F.col("l_tax") + 100 * F.col("l_discount")).alias("z")))


@query("test_table", COLLIDER + " SELECT x, y, z, free FROM i")
def test_table(spark, sf):
    """All tests of three variables as rows, done at once."""
    d = collider(spark, sf)
    t = TestTable.recording(LinearCorrelation(d))
    t.pvalues([(a, b, z) for a, b, c in (("x", "y", "z"), ("x", "z", "y"), ("y", "z", "x")) for z in ([], [c])])
    return t.table(spark).select("x", "y", F.array_join("z", ",").alias("z"), (F.col("p") > ALPHA).alias("free"))


@query("pc_directions", COLLIDER_ARCS)
def pc_directions(spark, sf):
    """Arcs of a known collider, learned from a table of tests that another test object filled."""
    t = TestTable.recording(LinearCorrelation(collider(spark, sf)))
    PC().estimate(t, alpha=ALPHA)
    g = PC().estimate(TestTable(t.variables(), t.table(spark)), alpha=ALPHA)
    return spark.createDataFrame(sorted(g.arcs()), "a string, b string")


@query("pc_separating_sets", COLLIDER + " SELECT x AS a, y AS b, z AS separated_by FROM gone")
def pc_separating_sets(spark, sf):
    pc = PC()
    pc.estimate(LinearCorrelation(collider(spark, sf)), alpha=ALPHA, use_sepsets=True)
    return spark.createDataFrame([(a, b, ",".join(z)) for a, b, z, _ in pc.sepset_rows()], "a string, b string, separated_by string")


@query("hc_collider_arcs", COLLIDER_ARCS)
def hc_collider_arcs(spark, sf):
    """A collider's arcs are the same in every network of its class, so the score finds them too."""
    return spark.createDataFrame(sorted(hc(collider(spark, sf), GaussianNetworkType()).arcs()), "a string, b string")


@query("dmmhc_transition_arcs", f"""WITH e AS (SELECT ts, event_id, value + coalesce(lag(value) OVER (ORDER BY ts, event_id), 0) AS w, CAST(user_id % 7 AS DOUBLE) AS v FROM events), s AS (SELECT w, v, lag(w) OVER (ORDER BY ts, event_id) AS w1, lag(v) OVER (ORDER BY ts, event_id) AS v1 FROM e),
c AS (SELECT count(w1) AS n, corr(w, w1) AS ww, corr(w, v1) AS wv, corr(v, w1) AS vw, corr(v, v1) AS vv FROM s), t AS (SELECT 'w_t_1' AS a, 'w_t_0' AS b, ww AS r, n FROM c UNION ALL SELECT 'v_t_1', 'w_t_0', wv, n FROM c UNION ALL SELECT 'w_t_1', 'v_t_0', vw, n FROM c UNION ALL SELECT 'v_t_1', 'v_t_0', vv, n FROM c)
SELECT a, b FROM t WHERE abs(r) * sqrt((n - 2) / (1 - r * r)) > {CRITICAL}""")
def dmmhc_transition_arcs(spark, sf):
    """Arcs into the present: as each variable has one dependent ancestor at most, they are the dependent pairs."""
    s = DynamicDataFrame(moving(spark, sf), 1)
    m = DMMHC().estimate(DynamicLinearCorrelation(s), ArcOperatorSet(), DynamicBIC(s), ["w", "v"], GaussianNetworkType(), 1, alpha=ALPHA)
    return spark.createDataFrame(sorted(m.transition_bn().arcs()), "a string, b string")
