"""More queries with their SQL: ingest and saving, positions and roles, distribution functions, densities, hybrid factors, sampling laws, graphs
made from tables, network rules, dynamic and validated scores, mutual information, search operators and structure learning."""

from __future__ import annotations

import itertools
import math
import os
import pickle
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import stats as S
from netloom.operators.constraint import MeekRules, all_subsets, combinations_of_two_sets
from netloom.operators.factors import CKDE, HCKDE, MLE, CLinearGaussianCPD, CKDEType, DiscreteFactor, DiscreteFactorType, LinearGaussianCPD, LinearGaussianCPDType
from netloom.operators.graph import Dag, PartiallyDirectedGraph, UndirectedGraph
from netloom.operators.independence import LinearCorrelation, MutualInformation, gaussian_entropy
from netloom.operators.kde import KDE, NormalReferenceRule
from netloom.operators.learn import MMHC, MMPC, PC, check_restrictions, hc
from netloom.operators.models import CLGNetwork, CLGNetworkType, DiscreteBNType, DynamicGaussianNetwork, GaussianNetwork, GaussianNetworkType, KDENetworkType, SemiparametricBN, SemiparametricBNType
from netloom.operators.scores import BIC, DynamicBIC, ValidatedLikelihood
from netloom.operators.search import ArcOperatorSet, OperatorTabuSet
from netloom.operators.temporal import DynamicDataFrame
from netloom.plans.catalogue import CLG, DISC, FLAGS, KDE2, LG_ORDERS, LOGL, PRICE, QTY, SPLIT_ORDERS, TAX, customers, event_slices, lineitem, one_row, orders_xy, suppliers, table
from netloom.sources.dataset import Dataset, from_arrow, from_pandas
from netloom.sources.serialization import load, save

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sources


@query("ingest_pandas", "SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS holes FROM supplier")
def ingest_pandas(spark, sf):
    """A pandas frame of the whole supplier table, NaN as null."""
    pdf = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("holes")).toPandas()
    return from_pandas(pdf, spark)


@query("ingest_arrow", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def ingest_arrow(spark, sf):
    return from_arrow(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").toArrow(), spark)


BN_MEAN = LG_ORDERS + f", g AS (SELECT avg(x) AS ax, var_samp(x) AS vx FROM o) SELECT round(avg({LOGL} - 0.5 * (x - ax) * (x - ax) / vx - 0.5 * ln(vx) - 0.5 * ln(2 * pi())), 6) AS mean_logl FROM o, f, g"


@query("save_and_load", BN_MEAN)
def save_and_load(spark, sf):
    """A fitted network through a file and through pickle scores like the one before."""
    d = orders_xy(spark, sf)
    m = GaussianNetwork(["x", "y"], [("x", "y")]).fit(d)
    with tempfile.TemporaryDirectory() as folder:
        again = load(save(m, os.path.join(folder, "model"), include_cpd=True))
    again.include_cpd = True
    return one_row(spark, {"mean_logl": round(pickle.loads(pickle.dumps(again)).slogl(d) / d.num_rows, 6)})


# ---------------------------------------------------------------- positions, roles, configurations


@query("dataset_loc", "SELECT o_totalprice, o_orderkey FROM orders")
def dataset_loc(spark, sf):
    d = Dataset.of(table(spark, sf, "orders"))
    at = d.df.columns.index("o_orderkey")
    if not d.has_columns("o_totalprice", at) or d.has_columns("nothing"):
        raise AssertionError("column checks")
    return d.loc("o_totalprice", at).df


@query("dataset_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
def dataset_slice(spark, sf):
    return Dataset.of(table(spark, sf, "orders"), order_by=["o_orderkey"], columns=["o_orderkey", "o_totalprice"]).slice(100, 25).df.select("o_orderkey", "o_totalprice")


TAKEN = [7, 0, 7, 123, 1]


@query("dataset_take", f"SELECT o_orderkey, o_totalprice, CAST(i AS BIGINT) AS i FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders) JOIN (VALUES {', '.join(f'({p}, {i})' for i, p in enumerate(TAKEN))}) AS t(pos, i) USING (pos)")
def dataset_take(spark, sf):
    d = Dataset.of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), order_by=["o_totalprice", "o_orderkey"])
    return d.take(TAKEN).df.select("o_orderkey", "o_totalprice", F.col("_take").alias("i"))


@query("column_roles", "SELECT 'l_quantity' AS c, 'continuous' AS role, CAST(0 AS BIGINT) AS levels UNION ALL SELECT 'l_returnflag', 'discrete', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'l_linestatus', 'discrete', count(DISTINCT l_linestatus) FROM lineitem")
def column_roles(spark, sf):
    d = lineitem(spark, sf, [QTY, *FLAGS])
    return frame(spark, [(c, "continuous" if d.is_continuous(c) else "discrete", d.cardinality(c) if d.is_discrete(c) else 0) for c in d.columns], "c string, role string, levels long")


@query("by_configuration", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2")
def by_configuration(spark, sf):
    d = lineitem(spark, sf, [QTY, *FLAGS])
    return S.slice_by_configuration(d, FLAGS).groupBy("configuration").agg(F.first(FLAGS[0]).alias(FLAGS[0]), F.first(FLAGS[1]).alias(FLAGS[1]), F.count("*").alias("n"), F.round(F.avg(QTY), 6).alias("mean")).drop("configuration")


@query("dynamic_accessors", "SELECT CAST(2 AS BIGINT) AS variables, CAST(6 AS BIGINT) AS columns, CAST(2 AS BIGINT) AS markov, count(*) - 2 AS num_rows FROM events")
def dynamic_accessors(spark, sf):
    d = event_slices(spark, sf)
    return one_row(spark, {"variables": d.num_variables(), "columns": d.num_columns(), "markov": d.markovian_order, "num_rows": d.num_rows()})


@query("temporal_loc", "SELECT event_id, value AS value_t_0, lag(event_type, 2) OVER w AS event_type_t_2 FROM events WINDOW w AS (ORDER BY ts, event_id) QUALIFY row_number() OVER w > 2")
def temporal_loc(spark, sf):
    return event_slices(spark, sf).transition_df().df.select("event_id", "value_t_0", "event_type_t_2")


@query("create_temporal_slice", "SELECT x, count(*) AS n FROM (SELECT lag(event_type, 3) OVER (ORDER BY ts, event_id) AS x FROM events) GROUP BY 1")
def create_temporal_slice(spark, sf):
    from netloom.operators.temporal import create_temporal_slice as cut

    return cut(table(spark, sf, "events"), ["event_type"], 3, ["ts", "event_id"]).groupBy(F.col("event_type_t_3").alias("x")).agg(F.count("*").alias("n"))


@query("column_spread", "SELECT round(var_samp(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity) * (count(*) - 1) / 1e6, 6) AS sse FROM lineitem")
def column_spread(spark, sf):
    m = S.SuffStats(lineitem(spark, sf)).moments([QTY])
    return one_row(spark, {"v": round(float(m.cov[0, 0]), 6), "sd": round(math.sqrt(m.cov[0, 0]), 6), "sse": round(float(m.sse[0, 0]) / 1e6, 6)})


@query("block_covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS value FROM lineitem" for a in (QTY, DISC) for b in (TAX, QTY)))
def block_covariance(spark, sf):
    c = S.block_covariance(lineitem(spark, sf), [QTY, DISC], [TAX, QTY])
    return frame(spark, [(a, b, round(float(c[i, j]), 6)) for i, a in enumerate((QTY, DISC)) for j, b in enumerate((TAX, QTY))], "a string, b string, value double")


@query("median_distance", "WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x FROM orders QUALIFY i <= 500) SELECT round(median(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 5) AS d FROM r a JOIN r b ON a.i < b.i")
def median_distance(spark, sf):
    return one_row(spark, {"d": round(S.median_distance(orders_xy(spark, sf), ["x", "y"]), 5)})


# ---------------------------------------------------------------- factors

#: The normal distribution function of column z by the series of positive terms z**(2n+1) / (2n+1)!!; beyond 8 it is 0 or 1 to rounding.
PHI = "(CASE WHEN z > 8 THEN 1 WHEN z < -8 THEN 0 ELSE 0.5 + sign(z) * exp(-0.5 * z * z) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(greatest(abs(z), 1e-300)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1))))) END)"


@query("lg_cdf", f"{LG_ORDERS}, q AS (SELECT o_orderkey, (y - a - b * x) / sqrt(v) AS z FROM o, f) SELECT o_orderkey, round({PHI}, 6) AS cdf FROM q")
def lg_cdf(spark, sf):
    d = orders_xy(spark, sf)
    return LinearGaussianCPD("y", ["x"]).fit(d).cdf(d).select("o_orderkey", F.round("cdf", 6).alias("cdf"))


@query("ckde_cdf", KDE2 + f" u AS (SELECT c_custkey, exp(-0.5 * dy * dy / c - max(-0.5 * dy * dy / c) OVER (PARTITION BY c_custkey)) AS w, (dx - b / c * dy) / sqrt(a - b * b / c) AS z FROM q), t AS (SELECT c_custkey, w, {PHI} AS p FROM u) SELECT c_custkey, round(sum(w * p) / sum(w), 6) AS cdf FROM t GROUP BY 1")
def ckde_cdf(spark, sf):
    return CKDE("x", ["y"]).fit(suppliers(spark, sf)).cdf(customers(spark, sf)).select("c_custkey", F.round("cdf", 6).alias("cdf"))


def residual(target: str, by: str) -> str:
    return f"{target} - (SELECT regr_intercept({target}, {by}) FROM {{t}}) - (SELECT regr_slope({target}, {by}) FROM {{t}}) * {by}"


@query("lg_fit_3p", f"""WITH l AS (SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem),
m AS (SELECT y, x1, x2, x3, {residual('x2', 'x1').format(t='l')} AS e2, {residual('x3', 'x1').format(t='l')} AS f3 FROM l),
k AS (SELECT *, f3 - (SELECT regr_slope(f3, e2) FROM m) * e2 AS e3 FROM m),
c AS (SELECT regr_slope(y, e3) AS b3, regr_slope(y, e2) - regr_slope(y, e3) * (regr_slope(x3, e2)) AS b2 FROM k),
d AS (SELECT b2, b3, regr_slope(y, x1) - b2 * regr_slope(x2, x1) - b3 * regr_slope(x3, x1) AS b1 FROM k, c GROUP BY b2, b3),
z AS (SELECT b1, b2, b3, avg(y - b1 * x1 - b2 * x2 - b3 * x3) AS b0, var_samp(y - b1 * x1 - b2 * x2 - b3 * x3) * (count(*) - 1) / (count(*) - 4) AS v FROM l, d GROUP BY b1, b2, b3)
SELECT round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(b3, 4) AS b3, round(v / 1e6, 4) AS variance FROM z""")
def lg_fit_3p(spark, sf):
    f = LinearGaussianCPD(PRICE, [QTY, DISC, TAX]).fit(lineitem(spark, sf))
    return one_row(spark, {f"b{i}": round(float(b), 4) for i, b in enumerate(f.beta)} | {"variance": round(f.variance / 1e6, 4)})


@query("mle_gaussian", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS b0, round(regr_slope(l_extendedprice, l_quantity), 4) AS b1, round((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / 1e6, 4) AS variance FROM lineitem")
def mle_gaussian(spark, sf):
    p = MLE(LinearGaussianCPDType()).estimate(lineitem(spark, sf, [PRICE, QTY]), PRICE, [QTY])
    return one_row(spark, {"b0": round(float(p.beta[0]), 4), "b1": round(float(p.beta[1]), 4), "variance": round(p.variance / 1e6, 4)})


@query("mle_discrete", "SELECT l_returnflag, l_linestatus, round(ln(n) - ln(sum(n) OVER (PARTITION BY l_linestatus)), 6) AS logprob FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def mle_discrete(spark, sf):
    d = lineitem(spark, sf, FLAGS)
    p = MLE(DiscreteFactorType()).estimate(d, FLAGS[0], FLAGS[1:]).logprob
    return frame(spark, [(v, e, round(float(p[i, j]), 6)) for i, v in enumerate(d.discrete[FLAGS[0]]) for j, e in enumerate(d.discrete[FLAGS[1]]) if p[i, j] > -math.inf], "l_returnflag string, l_linestatus string, logprob double")


@query("factor_set_by_hand", "SELECT o_orderkey, round(-0.5 * pow((o_totalprice - 1000 - 2 * o_custkey) / 500, 2) - ln(500) - 0.5 * ln(2 * pi()), 6) AS logl FROM orders")
def factor_set_by_hand(spark, sf):
    f = LinearGaussianCPD("y", ["x"], [1000.0, 2.0], 250000.0)
    return f.logl(orders_xy(spark, sf)).select("o_orderkey", F.round("logl", 6).alias("logl"))


@query("clg_logl_unfitted", """WITH o AS (SELECT o_orderkey, o_totalprice AS y, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'rare' ELSE o_orderstatus END AS g FROM orders), p AS (SELECT g, avg(y) AS m, var_samp(y) AS v FROM o WHERE g <> 'rare' GROUP BY 1)
SELECT o_orderkey, round(-0.5 * (y - m) * (y - m) / v - 0.5 * ln(v) - 0.5 * ln(2 * pi()), 6) AS logl FROM o LEFT JOIN p USING (g)""")
def clg_logl_unfitted(spark, sf):
    """A configuration of one row has no variance, so its factor is not fitted and its row has no value."""
    low = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.when(F.col("o_orderkey") == low, "rare").otherwise(F.col("o_orderstatus")).alias("g"))
    d = Dataset.of(df, order_by=["o_orderkey"])
    return CLinearGaussianCPD("y", ["g"]).fit(d).logl(d).select("o_orderkey", F.round("logl", 6).alias("logl"))


@query("hckde_logl", """WITH s AS (SELECT s_acctbal AS x, s_suppkey % 3 AS g FROM supplier), h AS (SELECT g, sqrt(pow(4.0 / (3.0 * count(*)), 0.4) * var_samp(x)) AS h, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT c_custkey, -0.5 * pow((c_acctbal - x) / h, 2) AS e, h, n FROM customer JOIN s ON s.g = c_custkey % 3 JOIN h ON h.g = s.g)
SELECT c_custkey, round(max(e) + ln(sum(exp(e - m))) - ln(any_value(n)) - ln(any_value(h)) - 0.5 * ln(2 * pi()), 6) AS logl FROM (SELECT *, max(e) OVER (PARTITION BY c_custkey) AS m FROM k) GROUP BY 1""")
def hckde_logl(spark, sf):
    train = Dataset.of(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 3).cast("string").alias("g")))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 3).cast("string").alias("g"))
    return HCKDE("x", ["g"]).fit(train).logl(rows).select("c_custkey", F.round("logl", 6).alias("logl"))


@query("ckde_parts", "SELECT round(var_samp(s_acctbal) * pow(count(*), -1.0 / 3), 4) AS joint, round(var_samp(s_suppkey) * pow(count(*), -1.0 / 3), 4) AS marginal, count(*) AS n FROM supplier")
def ckde_parts(spark, sf):
    f = CKDE("x", ["y"]).fit(suppliers(spark, sf))
    return one_row(spark, {"joint": round(float(f.kde_joint().bandwidth[0, 0]), 4), "marginal": round(float(f.kde_marg().bandwidth[0, 0]), 4), "n": f.num_instances()})


@query("kde_slogl_1d", "WITH s AS (SELECT s_acctbal AS x FROM supplier), h AS (SELECT sqrt(pow(4.0 / (3.0 * count(*)), 0.4) * var_samp(x)) AS h, count(*) AS n FROM s), k AS (SELECT c_custkey, ln(sum(exp(-0.5 * pow((c_acctbal - x) / h, 2)))) - ln(any_value(n)) - ln(any_value(h)) - 0.5 * ln(2 * pi()) AS l FROM customer, s, h GROUP BY 1) SELECT round(avg(l), 6) AS mean_logl FROM k")
def kde_slogl_1d(spark, sf):
    c = customers(spark, sf)
    return one_row(spark, {"mean_logl": round(KDE(["x"]).fit(suppliers(spark, sf)).slogl(c) / c.count(), 6)})


NR_DIAG = "pow(2 * pow(1 - r * r, 2.5) / (2 + r * r) / n, 1.0 / 3)"


@query("nr_diag_bandwidth", f"SELECT round({NR_DIAG} * v0, 6) AS h0, round({NR_DIAG} * v1 / 1e6, 6) AS h1 FROM (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r, var_samp(l_quantity) AS v0, var_samp(l_extendedprice) AS v1 FROM lineitem)")
def nr_diag_bandwidth(spark, sf):
    h = NormalReferenceRule().diag_bandwidth(lineitem(spark, sf), [QTY, PRICE])
    return one_row(spark, {"h0": round(float(h[0]), 6), "h1": round(float(h[1]) / 1e6, 6)})


#: Draws of a law; a mean lies within five standard errors, a variance within 3 percent.
DRAWS = 100_000


def law(spark, df: DataFrame, column: str, mean: float, variance: float) -> DataFrame:
    n, m, v = df.agg(F.count(column), F.avg(column), F.var_samp(column)).first()
    return one_row(spark, {"n": n, "mean_holds": int(abs(m - mean) < 5 * math.sqrt(variance / n)), "variance_holds": int(abs(v / variance - 1) < 0.03)})


LAW = f"SELECT CAST({DRAWS} AS BIGINT) AS n, CAST(1 AS BIGINT) AS mean_holds, CAST(1 AS BIGINT) AS variance_holds"


@query("lg_sample_law", LAW)
def lg_sample_law(spark, sf):
    evidence = spark.range(DRAWS).select(F.lit(3.0).alias("x"))
    return law(spark, LinearGaussianCPD("y", ["x"], [1.0, 2.0], 4.0).sample(DRAWS, evidence, 5), "y", 7.0, 4.0)


@query("bn_sample_law", LAW)
def bn_sample_law(spark, sf):
    """The law of y in a sample of a fitted chain is that of the data."""
    d = orders_xy(spark, sf)
    m, v = d.df.agg(F.avg("y"), F.var_samp("y")).first()
    return law(spark, GaussianNetwork(["x", "y"], [("x", "y")]).fit(d).sample(DRAWS, 3), "y", m, v)


@query("conditional_sample_law", LAW)
def conditional_sample_law(spark, sf):
    d = orders_xy(spark, sf)
    f = GaussianNetwork(["x", "y"], [("x", "y")]).fit(d)
    drawn = f.conditional_bn(["y"], ["x"]).sample(spark.range(DRAWS).select(F.lit(100.0).alias("x")), 4)
    b = f.cpd("y")
    return law(spark, drawn, "y", float(b.beta[0] + 100 * b.beta[1]), b.variance)


@query("clg_sample_law", LAW)
def clg_sample_law(spark, sf):
    d = lineitem(spark, sf, [PRICE, QTY, FLAGS[0]])
    f = CLinearGaussianCPD(PRICE, [QTY, FLAGS[0]]).fit(d)
    k = next(iter(f.factors))
    x = f.factors[k]
    drawn = f.sample(DRAWS, spark.range(DRAWS).select(F.lit(10.0).alias(QTY), F.lit(d.discrete[FLAGS[0]][k[0]]).alias(FLAGS[0])), 6)
    return law(spark, drawn, PRICE, float(x.beta[0] + 10 * x.beta[1]), x.variance)


@query("ckde_sample_law", LAW)
def ckde_sample_law(spark, sf):
    """Mean and variance of a kernel density are those of the data, plus the bandwidth (and n - 1 over n)."""
    d = suppliers(spark, sf)
    f = CKDE("x").fit(d)
    n, m, v = d.df.agg(F.count("x"), F.avg("x"), F.var_samp("x")).first()
    return law(spark, f.sample(DRAWS, None, 7), "x", m, v * (n - 1) / n + float(f.kde_joint().bandwidth[0, 0]))


@query("discrete_sample_law", "SELECT l_returnflag AS v, CAST(1 AS BIGINT) AS holds FROM lineitem GROUP BY 1")
def discrete_sample_law(spark, sf):
    d = lineitem(spark, sf, FLAGS[:1])
    f = DiscreteFactor(FLAGS[0]).fit(d)
    seen = {r[0]: r[1] for r in f.sample(DRAWS, None, 8).groupBy(FLAGS[0]).count().collect()}
    p = {v: math.exp(f.logprob[i]) for i, v in enumerate(d.discrete[FLAGS[0]])}
    return frame(spark, [(v, int(abs(seen[v] / DRAWS - p[v]) < 5 * math.sqrt(p[v] * (1 - p[v]) / DRAWS))) for v in seen], "v string, holds long")


# ---------------------------------------------------------------- graphs over the nation table: arcs run to n + 3 and to 2 n + 1

ARCS_SQL = "arcs(a, b) AS (SELECT n_name, m.n_name FROM nation n JOIN nation m ON m.n_nationkey IN (n.n_nationkey + 3, 2 * n.n_nationkey + 1) AND m.n_nationkey > n.n_nationkey)".replace("SELECT n_name", "SELECT n.n_name")


def nation_arcs(spark, sf) -> tuple[list[str], list[tuple[str, str]]]:
    names = {r["n_nationkey"]: r["n_name"] for r in table(spark, sf, "nation").collect()}
    return list(names.values()), [(names[k], names[j]) for k in names for j in sorted({k + 3, 2 * k + 1}) if j in names and j > k]


def nation_dag(spark, sf) -> Dag:
    return Dag(*nation_arcs(spark, sf))


@query("graph_degrees", f"WITH {ARCS_SQL} SELECT n_name AS node, (SELECT count(*) FROM arcs WHERE b = n_name) AS parents, (SELECT count(*) FROM arcs WHERE a = n_name) AS children, CAST(n_name NOT IN (SELECT b FROM arcs) AS BIGINT) AS root, CAST(n_name NOT IN (SELECT a FROM arcs) AS BIGINT) AS leaf FROM nation")
def graph_degrees(spark, sf):
    g = nation_dag(spark, sf)
    return frame(spark, [(n, g.num_parents(n), g.num_children(n), int(g.is_root(n)), int(g.is_leaf(n))) for n in g.nodes()], "node string, parents long, children long, root long, leaf long")


PATHS = f"WITH RECURSIVE {ARCS_SQL}, r(a, b) AS (SELECT a, b FROM arcs UNION SELECT r.a, x.b FROM r JOIN arcs x ON x.a = r.b)"


@query("graph_paths", PATHS + " SELECT a, b FROM r")
def graph_paths(spark, sf):
    g = nation_dag(spark, sf)
    return frame(spark, [(a, b) for a, b in itertools.permutations(g.nodes(), 2) if g.has_path(a, b)], "a string, b string")


@query("graph_addable_arcs", PATHS + " SELECT n.n_name AS a, m.n_name AS b FROM nation n JOIN nation m ON n.n_name <> m.n_name LEFT JOIN r ON r.a = m.n_name AND r.b = n.n_name WHERE r.a IS NULL")
def graph_addable_arcs(spark, sf):
    g = nation_dag(spark, sf)
    return frame(spark, [(a, b) for a, b in itertools.permutations(g.nodes(), 2) if g.can_add_arc(a, b)], "a string, b string")


@query("graph_flippable_arcs", PATHS + " SELECT a, b FROM arcs WHERE NOT EXISTS (SELECT 1 FROM arcs x JOIN r ON r.a = x.b AND r.b = arcs.b WHERE x.a = arcs.a AND x.b <> arcs.b)")
def graph_flippable_arcs(spark, sf):
    g = nation_dag(spark, sf)
    return frame(spark, [(a, b) for a, b in g.arcs() if g.can_flip_arc(a, b)], "a string, b string")


@query("graph_topological_order", f"WITH {ARCS_SQL} SELECT (SELECT count(*) FROM nation) AS nodes, count(*) AS arcs, CAST(0 AS BIGINT) AS backward FROM arcs")
def graph_topological_order(spark, sf):
    g = nation_dag(spark, sf)
    at = {n: i for i, n in enumerate(g.topological_sort())}
    return one_row(spark, {"nodes": len(at), "arcs": g.num_arcs(), "backward": sum(at[a] > at[b] for a, b in g.arcs())})


CLASS = f"WITH {ARCS_SQL}, s AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM arcs) SELECT a, b, 'pair' AS kind FROM s UNION ALL SELECT DISTINCT least(x.a, y.a) || '>' || x.b, greatest(x.a, y.a), 'collider' FROM arcs x JOIN arcs y ON x.b = y.b AND x.a < y.a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.a = least(x.a, y.a) AND s.b = greatest(x.a, y.a))"


def equivalence_class(spark, g) -> DataFrame:
    """What Markov-equivalent graphs share: adjacent pairs and colliders of non-adjacent parents."""
    near = {tuple(sorted(x)) for x in g.arcs()}
    colliders = {(f"{a}>{n}", b, "collider") for n in g.nodes() for a, b in itertools.combinations(sorted(g.parents(n)), 2) if (a, b) not in near}
    return frame(spark, [(*p, "pair") for p in near] + sorted(colliders), "a string, b string, kind string")


@query("graph_to_pdag_and_back", CLASS)
def graph_to_pdag_and_back(spark, sf):
    return equivalence_class(spark, nation_dag(spark, sf).to_pdag().to_dag())


@query("graph_to_approximate_dag", CLASS)
def graph_to_approximate_dag(spark, sf):
    return equivalence_class(spark, nation_dag(spark, sf).to_pdag().to_approximate_dag())


@query("graph_complete", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def graph_complete(spark, sf):
    return frame(spark, [tuple(sorted(e)) for e in UndirectedGraph.Complete(nation_arcs(spark, sf)[0]).edges()], "a string, b string")


@query("graph_neighbors", f"WITH {ARCS_SQL}, e AS (SELECT a, b FROM arcs UNION ALL SELECT b, a FROM arcs) SELECT n_name AS node, count(b) AS neighbors FROM nation LEFT JOIN e ON e.a = n_name GROUP BY 1")
def graph_neighbors(spark, sf):
    nodes, arcs = nation_arcs(spark, sf)
    g = UndirectedGraph(nodes, arcs)
    return frame(spark, [(n, g.num_neighbors(n)) for n in g.nodes()], "node string, neighbors long")


@query("graph_direct_undirect", f"WITH {ARCS_SQL}, k AS (SELECT a, b, n_nationkey % 2 AS odd FROM arcs JOIN nation ON n_name = a) SELECT a, b, 'arc' AS kind FROM k WHERE odd = 0 UNION ALL SELECT least(a, b), greatest(a, b), 'edge' FROM k WHERE odd = 1")
def graph_direct_undirect(spark, sf):
    """All edges are directed, then those from odd keys undirected again."""
    nodes, arcs = nation_arcs(spark, sf)
    key = {r["n_name"]: r["n_nationkey"] for r in table(spark, sf, "nation").collect()}
    g = PartiallyDirectedGraph(nodes)
    for a, b in arcs:
        g.add_edge(a, b)
        g.direct(a, b)
        if key[a] % 2:
            g.undirect(a, b)
    return frame(spark, [(a, b, "arc") for a, b in g.arcs()] + [(*sorted(e), "edge") for e in g.edges()], "a string, b string, kind string")


@query("graph_conditional", f"WITH {ARCS_SQL}, k AS (SELECT a, b, x.n_nationkey < 5 AS ia, y.n_nationkey < 5 AS ib FROM arcs JOIN nation x ON x.n_name = a JOIN nation y ON y.n_name = b) SELECT a, b, CAST(ia AS BIGINT) AS interface FROM k WHERE NOT ib")
def graph_conditional(spark, sf):
    """The graph given nations 0 to 4: arcs into these are gone."""
    names = [r["n_name"] for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    g = nation_dag(spark, sf).conditional_graph(names[5:], names[:5])
    return frame(spark, [(a, b, int(g.is_interface(a))) for a, b in g.arcs()], "a string, b string, interface long")


@query("meek_rules", "SELECT * FROM (VALUES (1, 'a', 'b'), (1, 'b', 'c'), (2, 'a', 'b'), (2, 'b', 'c'), (2, 'a', 'c'), (3, 'b', 'd'), (3, 'c', 'd'), (3, 'a', 'd')) AS t(rule, a, b)")
def meek_rules(spark, sf):
    """The textbook figure of each rule: the arcs after it."""
    figures = {1: ([("a", "b")], [("b", "c")]), 2: ([("a", "b"), ("b", "c")], [("a", "c")]), 3: ([("b", "d"), ("c", "d")], [("a", "b"), ("a", "c"), ("a", "d")])}
    out = []
    for rule, (arcs, edges) in figures.items():
        g = PartiallyDirectedGraph(["a", "b", "c", "d"])
        for a, b in arcs:
            g.add_arc(a, b)
        for a, b in edges:
            g.add_edge(a, b)
        getattr(MeekRules, f"rule{rule}")(g)
        out += [(rule, a, b) for a, b in g.arcs()]
    return frame(spark, out, "rule int, a string, b string")


@query("subsets", "WITH k AS (SELECT n_name AS x, n_nationkey AS i FROM nation WHERE n_nationkey < 6) SELECT a.x || ',' || b.x AS s FROM k a JOIN k b ON a.i < b.i UNION ALL SELECT a.x || ',' || b.x || ',' || c.x FROM k a JOIN k b ON a.i < b.i JOIN k c ON b.i < c.i")
def subsets(spark, sf):
    names = [r["n_name"] for r in table(spark, sf, "nation").where("n_nationkey < 6").orderBy("n_nationkey").collect()]
    return frame(spark, [(",".join(s),) for s in all_subsets(names, 2, 3)], "s string")


@query("subsets_of_two_sets", "WITH k AS (SELECT n_name AS x, n_nationkey AS i FROM nation WHERE n_nationkey < 7) SELECT DISTINCT a.x AS a, b.x AS b FROM k a JOIN k b ON a.x < b.x WHERE a.i < 4 AND b.i < 4 OR a.i >= 3 AND b.i >= 3")
def subsets_of_two_sets(spark, sf):
    """Pairs within either of two overlapping sets, each once."""
    names = [r["n_name"] for r in table(spark, sf, "nation").where("n_nationkey < 7").orderBy("n_nationkey").collect()]
    return frame(spark, [tuple(sorted(s)) for s in combinations_of_two_sets(names[:4], names[3:], 2)], "a string, b string")


# ---------------------------------------------------------------- networks


@query("network_types", "SELECT * FROM (VALUES ('gaussian', 'LinearGaussianFactor', 1), ('discrete', 'DiscreteFactor', 1), ('kde', 'CKDEFactor', 1)) AS t(network, node_type, homogeneous)")
def network_types(spark, sf):
    kinds = {"gaussian": (GaussianNetworkType(), LinearGaussianCPDType(), "LinearGaussianFactor"), "discrete": (DiscreteBNType(), DiscreteFactorType(), "DiscreteFactor"), "kde": (KDENetworkType(), CKDEType(), "CKDEFactor")}
    return frame(spark, [(k, name if t.default_node_type() == f else "other", int(t.is_homogeneous())) for k, (t, f, name) in kinds.items()], "network string, node_type string, homogeneous int")


@query("node_types_of_data", "SELECT column_name AS node, CASE WHEN data_type = 'VARCHAR' THEN 'discrete' ELSE 'gaussian' END AS node_type FROM (DESCRIBE SELECT l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem) AS t(column_name, data_type, a, b, c, d)")
def node_types_of_data(spark, sf):
    """Types that a network without given types takes from the data."""
    d = lineitem(spark, sf, [QTY, PRICE, *FLAGS])
    m = CLGNetwork([QTY, PRICE, *FLAGS])
    m.set_unknown_node_types(d)
    return frame(spark, [(n, "discrete" if m.node_type(n) == DiscreteFactorType() else "gaussian") for n in m.nodes()], "node string, node_type string")


@query("arc_rules_clg", "WITH k(n, d) AS (VALUES ('l_quantity', 0), ('l_extendedprice', 0), ('l_returnflag', 1), ('l_linestatus', 1)) SELECT a.n AS a, b.n AS b FROM k a JOIN k b ON a.n <> b.n WHERE NOT (a.d = 0 AND b.d = 1)")
def arc_rules_clg(spark, sf):
    m = CLGNetwork([QTY, PRICE, *FLAGS])
    m.set_unknown_node_types(lineitem(spark, sf, [QTY, PRICE, *FLAGS]))
    return frame(spark, [(a, b) for a, b in itertools.permutations(m.nodes(), 2) if CLGNetworkType().can_have_arc(m, a, b)], "a string, b string")


@query("arc_rules_semiparametric", "WITH k(n) AS (VALUES ('a'), ('b'), ('c')) SELECT a.n AS a, b.n AS b FROM k a JOIN k b ON a.n <> b.n")
def arc_rules_semiparametric(spark, sf):
    """Between continuous nodes of either type every arc is allowed."""
    m = SemiparametricBN(["a", "b", "c"], [], [("a", CKDEType()), ("b", LinearGaussianCPDType()), ("c", CKDEType())])
    return frame(spark, [(a, b) for a, b in itertools.permutations(m.nodes(), 2) if SemiparametricBNType().can_have_arc(m, a, b)], "a string, b string")


@query("force_whitelist", "SELECT * FROM (VALUES ('a', 'c'), ('b', 'c'), ('b', 'd')) AS t(a, b)")
def force_whitelist(spark, sf):
    """A whitelisted arc that is missing is added, one that is there stays."""
    m = GaussianNetwork(["a", "b", "c", "d"], [("b", "c"), ("b", "d")])
    m.force_whitelist([("b", "c"), ("a", "c")])
    return frame(spark, m.arcs(), "a string, b string")


@query("restrictions", "SELECT * FROM (VALUES ('arc_black', 'a', 'b'), ('arc_black', 'b', 'a'), ('arc_black', 'c', 'd'), ('arc_white', 'd', 'c'), ('edge_black', 'a', 'b'), ('edge_white', 'a', 'd')) AS t(kind, a, b)")
def restrictions(spark, sf):
    """A blacklisted edge bars both arcs; a whitelisted edge with one barred arc is the other arc."""
    ab, aw, eb, ew = check_restrictions("abcd", [("c", "d")], [], [("a", "b")], [("c", "d"), ("a", "d")])
    rows = [("arc_black", *x) for x in ab] + [("arc_white", *x) for x in aw] + [("edge_black", *sorted(x)) for x in eb] + [("edge_white", *sorted(x)) for x in ew]
    return frame(spark, rows, "kind string, a string, b string")


@query("bn_cpds", LG_ORDERS + ", g AS (SELECT avg(x) AS ax, var_samp(x) AS vx FROM o) SELECT 'x' AS node, round(ax, 4) AS b0, CAST(NULL AS DOUBLE) AS b1, round(vx / 1e6, 4) AS variance FROM g UNION ALL SELECT 'y', round(a, 4), round(b, 4), round(v / 1e6, 4) FROM f")
def bn_cpds(spark, sf):
    m = GaussianNetwork(["x", "y"], [("x", "y")]).fit(orders_xy(spark, sf))
    rows = [(n, round(float(c.beta[0]), 4), round(float(c.beta[1]), 4) if len(c.beta) > 1 else None, round(c.variance / 1e6, 4)) for n in m.nodes() for c in [m.cpd(n)]]
    return frame(spark, rows, "node string, b0 double, b1 double, variance double")


@query("conditional_bn_logl", f"{LG_ORDERS} SELECT o_orderkey, round({LOGL}, 6) AS logl FROM o, f")
def conditional_bn_logl(spark, sf):
    """Given x, a row's value is that of y alone."""
    d = orders_xy(spark, sf)
    m = GaussianNetwork(["x", "y"], [("x", "y")]).fit(d).conditional_bn(["y"], ["x"])
    return m.logl(d).select("o_orderkey", F.round("logl", 6).alias("logl"))


@query("dbn_nodes", "WITH v(v) AS (VALUES ('p'), ('q')), k(k) AS (VALUES (0), (1), (2)) SELECT v || '_t_' || k AS node, CASE WHEN k = 0 THEN 'transition' ELSE 'static' END AS part FROM v, k")
def dbn_nodes(spark, sf):
    m = DynamicGaussianNetwork(["p", "q"], 2)
    return frame(spark, [(n, "static") for n in m.static_bn().nodes()] + [(n, "transition") for n in m.transition_bn().nodes()], "node string, part string")


DBN = """WITH e AS (SELECT event_id, value AS y, lag(value) OVER (ORDER BY ts, event_id) AS x, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), s AS (SELECT avg(y) AS ay, var_samp(y) AS vy FROM e),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2) AS v, CAST(regr_count(y, x) AS BIGINT) AS n FROM e WHERE pos > 1)"""


def value_series(spark, sf) -> Dataset:
    return Dataset.of(table(spark, sf, "events"), columns=["value"], order_by=["ts", "event_id"])


@query("dbn_logl_rows", DBN + f" SELECT event_id, round(CASE WHEN pos = 1 THEN -0.5 * (y - ay) * (y - ay) / vy - 0.5 * ln(vy) - 0.5 * ln(2 * pi()) ELSE {LOGL} END, 6) AS logl FROM e, s, f")
def dbn_logl_rows(spark, sf):
    d = value_series(spark, sf)
    m = DynamicGaussianNetwork(["value"], 1)
    m.transition_bn().add_arc("value_t_1", "value_t_0")
    return m.fit(d).logl(d).select("event_id", F.round("logl", 6).alias("logl"))


@query("dbn_sample_shape", "SELECT CAST(500 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(499 AS BIGINT) AS last, CAST(0 AS BIGINT) AS nulls")
def dbn_sample_shape(spark, sf):
    m = DynamicGaussianNetwork(["value"], 1)
    m.transition_bn().add_arc("value_t_1", "value_t_0")
    s = m.fit(value_series(spark, sf)).sample(500, 1)
    return s.agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("value").isNull()).alias("nulls"))


# ---------------------------------------------------------------- scores


@query("dynamic_bic", DBN + " SELECT 'static' AS part, round((0.5 * (1 - count(*)) - 0.5 * count(*) * ln(2 * pi()) - 0.5 * count(*) * ln(var_samp(y)) - ln(count(*))) / count(*), 6) AS score FROM e UNION ALL SELECT 'transition', round((0.5 * (2 - n) - 0.5 * n * ln(2 * pi()) - 0.5 * n * ln(v) - 1.5 * ln(n)) / n, 6) FROM f")
def dynamic_bic(spark, sf):
    s = DynamicDataFrame(value_series(spark, sf), 1)
    b, m = DynamicBIC(s), DynamicGaussianNetwork(["value"], 1)
    m.transition_bn().add_arc("value_t_1", "value_t_0")
    n = table(spark, sf, "events").count()
    return frame(spark, [("static", round(b.static_score().local_score(m.static_bn(), "value_t_1") / n, 6)), ("transition", round(b.transition_score().local_score(m.transition_bn(), "value_t_0") / (n - 1), 6))], "part string, score double")


@query("bic_of_network", LG_ORDERS + ", g AS (SELECT var_samp(x) AS vx, count(*) AS n FROM o) SELECT round((0.5 * (1 - n) - 0.5 * n * ln(2 * pi()) - 0.5 * n * ln(vx) - ln(n) + 0.5 * (2 - n) - 0.5 * n * ln(2 * pi()) - 0.5 * n * ln(v) - 1.5 * ln(n)) / n, 6) AS score FROM f, g")
def bic_of_network(spark, sf):
    d = orders_xy(spark, sf)
    return one_row(spark, {"score": round(BIC(d).score(GaussianNetwork(["x", "y"], [("x", "y")])) / d.num_rows, 6)})


@query("validated_likelihood", f"""{SPLIT_ORDERS}, t AS (SELECT y, x, i, n, n - CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS tn FROM s),
tr AS (SELECT y, x, CAST(CASE WHEN i < (tn % 5) * (tn // 5 + 1) THEN i // (tn // 5 + 1) ELSE tn % 5 + (i - (tn % 5) * (tn // 5 + 1)) // (tn // 5) END AS INT) AS fold, tn FROM t WHERE i < tn),
f AS (SELECT k AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS v FROM tr, range(5) AS r(k) WHERE fold <> k GROUP BY 1),
h AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS v FROM tr)
SELECT 'train' AS part, round(avg({LOGL}), 6) AS score FROM tr JOIN f USING (fold) UNION ALL SELECT 'validation', round(avg({LOGL}), 6) FROM t, h WHERE i >= tn""")
def validated_likelihood(spark, sf):
    d = orders_xy(spark, sf)
    v, m = ValidatedLikelihood(d, 0.2, 5, 7, key=["o_orderkey"]), GaussianNetwork(["x", "y"], [("x", "y")])
    n = [v.training_data().num_rows, v.validation_data().num_rows]
    return frame(spark, [("train", round(v.local_score(m, "y") / n[0], 6)), ("validation", round(v.vlocal_score(m, "y") / n[1], 6))], "part string, score double")


# ---------------------------------------------------------------- mutual information

GROUPS = "WITH g AS (SELECT l_returnflag AS r, l_linestatus AS s, grouping(l_returnflag, l_linestatus) AS level, CAST(count(*) AS DOUBLE) AS n, var_samp(l_quantity) AS q, var_samp(l_extendedprice) AS p, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))), h AS (SELECT level, sum(n * ln(n)) AS nln, sum(n) AS t, sum(n * 0.5 * ln(q)) AS hq, sum(n * 0.5 * ln(p)) AS hp, sum(n * 0.5 * ln(q * p - c * c)) AS hqp FROM g GROUP BY 1), o AS (SELECT max(t) AS t, "
GROUPS += ", ".join(f"max({k}) FILTER (WHERE level = {v}) AS {k}{v}" for k in ("nln", "hq", "hp", "hqp") for v in range(4)) + " FROM h) "
CASES = [(FLAGS[0], FLAGS[1], [QTY]), (FLAGS[0], QTY, [PRICE]), (FLAGS[0], QTY, [FLAGS[1], PRICE]), (QTY, PRICE, [FLAGS[0]])]


@query("cmi_hybrid", GROUPS + f"""SELECT '{FLAGS[0]}' AS x, '{FLAGS[1]}' AS y, '{QTY}' AS z, round(greatest(0, (nln0 - nln1 - nln2 + nln3 - hq0 + hq1 + hq2 - hq3) / t) * 1e3, 4) AS mi FROM o
UNION ALL SELECT '{FLAGS[0]}', '{QTY}', '{PRICE}', round(greatest(0, (-hqp1 + hp1 + hqp3 - hp3) / t) * 1e3, 4) FROM o
UNION ALL SELECT '{FLAGS[0]}', '{QTY}', '{FLAGS[1]},{PRICE}', round(greatest(0, (-hqp0 + hp0 + hqp2 - hp2) / t) * 1e3, 4) FROM o
UNION ALL SELECT '{QTY}', '{PRICE}', '{FLAGS[0]}', round(greatest(0, (hq1 + hp1 - hqp1) / t) * 1e3, 4) FROM o""")
def cmi_hybrid(spark, sf):
    t = MutualInformation(lineitem(spark, sf, [QTY, PRICE, *FLAGS]))
    return frame(spark, [(x, y, ",".join(z), round(t.mi(x, y, z) * 1e3, 4)) for x, y, z in CASES], "x string, y string, z string, mi double")


@query("cmi_degrees", f"WITH k AS (SELECT count(DISTINCT l_returnflag) AS r, count(DISTINCT l_linestatus) AS s FROM lineitem) SELECT '{FLAGS[0]}' AS x, '{FLAGS[1]}' AS y, CAST((r - 1) * (s - 1) AS BIGINT) AS df FROM k UNION ALL SELECT '{FLAGS[0]}', '{QTY}', (r - 1) * 2 FROM k UNION ALL SELECT '{QTY}', '{PRICE}', 1 FROM k")
def cmi_degrees(spark, sf):
    t = MutualInformation(lineitem(spark, sf, [QTY, PRICE, *FLAGS]), asymptotic_df=True)
    return frame(spark, [(x, y, t.df(x, y)) for x, y in ((FLAGS[0], FLAGS[1]), (FLAGS[0], QTY), (QTY, PRICE))], "x string, y string, df long")


@query("gaussian_entropy", "SELECT round(1 + ln(2 * pi()) + 0.5 * ln(var_samp(l_quantity) * var_samp(l_extendedprice) - pow(covar_samp(l_quantity, l_extendedprice), 2)), 6) AS h FROM lineitem")
def entropy(spark, sf):
    return one_row(spark, {"h": round(float(gaussian_entropy(S.covariance(lineitem(spark, sf), QTY, PRICE))), 6)})


# ---------------------------------------------------------------- search and structure: x -> y -> z in a chain, w apart

CHAIN_SQL = "ch AS (SELECT l_quantity AS x, 2 * l_quantity + l_partkey * 37 % 101 AS y, 2 * l_quantity + l_partkey * 37 % 101 + l_suppkey * 53 % 97 AS z, CAST((l_orderkey * 7919 + l_linenumber * 104729) % 89 AS DOUBLE) AS w FROM lineitem)"
VARS = "xyzw"


def chain(spark, sf) -> Dataset:
    y = 2 * F.col(QTY) + F.col("l_partkey") * 37 % 101
    return Dataset.of(table(spark, sf, "lineitem").select(F.col(QTY).alias("x"), y.alias("y"), (y + F.col("l_suppkey") * 53 % 97).alias("z"), ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 89).cast("double").alias("w")))


CORR = "r0 AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM ch" for a in VARS for b in VARS if a != b) + ")"


@query("arc_operators", f"WITH {CHAIN_SQL}, {CORR} SELECT a, b, round(CASE WHEN r = 0 THEN 0 ELSE 0.5 - 0.5 * n * ln((1 - r * r) * (n - 1) / (n - 2)) - 0.5 * ln(n) END / n * 1e3, 4) AS delta FROM r0")
def arc_operators(spark, sf):
    """All single arcs from the empty network with what they add to BIC, in the order in which a search with a tabu list would meet them."""
    d = chain(spark, sf)
    m, score, ops, tabu = GaussianNetwork(list(VARS)), BIC(d), ArcOperatorSet(), OperatorTabuSet()
    ops.cache_scores(m, score)
    out = []
    while (op := ops.find_max(m, tabu)) is not None:
        out.append((op.source(), op.target(), round(op.delta() / d.num_rows * 1e3, 4)))
        tabu.insert(op)
    ops.finished()
    return frame(spark, out, "a string, b string, delta double")


#: A pair is linked if no set of the other variables makes its partial correlation insignificant at 5 percent (1.96 for many rows).
SKELETON = f"""WITH {CHAIN_SQL}, {CORR},
r1 AS (SELECT ab.a, ab.b, ac.b AS c, (ab.r - ac.r * bc.r) / sqrt((1 - ac.r * ac.r) * (1 - bc.r * bc.r)) AS r, ab.n FROM r0 ab JOIN r0 ac ON ac.a = ab.a AND ac.b <> ab.b JOIN r0 bc ON bc.a = ab.b AND bc.b = ac.b),
r2 AS (SELECT ab.a, ab.b, (ab.r - ad.r * bd.r) / sqrt((1 - ad.r * ad.r) * (1 - bd.r * bd.r)) AS r, ab.n FROM r1 ab JOIN r1 ad ON ad.a = ab.a AND ad.c = ab.c AND ad.b <> ab.b JOIN r1 bd ON bd.a = ab.b AND bd.c = ab.c AND bd.b = ad.b),
t AS (SELECT a, b, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM r0 UNION ALL SELECT a, b, abs(r) * sqrt((n - 3) / (1 - r * r)) FROM r1 UNION ALL SELECT a, b, abs(r) * sqrt((n - 4) / (1 - r * r)) FROM r2)
SELECT a, b FROM t WHERE a < b GROUP BY 1, 2 HAVING min(t) > 1.96"""


def skeleton(spark, g) -> DataFrame:
    return frame(spark, sorted({tuple(sorted(e)) for e in [*g.arcs(), *getattr(g, "edges", list)()]}), "a string, b string")


@query("pc_skeleton_chain", SKELETON)
def pc_skeleton_chain(spark, sf):
    return skeleton(spark, PC().estimate(LinearCorrelation(chain(spark, sf))))


@query("mmpc_skeleton_chain", SKELETON)
def mmpc_skeleton_chain(spark, sf):
    return skeleton(spark, MMPC().estimate(LinearCorrelation(chain(spark, sf))))


@query("hc_skeleton_chain", SKELETON)
def hc_skeleton_chain(spark, sf):
    return skeleton(spark, hc(chain(spark, sf), GaussianNetworkType()).graph())


@query("hc_bge_skeleton_chain", SKELETON)
def hc_bge_skeleton_chain(spark, sf):
    return skeleton(spark, hc(chain(spark, sf), GaussianNetworkType(), score="bge").graph())


@query("mmhc_skeleton_chain", SKELETON)
def mmhc_skeleton_chain(spark, sf):
    d = chain(spark, sf)
    return skeleton(spark, MMHC().estimate(LinearCorrelation(d), ArcOperatorSet(), BIC(d)).graph())


@query("hc_with_restrictions", "SELECT * FROM (VALUES ('w', 'x'), ('z', 'y')) AS t(a, b)")
def hc_with_restrictions(spark, sf):
    """A whitelisted arc without support stays, a blacklisted pair stays apart, one parent at most."""
    m = hc(chain(spark, sf), GaussianNetworkType(), arc_whitelist=[("w", "x"), ("z", "y")], arc_blacklist=[("x", "y"), ("y", "x"), ("x", "z"), ("z", "x")], max_indegree=1)
    return frame(spark, m.arcs(), "a string, b string")
