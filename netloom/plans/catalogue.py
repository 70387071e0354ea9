"""One query for each operator family over the driver's tables, with DuckDB SQL where SQL can express it. Queries run over whole
tables; floats are rounded so that both engines agree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import stats as S
from netloom.operators.factors import CKDE, CLinearGaussianCPD, DiscreteFactor, LinearGaussianCPD
from netloom.operators.graph import Dag, reachability
from netloom.operators.independence import ChiSquare, KMutualInformation, LinearCorrelation, MutualInformation, RCoT
from netloom.operators.kde import KDE, NormalReferenceRule, ProductKDE, ScottsBandwidth, UCVScorer
from netloom.operators.learn import DMMHC, MMHC, MMPC, PC, hc
from netloom.operators.models import CLGNetwork, DynamicGaussianNetwork, GaussianNetwork, GaussianNetworkType
from netloom.operators.scores import BDe, BGe, BIC, CVLikelihood, DynamicBIC, HoldoutLikelihood
from netloom.operators.search import ArcOperatorSet
from netloom.operators.split import CrossValidation, HoldOut
from netloom.operators.temporal import DynamicDataFrame
from netloom.sources.dataset import Dataset

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PRICE, QTY, DISC, TAX = "l_extendedprice", "l_quantity", "l_discount", "l_tax"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def lineitem(spark, sf, cols=(QTY, PRICE, DISC, TAX), discrete=None) -> Dataset:
    return Dataset.of(table(spark, sf, "lineitem"), discrete=discrete, columns=list(cols))


def one_row(spark: SparkSession, values: dict[str, float | int | str]) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# ---------------------------------------------------------------- linear-Gaussian


def lg_row(spark, sf, variable, evidence):
    f = LinearGaussianCPD(variable, evidence).fit(lineitem(spark, sf, [variable, *evidence]))
    return one_row(spark, {f"b{i}": round(float(b), 4) for i, b in enumerate(f.beta)} | {"variance": round(f.variance / 1e6, 4)})


@query("lg_fit_0p", "SELECT round(avg(l_extendedprice), 4) AS b0, round(var_samp(l_extendedprice) / 1e6, 4) AS variance FROM lineitem")
def lg_fit_0p(spark, sf):
    return lg_row(spark, sf, PRICE, [])


@query("lg_fit_1p", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS b0, round(regr_slope(l_extendedprice, l_quantity), 4) AS b1, round((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / 1e6, 4) AS variance FROM lineitem")
def lg_fit_1p(spark, sf):
    return lg_row(spark, sf, PRICE, [QTY])


TWO = """WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS ay, avg(l_quantity) AS a1, avg(l_discount) AS a2, var_samp(l_extendedprice) AS yy, var_samp(l_quantity) AS c11, var_samp(l_discount) AS c22,
covar_samp(l_quantity, l_discount) AS c12, covar_samp(l_extendedprice, l_quantity) AS y1, covar_samp(l_extendedprice, l_discount) AS y2 FROM lineitem),
b AS (SELECT *, (y1 * c22 - y2 * c12) / (c11 * c22 - c12 * c12) AS k1, (y2 * c11 - y1 * c12) / (c11 * c22 - c12 * c12) AS k2 FROM m)"""


@query("lg_fit_2p", TWO + " SELECT round(ay - k1 * a1 - k2 * a2, 4) AS b0, round(k1, 4) AS b1, round(k2, 4) AS b2, round((n - 1) * (yy - k1 * y1 - k2 * y2) / (n - 3) / 1e6, 4) AS variance FROM b")
def lg_fit_2p(spark, sf):
    return lg_row(spark, sf, PRICE, [QTY, DISC])


LG_ORDERS = """WITH o AS (SELECT o_orderkey, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x FROM orders), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS v FROM o)"""
LOGL = "-0.5 * (y - a - b * x) * (y - a - b * x) / v - 0.5 * ln(v) - 0.5 * ln(2 * pi())"


def orders_xy(spark, sf) -> Dataset:
    return Dataset.of(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x")), order_by=["o_orderkey"])


@query("lg_logl", f"{LG_ORDERS} SELECT o_orderkey, round({LOGL}, 6) AS logl FROM o, f")
def lg_logl(spark, sf):
    d = orders_xy(spark, sf)
    return LinearGaussianCPD("y", ["x"]).fit(d).logl(d).select("o_orderkey", F.round("logl", 6).alias("logl"))


@query("lg_slogl", f"{LG_ORDERS} SELECT round(avg({LOGL}), 6) AS mean_logl FROM o, f")
def lg_slogl(spark, sf):
    d = orders_xy(spark, sf)
    return one_row(spark, {"mean_logl": round(LinearGaussianCPD("y", ["x"]).fit(d).slogl(d) / d.num_rows, 6)})


@query("lg_logl_nulls", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS y, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS x FROM orders),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2) AS v FROM o) SELECT o_orderkey, round(""" + LOGL + ", 6) AS logl FROM o, f")
def lg_logl_nulls(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("y"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey").cast("double")).alias("x"))
    d = Dataset.of(df, order_by=["o_orderkey"])
    return LinearGaussianCPD("y", ["x"]).fit(d).logl(d).select("o_orderkey", F.round("logl", 6).alias("logl"))


# ---------------------------------------------------------------- moments and counts

NAMES = [QTY, PRICE, DISC, TAX]


def matrix_sql(expr: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({expr.format(a=a, b=b)}, 6) AS value FROM lineitem" for i, a in enumerate(NAMES) for b in NAMES[i:])


def matrix_frame(spark, m, scale=1.0):
    return spark.createDataFrame([(a, b, round(float(m[i, j]) * scale, 6)) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if j >= i], "a string, b string, value double")


@query("cov_matrix", matrix_sql("covar_samp({a}, {b}) / 1e3"))
def cov_matrix(spark, sf):
    return matrix_frame(spark, S.covariance(lineitem(spark, sf), *NAMES), 1e-3)


@query("sse_matrix", matrix_sql("covar_samp({a}, {b}) * (count(*) - 1) / 1e9"))
def sse_matrix(spark, sf):
    return matrix_frame(spark, S.sse(lineitem(spark, sf), *NAMES), 1e-9)


@query("column_means", " UNION ALL ".join(f"SELECT '{c}' AS a, round(avg({c}), 6) AS mean FROM lineitem" for c in NAMES))
def column_means(spark, sf):
    return spark.createDataFrame([(c, round(float(v), 6)) for c, v in zip(NAMES, S.means(lineitem(spark, sf), *NAMES), strict=True)], "a string, mean double")


@query("min_max", " UNION ALL ".join(f"SELECT '{c}' AS a, min({c}) AS low, max({c}) AS high FROM lineitem" for c in NAMES))
def min_max(spark, sf):
    return spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in S.min_max(lineitem(spark, sf), *NAMES).items()], "a string, low double, high double")


@query("normalize", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders")
def normalize(spark, sf):
    d = Dataset.of(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("z")), order_by=["o_orderkey"])
    return S.normalize(d).df.select("o_orderkey", F.round("z", 6).alias("z"))


@query("rank_transform", "SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS DOUBLE) AS r FROM events")
def rank_transform(spark, sf):
    d = Dataset.of(table(spark, sf, "events").select("event_id", F.col("value").alias("r")), order_by=["event_id"])
    return S.rank_data(d, ["event_id"]).df.select("event_id", "r")


@query("filter_null", "SELECT o_orderkey FROM orders WHERE o_orderkey % 17 <> 0 AND o_custkey % 11 <> 0")
def filter_null(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("y"), F.when(F.col("o_custkey") % 11 != 0, F.lit(1.0)).alias("x"))
    return Dataset.of(df, order_by=["o_orderkey"]).filter_null("x", "y").df.select("o_orderkey")


@query("valid_rows", "SELECT count(*) FILTER (WHERE o_orderkey % 17 <> 0 AND o_custkey % 11 <> 0) AS valid, count(*) FILTER (WHERE NOT (o_orderkey % 17 <> 0 AND o_custkey % 11 <> 0)) AS nulls FROM orders")
def valid_rows(spark, sf):
    df = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("y"), F.when(F.col("o_custkey") % 11 != 0, F.lit(1.0)).alias("x"))
    d = Dataset.of(df)
    return one_row(spark, {"valid": d.valid_rows("x", "y"), "nulls": d.null_count("x", "y")})


FLAGS = ["l_returnflag", "l_linestatus"]


@query("joint_counts", "SELECT a.v AS l_returnflag, b.v AS l_linestatus, count(l_returnflag) AS n FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus AS v FROM lineitem) b LEFT JOIN lineitem ON l_returnflag = a.v AND l_linestatus = b.v GROUP BY 1, 2")
def joint_counts(spark, sf):
    return S.joint_counts(lineitem(spark, sf, FLAGS), *FLAGS[:1], FLAGS[1:])


@query("marginal_counts", "SELECT l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def marginal_counts(spark, sf):
    return S.marginal_counts(S.joint_counts(lineitem(spark, sf, FLAGS), *FLAGS[:1], FLAGS[1:]), FLAGS[1:])


@query("count_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def count_cube(spark, sf):
    return S.count_cube(lineitem(spark, sf, FLAGS), FLAGS)


@query("configuration_index", "SELECT o_orderkey, CAST((CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) + 3 * (CAST(left(o_orderpriority, 1) AS INT) - 1) AS BIGINT) AS i FROM orders")
def configuration_index(spark, sf):
    d = Dataset.of(table(spark, sf, "orders"), columns=["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return d.df.select("o_orderkey", S.configuration_index(d, ["o_orderstatus", "o_orderpriority"]).alias("i"))


@query("grouped_moments", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def grouped_moments(spark, sf):
    d = lineitem(spark, sf, [QTY, FLAGS[0]])
    g = S.SuffStats(d).grouped(FLAGS[:1], [QTY])
    return spark.createDataFrame([(d.discrete[FLAGS[0]][k[0]], m.n, round(float(m.mean[0]), 6), round(float(m.cov[0, 0]), 6)) for k, m in g.items()], "l_returnflag string, n long, mean double, variance double")


# ---------------------------------------------------------------- discrete and conditional Gaussian

CPT = "SELECT l_returnflag, l_linestatus, ln(n) - ln(sum(n) OVER (PARTITION BY l_linestatus)) AS lp FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query("cpt_fit", f"SELECT l_returnflag, l_linestatus, round(exp(lp), 6) AS p FROM ({CPT})")
def cpt_fit(spark, sf):
    d = lineitem(spark, sf, FLAGS)
    f = DiscreteFactor(*FLAGS[:1], FLAGS[1:]).fit(d)
    return spark.createDataFrame([(v, e, round(math.exp(f.logprob[i, j]), 6)) for i, v in enumerate(d.discrete[FLAGS[0]]) for j, e in enumerate(d.discrete[FLAGS[1]]) if f.logprob[i, j] > -math.inf], "l_returnflag string, l_linestatus string, p double")


@query("cpt_logl", "SELECT o_orderkey, round(lp, 6) AS logl FROM orders JOIN (SELECT o_orderstatus, o_orderpriority, ln(n) - ln(sum(n) OVER (PARTITION BY o_orderpriority)) AS lp FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) USING (o_orderstatus, o_orderpriority)")
def cpt_logl(spark, sf):
    d = Dataset.of(table(spark, sf, "orders"), columns=["o_orderstatus", "o_orderpriority", "o_orderkey"])
    return DiscreteFactor("o_orderstatus", ["o_orderpriority"]).fit(d).logl(d).select("o_orderkey", F.round("logl", 6).alias("logl"))


@query("cpt_slogl", f"SELECT round(avg(lp), 6) AS mean_logl FROM lineitem JOIN ({CPT}) USING (l_returnflag, l_linestatus)")
def cpt_slogl(spark, sf):
    d = lineitem(spark, sf, FLAGS)
    return one_row(spark, {"mean_logl": round(DiscreteFactor(*FLAGS[:1], FLAGS[1:]).fit(d).slogl(d) / d.num_rows, 6)})


@query("cpt_unseen_uniform", "SELECT v AS l_returnflag, 'Z' AS l_linestatus, round(1.0 / count(*) OVER (), 6) AS p FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)")
def cpt_unseen_uniform(spark, sf):
    d = Dataset.of(table(spark, sf, "lineitem"), discrete={FLAGS[1]: ["F", "O", "Z"]}, columns=FLAGS)
    f = DiscreteFactor(*FLAGS[:1], FLAGS[1:]).fit(d)
    return spark.createDataFrame([(v, "Z", round(math.exp(f.logprob[i, 2]), 6)) for i, v in enumerate(d.discrete[FLAGS[0]])], "l_returnflag string, l_linestatus string, p double")


CLG = """WITH g AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
(regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) AS v, count(*) AS n FROM lineitem GROUP BY 1)"""


def clg(spark, sf):
    d = lineitem(spark, sf, [PRICE, QTY, FLAGS[0]])
    return d, CLinearGaussianCPD(PRICE, [QTY, FLAGS[0]]).fit(d)


@query("clg_fit", CLG + " SELECT l_returnflag, round(a, 4) AS b0, round(b, 4) AS b1, round(v / 1e6, 4) AS variance FROM g")
def clg_fit(spark, sf):
    d, f = clg(spark, sf)
    return spark.createDataFrame([(d.discrete[FLAGS[0]][k[0]], round(float(x.beta[0]), 4), round(float(x.beta[1]), 4), round(x.variance / 1e6, 4)) for k, x in f.factors.items()], "l_returnflag string, b0 double, b1 double, variance double")


@query("clg_logl", CLG + " SELECT l_returnflag, round(avg(-0.5 * pow(l_extendedprice - a - b * l_quantity, 2) / v - 0.5 * ln(v) - 0.5 * ln(2 * pi())), 6) AS mean_logl FROM lineitem JOIN g USING (l_returnflag) GROUP BY 1")
def clg_logl(spark, sf):
    d, f = clg(spark, sf)
    return f.logl(d).groupBy(FLAGS[0]).agg(F.round(F.avg("logl"), 6).alias("mean_logl"))


# ---------------------------------------------------------------- splits and time

SHUFFLED = "SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders"
FOLD = "CAST(CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INT)"


def order_rows(spark, sf) -> Dataset:
    return Dataset.of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), order_by=["o_orderkey"])


@query("kfold_assign", f"SELECT o_orderkey, {FOLD} AS fold FROM ({SHUFFLED})")
def kfold_assign(spark, sf):
    return CrossValidation(order_rows(spark, sf), 10, 7).frame().select("o_orderkey", "fold")


@query("kfold_sizes", f"SELECT {FOLD} AS fold, count(*) AS n FROM ({SHUFFLED}) GROUP BY 1")
def kfold_sizes(spark, sf):
    return CrossValidation(order_rows(spark, sf), 10, 7).frame().groupBy("fold").agg(F.count("*").alias("n"))


@query("kfold_disjoint", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS shared FROM orders")
def kfold_disjoint(spark, sf):
    train, test = CrossValidation(order_rows(spark, sf), 10, 7).fold(3)
    both = train.df.select("o_orderkey").join(test.df.select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count("*").alias("shared"))
    return train.df.unionByName(test.df).agg(F.count("*").alias("n")).join(both)


@query("holdout_split", f"SELECT o_orderkey, i >= n - CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS is_test FROM ({SHUFFLED})")
def holdout_split(spark, sf):
    return HoldOut(order_rows(spark, sf), 0.2, 7).frame().select("o_orderkey", "is_test")


def event_slices(spark, sf, m=2) -> DynamicDataFrame:
    return DynamicDataFrame(Dataset.of(table(spark, sf, "events"), columns=["value", "event_type"], order_by=["ts", "event_id"]), m)


def lag_sql(shifts: dict[int, int], first: int) -> str:
    cols = ", ".join(f"lag({v}, {s}) OVER w AS {v}_t_{k}" for k, s in shifts.items() for v in ("value", "event_type"))
    keep = ", ".join(f"{v}_t_{k}" for k in shifts for v in ("value", "event_type"))
    return f"SELECT event_id, {keep} FROM (SELECT event_id, {cols}, row_number() OVER w AS pos FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE pos > {first}"


@query("temporal_slices", lag_sql({1: 1}, 2))
def temporal_slices(spark, sf):
    return event_slices(spark, sf).temporal_slice(1).df.drop("ts")


@query("static_df", lag_sql({1: 0, 2: 1}, 1))
def static_df(spark, sf):
    return event_slices(spark, sf).static_df().df.drop("ts")


@query("transition_df", lag_sql({0: 0, 1: 1, 2: 2}, 2))
def transition_df(spark, sf):
    return event_slices(spark, sf).transition_df().df.drop("ts")


# ---------------------------------------------------------------- scores


def score_row(spark, d: Dataset, value: float):
    return one_row(spark, {"score": round(value / d.num_rows, 6)})


@query("bic_lg", TWO + " SELECT round((0.5 * (3 - n) - 0.5 * n * ln(2 * pi()) - 0.5 * n * ln((n - 1) * (yy - k1 * y1 - k2 * y2) / (n - 3)) - 0.5 * ln(n) * 4) / n, 6) AS score FROM b")
def bic_lg(spark, sf):
    d = lineitem(spark, sf)
    m = GaussianNetwork([QTY, PRICE, DISC, TAX], [(QTY, PRICE), (DISC, PRICE)])
    return score_row(spark, d, BIC(d).local_score(m, PRICE))


@query("bic_discrete", f"SELECT round(avg(lp) - 0.5 * ln(count(*)) * (3 - 1) * 2 / count(*), 6) AS score FROM lineitem JOIN ({CPT}) USING (l_returnflag, l_linestatus)")
def bic_discrete(spark, sf):
    d = lineitem(spark, sf, FLAGS)
    return score_row(spark, d, BIC(d).discrete(FLAGS[0], FLAGS[1:]))


@query("bic_clg", CLG + " SELECT round((sum(0.5 * (2 - n) - 0.5 * n * ln(2 * pi()) - 0.5 * n * ln(v)) - 0.5 * ln(sum(n)) * count(*) * 3) / sum(n), 6) AS score FROM g")
def bic_clg(spark, sf):
    d = lineitem(spark, sf, [PRICE, QTY, FLAGS[0]])
    return score_row(spark, d, BIC(d).local_score(CLGNetwork([PRICE, QTY, FLAGS[0]], [(QTY, PRICE), (FLAGS[0], PRICE)]), PRICE))


@query("bde", """WITH c AS (SELECT a.v AS x, b.v AS z, count(l_returnflag) AS n FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus AS v FROM lineitem) b LEFT JOIN lineitem ON l_returnflag = a.v AND l_linestatus = b.v GROUP BY 1, 2),
k AS (SELECT 1.0 / count(*) AS alpha, count(*) AS cells, count(DISTINCT x) AS r, sum(n) AS total FROM c), p AS (SELECT z, sum(n) AS m FROM c GROUP BY 1)
SELECT round((-cells * lgamma(alpha) + (SELECT sum(lgamma(n + (SELECT alpha FROM k))) FROM c) + (SELECT sum(lgamma((SELECT r * alpha FROM k)) - lgamma((SELECT r * alpha FROM k) + m)) FROM p)) / total, 6) AS score FROM k""")
def bde(spark, sf):
    d = lineitem(spark, sf, FLAGS)
    return score_row(spark, d, BDe(d).of(FLAGS[0], FLAGS[1:]))


@query("bge_0p", """WITH m AS (SELECT count(*) AS n, (count(*) - 1) * var_samp(l_quantity) AS sse FROM lineitem), k AS (SELECT *, 1.0 * (6 - 4 - 1) / 2 AS t, 6 - 4 + 1 AS w FROM m)
SELECT round((0.5 * (0 - ln(n + 1)) + lgamma(0.5 * (n + w)) - lgamma(0.5 * w) - 0.5 * n * ln(pi()) + 0.5 * w * ln(t) - 0.5 * (n + w) * ln(t + sse)) / n, 6) AS score FROM k""")
def bge_0p(spark, sf):
    d = lineitem(spark, sf)
    return score_row(spark, d, BGe(d).of(QTY, [], 4))


@query("bge_1p", """WITH m AS (SELECT count(*) AS n, (count(*) - 1) * var_samp(l_extendedprice) AS yy, (count(*) - 1) * var_samp(l_quantity) AS xx, (count(*) - 1) * covar_samp(l_extendedprice, l_quantity) AS xy FROM lineitem), k AS (SELECT *, 1.0 * (6 - 4 - 1) / 2 AS t, 6 - 4 AS w FROM m)
SELECT round((0.5 * (0 - ln(n + 1)) + lgamma(0.5 * (n + w + 2)) - lgamma(0.5 * (w + 2)) - 0.5 * n * ln(pi()) + 0.5 * (w + 3) * ln(t) - 0.5 * (n + w + 2) * ln((t + yy) * (t + xx) - xy * xy) + 0.5 * (n + w + 1) * ln(t + xx)) / n, 6) AS score FROM k""")
def bge_1p(spark, sf):
    d = lineitem(spark, sf)
    return score_row(spark, d, BGe(d).of(PRICE, [QTY], 4))


SPLIT_ORDERS = "WITH s AS (" + SHUFFLED.replace("SELECT o_orderkey,", "SELECT o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x,") + ")"


@query("cv_likelihood_lg", f"{SPLIT_ORDERS}, t AS (SELECT y, x, {FOLD} AS fold FROM s), f AS (SELECT k AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS v FROM t, range(10) AS r(k) WHERE fold <> k GROUP BY 1) SELECT round(avg({LOGL}), 6) AS score FROM t JOIN f USING (fold)")
def cv_likelihood_lg(spark, sf):
    d = orders_xy(spark, sf)
    return score_row(spark, d, CVLikelihood(d, 10, 7, key=["o_orderkey"]).local_score(GaussianNetwork(["x", "y"], [("x", "y")]), "y"))


@query("holdout_likelihood_lg", f"{SPLIT_ORDERS}, t AS (SELECT y, x, i >= n - CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS test FROM s), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS v FROM t WHERE NOT test) SELECT round(sum({LOGL}) / (SELECT count(*) FROM t), 6) AS score FROM t, f WHERE test")
def holdout_likelihood_lg(spark, sf):
    d = orders_xy(spark, sf)
    return score_row(spark, d, HoldoutLikelihood(d, 0.2, 7, key=["o_orderkey"]).local_score(GaussianNetwork(["x", "y"], [("x", "y")]), "y"))


# ---------------------------------------------------------------- independence


@query("corr_t_stat", "SELECT round(r, 6) AS r, round(r * sqrt(n - 2) / sqrt(1 - r * r), 4) AS t, n - 2 AS df FROM (SELECT corr(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem)")
def corr_t_stat(spark, sf):
    r, df = LinearCorrelation(lineitem(spark, sf)).correlation(PRICE, QTY)
    return one_row(spark, {"r": round(r, 6), "t": round(r * math.sqrt(df) / math.sqrt(1 - r * r), 4), "df": df})


@query("partial_corr_1z", "SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS r, n - 3 AS df FROM (SELECT corr(l_extendedprice, l_quantity) AS ab, corr(l_extendedprice, l_discount) AS ac, corr(l_quantity, l_discount) AS bc, count(*) AS n FROM lineitem)")
def partial_corr_1z(spark, sf):
    r, df = LinearCorrelation(lineitem(spark, sf)).correlation(PRICE, QTY, DISC)
    return one_row(spark, {"r": round(r, 6), "df": df})


CHI = "WITH c AS (SELECT {x} AS x, {y} AS y, {z} AS z, count(*) AS n FROM {t} GROUP BY 1, 2, 3), g AS (SELECT a.x, b.y, d.z, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT x FROM c) a CROSS JOIN (SELECT DISTINCT y FROM c) b CROSS JOIN (SELECT DISTINCT z FROM c) d LEFT JOIN c ON c.x = a.x AND c.y = b.y AND c.z = d.z), e AS (SELECT *, sum(n) OVER (PARTITION BY x, z) * sum(n) OVER (PARTITION BY y, z) / sum(n) OVER (PARTITION BY z) AS e FROM g), s AS (SELECT sum(CASE WHEN e > 0 THEN (n - e) * (n - e) / e ELSE 0 END) AS stat, CAST((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) * count(DISTINCT z) AS BIGINT) AS df FROM e)"


@query("chi2_stat", CHI.format(x="l_returnflag", y="l_linestatus", z="1", t="lineitem") + " SELECT round(stat, 5) AS stat, df FROM s")
def chi2_stat(spark, sf):
    s, df = ChiSquare(lineitem(spark, sf, FLAGS)).statistic(*FLAGS)
    return one_row(spark, {"stat": round(s, 5), "df": df})


@query("chi2_cond_stat", CHI.format(x="o_orderstatus", y="o_orderpriority", z="o_custkey % 4", t="orders") + " SELECT round(stat, 5) AS stat, df FROM s")
def chi2_cond_stat(spark, sf):
    d = Dataset.of(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 4).cast("string").alias("z")))
    s, df = ChiSquare(d).statistic("o_orderstatus", "o_orderpriority", "z")
    return one_row(spark, {"stat": round(s, 5), "df": df})


@query("chi2_pvalue_df2", CHI.format(x="l_returnflag", y="l_linestatus", z="1", t="lineitem") + " SELECT round(exp(-stat / 2), 6) AS p FROM s WHERE df = 2")
def chi2_pvalue_df2(spark, sf):
    return one_row(spark, {"p": round(ChiSquare(lineitem(spark, sf, FLAGS)).pvalue(*FLAGS), 6)})


@query("mi_dd", "WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2) SELECT round(sum(n / t * ln(n * t / (a * b))) * 1e6, 4) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS a, sum(n) OVER (PARTITION BY y) AS b FROM c)")
def mi_dd(spark, sf):
    return one_row(spark, {"mi": round(MutualInformation(lineitem(spark, sf, FLAGS)).mi(*FLAGS) * 1e6, 4)})


@query("mi_dc", "SELECT round(greatest(0, 0.5 * ln(v) - sum(n / t * 0.5 * ln(u))) * 1e6, 2) AS mi FROM (SELECT var_samp(l_quantity) AS v, CAST(count(*) AS DOUBLE) AS t FROM lineitem), (SELECT l_returnflag, count(*) AS n, var_samp(l_quantity) AS u FROM lineitem GROUP BY 1) GROUP BY v")
def mi_dc(spark, sf):
    return one_row(spark, {"mi": round(MutualInformation(lineitem(spark, sf, [QTY, FLAGS[0]])).mi(FLAGS[0], QTY) * 1e6, 2)})


@query("mi_cc", "SELECT round(-0.5 * ln(1 - pow(corr(l_extendedprice, l_quantity), 2)) * 1e6, 2) AS mi FROM lineitem")
def mi_cc(spark, sf):
    return one_row(spark, {"mi": round(MutualInformation(lineitem(spark, sf, [QTY, PRICE])).mi(PRICE, QTY) * 1e6, 2)})


@query("cmi_ddd", "WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, o_custkey % 4 AS z, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2, 3) SELECT round(sum(n / t * ln(n * k / (a * b))) * 1e6, 3) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY z) AS k, sum(n) OVER (PARTITION BY x, z) AS a, sum(n) OVER (PARTITION BY y, z) AS b FROM c)")
def cmi_ddd(spark, sf):
    d = Dataset.of(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 4).cast("string").alias("z")))
    return one_row(spark, {"mi": round(MutualInformation(d).mi("o_orderstatus", "o_orderpriority", "z") * 1e6, 3)})


@query("cmi_hybrid_pvalues")
def cmi_hybrid_pvalues(spark, sf):
    t = MutualInformation(lineitem(spark, sf, [QTY, PRICE, *FLAGS]))
    cases = [(FLAGS[0], FLAGS[1], [QTY]), (FLAGS[0], QTY, [PRICE]), (FLAGS[0], QTY, [FLAGS[1], PRICE]), (QTY, PRICE, [FLAGS[0]])]
    return spark.createDataFrame([(x, y, ",".join(z), t.df(x, y, z), round(t.pvalue(x, y, z), 6)) for x, y, z in cases], "x string, y string, z string, df long, p double")


@query("cmiknn_pvalue")
def cmiknn_pvalue(spark, sf):
    """The method is quadratic; it runs over the whole supplier table, with the default of 1,000 permutations."""
    df = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("a"), F.col("s_suppkey").cast("double").alias("b"), F.col("s_nationkey").cast("double").alias("c"))
    t = KMutualInformation(Dataset.of(df), 5, 1, 5, 1000)
    return spark.createDataFrame([("a,b", t.pvalue("a", "b")), ("a,b|c", t.pvalue("a", "b", "c"))], "test string, p double")


@query("rcot_pvalue")
def rcot_pvalue(spark, sf):
    t = RCoT(lineitem(spark, sf), seed=1)
    return spark.createDataFrame([("marginal", t.pvalue(PRICE, QTY)), ("conditional", t.pvalue(PRICE, QTY, [DISC, TAX]))], "test string, p double")


# ---------------------------------------------------------------- densities (training: the whole supplier table; scored rows: the whole customer table)

KDE1 = "WITH s AS (SELECT s_acctbal AS x FROM supplier), h AS (SELECT sqrt(pow(4.0 / (3.0 * count(*)), 0.4) * var_samp(x)) AS h, count(*) AS n FROM s), k AS (SELECT c_custkey, -0.5 * pow((c_acctbal - x) / h, 2) AS e, h, n FROM customer, s, h)"


def suppliers(spark, sf) -> Dataset:
    return Dataset.of(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y")))


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 997).cast("double").alias("y"))


@query("kde_logl_1d", KDE1 + " SELECT c_custkey, round(max(e) + ln(sum(exp(e - m))) - ln(any_value(n)) - ln(any_value(h)) - 0.5 * ln(2 * pi()), 6) AS logl FROM (SELECT *, max(e) OVER (PARTITION BY c_custkey) AS m FROM k) GROUP BY 1")
def kde_logl_1d(spark, sf):
    return KDE(["x"]).fit(suppliers(spark, sf)).logl(customers(spark, sf)).select("c_custkey", F.round("logl", 6).alias("logl"))


KDE2 = """WITH s AS (SELECT s_acctbal AS x, CAST(s_suppkey AS DOUBLE) AS y FROM supplier), h AS (SELECT pow(count(*), -1.0 / 3) AS f, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, count(*) AS n FROM s),
g AS (SELECT f * a AS a, f * b AS b, f * c AS c, f * f * (a * c - b * b) AS d, n FROM h), q AS (SELECT c_custkey, c_acctbal - x AS dx, c_custkey % 997 - y AS dy, a, b, c, d, n FROM customer, s, g),"""
LSE = "SELECT *, max(e) OVER (PARTITION BY c_custkey) AS m FROM k"


@query("kde_logl_2d", KDE2 + f" k AS (SELECT c_custkey, -0.5 * (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / d AS e, d, n FROM q) SELECT c_custkey, round(max(e) + ln(sum(exp(e - m))) - ln(any_value(n)) - 0.5 * ln(any_value(d)) - ln(2 * pi()), 6) AS logl FROM ({LSE}) GROUP BY 1")
def kde_logl_2d(spark, sf):
    return KDE(["x", "y"]).fit(suppliers(spark, sf)).logl(customers(spark, sf)).select("c_custkey", F.round("logl", 6).alias("logl"))


@query("product_kde_logl", KDE2 + f" k AS (SELECT c_custkey, -0.5 * (dx * dx / a + dy * dy / c) AS e, a * c AS d, n FROM q) SELECT c_custkey, round(max(e) + ln(sum(exp(e - m))) - ln(any_value(n)) - 0.5 * ln(any_value(d)) - ln(2 * pi()), 6) AS logl FROM ({LSE}) GROUP BY 1")
def product_kde_logl(spark, sf):
    return ProductKDE(["x", "y"], ScottsBandwidth()).fit(suppliers(spark, sf)).logl(customers(spark, sf)).select("c_custkey", F.round("logl", 6).alias("logl"))


@query("ckde_logl", KDE2 + " k AS (SELECT c_custkey, -0.5 * (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / d AS e, -0.5 * dy * dy / c AS u, d, c, n FROM q) SELECT c_custkey, round(max(e) + ln(sum(exp(e - m))) - 0.5 * ln(any_value(d)) - (max(u) + ln(sum(exp(u - mu))) - 0.5 * ln(any_value(c))) - 0.5 * ln(2 * pi()), 6) AS logl FROM (SELECT *, max(e) OVER (PARTITION BY c_custkey) AS m, max(u) OVER (PARTITION BY c_custkey) AS mu FROM k) GROUP BY 1")
def ckde_logl(spark, sf):
    return CKDE("x", ["y"]).fit(suppliers(spark, sf)).logl(customers(spark, sf)).select("c_custkey", F.round("logl", 6).alias("logl"))


@query("nr_bandwidth", "SELECT round(pow(4.0 / (count(*) * 4), 1.0 / 3) * var_samp(l_quantity), 6) AS h00, round(pow(4.0 / (count(*) * 4), 1.0 / 3) * covar_samp(l_quantity, l_extendedprice), 4) AS h01, round(pow(4.0 / (count(*) * 4), 1.0 / 3) * var_samp(l_extendedprice) / 1e6, 6) AS h11 FROM lineitem")
def nr_bandwidth(spark, sf):
    h = NormalReferenceRule().bandwidth(lineitem(spark, sf), [QTY, PRICE])
    return one_row(spark, {"h00": round(float(h[0, 0]), 6), "h01": round(float(h[0, 1]), 4), "h11": round(float(h[1, 1]) / 1e6, 6)})


@query("scott_bandwidth", "SELECT round(pow(count(*), -1.0 / 3) * var_samp(l_quantity), 6) AS h0, round(pow(count(*), -1.0 / 3) * var_samp(l_extendedprice) / 1e6, 6) AS h1 FROM lineitem")
def scott_bandwidth(spark, sf):
    h = ScottsBandwidth().diag_bandwidth(lineitem(spark, sf), [QTY, PRICE])
    return one_row(spark, {"h0": round(float(h[0]), 6), "h1": round(float(h[1]) / 1e6, 6)})


@query("ucv_score", "WITH s AS (SELECT s_suppkey AS i, s_acctbal AS x FROM supplier), h AS (SELECT pow(4.0 / (3.0 * count(*)), 0.4) * var_samp(x) AS v, count(*) AS n FROM s), p AS (SELECT sum(exp(-0.25 * (a.x - b.x) * (a.x - b.x) / v)) AS s2, sum(exp(-0.5 * (a.x - b.x) * (a.x - b.x) / v)) AS s1 FROM s a JOIN s b ON a.i < b.i, h) SELECT round((1 / sqrt(4 * pi() * v) + 2 * s2 / sqrt(4 * pi() * v) / n - 4 * s1 / sqrt(2 * pi() * v) / (n - 1)) * 1e6, 4) AS ucv FROM h, p")
def ucv_score(spark, sf):
    d = suppliers(spark, sf)
    h = NormalReferenceRule().bandwidth(d, ["x"])[0]
    return one_row(spark, {"ucv": round(UCVScorer(d, ["x"]).score_diagonal(h) * 1e6, 4)})


# ---------------------------------------------------------------- models


@query("bn_slogl", LG_ORDERS + f", g AS (SELECT avg(x) AS ax, var_samp(x) AS vx FROM o) SELECT round(avg({LOGL} - 0.5 * (x - ax) * (x - ax) / vx - 0.5 * ln(vx) - 0.5 * ln(2 * pi())), 6) AS mean_logl FROM o, f, g")
def bn_slogl(spark, sf):
    d = orders_xy(spark, sf)
    m = GaussianNetwork(["x", "y"], [("x", "y")]).fit(d)
    return one_row(spark, {"mean_logl": round(m.slogl(d) / d.num_rows, 6)})


@query("bn_logl_rows", LG_ORDERS + f", g AS (SELECT avg(x) AS ax, var_samp(x) AS vx FROM o) SELECT o_orderkey, round({LOGL} - 0.5 * (x - ax) * (x - ax) / vx - 0.5 * ln(vx) - 0.5 * ln(2 * pi()), 6) AS logl FROM o, f, g")
def bn_logl_rows(spark, sf):
    d = orders_xy(spark, sf)
    return GaussianNetwork(["x", "y"], [("x", "y")]).fit(d).logl(d).select("o_orderkey", F.round("logl", 6).alias("logl"))


@query("dbn_slogl", """WITH e AS (SELECT value AS y, lag(value) OVER (ORDER BY ts, event_id) AS x, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), s AS (SELECT avg(y) AS ay, var_samp(y) AS vy FROM e),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2) AS v FROM e WHERE pos > 1)
SELECT round(avg(CASE WHEN pos = 1 THEN -0.5 * (y - ay) * (y - ay) / vy - 0.5 * ln(vy) - 0.5 * ln(2 * pi()) ELSE """ + LOGL + " END), 6) AS mean_logl FROM e, s, f")
def dbn_slogl(spark, sf):
    d = Dataset.of(table(spark, sf, "events"), columns=["value"], order_by=["ts", "event_id"])
    m = DynamicGaussianNetwork(["value"], 1)
    m.transition_bn().add_arc("value_t_1", "value_t_0")
    m.fit(d)
    return one_row(spark, {"mean_logl": round(m.slogl(d) / d.num_rows, 6)})


@query("sample_bn")
def sample_bn(spark, sf):
    d = orders_xy(spark, sf)
    return GaussianNetwork(["x", "y"], [("x", "y")]).fit(d).sample(d.num_rows, 3, ordered=True)


@query("dbn_sample")
def dbn_sample(spark, sf):
    d = Dataset.of(table(spark, sf, "events"), columns=["value"], order_by=["ts", "event_id"])
    m = DynamicGaussianNetwork(["value"], 1)
    m.transition_bn().add_arc("value_t_1", "value_t_0")
    return m.fit(d).sample(500, 1)


ARCS = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("f", "g")]
ARC_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in ARCS)


@query("graph_roots_leaves", f"WITH arcs(src, dst) AS (VALUES {ARC_ROWS}) SELECT DISTINCT src AS node, 'root' AS role FROM arcs WHERE src NOT IN (SELECT dst FROM arcs) UNION SELECT DISTINCT dst, 'leaf' FROM arcs WHERE dst NOT IN (SELECT src FROM arcs)")
def graph_roots_leaves(spark, sf):
    g = Dag(arcs=ARCS)
    return spark.createDataFrame([(n, "root") for n in g.roots()] + [(n, "leaf") for n in g.leaves()], "node string, role string")


@query("graph_reachability", f"WITH RECURSIVE arcs(src, dst) AS (VALUES {ARC_ROWS}), r(src, dst) AS (SELECT * FROM arcs UNION SELECT r.src, a.dst FROM r JOIN arcs a ON r.dst = a.src) SELECT src, dst FROM r")
def graph_reachability(spark, sf):
    return reachability(Dag(arcs=ARCS).arcs_frame(spark))


# ---------------------------------------------------------------- structure learning


def arcs_of(spark, g) -> DataFrame:
    return spark.createDataFrame([(a, b, "arc") for a, b in g.arcs()] + [(a, b, "edge") for a, b in getattr(g, "edges", list)()], "src string, dst string, kind string")


def linked(spark, sf) -> Dataset:
    """Columns with known dependences over all line items: price follows quantity and part, charge follows price, discount and tax."""
    li = table(spark, sf, "lineitem").select(F.col(QTY).alias("q"), (F.col(QTY) * 3 + F.col(DISC) * 100).alias("p"), (F.col(QTY) * 3 + F.col(DISC) * 200 + F.col(TAX) * 50).alias("c"), F.col(TAX).alias("t"))
    return Dataset.of(li)


@query("hc_gaussian_arcs")
def hc_gaussian_arcs(spark, sf):
    return arcs_of(spark, hc(lineitem(spark, sf), GaussianNetworkType()).graph())


@query("hc_linked_arcs")
def hc_linked_arcs(spark, sf):
    return arcs_of(spark, hc(linked(spark, sf), GaussianNetworkType(), score="bge").graph())


@query("pc_skeleton")
def pc_skeleton(spark, sf):
    return arcs_of(spark, PC().estimate(LinearCorrelation(linked(spark, sf))))


@query("mmpc_cpcs")
def mmpc_cpcs(spark, sf):
    return arcs_of(spark, MMPC().estimate(LinearCorrelation(linked(spark, sf))))


@query("mmhc_arcs")
def mmhc_arcs(spark, sf):
    d = linked(spark, sf)
    return arcs_of(spark, MMHC().estimate(LinearCorrelation(d), ArcOperatorSet(), BIC(d)).graph())


@query("dmmhc_arcs")
def dmmhc_arcs(spark, sf):
    from netloom.operators.independence import DynamicLinearCorrelation

    s = DynamicDataFrame(Dataset.of(table(spark, sf, "events").select("ts", "event_id", "value", (F.col("value") + F.col("user_id") % 7).alias("v")), order_by=["ts", "event_id"]), 1)
    m = DMMHC().estimate(DynamicLinearCorrelation(s), ArcOperatorSet(), DynamicBIC(s))
    return arcs_of(spark, m.static_bn().graph()).unionByName(arcs_of(spark, m.transition_bn().graph()))

