"""Sufficient statistics: moments, grouped moments and contingency counts, batched into as few jobs as there are null patterns."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampType

from netloom.functions.special import TOL
from netloom.sources.dataset import Dataset

#: Aggregate expressions of one job; cells of a count table that is collected whole.
MAX_EXPRESSIONS, MAX_CELLS = 600, 1_000_000


def col(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


@dataclass
class Moments:
    """Rows, means and centred cross-products (SSE) of an ordered set of columns."""

    cols: list[str]
    n: int
    mean: np.ndarray
    sse: np.ndarray

    @property
    def cov(self) -> np.ndarray:
        return self.sse / (self.n - 1) if self.n > 1 else np.full_like(self.sse, math.nan)

    def take(self, cols: Sequence[str]) -> Moments:
        i = [self.cols.index(c) for c in cols]
        return Moments(list(cols), self.n, self.mean[i], self.sse[np.ix_(i, i)])

    def __add__(self, other: Moments) -> Moments:
        """Pooled rows; the pairwise update avoids cancellation."""
        if not other.n or not self.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(self.cols, n, self.mean + d * other.n / n, self.sse + other.sse + np.outer(d, d) * self.n * other.n / n)

    @classmethod
    def empty(cls, cols: Sequence[str]) -> Moments:
        return cls(list(cols), 0, np.zeros(len(cols)), np.zeros((len(cols), len(cols))))


def moment_columns(cols: Sequence[str], tag: str = "m", when: Column | None = None) -> list[Column]:
    """Count, means and upper co-moments (times n - 1 later) of rows that are valid in all of `cols`."""
    ok = Dataset.valid(cols) if when is None else Dataset.valid(cols) & when
    v = {c: F.when(ok, col(c)) for c in cols}
    out = [F.count_if(ok).alias(f"{tag}_n")] + [F.avg(v[c]).alias(f"{tag}_a{i}") for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        out += [(F.var_samp(v[a]) if i == j else F.covar_samp(v[a], v[b])).alias(f"{tag}_c{i}_{j}") for j, b in enumerate(cols) if j >= i]
    return out


def moments_from(row, cols: Sequence[str], tag: str = "m") -> Moments:
    n, d = int(row[f"{tag}_n"]), len(cols)
    mean = np.array([row[f"{tag}_a{i}"] if n else 0.0 for i in range(d)], float)
    sse = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            x = row[f"{tag}_c{i}_{j}"]
            sse[i, j] = sse[j, i] = (n - 1) * x if n > 1 and x is not None else 0.0
    return Moments(list(cols), n, mean, sse)


class SuffStats:
    """What a dataset has told so far, by column set. Without nulls one job over all columns answers everything of its kind."""

    def __init__(self, data: Dataset):
        self.data = data
        self._moments: dict[tuple[str, ...], Moments] = {}
        self._counts: dict[tuple[str, ...], np.ndarray] = {}
        self._grouped: dict[tuple, dict[tuple[str, ...], Moments]] = {}
        self.jobs = 0

    # ---- moments
    def prefetch(self, sets: Iterable[Sequence[str]]) -> None:
        """Moments of several column sets, in one job for each MAX_EXPRESSIONS aggregates."""
        todo = {tuple(sorted(s)) for s in sets if s}
        if self.data.null_free(self.data.continuous) and todo:
            todo = {tuple(sorted(self.data.continuous))}
        todo = sorted(todo - set(self._moments))
        while todo:
            take, size = [], 0
            while todo and (not take or size + (k := len(todo[0]) * (len(todo[0]) + 3) // 2 + 1) <= MAX_EXPRESSIONS):
                size += len(todo[0]) * (len(todo[0]) + 3) // 2 + 1
                take.append(todo.pop(0))
            cols = [c for i, s in enumerate(take) for c in moment_columns(s, f"s{i}")]
            row = self.data.df.agg(*cols).first()
            self.jobs += 1
            for i, s in enumerate(take):
                self._moments[s] = moments_from(row, s, f"s{i}")

    def moments(self, cols: Sequence[str]) -> Moments:
        key = tuple(sorted(cols))
        if key not in self._moments:
            whole = tuple(sorted(self.data.continuous))
            if not (set(key) <= set(whole) and whole in self._moments and self.data.null_free(self.data.continuous)):
                self.prefetch([key])
            if key not in self._moments:
                self._moments[key] = self._moments[whole].take(key)
        return self._moments[key].take(cols)

    # ---- counts
    def counts(self, cols: Sequence[str]) -> np.ndarray:
        """Dense contingency table over the domains, in the order of `cols`; zero cells are there."""
        key = tuple(sorted(cols))
        if key not in self._counts:
            every = tuple(sorted(self.data.discrete))
            if every in self._counts and self.data.null_free(every):
                self._counts[key] = self._marginal(every, key)
            elif self.data.null_free(every) and math.prod(self.data.cardinality(c) for c in every) <= MAX_CELLS:
                self._counts[every] = self._count_job(every)
                if key != every:
                    self._counts[key] = self._marginal(every, key)
            else:
                self._counts[key] = self._count_job(key)
        table = self._counts[key]
        return np.transpose(table, [key.index(c) for c in cols]) if cols else table

    def _marginal(self, every: tuple[str, ...], key: tuple[str, ...]) -> np.ndarray:
        return self._counts[every].sum(axis=tuple(i for i, c in enumerate(every) if c not in key))

    def _count_job(self, key: tuple[str, ...]) -> np.ndarray:
        shape = tuple(self.data.cardinality(c) for c in key)
        if math.prod(shape) > 50 * MAX_CELLS:
            raise ValueError(f"a contingency table of {math.prod(shape)} cells")
        table = np.zeros(shape, np.int64)
        self.jobs += 1
        if not key:
            return np.array(self.data.num_rows)
        rows = self.data.df.where(Dataset.valid(key)).groupBy(*[self.data.code(c).alias(str(i)) for i, c in enumerate(key)]).count().collect()
        for r in rows:
            if any(x is None for x in r[:-1]):
                raise ValueError(f"a value of {key} is outside its domain")
            table[tuple(r[:-1])] = r[-1]
        return table

    # ---- grouped moments
    def grouped(self, discrete: Sequence[str], cols: Sequence[str]) -> dict[tuple[int, ...], Moments]:
        """Moments for each observed configuration (codes of `discrete`)."""
        dk, ck = tuple(sorted(discrete)), tuple(sorted(cols))
        if (dk, ck) not in self._grouped:
            need = [*dk, *ck]
            rows = self.data.df.where(Dataset.valid(need)).groupBy(*[self.data.code(c).alias(f"g{i}") for i, c in enumerate(dk)]).agg(*moment_columns(ck)).collect()
            self.jobs += 1
            self._grouped[dk, ck] = {tuple(r[f"g{i}"] for i in range(len(dk))): moments_from(r, ck) for r in rows}
        at = [dk.index(c) for c in discrete]
        return {tuple(k[i] for i in at): m.take(cols) for k, m in self._grouped[dk, ck].items()}


@dataclass
class LinearFit:
    beta: np.ndarray
    variance: float
    rss: float
    n: int


def linear_fit(m: Moments, variable: str, evidence: Sequence[str]) -> LinearFit:
    """Least squares from moments. A regressor that is constant, or a combination of those before it, gets 0. The variance is
    RSS / (n - p - 1); infinite if there are not more rows than coefficients."""
    p = len(evidence)
    s = m.take([*evidence, variable])
    a, mean = s.sse.copy(), s.mean
    used: list[int] = []
    scale = np.diag(s.sse).copy()
    work = a.copy()
    for j in range(p):
        if m.n > 1 and scale[j] / max(1, m.n - 1) >= TOL and work[j, j] > 1e-10 * scale[j]:
            used.append(j)
            work = work - np.outer(work[:, j], work[j]) / work[j, j]
    b = np.zeros(p)
    if used:
        b[used] = np.linalg.solve(a[np.ix_(used, used)], a[used, p])
    rss = float(max(0.0, a[p, p] - b @ a[:p, p]))
    beta = np.concatenate([[mean[p] - b @ mean[:p]], b])
    return LinearFit(beta, rss / (m.n - p - 1) if m.n > p + 1 else math.inf, rss, m.n)


def covariance(data: Dataset, *cols: str) -> np.ndarray:
    return SuffStats(data).moments(cols or data.continuous).cov


def sse(data: Dataset, *cols: str) -> np.ndarray:
    return SuffStats(data).moments(cols or data.continuous).sse


def means(data: Dataset, *cols: str) -> np.ndarray:
    return SuffStats(data).moments(cols or data.continuous).mean


def block_covariance(data: Dataset, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Covariances between two groups of columns, over rows valid in both."""
    both = list(dict.fromkeys([*left, *right]))
    c = SuffStats(data).moments(both).cov
    return c[np.ix_([both.index(x) for x in left], [both.index(x) for x in right])]


def min_max(data: Dataset, *cols: str) -> dict[str, tuple[float, float]]:
    cols = cols or tuple(data.continuous)
    row = data.df.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}


def normalize(data: Dataset) -> Dataset:
    """z-scores of all continuous columns (ddof 1); a constant column becomes 0, nulls stay."""
    cols = data.continuous
    row = data.df.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    put = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        put[c] = F.when(col(c).isNotNull(), (col(c) - (row[f"m{i}"] or 0.0)) / s if s else F.lit(0.0))
    return data.with_df(data.df.withColumns(put))


#: Sampled rows for each bound between two ranges; bounds that a row is compared with one after another; ranges beyond which their bounds are searched
#: in Arrow batches, as an expression of so many would not be compiled.
SAMPLED, FANOUT, COMPILED = 25, 32, 256


class Ranges:
    """Ranges of similar size of a table in the order of `order` (nulls first), as many as there are shuffle partitions. The bounds are rows of a
    sample of SAMPLED rows a range, by the hash of their order columns, so they hold all these columns: equal values of the first do not
    meet in one range unless the others are equal, too. The bounds are fixed when this is made, by one job, and the number of a row's range is the
    same in every task."""

    def __init__(self, rows: DataFrame, order: Sequence[str], parts: int = 0):
        self.order = list(order)
        n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kinds = [rows.schema[o].dataType for o in order]
        self.compiled = n <= COMPILED or not all(isinstance(k, (NumericType, StringType, TimestampType, DateType)) for k in kinds)
        self.keys = [self._key(F.col(f"`{o}`"), k) for o, k in zip(order, kinds, strict=True)]
        sample = rows.select(*[k.alias(f"k{i}") for i, k in enumerate(self.keys)])
        names = sample.columns
        got = sample.orderBy(F.xxhash64(*names), *names).limit(SAMPLED * n).orderBy(*names).collect() if n > 1 else []
        self.types = [f.dataType for f in sample.schema.fields]
        self.bounds = list(dict.fromkeys(tuple(got[i * len(got) // n]) for i in range(1, n))) if got else []

    def _key(self, c: Column, kind: DataType) -> Column:
        """A column as what is compared: instants and days are whole numbers where Python compares them."""
        if self.compiled:
            return c
        return F.unix_micros(c) if isinstance(kind, TimestampType) else F.datediff(c, F.lit("1970-01-01")) if isinstance(kind, DateType) else c

    def number(self) -> Column:
        """The number of a row's range: a search tree over the bounds, or a binary search of Arrow batches."""
        if not self.bounds:
            return F.lit(0)
        return self._tree() if self.compiled else self._search()

    def _search(self) -> Column:
        place = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)  # noqa: E731, PLR0124
        bounds = [tuple(place(v) for v in b) for b in self.bounds]
        first = [b[0][1] for b in bounds if b[0][0] == 1]
        before = sum(b[0][0] == 0 for b in bounds)
        plain = all(isinstance(v, (int, float)) for v in first)

        def search(*cols: pa.Array) -> pa.Array:
            n, kind = len(cols[0]), cols[0].type
            out, ask = np.zeros(n, np.int64), np.ones(n, bool)
            if plain and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
                # by the first key alone, where no bound has the same one
                at, values = np.array(first), cols[0].fill_null(0).to_numpy(zero_copy_only=False)
                lo, hi = np.searchsorted(at, values, "left"), np.searchsorted(at, values, "right")
                out, ask = before + lo, (lo < hi) | (values != values) | cols[0].is_null().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(ask)
            if len(rows):
                asked = [c.take(pa.array(rows)).to_pylist() for c in cols]
                out[rows] = [bisect.bisect_left(bounds, tuple(map(place, row))) for row in zip(*asked, strict=True)]
            return pa.array(out)

        return F.arrow_udf(search, "long")(*self.keys)

    def _tree(self) -> Column:
        row = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(self.keys)])
        point = lambda b: F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, self.types, strict=True))])

        def place(bounds: list[tuple]) -> Column:
            if len(bounds) <= FANOUT:
                below = [F.when(point(b) < row, 1).otherwise(0) for b in bounds]
                return sum(below[1:], below[0])
            step = FANOUT
            while step * FANOUT < len(bounds):
                step *= FANOUT
            out = F
            for i in range(step, len(bounds), step):  # the subtree of a row is the first whose upper bound is not below it
                out = out.when(point(bounds[i]) >= row, place(bounds[i - step : i]) + (i - step))
            last = range(0, len(bounds), step)[-1]
            return out.otherwise(place(bounds[last:]) + last)

        return place(self.bounds)


def ranked(df: DataFrame, column: str, tie: Sequence[str], output: str, parts: int = 0, digest: bool = False) -> DataFrame:
    """0-based position of each non-null value of `column`, ties by `tie`. Rows are dealt to ranges whose bounds are fixed beforehand
    (Ranges over value and tie; equal parts of the hexadecimal scale for a digest) and positions are running totals of the ranges' sizes
    plus the place inside: no task sees all rows, however often a value occurs, and a repeated task finds the same positions."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value, rows = F.col(f"`{column}`"), df.where(F.col(f"`{column}`").isNotNull())
    order = list(dict.fromkeys([column, *tie]))
    if digest:
        part = F.floor(F.conv(F.substring(value, 1, 8), 16, 10).cast("long") * n / (1 << 32))
    else:
        part = Ranges(rows, order, n).number()
    rows = rows.withColumn("_part", part.cast("int"))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    base = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(f"`{t}`") for t in order]))
    return rows.withColumn("_in", inner).join(F.broadcast(base), "_part").withColumn(output, (F.col("_base") + F.col("_in") - 1).cast("long")).drop("_part", "_in", "_base")


def positioned(data: Dataset, output: str = "_at") -> DataFrame:
    """All rows with their 0-based position in the order of `order_by`."""
    if not data.order_by:
        raise ValueError("positions need order_by")
    flagged = data.df.withColumn("_all", F.lit(0))
    return ranked(flagged, "_all", data.order_by, output).drop("_all")


def take(data: Dataset, indices) -> Dataset:
    """Rows by position in `order_by`, in the order of `indices` (a sequence, or a frame with one integer column), as often as they are
    named; a position that is not there is an IndexError. The result's order is its column `_take`."""
    spark = data.df.sparkSession
    if isinstance(indices, DataFrame):
        wanted = ranked(indices.toDF("_at").withColumn("_i", F.monotonically_increasing_id()), "_i", [], "_take").drop("_i")
    else:
        wanted = spark.createDataFrame([(int(x), i) for i, x in enumerate(indices)], "_at long, _take long")
    n = data.num_rows
    if not wanted.where(f"_at IS NULL OR _at < 0 OR _at >= {n}").isEmpty():
        raise IndexError(f"positions are 0..{n - 1}")
    out = positioned(data).join(wanted, "_at").drop("_at")
    return Dataset(out, data.continuous, data.discrete, ["_take"], data.strict_floats)


def rank_data(data: Dataset, key: Sequence[str]) -> Dataset:
    """Every continuous column replaced by its 0-based rank, ties by `key` (a unique key of the rows). The values of all columns are rows of one table
    that is dealt to ranges of (column, value, key) once; the ranks come back together by key, along with the other columns, which
    travel with the first column's values."""
    cols, names = list(data.continuous), data.df.columns
    if not cols:
        return data
    keys = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)]
    kept = [c for c in names if c not in cols and c not in key]
    other = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(kept)], F.lit(True).alias("here"))
    numeric = [F.struct(F.lit(i).alias("_c"), F.col(f"`{c}`").alias("_v"), F.when(F.lit(i == 0), other).alias("_o")) for i, c in enumerate(cols)]
    same = len({data.df.schema[c].dataType for c in cols}) == 1
    if not same:
        numeric = [F.struct(F.lit(i).alias("_c"), F.col(f"`{c}`").cast("double").alias("_v"), F.when(F.lit(i == 0), other).alias("_o")) for i, c in enumerate(cols)]
    each = data.df.select(*keys, F.explode(F.array(*numeric)).alias("_x")).select(*[f"k{i}" for i in range(len(key))], "_x.*")
    order = ["_c", "_v", *[f"k{i}" for i in range(len(key))]]
    each = each.withColumn("_part", Ranges(each.select(*order), order).number().cast("int"))
    counted = F.col("_v").isNotNull()
    sizes = each.where(counted).groupBy("_c", "_part").agg(F.count("*").alias("_size"))
    base = sizes.select("_c", "_part", F.coalesce(F.sum("_size").over(Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.sum(F.when(counted, 1)).over(Window.partitionBy("_part", "_c").orderBy("_v", *order[2:]).rowsBetween(Window.unboundedPreceding, 0))
    at = each.withColumn("_in", inner).join(F.broadcast(base), ["_c", "_part"], "left")
    rank = F.when(counted, (F.col("_base") + F.col("_in") - 1).cast("double"))
    back = at.groupBy(*order[2:]).agg(*[F.max(F.when(F.col("_c") == i, rank)).alias(f"r{i}") for i in range(len(cols))], F.first("_o", ignorenulls=True).alias("_o"))
    value = {c: F.col(f"r{i}") for i, c in enumerate(cols)} | {k: F.col(f"k{i}") for i, k in enumerate(key) if k not in cols} | {c: F.col(f"_o.o{i}") for i, c in enumerate(kept)}
    return data.with_df(back.select(*[value[c].alias(c) for c in names]))


def joint_counts(data: Dataset, variable: str, evidence: Sequence[str] = ()) -> DataFrame:
    """Every configuration of variable and evidence with its count `n`, unobserved ones as 0: as many rows as there are configurations,
    numbered by range() and spelled out from the domains. More than 50 * MAX_CELLS configurations are a ValueError."""
    cols = [variable, *evidence]
    cells = math.prod(data.cardinality(c) for c in cols)
    if cells > 50 * MAX_CELLS:
        raise ValueError(f"a contingency table of {cells} cells")
    at = dict(zip(cols, strides(data, cols), strict=True))
    value = lambda c: F.element_at(F.array(*[F.lit(v) for v in data.discrete[c]]), (F.expr(f"id div {at[c]}") % data.cardinality(c) + 1).cast("int"))
    grid = data.df.sparkSession.range(cells).select(*[value(c).alias(c) for c in cols])
    seen = data.df.where(Dataset.valid(cols)).groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, cols, "left").na.fill(0, ["n"])


def marginal_counts(counts: DataFrame, evidence: Sequence[str]) -> DataFrame:
    return counts.groupBy(*[F.col(f"`{c}`") for c in evidence]).agg(F.sum("n").alias("n"))


def count_cube(data: Dataset, cols: Sequence[str]) -> DataFrame:
    """Counts of all marginals of `cols` at once; a column that is summed over is null, and `level` is its grouping id."""
    return data.df.where(Dataset.valid(cols)).cube(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def strides(data: Dataset, cols: Sequence[str]) -> list[int]:
    """Place values of the mixed-radix configuration number; the first column moves fastest."""
    out, k = [], 1
    for c in cols:
        out.append(k)
        k *= data.cardinality(c)
    return out


def configuration_index(data: Dataset, cols: Sequence[str]) -> Column:
    """Number of a row's configuration; null if a value is null or outside its domain."""
    total = F.lit(0)
    for c, s in zip(cols, strides(data, cols), strict=True):
        total = total + data.code(c) * s
    return total.cast("long")


def slice_by_configuration(data: Dataset, cols: Sequence[str]) -> DataFrame:
    """Rows with their configuration number in `configuration`."""
    return data.df.withColumn("configuration", configuration_index(data, cols)).where("configuration IS NOT NULL")


def median_distance(data: Dataset, cols: Sequence[str], limit: int = 500) -> float:
    """Median Euclidean distance between the first `limit` valid rows in order (without order_by: of the hash of the columns, so that every run
    takes the same); 0 becomes 1."""
    df = data.df.where(Dataset.valid(cols))
    order = data.order_by or [F.xxhash64(*[col(c) for c in cols]), *[col(c) for c in cols]]
    rows = df.orderBy(*order).limit(limit)
    x = np.array([tuple(r) for r in rows.select(*[col(c) for c in cols]).collect()], float)
    if len(x) < 2:
        return 1.0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]
    return float(np.median(d)) or 1.0
