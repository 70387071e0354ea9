"""Time slices of an ordered table: `v_t_k` is the value of v k rows ago."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from netloom.operators.stats import Ranges
from netloom.sources.dataset import Dataset


def temporal_name(variable: str, k: int) -> str:
    return f"{variable}_t_{k}"


class DynamicDataFrame:
    """Slices of a table of Markov order m. Lags follow `order_by`; with `series` they stay within each series. The table is cut into ranges of
    series and order, whose bounds and last rows are found once and kept with the dataset; the last rows of a range go along to the next ones, so
    no task sees all of the table or of a long series."""

    def __init__(self, data, markovian_order: int, order_by: Sequence[str] | None = None, series: Sequence[str] = ()):
        if markovian_order < 1:
            raise ValueError("the Markov order is at least 1")
        self.data, self.m = Dataset.of(data), markovian_order
        self.order, self.series = list(order_by or self.data.order_by), list(series)
        if not self.order:
            raise ValueError("temporal slices need order_by")
        self.variables = [c for c in self.data.columns if c not in self.order and c not in self.series]
        self.layout = Layout.of(self.data, self.order, self.series, markovian_order)

    @property
    def markovian_order(self) -> int:
        return self.m

    def origin_df(self) -> Dataset:
        return self.data

    def num_variables(self) -> int:
        return len(self.variables)

    def num_columns(self) -> int:
        return len(self.variables) * (self.m + 1)

    def num_rows(self) -> int:
        return self.transition_df().df.count()

    def _lags(self, shifts: dict[int, int], first: int) -> Dataset:
        """Columns v_t_k = lag(v, shift), rows from position `first` (0-based) on."""
        cells = [(temporal_name(v, k), v, s) for k, s in shifts.items() for v in self.variables]
        df = self.layout.lagged(cells, first)
        domains = {temporal_name(v, k): self.data.discrete[v] for k in shifts for v in self.variables if v in self.data.discrete}
        real = [temporal_name(v, k) for k in shifts for v in self.variables if v in self.data.continuous]
        return Dataset(df, real, domains, self.order)

    def temporal_slice(self, k: int | Sequence[int]) -> Dataset:
        """Slices k of the rows that have all m slices before them."""
        ks = [k] if isinstance(k, int) else list(k)
        if any(not 0 <= x <= self.m for x in ks):
            raise ValueError(f"slices are 0..{self.m}")
        return self._lags({x: x for x in ks}, self.m)

    def static_df(self) -> Dataset:
        """Slices 1..m without the current row: v_t_k is k - 1 rows ago."""
        return self._lags({k: k - 1 for k in range(1, self.m + 1)}, self.m - 1)

    def transition_df(self) -> Dataset:
        return self._lags({k: k for k in range(self.m + 1)}, self.m)

    def loc(self, *cells: tuple[str, int]) -> Dataset:
        """Columns by (variable, slice)."""
        return self.transition_df().loc([temporal_name(v, k) for v, k in cells])


class Layout:
    """A table cut into ranges of (series, order) for lags of up to `m` rows. `carried` are, for each range, the m rows before it. Two
    jobs find them, when the first lag is asked for: one for the bounds, one for the last m rows of all ranges, which are all that reaches the driver."""

    def __init__(self, df: DataFrame, order: Sequence[str], series: Sequence[str], m: int):
        self.df, self.order, self.series, self.m = df, list(order), list(series), m
        self._rows: DataFrame | None = None

    @classmethod
    def of(cls, data: Dataset, order: Sequence[str], series: Sequence[str], m: int) -> Layout:
        """The dataset's own layout for this order, made anew if it carries fewer rows than needed."""
        kept = data.__dict__.setdefault("_layouts", {})
        key = (tuple(order), tuple(series))
        if key not in kept or kept[key].m < m:
            kept[key] = cls(data.df, order, series, m)
        return kept[key]

    def rows(self) -> DataFrame:
        """The table's rows with their range, `_part`, and the carried rows of each range, `_carried`."""
        if self._rows is None:
            key = list(dict.fromkeys([*self.series, *self.order]))
            rows = self.df.withColumn("_part", Ranges(self.df, key).number().cast("int"))
            back = Window.partitionBy("_part").orderBy(*[F.col(f"`{k}`").desc() for k in key])
            last = rows.withColumn("_last", F.row_number().over(back)).where(f"_last <= {self.m}").orderBy("_part", F.desc("_last")).drop("_last").collect()
            carried, before = [], []
            for _, group in itertools.groupby(last, lambda r: r["_part"]):
                own = list(group)
                carried += [(*r[:-1], own[0]["_part"], True) for r in before[-self.m :]]
                before = (before + own)[-self.m :]
            schema = StructType([*rows.schema.fields, StructField("_carried", BooleanType())])
            self._rows = rows.withColumn("_carried", F.lit(False)).unionByName(self.df.sparkSession.createDataFrame(carried, schema))
        return self._rows

    def lagged(self, cells: Sequence[tuple[str, str, int]], first: int = 0) -> DataFrame:
        """`series` and `order` columns, and for each cell (name, column, shift) the value of `shift` rows before; rows from position `first`
        (0-based, in their series) on."""
        if max([first, *[s for _, _, s in cells]]) > self.m:
            raise ValueError(f"this layout carries {self.m} rows")
        w = Window.partitionBy("_part", *[F.col(f"`{s}`") for s in self.series]).orderBy(*[F.col(f"`{o}`") for o in self.order])
        values = [F.lag(F.col(f"`{c}`"), s).over(w).alias(n) if s else F.col(f"`{c}`").alias(n) for n, c, s in cells]
        at = F.row_number().over(w).alias("_at")  # carried rows count, and there are `first` of them if the series has as many before
        return self.rows().select(*[F.col(f"`{c}`") for c in [*self.series, *self.order]], *values, at, "_carried").where(f"NOT _carried AND _at > {first}").drop("_at", "_carried")


def lagged(df: DataFrame, cells: Sequence[tuple[str, str, int]], order: Sequence[str], series: Sequence[str] = (), first: int = 0) -> DataFrame:
    """Layout.lagged() of a table that is laid out for this one call."""
    return Layout(df, order, series, max([1, first, *[s for _, _, s in cells]])).lagged(cells, first)


def create_temporal_slice(df: DataFrame, columns: Sequence[str], k: int, order_by: Sequence[str]) -> DataFrame:
    return lagged(df, [(temporal_name(c, k), c, k) for c in columns], order_by).select(*[F.col(f"`{temporal_name(c, k)}`") for c in columns])
