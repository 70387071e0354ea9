"""Tables for learners: ingest, column roles, categorical domains and the null rule.

A row takes part in an operator if it has no null in the columns that the operator touches. NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_pandas(pdf, spark: SparkSession | None = None) -> DataFrame:
    """A pandas frame without its index; categorical columns become strings, NaN becomes null, float widths stay."""
    import pyarrow as pa

    return from_arrow(pa.Table.from_pandas(pdf, preserve_index=False).replace_schema_metadata(None), spark)


def from_arrow(table, spark: SparkSession | None = None) -> DataFrame:
    """A pyarrow Table or RecordBatch, or any object with the Arrow stream interface. Dictionary columns become strings."""
    import pyarrow as pa

    spark = spark or SparkSession.active()
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    elif not isinstance(table, pa.Table):
        table = pa.table(table)
    for i, f in enumerate(table.schema):
        if pa.types.is_dictionary(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(f.type.value_type))
    return normalise_nan(spark.createDataFrame(table))


def normalise_nan(df: DataFrame) -> DataFrame:
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in real else F.col(f"`{c}`") for c in df.columns]) if real else df


def to_frame(data, spark: SparkSession | None = None) -> DataFrame:
    """A Spark frame of whatever the user has."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, Dataset):
        return data.df
    return from_pandas(data, spark) if type(data).__module__.startswith("pandas") else from_arrow(data, spark)


@dataclass
class Dataset:
    """A frame with continuous columns, discrete columns with ordered categories, and an order for temporal operators.

    float32 and float64 columns may be mixed unless `strict_floats` is set. Categories that no row has still count.
    """

    df: DataFrame
    continuous: list[str] = field(default_factory=list)
    discrete: dict[str, list[str]] = field(default_factory=dict)
    order_by: list[str] = field(default_factory=list)
    strict_floats: bool = False
    _nulls: dict[str, int] | None = None
    _rows: int | None = None

    @classmethod
    def of(cls, data, discrete: dict[str, Sequence[str]] | Iterable[str] | None = None, order_by: Sequence[str] = (), columns: Sequence[str] | None = None, strict_floats: bool = False, categorical_like: Dataset | None = None) -> Dataset:
        """Double and float columns are continuous; strings are discrete, with the sorted values found as domain unless one is given.
        Other columns are carried along without a role. One job finds all undeclared domains."""
        if isinstance(data, Dataset):
            return data
        pandas_domains = {}
        if type(data).__module__.startswith("pandas"):
            pandas_domains = {c: [str(x) for x in data[c].cat.categories] for c in data.columns if str(data[c].dtype) == "category"}
        df = normalise_nan(to_frame(data))
        if columns:
            df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, *order_by])])
        given = dict(discrete) if isinstance(discrete, dict) else {}
        given = pandas_domains | (categorical_like.discrete if categorical_like else {}) | given
        floats = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        if strict_floats and len({type(t) for t in floats.values()}) > 1:
            raise ValueError("float32 and float64 columns are mixed")
        names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in order_by]
        if discrete is not None and not isinstance(discrete, dict):
            names = list(dict.fromkeys([*names, *discrete]))
            df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in discrete})
        ask = [c for c in names if c not in given]
        found = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(ask)]).first() if ask else ()
        domains = {c: list(given[c]) if c in given else list(found[str(ask.index(c))]) for c in names}
        return cls(df, [c for c in floats if c not in order_by], domains, list(order_by), strict_floats)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c in self.discrete or c in self.continuous]

    def with_df(self, df: DataFrame) -> Dataset:
        have = set(df.columns)
        return Dataset(df, [c for c in self.continuous if c in have], {c: v for c, v in self.discrete.items() if c in have}, [c for c in self.order_by if c in have], self.strict_floats)

    def loc(self, *cols: str | int | Sequence) -> Dataset:
        """Projection by names or positions."""
        flat = [x for c in cols for x in (c if isinstance(c, (list, tuple)) else [c])]
        names = [self.df.columns[c] if isinstance(c, int) else c for c in flat]
        self.raise_has_columns(*names)
        return self.with_df(self.df.select(*[F.col(f"`{c}`") for c in names]))

    def has_columns(self, *cols) -> bool:
        flat = [x for c in cols for x in (c if isinstance(c, (list, tuple)) else [c])]
        return all(c < len(self.df.columns) if isinstance(c, int) else c in self.df.columns for c in flat)

    def raise_has_columns(self, *cols) -> None:
        flat = [x for c in cols for x in (c if isinstance(c, (list, tuple)) else [c])]
        if missing := [c for c in flat if not self.has_columns(c)]:
            raise ValueError(f"no such columns: {missing}")

    def is_continuous(self, c: str) -> bool:
        return c in self.continuous

    def is_discrete(self, c: str) -> bool:
        return c in self.discrete

    def same_type(self, *cols: str) -> None:
        """Error unless the columns are all continuous of one width or all discrete."""
        kinds = {"discrete" if c in self.discrete else self.df.schema[c].dataType.typeName() for c in cols}
        if len(kinds) > 1:
            raise ValueError(f"columns of different types: {sorted(kinds)}")

    def cardinality(self, c: str) -> int:
        return len(self.discrete[c])

    @staticmethod
    def valid(cols: Iterable[str]) -> Column:
        """True where no column is null."""
        return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols], F.lit(True))

    def filter_null(self, *cols: str) -> Dataset:
        return self.with_df(self.df.dropna("any", subset=list(cols) or self.df.columns))

    def nulls(self) -> dict[str, int]:
        """Null counts of all columns with a role and the number of rows: one job, kept."""
        if self._nulls is None:
            cols = self.columns
            row = self.df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(str(i)) for i, c in enumerate(cols)]).first()
            self._rows, self._nulls = row["n"], {c: row[str(i)] for i, c in enumerate(cols)}
        return self._nulls

    @property
    def num_rows(self) -> int:
        self.nulls()
        return self._rows

    def null_free(self, cols: Iterable[str] | None = None) -> bool:
        n = self.nulls()
        return not any(n[c] for c in (cols or n))

    def null_count(self, *cols: str) -> int:
        """Rows with a null in any of the columns."""
        return self.df.agg(F.count_if(~self.valid(cols or self.columns))).first()[0]

    def valid_rows(self, *cols: str) -> int:
        return self.df.agg(F.count_if(self.valid(cols or self.columns))).first()[0]

    def code(self, c: str) -> Column:
        """Position of a value in its domain; null for null and for values outside."""
        at = F.array_position(F.array(*[F.lit(v) for v in self.discrete[c]]), F.col(f"`{c}`")) if self.discrete[c] else F.lit(0)
        return F.nullif(at, F.lit(0)) - 1

    def slice(self, offset: int, length: int | None = None) -> Dataset:
        """Rows by position in `order_by`."""
        if not self.order_by:
            raise ValueError("a slice needs order_by")
        out = self.df.orderBy(*self.order_by).offset(offset)
        return self.with_df(out if length is None else out.limit(length))

    def take(self, indices) -> Dataset:
        """Rows by position in `order_by`: a sequence of integers or a frame of one integer column."""
        from netloom.operators.stats import take

        return take(self, indices)
