"""Cross-validation and hold-out splits by a seeded digest order of a unique key: the same split in any engine and partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.stats import ranked
from netloom.sources.dataset import Dataset


def digest_order(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(f"`{k}`").cast("string") for k in key], F.lit(str(seed))).cast("binary"))


def _row_key(data: Dataset, key: Sequence[str] | None) -> list[str]:
    return list(key) if key else list(data.order_by) or list(data.df.columns)


class CrossValidation:
    """k folds over valid rows; the first n % k folds hold one row more. `include_null` splits all rows."""

    def __init__(self, data, k: int = 10, seed: int | None = None, include_null: bool = False, key: Sequence[str] | None = None):
        self.data, self.k, self.seed = Dataset.of(data), k, 0 if seed is None else seed
        self.include_null, self.key = include_null, _row_key(self.data, key)
        base = self.data.df if include_null else self.data.df.where(Dataset.valid(self.data.columns))
        self.n = base.count()
        if k <= 1 or k > self.n:
            raise ValueError(f"cannot make {k} folds of {self.n} rows")
        rows = ranked(base.withColumn("_order", digest_order(self.key, self.seed)), "_order", self.key, "_at", digest=True).drop("_order")
        big, size = self.n % k, self.n // k
        fold = F.when(F.col("_at") < big * (size + 1), F.floor(F.col("_at") / (size + 1))).otherwise(big + F.floor((F.col("_at") - big * (size + 1)) / max(size, 1)))
        self.rows = rows.withColumn("fold", fold.cast("int")).drop("_at")

    def frame(self) -> DataFrame:
        """All rows with their `fold`."""
        return self.rows

    def fold(self, i: int) -> tuple[Dataset, Dataset]:
        """Training and test data of one fold."""
        if not 0 <= i < self.k:
            raise IndexError(i)
        return self.data.with_df(self.rows.where(F.col("fold") != i).drop("fold")), self.data.with_df(self.rows.where(F.col("fold") == i).drop("fold"))

    def __iter__(self) -> Iterator[tuple[Dataset, Dataset]]:
        return (self.fold(i) for i in range(self.k))

    def indices(self) -> Iterator[tuple[DataFrame, DataFrame]]:
        """Keys of the rows of each side, the form that positions take in an unordered table."""
        keys = [F.col(f"`{c}`") for c in self.key]
        return ((a.df.select(*keys), b.df.select(*keys)) for a, b in self)

    def loc(self, *cols: str) -> CrossValidation:
        """The same split over some columns."""
        out = object.__new__(CrossValidation)
        out.__dict__.update(self.__dict__)
        keep = list(dict.fromkeys([*cols, "fold"]))
        out.rows = self.rows.select(*[F.col(f"`{c}`") for c in keep])
        out.data = self.data.loc(*cols)
        out.key = [k for k in self.key if k in cols] or list(cols)
        return out


class HoldOut:
    """Test rows are the last round(n * ratio) of the digest order, half away from zero."""

    def __init__(self, data, test_ratio: float = 0.2, seed: int | None = None, include_null: bool = False, key: Sequence[str] | None = None):
        if not 0 < test_ratio < 1:
            raise ValueError("test_ratio must be between 0 and 1")
        self.data, self.seed, self.test_ratio = Dataset.of(data), 0 if seed is None else seed, test_ratio
        self.key = _row_key(self.data, key)
        base = self.data.df if include_null else self.data.df.where(Dataset.valid(self.data.columns))
        n = base.count()
        test = int(n * test_ratio + 0.5)
        if not 0 < test < n:
            raise ValueError("one side of the split is empty")
        rows = ranked(base.withColumn("_order", digest_order(self.key, self.seed)), "_order", self.key, "_at", digest=True).drop("_order")
        self.rows = rows.withColumn("is_test", F.col("_at") >= n - test).drop("_at")

    def frame(self) -> DataFrame:
        return self.rows

    def training_data(self) -> Dataset:
        return self.data.with_df(self.rows.where("NOT is_test").drop("is_test"))

    def test_data(self) -> Dataset:
        return self.data.with_df(self.rows.where("is_test").drop("is_test"))
