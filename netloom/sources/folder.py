"""Models as folders on any file system that Spark reaches: model.json for the structure, Parquet for training rows.

The JSON holds objects of this package by class and attributes, nothing else, so reading it runs no foreign code. Matrices of many rows and
training tables are Parquet tables beside it; a training table is read when something is scored. A save writes its tables to a folder of
its own and then puts model.json in place, so readers find the old model or the new one.
"""

from __future__ import annotations

import importlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FORMAT, PACKAGE = 1, "netloom."
#: Cells beyond which an array is a table.
CELLS = 10_000


class _Writer:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.number = spark, base, 0

    def table(self, df: DataFrame) -> str:
        name, self.number = f"{self.base}/{self.number}", self.number + 1
        return self._put(df, name)

    def _put(self, df: DataFrame, name: str) -> str:
        df.write.parquet(name)
        return name.rsplit("/", 2)[-2] + "/" + name.rsplit("/", 1)[-1]

    def encode(self, x):
        if x is None or isinstance(x, (bool, int, str)):
            return x
        if isinstance(x, (float, np.floating)):
            return {"float": float(x).hex()}
        if isinstance(x, np.integer):
            return int(x)
        if isinstance(x, np.ndarray):
            if x.size > CELLS and x.ndim == 2 and x.dtype == float:
                cells = {"i": np.arange(len(x))} | {f"c{k}": x[:, k] for k in range(x.shape[1])}
                return {"matrix": self.table(self.spark.createDataFrame(pa.table(cells))), "columns": x.shape[1]}
            if x.dtype.kind not in "fiub":
                raise TypeError(f"arrays of {x.dtype} cannot be saved")
            return {"array": [v.hex() for v in x.ravel().tolist()] if x.dtype.kind == "f" else x.ravel().tolist(), "shape": list(x.shape), "type": x.dtype.str}
        if isinstance(x, DataFrame):
            return {"table": self.table(x), "schema": x.schema.json()}
        if isinstance(x, dict) and type(x) is dict:
            return {"dict": [[self.encode(k), self.encode(v)] for k, v in x.items()]}
        for kind in (list, tuple, set, frozenset):
            if type(x) is kind:
                items = sorted(x, key=repr) if kind in (set, frozenset) else x
                return {kind.__name__: [self.encode(v) for v in items]}
        if isinstance(x, type) and x.__module__.startswith(PACKAGE):
            return {"type": f"{x.__module__}:{x.__qualname__}"}
        if type(x).__module__.startswith(PACKAGE):
            state = x.__getstate__() if type(x).__dict__.get("__getstate__") or hasattr(x, "__setstate__") else x.__dict__
            out = {"class": f"{type(x).__module__}:{type(x).__qualname__}", "state": self.encode(dict(state))}
            if isinstance(x, (tuple, dict)):
                out["items"] = self.encode(tuple(x) if isinstance(x, tuple) else dict(x))
            return out
        raise TypeError(f"{type(x).__qualname__} cannot be saved in a folder")


class _Reader:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri, self.seen = spark, uri, {}

    def kind(self, name: str) -> type:
        module, _, path = name.partition(":")
        if not module.startswith(PACKAGE):
            raise ValueError(f"{name} is no class of this package")
        found = importlib.import_module(module)
        for part in path.split("."):
            found = getattr(found, part)
        if not isinstance(found, type):
            raise ValueError(f"{name} is no class")
        return found

    def decode(self, x):
        if not isinstance(x, dict):
            return x
        if "float" in x:
            return float.fromhex(x["float"])
        if "matrix" in x:
            t = self.spark.read.parquet(f"{self.uri}/{x['matrix']}").orderBy("i").toArrow()
            return np.column_stack([t.column(f"c{k}").to_numpy() for k in range(x["columns"])])
        if "array" in x:
            kind = np.dtype(x["type"])
            return np.array([float.fromhex(v) for v in x["array"]] if kind.kind == "f" else x["array"], kind).reshape(x["shape"])
        if "table" in x:
            from pyspark.sql.types import StructType

            return self.spark.read.schema(StructType.fromJson(json.loads(x["schema"]))).parquet(f"{self.uri}/{x['table']}")
        if "dict" in x:
            return {self.decode(k): self.decode(v) for k, v in x["dict"]}
        for kind in (list, tuple, set, frozenset):
            if kind.__name__ in x:
                return kind(self.decode(v) for v in x[kind.__name__])
        if "type" in x:
            return self.kind(x["type"])
        cls, state = self.kind(x["class"]), self.decode(x["state"])
        if issubclass(cls, tuple):
            out = tuple.__new__(cls, self.decode(x["items"]))
        elif issubclass(cls, dict):
            out = cls(self.decode(x["items"]))
        else:
            out = object.__new__(cls)
        out.__setstate__(state) if hasattr(out, "__setstate__") else out.__dict__.update(state)
        return out


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(uri).getFileSystem(spark._jsc.hadoopConfiguration())


def save_folder(obj, uri: str, spark: SparkSession | None = None) -> str:
    """Write `obj` to the folder `uri`; an earlier model there is replaced."""
    spark, uri = spark or SparkSession.active(), uri.rstrip("/")
    data = {"format": FORMAT, "model": _Writer(spark, f"{uri}/tables-{uuid.uuid4().hex}").encode(obj)}
    path, fs = _fs(spark, uri)
    fs.mkdirs(path(uri))
    draft, to = path(f"{uri}/draft-{uuid.uuid4().hex}.json"), path(f"{uri}/model.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(data).encode()))
    stream.close()
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(draft, to):
        raise OSError(f"{uri}/model.json could not be put in place")
    return uri


def load_folder(uri: str, spark: SparkSession | None = None):
    spark, uri = spark or SparkSession.active(), uri.rstrip("/")
    path, fs = _fs(spark, uri)
    stream = fs.open(path(f"{uri}/model.json"))
    try:
        data = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    if data.get("format") != FORMAT:
        raise ValueError(f"{uri} has format {data.get('format')}, not {FORMAT}")
    return _Reader(spark, uri).decode(data["model"])
