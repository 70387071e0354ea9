"""Session helpers: the shared folder, durable intermediate tables and Arrow batch sizes."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:/")
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4 << 20


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough that a batch of ordinary documents stays within a few MB, and one of wide rows within BYTES_PER_BATCH or
    a single row."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) not in range(1, ROWS_PER_BATCH + 1):
        spark.conf.set(key, str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, whose
    tasks run on this machine; on a cluster a RuntimeError, since no other machine would see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="netloom_shared_")
        atexit.register(shutil.rmtree, own, True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


#: Tables that store() wrote and nothing has deleted, by the owner that was set then.
_stored: dict[str | None, list[str]] = {}
_owner: list[str | None] = [None]


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables that are stored inside belong to `owner`, whose sweep() deletes them and no others."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def _keep(path: str) -> None:
    _stored.setdefault(_owner[-1], []).append(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back. A lost executor loses nothing of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    _keep(path)
    return out


def store_pieces(spark: SparkSession, pieces: Iterator[list[tuple]], schema: str, name: str) -> DataFrame:
    """A table that the driver appends to the shared folder piece by piece, so that it holds one piece at a time."""
    path = fresh_path(spark, name)
    for piece in pieces:
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(path)
    _keep(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of stored tables that no later step reads; what is no stored table stays."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        for paths in _stored.values():
            if path in paths:
                paths.remove(path)
                _delete(df.sparkSession, path)


def sweep(spark: SparkSession, owner: str | None = None) -> None:
    """Delete the owner's stored tables. Only for an owner that has written out every result that reads them."""
    for path in _stored.pop(owner, []):
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished phases: its cleaner acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or of a path without scheme; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if SCHEME.match(uri) else uri


def put_file(uri: str, data: bytes) -> None:
    """Write a file under its final name in one step, so that a retried task replaces it whole."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store_, key = fs.FileSystem.from_uri(uri)
    part = f"{key}.{uuid.uuid4().hex}.part"
    store_.create_dir(os.path.dirname(key), recursive=True)
    with store_.open_output_stream(part) as f:
        f.write(data)
    store_.move(part, key)


def get_file(uri: str) -> bytes:
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store_, key = fs.FileSystem.from_uri(uri)
    with store_.open_input_stream(key) as f:
        return f.read()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """mapInArrow by single batches; `fn` may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
