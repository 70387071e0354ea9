"""Scoring a stream with a fitted model, and keeping sufficient statistics of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from netloom.operators.stats import Moments, moment_columns, moments_from


def score_stream(model, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, output: str = "logl", trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch goes to `sink(frame with its log-likelihoods, batch id)`. The batch id repeats after a failure, so a sink that
    overwrites by it is exact."""

    def each(batch: DataFrame, number: int) -> None:
        sink(model.attach_logl(batch, output), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class StreamingMoments:
    """Moments of some columns over all batches, pooled by the pairwise update. Each batch's moments are a table named by its number in
    `folder` (by default beside the checkpoint), so a repeated batch replaces itself and a restarted stream goes on where it was."""

    def __init__(self, columns: Sequence[str], folder: str | None = None):
        self.columns, self.folder = list(columns), folder

    def update(self, batch: DataFrame, number: int) -> None:
        if self.folder is None:
            raise ValueError("no folder to keep moments in")
        batch.agg(*moment_columns(self.columns)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    @property
    def moments(self) -> Moments:
        total, spark = Moments.empty(self.columns), SparkSession.active()
        if self.folder is None:
            return total
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return total
        for row in spark.read.parquet(self.folder).orderBy("batch").toLocalIterator():
            total = total + moments_from(row, self.columns)
        return total

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        self.folder = self.folder or f"{checkpoint}_moments"
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
