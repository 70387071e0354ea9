"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to spark.checkpoint.dir and read back, so that a lost executor changes nothing of it. Where that is unset, a folder of our
    own in local mode, and an error on a cluster, where no other machine would see it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="netloom_checkpoint_")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
