"""Where results are kept between jobs: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The named folder; a temporary one only where none is set and all runs in one process (tests)."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder. How the rows are partitioned stays known."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
