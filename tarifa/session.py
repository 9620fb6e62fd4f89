"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names for checkpoints.

    Where none is set, a session on one machine takes a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most ``rows`` rows, by reading no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer read, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
