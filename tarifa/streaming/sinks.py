"""A table of micro-batches that holds each of them once, whatever is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_once(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch to its own folder, over what an earlier try of the same batch left there."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches written so far, with the column ``batch``."""
    return spark.read.parquet(path)
