"""Sinks for small results, and tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a result that one file or report may have.
MOST_ROWS = 100_000


def few(df: DataFrame, most: int = MOST_ROWS) -> list:
    """The rows of a small result; more than ``most`` are refused, having read no more than one beyond."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a result of over {most} rows is not a report; write it as a table")
    return rows


def write_csv(df: DataFrame, path: str, one_file: bool = False, most: int = MOST_ROWS, sep: str = ",") -> None:
    """A result as CSV with a header, through Spark's writer; ``one_file`` only for at most ``most`` rows."""
    if one_file:
        df = df.sparkSession.createDataFrame(few(df, most), df.schema).coalesce(1)
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_json_document(df: DataFrame, path: str, name: str = "rows", most: int = MOST_ROWS) -> None:
    """A small result as one indented JSON document, an object with the list ``name``; nulls are kept."""
    rows = df.sparkSession.createDataFrame(few(df, most), df.schema).coalesce(1)
    listed = F.coalesce(F.collect_list(F.struct("*")), F.array())
    text = F.to_json(F.struct(listed.alias(name)), {"pretty": "true", "ignoreNullFields": "false"})
    rows.agg(text.alias("value")).write.mode("overwrite").text(path)


def write_blocks(rows: DataFrame, path: str, block: str, order: str, text: str = "value") -> None:
    """A text file per value of ``block``, in a folder of that name, its lines in the order of ``order``."""
    dealt = rows.repartition(block).sortWithinPartitions(block, order)
    dealt.select(block, text).write.mode("overwrite").partitionBy(block).text(path)


def markdown(df: DataFrame, title: str, digits: int = 5, most: int = 1000) -> str:
    """A result of at most ``most`` rows as a Markdown table."""

    def cell(x) -> str:
        return "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|")

    rows = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(rows + ["| " + " | ".join(map(cell, r)) + " |" for r in few(df, most)]) + "\n"


def artifact_table(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder in any store, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_policy_table(rows: DataFrame, name: str, path: str, buckets: int = 16, year: str = "year", key: str = "insured_id") -> DataFrame:
    """Policy years as a table in folders by year and in buckets by id, read back.

    Filters on the year leave folders out; joins on the id, and distinct ids, read buckets that lie
    together already and shuffle no ids.  Rows are dealt by year and bucket before they are written, so
    each folder has a file a bucket.
    """
    dealt = rows.repartition(buckets, F.col(key))
    dealt.write.mode("overwrite").partitionBy(year).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)
