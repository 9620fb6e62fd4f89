"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it written as
Parquet and read again.  All but the last return the columns of ``documents``.  Every stage takes
nulls in any column, empty and very long texts, repeated rows and ids, and further columns; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarifa.llm import exact_dedup, mixing, quality, queries, simhash
from tarifa.llm.common import checkpoint_dir, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed and the adaptive rules reject go, those of null and empty texts among them; repeated rows are judged alike."""
    return quality.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts stays, the longest, then that of smallest id; null ids are last, rows that tie are one document."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates stays, the one of smallest id; null ids are last, of rows that tie one stays."""
    return simhash.first_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix begins them, in training order; a null source is a source of its own, null texts have no words and go."""
    return mixing.mixed_documents(docs, queries.MIX_SCHEDULES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, encoded and decoded; a null text counts as empty."""
    return queries.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: SQL can't express byte-pair encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written to the shared folder, and removed once the next one is."""
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
