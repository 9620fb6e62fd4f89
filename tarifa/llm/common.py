"""Small helpers the corpus operators share."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One white-space character, as a Java regular-expression class.
SPACE = r"[ \t-\r]"
#: One word.
WORD = r"[^ \t-\r]+"
#: The same characters as a literal, for trim and translate.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The parquet table ``table`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints that the session names; on one machine without one, a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer read, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder; lost executors lose no part of it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a written table of a few numbers or digests a row lies in one part.
FEW = 1 << 18


def gathered(df: DataFrame) -> DataFrame:
    """``df``, written once, of narrow rows; at most ``FEW`` rows lie in one part, so that steps on them are one task each and not one for each partition."""
    df = materialize(df)
    return materialize(df.coalesce(1)) if df.count() <= FEW else df


def firsts(rows: DataFrame, *key: str) -> DataFrame:
    """``rows``, written once, with ``first_of_key``: true for exactly one row of each key, which is nobody's large task."""
    rows = materialize(rows.withColumn("row_of_key", F.monotonically_increasing_id()))
    least = rows.groupBy(*key).agg(F.min("row_of_key").alias("row_of_key")).select("row_of_key", F.lit(True).alias("first_of_key"))
    return rows.join(least, "row_of_key", "left").withColumn("first_of_key", F.coalesce("first_of_key", F.lit(False))).drop("row_of_key")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows``, written once, with a column per entry of ``sums``: the sum of the named column over the rows before, in an order.

    Rows are range-partitioned by the order and added up within their slice; the slices' sums, a row
    per partition, give each slice its start.  So no task sees more than its slice, whatever the keys.
    """
    sliced = materialize(rows.repartitionByRange(*order).withColumn("slice_of", F.spark_partition_id()))
    earlier = Window.orderBy("slice_of").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("slice_of").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("slice_of").agg(*[F.sum(c).alias(f"start_{n}") for n, c in sums.items()])
    starts = starts.select("slice_of", *[F.coalesce(F.sum(f"start_{n}").over(earlier), F.lit(0)).alias(f"start_{n}") for n in sums])
    out = sliced.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(starts), "slice_of")
    return out.withColumns({n: F.col(n) + F.col(f"start_{n}") for n in sums}).drop("slice_of", *[f"start_{n}" for n in sums])


def text_of(column: str | Column = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def key_of(column: str | Column) -> Column:
    """A non-null grouping key: null and every string stay apart, so plain equi-joins work."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def require(df: DataFrame, *columns: str) -> None:
    """Raise if ``df`` lacks a column an operator reads."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


#: Bits a member of a bitmap of hashes, and its bits at most (a power of two: 32 MB).
BITS_A_HASH, MOST_BITS = 32, 28


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every hash of a one-column frame of longs: an array of at most 2**MOST_BITS bits.

    It tells tasks which rows can't matter; more hashes than it has room for make it let more
    rows through, never fewer.  Up to ``FEW`` hashes are folded by one task.
    """
    n = hashes.count()
    bits = min(max(16, math.ceil(math.log2(max(n, 1) * BITS_A_HASH))), MOST_BITS)
    block = 1 << 16  # bits

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits))
            yield pa.RecordBatch.from_arrays([pa.array((at // block).astype(np.int32)), pa.array((at % block).astype(np.int32))], ["block", "bit"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(blocks).tolist():
                known.setdefault(b, np.zeros(block, bool))[bit[blocks == b]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), pa.array([np.packbits(x).tobytes() for x in known.values()], pa.binary())], ["block", "bits"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(positions(batches))

    out, kind = np.zeros((1 << bits) // 8, np.uint8), "block int, bits binary"
    found = hashes.repartition(1).mapInArrow(both, kind) if n <= FEW else hashes.mapInArrow(positions, "block int, bit int").repartition("block").mapInArrow(fold, kind)
    for r in found.collect():  # one job, whatever the partitions; 32 MB at most
        out[r.block * block // 8 : (r.block + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes a bitmap lets through."""
    at = hashes >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1 == 1
