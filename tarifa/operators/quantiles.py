"""Exact quantiles without a buffer of all values: counts by value, range-partitioned, and ranks from sums of slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def ranked(rows: DataFrame, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """(by..., x, n, start, end, total): each group's distinct values with their counts and ranks.

    Nulls don't count.  Equal values are counted before the shuffle, each slice of the order is
    summed in its own window, and only sums of slices meet.
    """
    keys = [F.col(b) for b in by]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    sliced = checkpointed(counts.repartitionByRange(*keys, "x").withColumn("slice", F.spark_partition_id()))
    sums = sliced.groupBy(*keys, "slice").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    begin = F.coalesce(F.sum("n").over(group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*keys, "slice", begin.alias("begin"), F.sum("n").over(group).alias("total"))
    within = Window.partitionBy(*keys, "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    found = sliced.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(starts), [*by, "slice"])  # a row per group and slice
    return found.withColumn("end", F.col("begin") + F.col("upto")).withColumn("start", F.col("end") - F.col("n"))


def quantile_cuts(rows: DataFrame, bins: int, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """(by..., cuts): rising cut points, all of them values, between at most ``bins`` parts of about as many rows each."""
    part = F.floor((F.col("end") - 1) * bins / F.col("total"))
    tops = ranked(rows, by, value).groupBy(*by, part.alias("part")).agg(F.max("x").alias("top"))
    return tops.groupBy(*by).agg(F.array_sort(F.collect_set("top")).alias("cuts")).withColumn("cuts", F.slice("cuts", 1, F.size("cuts") - 1))


def exact_quantiles(rows: DataFrame, qs: Sequence[float], by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """(by..., q): the linearly interpolated quantiles of ``value`` in each group, as an array in the order of ``qs``.

    Nulls don't count; a group without values has no row.  Equal values are counted before the
    shuffle, each slice of the order is summed in its own window, and only sums of slices meet.
    """
    keys = [F.col(b) for b in by]
    def at(rank):
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("x")))

    aggs = []
    for k, q in enumerate(qs):
        place = (F.col("total") - 1) * F.lit(float(q))
        aggs += [at(F.floor(place)).alias(f"lo{k}"), at(F.ceil(place)).alias(f"hi{k}"), F.max(place - F.floor(place)).alias(f"part{k}")]
    found = ranked(rows, by, value).groupBy(*keys).agg(*aggs)
    each = [F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"part{k}") for k in range(len(qs))]
    return found.select(*by, F.array(*each).alias("q"))
