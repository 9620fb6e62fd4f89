"""Feature drift: monitoring baselines and the population stability index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import MISSING, UNSEEN
from ..functions.exprs import bin_index, number, psi_term
from .quantiles import exact_quantiles

DECILES = tuple(i / 10 for i in range(1, 10))


def unpivot(df: DataFrame, features: Sequence[str], kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value): a row per record and feature."""
    value = (lambda f: number(f)) if kind == "double" else (lambda f: F.col(f).cast("string"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), value(f).alias("value")) for f in features])
    return df.select(*keep, F.inline(cells))


def numeric_baseline(df: DataFrame, features: Sequence[str], exact: bool = True) -> DataFrame:
    """(feature, cuts, ordinal, expected): shares of training records by decile bin, the last one missing values.

    Equal deciles collapse, so features have different numbers of bins; one without values has none.
    ``exact=False`` uses a sketch whose size doesn't grow with the values.
    """
    long = unpivot(df, features, "double")
    if exact:
        deciles = exact_quantiles(long, DECILES)
    else:
        deciles = long.groupBy("feature").agg(F.percentile_approx("value", F.array(*map(F.lit, DECILES)), 100_000).alias("q"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, features))).alias("feature"))
    no_cuts = F.array().cast("array<double>")
    cuts = names.join(deciles, "feature", "left").select("feature", F.coalesce(F.array_sort(F.array_distinct("q")), no_cuts).alias("cuts"))
    counts = binned(long, cuts).groupBy("feature", "ordinal").agg(F.count("*").alias("n"))
    bins = cuts.select("feature", "cuts", F.explode(F.sequence(F.lit(0), F.size("cuts") + 1)).alias("ordinal"))
    rows = bins.join(counts, ["feature", "ordinal"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("feature"))
    return rows.select("feature", "cuts", "ordinal", (F.col("n") / F.greatest(total, F.lit(1))).alias("expected"))


def binned(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """Long records with the bin of each value; ``cuts`` has a row per feature."""
    return long.join(F.broadcast(cuts), "feature").withColumn("ordinal", bin_index("value", F.col("cuts")))


def categorical_baseline(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, bucket, expected): shares of training records by level, with a missing bucket and an empty unseen one."""
    long = unpivot(df, features, "string").withColumn("bucket", F.coalesce("value", F.lit(MISSING)))
    counts = long.groupBy("feature", "bucket").agg(F.count("*").alias("n"))
    names = F.array(*map(F.lit, features))
    sentinels = df.sparkSession.range(1).select(F.explode(names).alias("feature"))
    sentinels = sentinels.select("feature", F.explode(F.array(F.lit(MISSING), F.lit(UNSEEN))).alias("bucket"))
    rows = counts.unionByName(sentinels.withColumn("n", F.lit(0).cast("long")))
    rows = rows.groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    return rows.select("feature", "bucket", (F.col("n") / F.greatest(total, F.lit(1))).alias("expected"))


def numeric_counts(df: DataFrame, baseline: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, bucket, n) of records by the baseline's bins."""
    cuts = baseline.select("feature", "cuts").distinct()
    long = binned(unpivot(df, features, "double", keep), cuts)
    return long.groupBy(*keep, "feature", F.col("ordinal").cast("string").alias("bucket")).agg(F.count("*").alias("n"))


def categorical_counts(df: DataFrame, baseline: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, bucket, n) of records by level; levels the baseline lacks are unseen.  Counted before the lookup."""
    long = unpivot(df, features, "string", keep).withColumn("bucket", F.coalesce("value", F.lit(MISSING)))
    counts = long.groupBy(*keep, "feature", "bucket").agg(F.count("*").alias("n"))
    known = baseline.select("feature", "bucket", F.lit(True).alias("known"))
    counts = counts.join(known, ["feature", "bucket"], "left")
    level = F.when(F.col("known"), F.col("bucket")).otherwise(UNSEEN)
    return counts.groupBy(*keep, "feature", level.alias("bucket")).agg(F.sum("n").alias("n"))


def as_buckets(numeric: DataFrame | None, categorical: DataFrame | None) -> DataFrame:
    """Baselines as one table (feature, bucket, expected)."""
    parts = []
    if numeric is not None:
        parts.append(numeric.select("feature", F.col("ordinal").cast("string").alias("bucket"), "expected"))
    if categorical is not None:
        parts.append(categorical.select("feature", "bucket", "expected"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def feature_psi(counts: DataFrame, buckets: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, psi): the index of counted records against the baseline's shares; features without records have none."""
    groups = counts.groupBy(*keep, "feature").agg(F.sum("n").alias("total")).where("total > 0")
    rows = groups.join(buckets, "feature").join(counts, [*keep, "feature", "bucket"], "left")
    rows = rows.withColumn("actual", F.coalesce("n", F.lit(0)) / F.col("total"))
    rows = rows.withColumn("bins", F.count("*").over(Window.partitionBy(*keep, "feature")))
    return rows.groupBy(*keep, "feature").agg(F.sum(psi_term("expected", "actual", "bins")).alias("psi"))


def largest(psi: DataFrame, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., max_psi, max_psi_feature): the largest index; on ties the feature that comes first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("feature"))
    return psi.groupBy(*keep).agg(F.max("psi").alias("max_psi"), F.max_by("feature", F.struct("psi", -rank)).alias("max_psi_feature"))
