"""Exposure-weighted portfolio and model metrics.

Every function takes a frame whose predictions are columns and returns a small frame; the sums
are partial aggregates, so what is shuffled doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import OFFLINE_FLOOR, TOTAL_EPS
from ..functions.exprs import age_band, at_least, poisson_deviance, ratio, tweedie_deviance, weighted_mean
from ..session import checkpointed
from .quantiles import exact_quantiles


def year_summary(df: DataFrame, year: str = "year", exact_ids: bool = True) -> DataFrame:
    """Per year: rows, distinct ids, exposure, claims, incurred, premium and their rates.

    ``exact_ids=False`` estimates the distinct ids (HyperLogLog) instead of shuffling every id.
    """
    ids = F.countDistinct("insured_id") if exact_ids else F.approx_count_distinct("insured_id", 0.01)
    sums = df.groupBy(year).agg(
        F.count("*").alias("rows"),
        ids.alias("unique_ids"),
        *[F.sum(f"total_{c}").alias(c) for c in ("exposure", "claims", "incurred", "premium")],
    )
    return sums.select(
        F.col(year).cast("long").alias("year"), "rows", "unique_ids", "exposure", "claims",
        ratio("claims", "exposure").alias("claim_frequency"),
        "incurred", ratio("incurred", "exposure").alias("pure_premium"),
        "premium", ratio("incurred", "premium").alias("observed_loss_ratio"),
    )


def renewal_summary(df: DataFrame) -> DataFrame:
    """The yearly summary of the renewal table."""
    sums = df.groupBy("renewal_year").agg(
        F.count("*").alias("rows"), F.countDistinct("ID").alias("unique_ids"), F.sum("Exposure").alias("exposure"),
        F.sum("N_claims_year").alias("claims"), F.sum("Cost_claims_year").alias("loss"),
    )
    return sums.withColumns({"claim_frequency": ratio("claims", "exposure"), "pure_premium": ratio("loss", "exposure")})


def calibration(actual: str, pred: str, exposure: str = "total_exposure") -> Column:
    """Aggregate: predicted over actual total."""
    return F.sum(F.col(pred) * F.col(exposure)) / F.greatest(F.sum(actual), F.lit(TOTAL_EPS))


def lock(actual: str, pred: str, exposure: str = "total_exposure") -> Column:
    """Aggregate: actual over predicted total, the scale a calibration year fixes."""
    return F.sum(actual) / F.greatest(F.sum(F.col(pred) * F.col(exposure)), F.lit(TOTAL_EPS))


def locked_scales(calibration_rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row of ``<model>_scale``; ``models`` maps a prediction to its actual total column."""
    rows = calibration_rows.withColumns({m: at_least(m, OFFLINE_FLOOR) for m in models})
    return rows.agg(*[lock(actual, m).alias(f"{m}_scale") for m, actual in models.items()])


def with_locked(rows: DataFrame, scales: DataFrame, models: Sequence[str]) -> DataFrame:
    """``rows`` with predictions held above the floor, scaled, and held there again (``<model>_locked``)."""
    out = rows.crossJoin(F.broadcast(scales))  # one row
    return out.withColumns(
        {f"{m}_locked": at_least(at_least(m, OFFLINE_FLOOR) * F.col(f"{m}_scale"), OFFLINE_FLOOR) for m in models}
    ).drop(*scales.columns)


def deviances(rows: DataFrame, frequency: Sequence[str], loss: Sequence[str]) -> DataFrame:
    """(model, target, deviance, calibration_ratio) of frequency and loss predictions, in one pass."""
    w = F.col("total_exposure")
    aggs = []
    for kind, models, total, unit in (("frequency", frequency, "total_claims", poisson_deviance), ("loss", loss, "total_incurred", tweedie_deviance)):
        for m in models:
            aggs.append((m, kind, weighted_mean(unit(F.col(total) / w, F.col(m)), w), calibration(total, m)))
    wide = rows.agg(*[F.struct(d.alias("deviance"), c.alias("calibration_ratio")).alias(f"{m}") for m, _, d, c in aggs])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("target"), F.col(m).alias("x")) for m, k, _, _ in aggs])
    return wide.select(F.explode(cells).alias("r")).select("r.model", "r.target", "r.x.deviance", "r.x.calibration_ratio")


def top_capture(df: DataFrame, score: str, outcome: str, exposure: str, keys: Sequence[str], fraction: float = 0.10) -> DataFrame:
    """(rows_kept, exposure_kept, capture): the share of the outcome among the highest scores.

    Rows go by score, highest first, ties by ``keys``; those stay whose running share of exposure is
    ``fraction`` or less, or the first row alone if none is.  Rows are range-partitioned by that
    order and numbered by slice; sums of the slices give each its start, so no task sees more than
    its slice.
    """
    order = [F.col("s").desc(), *[F.col(f"k{i}") for i in range(len(keys))]]
    rows = df.select(
        F.col(score).alias("s"), F.col(outcome).cast("double").alias("y"), F.col(exposure).cast("double").alias("w"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
    )
    sliced = checkpointed(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    totals = sliced.groupBy("slice").agg(F.sum("w").alias("w"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select("slice", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("begin"), F.sum("w").over(everything).alias("total"))
    within = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(F.broadcast(starts), "slice").select(  # a row per partition
        "s", "y", "w", *[f"k{i}" for i in range(len(keys))],
        ((F.col("begin") + F.sum("w").over(within)) / F.greatest("total", F.lit(TOTAL_EPS))).alias("share"),
    )
    keep = F.col("share") <= fraction
    first = F.min_by(F.struct("y", "w"), F.struct(-F.col("s"), *[F.col(f"k{i}") for i in range(len(keys))]))
    sums = ranked.agg(
        F.count_if(keep).alias("n"), F.sum(F.when(keep, F.col("y"))).alias("kept"), F.sum(F.when(keep, F.col("w"))).alias("kept_w"),
        F.sum("y").alias("all"), first.alias("first"),
    )
    some = F.col("n") > 0
    return sums.select(
        F.when(some, F.col("n")).otherwise(1).alias("rows_kept"),
        F.when(some, F.col("kept_w")).otherwise(F.col("first.w")).alias("exposure_kept"),
        (F.when(some, F.col("kept")).otherwise(F.col("first.y")) / F.greatest("all", F.lit(TOTAL_EPS))).alias("capture"),
    )


def seen_before(test: DataFrame, prior: DataFrame, id_col: str = "insured_id") -> DataFrame:
    """``test`` with ``seen_before``: whether the id occurs in ``prior``.  Null ids never do."""
    ids = prior.select(F.col(id_col).alias("prior_id")).where("prior_id IS NOT NULL").distinct()
    return test.join(ids, F.col(id_col) == F.col("prior_id"), "left").withColumn("seen_before", F.col("prior_id").isNotNull()).drop("prior_id")


def segment_metrics(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """Totals and calibration by whether the id was seen, by business type and by age band, in one aggregation.

    ``rows`` has ``seen_before``; ``models`` maps a prediction to its actual total.  A null group is
    a group of its own, told from the other dimensions by its grouping id.
    """
    dims = ("seen_before_test", "business_type", "driver_age_band")
    rows = rows.withColumns(
        {dims[0]: F.when(F.col("seen_before"), "seen").otherwise("unseen"), dims[2]: age_band("driver_age")}
    )
    sums = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("rows"),
        *[F.sum(f"total_{c}").alias(c) for c in ("exposure", "claims", "incurred")],
        *[calibration(actual, m).alias(f"{m}_calibration_ratio") for m, actual in models.items()],
    )
    dimension = F.when(F.col("g") == 3, dims[0]).when(F.col("g") == 5, dims[1]).otherwise(dims[2])
    group = F.when(F.col("g") == 3, F.col(dims[0])).when(F.col("g") == 5, F.col(dims[1])).otherwise(F.col(dims[2]))
    return sums.select(
        dimension.alias("dimension"), F.coalesce(group, F.lit("nan")).alias("group"), "rows", "exposure", "claims", "incurred",
        *[f"{m}_calibration_ratio" for m in models],
    )


def id_transport(test: DataFrame, prior: DataFrame, id_col: str = "insured_id") -> DataFrame:
    """How many distinct test ids were seen before: one row."""
    ids = test.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    flagged = seen_before(ids, prior, id_col)
    seen = F.count_if("seen_before")
    return flagged.agg(
        F.count("*").alias("test_unique_ids"), seen.alias("seen"), (F.count("*") - seen).alias("unseen"),
        (seen / F.greatest(F.count("*"), F.lit(1))).alias("share_seen"),
    )


def coverage_decomposition(parts: DataFrame) -> DataFrame:
    """Claims and losses by coverage.

    ``parts`` has a row per policy and coverage: ``coverage``, ``premium``, ``exposure``, ``claims``,
    ``incurred``.  A coverage is held where its premium is positive; claims and losses count on all
    rows.
    """
    held = F.coalesce("premium", F.lit(0.0)) > 0
    sums = parts.groupBy("coverage").agg(
        F.count_if(held).alias("covered_rows"), F.sum(F.when(held, F.col("exposure")).otherwise(0.0)).alias("covered_exposure"),
        F.sum("claims").alias("claims"), F.sum("incurred").alias("incurred"),
    )
    everything = Window.partitionBy()
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(everything), F.lit(TOTAL_EPS))
    return sums.withColumns(
        {
            "claim_frequency": ratio("claims", "covered_exposure"), "loss_rate": ratio("incurred", "covered_exposure"),
            "claim_share": share("claims"), "incurred_share": share("incurred"),
        }
    )


def unpivot_coverages(df: DataFrame, columns: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """A row per policy and coverage; ``columns`` gives each its premium, exposure, claims and incurred columns."""
    cells = [F.struct(F.lit(c).alias("coverage"), *[F.col(x).alias(n) for n, x in zip(("premium", "exposure", "claims", "incurred"), xs)]) for c, xs in columns.items()]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def reconciliation(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Sums of the coverages less the totals, for claims and losses."""
    a = parts.agg(F.sum("claims").alias("pc"), F.sum("incurred").alias("pi"))
    b = totals.agg(F.sum("total_claims").alias("tc"), F.sum("total_incurred").alias("ti"))
    return a.crossJoin(b).select((F.col("pc") - F.col("tc")).alias("claims_gap"), (F.col("pi") - F.col("ti")).alias("incurred_gap"))


def tail_thresholds(df: DataFrame, loss: str = "total_incurred", quantiles: Sequence[float] = (0.99, 0.995)) -> DataFrame:
    """Exact quantiles of the positive losses: one row ``q0``, ``q1``, ..., null if there are none."""
    q = exact_quantiles(df.where(F.col(loss) > 0).select(F.col(loss).alias("value")), quantiles, ()).agg(F.first("q").alias("q"))
    return q.select(*[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(len(quantiles))])


def tail_summary(df: DataFrame, loss: str = "total_incurred") -> DataFrame:
    """The largest loss, positive losses, thresholds, and the share of the total at or above each."""
    rows = df.crossJoin(F.broadcast(tail_thresholds(df, loss)))  # one row
    total = F.greatest(F.sum(loss), F.lit(TOTAL_EPS))
    share = lambda q: F.sum(F.when(F.col(loss) >= F.col(q), F.col(loss)).otherwise(0.0)) / total
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col(loss) > 0).alias("positive_rows"), F.max(loss).alias("largest"),
        F.max("q0").alias("q99"), F.max("q1").alias("q995"), share("q0").alias("top_1pct_share"), share("q1").alias("top_05pct_share"),
    )


def tail_sensitivity(df: DataFrame, models: Sequence[str], loss: str = "total_incurred") -> DataFrame:
    """Per model and subset (all rows, without the top 0.5 %, without the top 1 %): deviance, calibration, error.

    A row belongs to every subset it qualifies for; only three numbers a model are carried along.
    """
    rows = df.select(loss, "total_exposure", *models).crossJoin(F.broadcast(tail_thresholds(df, loss)))
    subsets = F.filter(
        F.array(F.lit("all"), F.when(F.col(loss) < F.col("q1"), "without_top_05pct"), F.when(F.col(loss) < F.col("q0"), "without_top_1pct")),
        lambda s: s.isNotNull(),
    )
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models])
    rows = rows.select(loss, F.col("total_exposure").alias("w"), F.explode(subsets).alias("subset"), F.lit(cells).alias("cells"))
    rows = rows.select(loss, "w", "subset", F.inline("cells"))
    y = F.col(loss)
    return rows.groupBy("model", "subset").agg(
        F.count("*").alias("rows"),
        weighted_mean(tweedie_deviance(y / F.col("w"), F.col("pred")), "w").alias("tweedie_deviance"),
        (F.sum(F.col("pred") * F.col("w")) / F.greatest(F.sum(y), F.lit(TOTAL_EPS))).alias("calibration_ratio"),
        F.avg(F.abs(F.col("pred") * F.col("w") - y)).alias("mean_absolute_error"),
    )


def transport_points(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """(segment, model, rows, point): calibration in overlapping segments (all, seen or unseen, new business or renewed)."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred"), F.col(a).alias("actual")) for m, a in models.items()])
    long = rows.select(F.explode(transport_segments()).alias("segment"), F.col("total_exposure").alias("w"), cells.alias("cells"))
    long = long.select("segment", "w", F.inline("cells"))
    return long.groupBy("segment", "model").agg(
        F.count("*").alias("rows"), (F.sum(F.col("pred") * F.col("w")) / F.greatest(F.sum("actual"), F.lit(TOTAL_EPS))).alias("point")
    )


def transport_segments() -> Column:
    """The transport segments a row belongs to."""
    seen = F.when(F.col("seen_before"), "seen").otherwise("unseen")
    return F.filter(F.array(F.lit("all"), seen, F.concat(F.lit("business_"), F.col("business_type"))), lambda s: s.isNotNull())


def transport_pivot(points: DataFrame, models: Sequence[str]) -> DataFrame:
    """A row per segment, a column per model."""
    return points.groupBy("segment").pivot("model", list(models)).agg(F.first("point"))
