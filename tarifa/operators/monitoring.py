"""Telemetry of a scoring service, as aggregates over a table of scored requests.

A request row has ``window_id``, ``seq``, ``latency_ms``, ``error``, ``batch_size``, ``unseen`` (records
with a warning), ``freq_log_ratio`` and ``loss_log_ratio``.  Counters run since the window began;
percentiles cover the last ``LAST`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import PRIVACY_BOUNDARY, TOTAL_EPS

# The default alert limits.
THRESHOLDS = {
    "error_rate": 0.02,
    "unseen_category_rate": 0.01,
    "p95_latency_ms": 200.0,
    "frequency_abs_log_ratio_p95": 0.75,
    "pure_premium_abs_log_ratio_p95": 1.00,
    "max_feature_psi": 0.25,
    "min_feature_drift_records": 500,
}
LAST = 5000
ALERTS = ("error_rate", "unseen_category_rate", "p95_latency_ms", "frequency_disagreement", "pure_premium_disagreement", "feature_drift")


def last_rows(df: DataFrame, n: int = LAST, by: str = "window_id", order: str = "seq", salts: int = 64) -> DataFrame:
    """The last ``n`` rows of each window.  Parts of a window give their last ``n`` first, so none is sorted whole."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = Window.partitionBy(by, "salt").orderBy(F.col(order).desc())
    few = salted.withColumn("k", F.row_number().over(part)).where(F.col("k") <= n)
    whole = Window.partitionBy(by).orderBy(F.col(order).desc())
    return few.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= n).drop("k", "salt")


def percentile_or_zero(c: Column | str, q: float) -> Column:
    return F.coalesce(F.percentile(c, q), F.lit(0.0))


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def snapshot(requests: DataFrame, last: int = LAST) -> DataFrame:
    """One row of aggregates per window."""
    counters = requests.groupBy("window_id").agg(
        F.count("*").alias("request_count"), F.count_if("error").alias("error_count"),
        F.sum("batch_size").alias("records_scored"), F.sum("unseen").alias("unseen_warning_records"),
    )
    recent = last_rows(requests, last).groupBy("window_id").agg(
        percentile_or_zero("latency_ms", 0.5).alias("latency_median"), percentile_or_zero("latency_ms", 0.95).alias("latency_p95"),
        F.max("latency_ms").alias("latency_max"),
        percentile_or_zero("batch_size", 0.5).alias("batch_median"), percentile_or_zero("batch_size", 0.95).alias("batch_p95"),
        F.max("batch_size").alias("batch_max"),
        percentile_or_zero(F.abs("freq_log_ratio"), 0.5).alias("frequency_p50"),
        percentile_or_zero(F.abs("freq_log_ratio"), 0.95).alias("frequency_p95"),
        percentile_or_zero(F.abs("loss_log_ratio"), 0.5).alias("pure_premium_p50"),
        percentile_or_zero(F.abs("loss_log_ratio"), 0.95).alias("pure_premium_p95"),
    )
    rates = counters.withColumns(
        {
            "error_rate": share(F.col("error_count"), F.col("request_count")),
            "unseen_category_rate": share(F.col("unseen_warning_records"), F.col("records_scored")),
            "privacy_boundary": F.lit(PRIVACY_BOUNDARY),
        }
    )
    return rates.join(recent, "window_id")


def with_alerts(snapshots: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Snapshots (with ``max_psi``, or without drift evidence) with one boolean per rule and ``alert_status``.

    Every rule is a strict excess; drift needs enough records to count.
    """
    t = thresholds
    psi = F.coalesce("max_psi", F.lit(0.0)) if "max_psi" in snapshots.columns else F.lit(0.0)
    rules = {
        "error_rate": F.col("error_rate") > t["error_rate"],
        "unseen_category_rate": F.col("unseen_category_rate") > t["unseen_category_rate"],
        "p95_latency_ms": F.col("latency_p95") > t["p95_latency_ms"],
        "frequency_disagreement": F.col("frequency_p95") > t["frequency_abs_log_ratio_p95"],
        "pure_premium_disagreement": F.col("pure_premium_p95") > t["pure_premium_abs_log_ratio_p95"],
        "feature_drift": (F.col("records_scored") >= t["min_feature_drift_records"]) & (psi > t["max_feature_psi"]),
    }
    out = snapshots.withColumns({f"alert_{k}": v for k, v in rules.items()})
    status = F.when(F.exists(F.array(*[F.col(f"alert_{k}") for k in rules]), lambda x: x), "RED").otherwise("GREEN")
    return out.withColumn("alert_status", status)


def active_alerts() -> Column:
    """The sorted names of the alerts that are on."""
    return F.array_sort(F.filter(F.array(*[F.when(F.col(f"alert_{k}"), k) for k in ALERTS]), lambda x: x.isNotNull()))


def disagreement_shift(snapshots: DataFrame, base: str, comparison: str) -> DataFrame:
    """How two windows' disagreement compares: ratios of the 95th percentiles, and relative alerts."""
    cols = ("frequency_p95", "pure_premium_p95")
    of = lambda w, p: snapshots.where(F.col("window_id") == w).select(*[F.col(c).alias(f"{p}_{c}") for c in cols])
    rows = of(base, "base").crossJoin(of(comparison, "cmp"))  # one row each
    for c in cols:
        b, x = F.col(f"base_{c}"), F.col(f"cmp_{c}")
        rows = rows.withColumns(
            {f"{c}_ratio": x / F.greatest(b, F.lit(TOTAL_EPS)), f"{c}_alert": x > F.greatest(1.5 * b, b + 0.10)}
        )
    return rows


def replay_acceptance(windows: DataFrame, control: str = "control", stress: str = "stress") -> DataFrame:
    """(check, passed): whether replays show what they should, and ``accepted``, whether all do.

    ``windows`` are snapshots with alerts, a row per replay: the control is green, stress sets off errors, unseen
    categories, drift and both relative disagreement alerts, and every replay reports aggregates only.  What
    a replay lacks isn't passed.
    """
    of = lambda w, c: F.bool_or(F.when(F.col("window_id") == w, c))
    shift = disagreement_shift(windows, control, stress).select(*[F.col(f"{c}_alert") for c in ("frequency_p95", "pure_premium_p95")])
    shift = shift.agg(*[F.bool_or(c).alias(c) for c in shift.columns])  # one row, also where a replay lacks
    rows = windows.agg(
        of(control, F.col("alert_status") == "GREEN").alias("control_green"), F.bool_and(F.col("privacy_boundary") == PRIVACY_BOUNDARY).alias("aggregates_only"),
        *[of(stress, F.col(f"alert_{a}")).alias(f"stress_{a}") for a in ("error_rate", "unseen_category_rate", "feature_drift")],
    ).crossJoin(F.broadcast(shift))
    rows = rows.withColumnsRenamed({"frequency_p95_alert": "frequency_shift", "pure_premium_p95_alert": "pure_premium_shift"})
    cells = [F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for c in rows.columns]
    return rows.select(F.array(*cells).alias("cells")).select(
        F.inline(F.concat("cells", F.array(F.struct(F.lit("accepted").alias("check"), F.forall("cells", lambda c: c["passed"]).alias("passed")))))
    )


def stressed(records: DataFrame, changes: dict[str, object]) -> DataFrame:
    """Records with fields overwritten, for a stress replay."""
    return records.withColumns({k: F.lit(v) for k, v in changes.items()})


def micro_batches(df: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """(batch, rows, first, last): rows in order, dealt to batches of ``size``.

    Ranks come from counts per slice of a range partitioning, so the order is never one task's work.
    """
    from ..session import checkpointed

    sliced = checkpointed(df.select(order).repartitionByRange(order).withColumn("slice", F.spark_partition_id()))
    counts = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    begin = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("slice", begin.alias("begin")))  # a row per partition
    rank = F.col("begin") + F.row_number().over(Window.partitionBy("slice").orderBy(order)) - 1
    batches = sliced.join(starts, "slice").withColumn("batch", F.floor(rank / size))
    return batches.groupBy("batch").agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the ones whose hashed integer keys are smallest; ties by the key."""
    from ..functions.exprs import lcg

    return df.orderBy(lcg(F.col(key), seed), key).limit(n)
