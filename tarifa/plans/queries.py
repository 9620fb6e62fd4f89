"""The query catalogue: every operator over the test tables.

Each query takes (spark, sf_dir).  ``oracle.SQL`` has the same rows in SQL.  Results are rounded here,
never inside operators: sums of money to cents, rates and deviances to six digits.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..contracts import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES, canonical
from ..functions import exprs as X
from ..operators import drift, governance, metrics, models, monitoring, resample, review
from ..session import checkpoint_folder, checkpointed
from ..sources.sinks import artifact_table, write_blocks, write_csv, write_json_document, write_policy_table
from ..sources.policy import (
    COVERAGES, ROW_KEY, containers, date_range, delimited, json_document, missing_audit, policy_year, read, renewal_audit, renewals, require_columns, usable_years, valid_policy_years,
    valid_renewals, value_counts,
)
from ..streaming import monitor
from ..streaming.sinks import batches, write_once
from ..streaming.telemetry import review_stream

TRAIN, CALIBRATION, TEST = 1999, 2000, 2001
MODELS = {"glm_freq": "total_claims", "xgb_freq": "total_claims", "glm_loss": "total_incurred", "xgb_loss": "total_incurred"}
NUMERIC, CATEGORIES = ("driver_age", "vehicle_value", "seats"), ("business_type", "vehicle_brand", "policy_type")

#: Rounds and learning rate of the boosted models in the queries; the catalogue's are 450 and 500 at 0.035 and 0.03.
BOOSTED = {"rounds": 50, "learning_rate": 0.3}


def rounded(df: DataFrame, money: tuple[str, ...] = (), rates: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in money} | {c: F.round(c, 6) for c in rates})


def years(spark: SparkSession, sf_dir: str, *wanted: int) -> DataFrame:
    """The analog's valid rows of some adjacent years; the time bounds reach the scan."""
    rows = policy_year(spark, sf_dir)
    first, last = f"{min(wanted)}-01-01", f"{max(wanted) + 1}-01-01"
    bound = (F.col("ship_ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ship_ts") < F.lit(last).cast("timestamp_ntz"))
    return valid_policy_years(rows.where(bound), wanted)


def row_number_key():
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")


def locked_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    scales = metrics.locked_scales(years(spark, sf_dir, CALIBRATION), MODELS)
    return metrics.with_locked(years(spark, sf_dir, TEST), scales, list(MODELS))


def year_summary(spark, sf_dir):
    out = metrics.year_summary(years(spark, sf_dir, TRAIN, CALIBRATION, TEST))
    return rounded(out, ("exposure", "claims", "incurred", "premium"), ("claim_frequency", "pure_premium", "observed_loss_ratio"))


def _audited(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return rows.select(*[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey")], F.when(F.col("o_orderkey") % 7 == 0, "NA").when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def schema_audit(spark, sf_dir):
    return rounded(missing_audit(_audited(spark, sf_dir)), rates=("rate",))


def audit_year_counts(spark, sf_dir):
    return value_counts(read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year")), "year")


def temporal_split_counts(spark, sf_dir):
    rows = years(spark, sf_dir, TRAIN, CALIBRATION, TEST)
    split = F.when(F.col("year") == TRAIN, "train").when(F.col("year") == CALIBRATION, "calibration").otherwise("test")
    usable = F.broadcast(usable_years(rows, "year", 1000).select("year"))  # a row per year
    return rows.join(usable, "year", "left_semi").groupBy(split.alias("split")).agg(F.count("*").alias("rows"))


def _renewals(spark, sf_dir) -> DataFrame:
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("ID"), day("o_orderdate").alias("Date_last_renewal"), day("l_shipdate").alias("Date_next_renewal"),
        F.when(F.col("l_linenumber") == 3, F.lit("31/12/1998")).when(F.col("l_linenumber") == 4, F.lit("32/13/1998")).alias("Date_lapse"),
        F.col("l_linenumber").cast("string").alias("N_claims_year"), F.col("l_extendedprice").cast("string").alias("Cost_claims_year"),
    )
    return renewals(rows)


def exposure_from_dates(spark, sf_dir):
    out = metrics.renewal_summary(valid_renewals(_renewals(spark, sf_dir)))
    return rounded(out, ("exposure", "claims", "loss"), ("claim_frequency", "pure_premium"))


def exposure_audit(spark, sf_dir):
    return renewal_audit(_renewals(spark, sf_dir))


def renewal_dates(spark, sf_dir):
    return date_range(_renewals(spark, sf_dir), "renewal_date").withColumn("years", F.concat_ws(",", "years"))


def locked_scale(spark, sf_dir):
    out = metrics.locked_scales(years(spark, sf_dir, CALIBRATION), MODELS)
    return rounded(out, rates=tuple(out.columns))


def calibration_ratio(spark, sf_dir):
    rows = locked_test(spark, sf_dir)
    return rows.agg(
        *[F.round(metrics.calibration(a, m), 6).alias(f"{m}_raw") for m, a in MODELS.items()],
        *[F.round(metrics.calibration(a, f"{m}_locked"), 6).alias(f"{m}_locked") for m, a in MODELS.items()],
    )


def _deviances(rows: DataFrame) -> DataFrame:
    return metrics.deviances(rows, ("glm_freq_locked", "xgb_freq_locked"), ("glm_loss_locked", "xgb_loss_locked"))


def locked_deviances(spark, sf_dir):
    return rounded(_deviances(locked_test(spark, sf_dir)), rates=("deviance", "calibration_ratio"))


def top10_capture(spark, sf_dir):
    out = metrics.top_capture(years(spark, sf_dir, TEST), "glm_freq", "total_claims", "total_exposure", ROW_KEY)
    return rounded(out, ("exposure_kept",), ("capture",))


def _seen(spark, sf_dir, rows: DataFrame) -> DataFrame:
    prior = policy_year(spark, sf_dir).where(F.col("year").isin(TRAIN, CALIBRATION)).select("insured_id")
    return metrics.seen_before(rows, prior)


def segment_calibration(spark, sf_dir):
    out = metrics.segment_metrics(_seen(spark, sf_dir, locked_test(spark, sf_dir)), {f"{m}_locked": a for m, a in MODELS.items()})
    return rounded(out, ("exposure", "claims", "incurred"), tuple(f"{m}_locked_calibration_ratio" for m in MODELS))


def id_transport(spark, sf_dir):
    return rounded(metrics.id_transport(years(spark, sf_dir, TEST), years(spark, sf_dir, TRAIN, CALIBRATION)), rates=("share_seen",))


def _coverages(spark, sf_dir) -> DataFrame:
    """Wide, as the source has them: four columns a coverage, then one row per policy and coverage."""
    rows, wide = years(spark, sf_dir, TEST), {}
    for k, c in enumerate(COVERAGES, 1):
        own = F.col("line_no") == k
        exposure = F.when(own, F.col("total_exposure") / 2).otherwise(0.0) if k == 1 else F.when(own, F.col("total_exposure")).otherwise(0.0)
        wide |= {f"{c}_exposure": exposure} | {f"{c}_{x}": F.when(own, F.col(f"total_{x}")).otherwise(0.0) for x in ("premium", "claims", "incurred")}
    names = {c: tuple(f"{c}_{x}" for x in ("premium", "exposure", "claims", "incurred")) for c in COVERAGES}
    return metrics.unpivot_coverages(rows.select(*[v.alias(k) for k, v in wide.items()]), names)


def coverage_decomposition(spark, sf_dir):
    out = metrics.coverage_decomposition(_coverages(spark, sf_dir))
    return rounded(out, ("covered_exposure", "claims", "incurred"), ("claim_frequency", "loss_rate", "claim_share", "incurred_share")).orderBy(F.desc("incurred"))


def coverage_reconciliation(spark, sf_dir):
    out = metrics.reconciliation(_coverages(spark, sf_dir), years(spark, sf_dir, TEST))
    return out.select(*[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in out.columns])


def tail_summary(spark, sf_dir):
    out = metrics.tail_summary(years(spark, sf_dir, TEST))
    return rounded(out, ("largest", "q99", "q995"), ("top_1pct_share", "top_05pct_share"))


def tail_sensitivity(spark, sf_dir):
    out = metrics.tail_sensitivity(locked_test(spark, sf_dir), ("glm_loss_locked", "xgb_loss_locked"))
    return rounded(out, rates=("tweedie_deviance", "calibration_ratio", "mean_absolute_error"))


def _transport(spark, sf_dir) -> DataFrame:
    rows = _seen(spark, sf_dir, locked_test(spark, sf_dir))
    return metrics.transport_points(rows, {f"{m}_locked": a for m, a in MODELS.items()})


def transport_points(spark, sf_dir):
    return rounded(_transport(spark, sf_dir), rates=("point",))


def transport_pivot(spark, sf_dir):
    out = metrics.transport_pivot(_transport(spark, sf_dir), [f"{m}_locked" for m in MODELS])
    closer = governance.closer(out, "glm_freq_locked", "xgb_freq_locked")
    return rounded(closer, rates=tuple(f"{m}_locked" for m in MODELS))


#: The pairs whose deviances a bootstrap compares: reference and challenger of each target.
PAIRS = {"frequency": ("glm_freq", "xgb_freq"), "loss": ("glm_loss", "xgb_loss")}
#: Replicates of the locked comparison, of each window and of the transport ratios.
REPS, WINDOW_REPS, RATIO_REPS = 250, 200, 300


def _boot(rows: DataFrame, reps: int, groups=None, draw=resample.replicates) -> DataFrame:
    """(group, pair, x): the replicates' differences of deviances."""
    w = F.col("total_exposure")
    unit = {"frequency": (X.poisson_deviance, F.col("total_claims") / w), "loss": (X.tweedie_deviance, F.col("total_incurred") / w)}
    pairs = {n: tuple(unit[n][0](unit[n][1], m) for m in models) for n, models in PAIRS.items()}
    frame = resample.deviance_differences(rows, pairs, row_number_key(), reps, groups=groups, draw=draw)
    return frame.select("group", F.inline(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(n).alias("x")) for n in PAIRS])))


_INTERVAL = ("mean", "ci95_low", "ci95_high", "p_gt_0")


def bootstrap_deviance_ci(spark, sf_dir):
    return rounded(resample.summary(_boot(years(spark, sf_dir, TEST), REPS), "x", ("pair",)), rates=_INTERVAL)


def bootstrap_ratio_ci(spark, sf_dir):
    """Calibration of every model in every (overlapping) transport segment."""
    rows = _seen(spark, sf_dir, locked_test(spark, sf_dir))
    models = {f"{m}_locked": (F.col(f"{m}_locked") * F.col("total_exposure"), F.col(a)) for m, a in MODELS.items()}
    frame = resample.ratios(rows, models, row_number_key(), metrics.transport_segments(), RATIO_REPS, 2027)
    return rounded(resample.summary(frame.withColumnRenamed("group", "segment"), "ratio", ("segment", "model")), rates=_INTERVAL)


def multinomial_deviance_ci(spark, sf_dir):
    """The locked comparison with replicates of exactly as many draws as there are rows."""
    rows = years(spark, sf_dir, TEST)
    return rounded(resample.summary(_boot(rows, REPS, draw=resample.fixed_replicates), "x", ("pair",)), rates=_INTERVAL)


def multinomial_ratio_ci(spark, sf_dir):
    """Calibration of every model in every transport segment, each segment resampled to its own size."""
    rows = _seen(spark, sf_dir, locked_test(spark, sf_dir))
    models = {f"{m}_locked": (F.col(f"{m}_locked") * F.col("total_exposure"), F.col(a)) for m, a in MODELS.items()}
    frame = resample.ratios(rows, models, row_number_key(), metrics.transport_segments(), RATIO_REPS, 2027, resample.fixed_replicates)
    return rounded(resample.summary(frame.withColumnRenamed("group", "segment"), "ratio", ("segment", "model")), rates=_INTERVAL)


def _windows_ci(spark, sf_dir) -> DataFrame:
    """(test_year, pair, interval): every year but the first, all in one pass."""
    rows = years(spark, sf_dir, *[test for _, test in models.rolling_windows([TRAIN, CALIBRATION, TEST])])
    found = resample.summary(_boot(rows, WINDOW_REPS, F.array(F.col("year").cast("string"))), "x", ("group", "pair"))
    return found.select(F.col("group").cast("int").alias("test_year"), F.col("pair").alias("target"), *_INTERVAL)


def rolling_origin(spark, sf_dir):
    """Each year tested with raw predictions, with the interval of the challenger's gain in the window."""
    out = None
    for train, test in models.rolling_windows([TRAIN, CALIBRATION, TEST]):
        rows = metrics.deviances(years(spark, sf_dir, test), ("glm_freq", "xgb_freq"), ("glm_loss", "xgb_loss"))
        n = years(spark, sf_dir, *train).agg(F.count("*").alias("n_train"))
        rows = rows.crossJoin(F.broadcast(n)).withColumns({"train_years": F.lit(",".join(map(str, train))), "test_year": F.lit(test)})
        out = rows if out is None else out.unionByName(rows)
    out = governance.cohort_diagnostic(out).join(_windows_ci(spark, sf_dir), ["test_year", "target"])
    return rounded(out, rates=("deviance", "calibration_ratio", *_INTERVAL))


def locked_gate(spark, sf_dir):
    boot = bootstrap_deviance_ci(spark, sf_dir).select(F.when(F.col("pair") == "frequency", "frequency").otherwise("loss").alias("target"), "ci95_low")
    challengers = _deviances(locked_test(spark, sf_dir)).where(F.col("model").startswith("xgb")).select("target", "calibration_ratio")
    gates = governance.locked_gate(challengers.join(boot, "target"))
    overall = F.broadcast(governance.promotion(gates))  # one row
    return rounded(gates.crossJoin(overall), rates=("calibration_ratio",))


def approval_gates(spark, sf_dir):
    """The seven gates of the decision, from the locked and rolling intervals, transport, deviances and complexity."""
    locked = bootstrap_deviance_ci(spark, sf_dir).agg(*[F.bool_and(F.when(F.col("pair") == n, F.col("ci95_low") > 0)).alias(f"locked_{n}") for n in PAIRS])
    rolling = _windows_ci(spark, sf_dir).agg(*[F.bool_and(F.when(F.col("target") == n, F.col("ci95_low") > 0)).alias(f"rolling_{n}") for n in PAIRS])
    nearer = F.when(F.abs(F.col("xgb_loss_locked") - 1) < F.abs(F.col("glm_loss_locked") - 1), "xgb_loss").otherwise("glm_loss")
    winners = transport_pivot(spark, sf_dir).where(F.col("segment").isin("seen", "unseen")).agg((F.count_distinct(nearer) == 1).alias("transport_consistent"))
    of = lambda m, c: F.max(F.when(F.col("model") == f"{m}_locked", F.col(c)))
    deviance = _deviances(locked_test(spark, sf_dir)).agg((of("xgb_loss", "deviance") < of("glm_loss", "deviance")).alias("lower_loss_deviance"))
    cost = _complexity(spark).agg((of("xgb_loss", "terms") > of("glm_loss", "terms")).alias("complexity"))
    rows = locked
    for part in (rolling, winners, deviance, cost):
        rows = rows.crossJoin(F.broadcast(part))  # one row each
    table = rows.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in governance.RECORDED])))
    return governance.approval(table)


def baseline_numeric(spark, sf_dir):
    out = drift.numeric_baseline(years(spark, sf_dir, TRAIN), NUMERIC)
    cut = F.get("cuts", F.col("ordinal"))
    return out.select("feature", "ordinal", F.round(cut, 6).alias("cut"), F.round("expected", 6).alias("expected"))


def baseline_categorical(spark, sf_dir):
    return rounded(drift.categorical_baseline(years(spark, sf_dir, TRAIN), CATEGORIES), rates=("expected",))


def _psi(spark, sf_dir) -> DataFrame:
    train, now = years(spark, sf_dir, TRAIN), years(spark, sf_dir, TEST)
    n, c = drift.numeric_baseline(train, NUMERIC), drift.categorical_baseline(train, CATEGORIES)
    counts = drift.numeric_counts(now, n, NUMERIC).unionByName(drift.categorical_counts(now, c, CATEGORIES))
    return drift.feature_psi(counts, drift.as_buckets(n, c))


def feature_psi(spark, sf_dir):
    return rounded(_psi(spark, sf_dir), rates=("psi",))


def largest_psi(spark, sf_dir):
    return rounded(drift.largest(_psi(spark, sf_dir), (*NUMERIC, *CATEGORIES)), rates=("max_psi",))


def unseen_category_rate(spark, sf_dir):
    """Test records, and the same with a brand that training never saw."""
    levels = models.Preprocessor((), CATEGORIES).fit(years(spark, sf_dir, TRAIN)).levels  # part of a model: its categories
    rows = years(spark, sf_dir, TEST)
    rows = rows.unionByName(monitoring.stressed(rows, {"vehicle_brand": "NEVER_SEEN"})).withColumn("warnings", X.unseen_warnings(CATEGORIES, levels))
    flagged = F.count_if(F.size("warnings") > 0)
    return rows.agg(F.count("*").alias("rows"), flagged.alias("flagged"), F.round(monitoring.share(flagged, F.count("*")), 6).alias("rate"))


def _requests(spark, sf_dir, releases: int = 0) -> DataFrame:
    """Events read as scored requests, a window per day, or per release and day."""
    n, day = F.get_json_object("props", "$.k").cast("long"), F.date_format("ts", "yyyy-MM-dd")
    window = F.concat(F.lit("r"), (F.col("event_id") % releases).cast("string"), F.lit("|"), day) if releases else day
    return read(spark, sf_dir, "events").select(
        window.alias("window_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"), n.alias("batch_size"),
        F.when(n % 17 == 0, 1).otherwise(0).alias("unseen"), F.log((F.col("value") + 100) / 250).alias("freq_log_ratio"),
        F.log((F.col("value") + 50) / 200).alias("loss_log_ratio"),
    )


_RATES = ("error_rate", "unseen_category_rate", "latency_median", "latency_p95", "latency_max", "batch_median", "batch_p95", "frequency_p50", "frequency_p95", "pure_premium_p50", "pure_premium_p95")
#: Limits under which the events pass through all review states.
LIMITS = monitoring.THRESHOLDS | {"error_rate": 0.20, "unseen_category_rate": 0.06, "p95_latency_ms": 472.0, "frequency_abs_log_ratio_p95": 0.9, "pure_premium_abs_log_ratio_p95": 1.3}


def monitoring_snapshot(spark, sf_dir):
    return rounded(monitoring.snapshot(_requests(spark, sf_dir)), rates=_RATES)


def _alerts(requests: DataFrame, first: str = "right(window_id, 10) < '2024-01-08'") -> DataFrame:
    """The windows' aggregates and alerts, with drift from those of ``first``: the first week."""
    rows = requests.withColumnsRenamed({"latency_ms": "latency", "batch_size": "batch"})
    base = drift.numeric_baseline(rows.where(first), ("latency", "batch"))
    counts = drift.numeric_counts(rows, base, ("latency", "batch"), ("window_id",))
    psi = drift.feature_psi(counts, drift.as_buckets(base, None), ("window_id",))
    top = drift.largest(psi, ("latency", "batch"), ("window_id",))
    snaps = monitoring.snapshot(requests).join(top, "window_id", "left")
    return monitoring.with_alerts(snaps, LIMITS)


def monitoring_alerts(spark, sf_dir):
    out = _alerts(_requests(spark, sf_dir)).select("window_id", "max_psi", "max_psi_feature", *[f"alert_{a}" for a in monitoring.ALERTS], "alert_status")
    return rounded(out, rates=("max_psi",))


def stream_monitor(spark, sf_dir):
    """The streaming monitor fed the events of four releases week by week, reset at every week's begin: its alerts after each week."""
    rows = _requests(spark, sf_dir, RELEASES)
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    rows = rows.withColumns({"service": F.substring_index("window_id", "|", 1), "week": week, "latency": F.col("latency_ms"), "batch": F.col("batch_size")})
    first = F.min(F.struct("week", "seq")).over(Window.partitionBy("service", "week"))
    rows = checkpointed(rows.withColumn("reset", F.col("seq") == first["seq"]).drop("window_id"))
    base = drift.numeric_baseline(rows.where("week < '2024-01-08'"), ("latency", "batch"))
    baseline = monitor.Baseline.collected(base, None, ("latency", "batch"))
    folder = f"{checkpoint_folder(spark)}/monitor-{uuid.uuid4().hex}"
    weeks = [r.week for r in rows.select("week").distinct().orderBy("week").collect()]  # a row a week
    for week in weeks:  # each week comes as new files, to a stream that starts again where it stopped
        rows.where(F.col("week") == week).write.mode("append").parquet(f"{folder}/in")
        found = monitor.monitor(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), baseline, LIMITS)
        writer = found.writeStream.foreachBatch(lambda batch, k: write_once(batch, k, f"{folder}/out")).outputMode("update")
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    label = F.concat_ws("|", "service", F.element_at(F.array(*map(F.lit, weeks)), F.col("batch") + 1))
    counters = ("request_count", "error_count", "records_scored", "unseen_warning_records")
    out = batches(spark, f"{folder}/out").select(label.alias("window_id"), *counters, "max_psi", "max_psi_feature", *[f"alert_{a}" for a in monitoring.ALERTS], "alert_status")
    return rounded(out, rates=("max_psi",))


def replay_acceptance(spark, sf_dir):
    """The first week as control, the rest as later data, and the first week under stress."""
    rows = _requests(spark, sf_dir)
    early = F.col("window_id") < "2024-01-08"
    control = rows.where(early).withColumn("window_id", F.lit("control"))
    stress = control.withColumns(
        {
            "window_id": F.lit("stress"), "latency_ms": F.col("latency_ms") * 3, "error": F.col("seq") % 2 == 0, "unseen": F.col("batch_size"),
            "freq_log_ratio": F.abs("freq_log_ratio") + 2, "loss_log_ratio": F.abs("loss_log_ratio") + 2,
        }
    )
    replays = control.unionByName(rows.where(~early).withColumn("window_id", F.lit("temporal"))).unionByName(stress)
    return monitoring.replay_acceptance(_alerts(replays, "window_id = 'control'"))


def disagreement_shift(spark, sf_dir):
    out = monitoring.disagreement_shift(monitoring.snapshot(_requests(spark, sf_dir)), "2024-01-01", "2024-01-15")
    return rounded(out, rates=tuple(c for c in out.columns if not c.endswith("_alert")))


#: Releases and chains that the review queries run side by side.
RELEASES = 4


def review_lifecycle(spark, sf_dir):
    """Every release's daily windows through the states of review."""
    alerts = _alerts(_requests(spark, sf_dir, RELEASES)).withColumns({"release_id": F.substring_index("window_id", "|", 1), "label": F.substring_index("window_id", "|", -1), "active_alerts": monitoring.active_alerts()})
    windows = review.with_evidence(alerts, "window_id", "request_count", "error_count", "records_scored", "unseen_warning_records")
    return review.lifecycle(windows).withColumn("active_alerts", F.concat_ws(",", "active_alerts"))


def _review_windows(spark, sf_dir) -> DataFrame:
    """Every release's daily windows with alerts and the digest of their full evidence, values rounded to six digits."""
    alerts = _alerts(_requests(spark, sf_dir, RELEASES)).withColumns({"release_id": F.substring_index("window_id", "|", 1), "label": F.substring_index("window_id", "|", -1), "active_alerts": monitoring.active_alerts()})
    six = {f: F.round(c, 6) for f, c in (("error_rate", "error_rate"), ("unseen_category_rate", "unseen_category_rate"), ("p95_latency_ms", "latency_p95"), ("frequency_abs_log_ratio_p95", "frequency_p95"), ("pure_premium_abs_log_ratio_p95", "pure_premium_p95"), ("max_feature_psi", "max_psi"))}
    eligible = F.col("records_scored") >= LIMITS["min_feature_drift_records"]
    return review.aggregate_evidence(alerts, max_feature_psi_feature="max_psi_feature", feature_drift_alert_eligible=eligible, **six)


def review_evidence(spark, sf_dir):
    """The aggregate evidence of every release's daily windows, and its digest."""
    return _review_windows(spark, sf_dir).select("release_id", "label", "evidence", "evidence_sha256")


def review_replay(spark, sf_dir):
    """The lifecycle replayed as a stream twice, in one go and stopped half-way and started again: both give each event once, the batch's."""
    windows = checkpointed(_review_windows(spark, sf_dir).select("release_id", "label", "active_alerts", "evidence_sha256"))
    half = windows.agg(F.percentile_approx(F.to_date("label"), 0.5).cast("string").alias("half")).first().half
    replays = []
    for name, parts in (("whole", [F.lit(True)]), ("restarted", [F.col("label") <= half, F.col("label") > half])):
        folder = f"{checkpoint_folder(spark)}/replay-{uuid.uuid4().hex}"
        for part in parts:
            windows.where(part).write.mode("append").parquet(f"{folder}/in")
            stream = review_stream(spark.readStream.schema(windows.schema).parquet(f"{folder}/in"))
            writer = stream.writeStream.foreachBatch(lambda batch, k, to=folder: write_once(batch, k, f"{to}/out")).outputMode("append")
            writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        replays.append(batches(spark, f"{folder}/out").withColumn("replay", F.lit(name)))
    events = replays[0].unionByName(replays[1]).groupBy("release_id", "sequence", "label", "state", "review_id_after").agg(
        F.count_if(F.col("replay") == "whole").alias("whole"), F.count_if(F.col("replay") == "restarted").alias("restarted")
    )
    batch = review.lifecycle(windows).select("release_id", "sequence", F.lit(True).alias("in_batch"), *[F.col(c).alias(f"b_{c}") for c in ("state", "review_id_after")])
    same = F.coalesce(F.col("state").eqNullSafe(F.col("b_state")) & F.col("review_id_after").eqNullSafe(F.col("b_review_id_after")), F.lit(False))
    return events.join(batch, ["release_id", "sequence"], "left").select("release_id", "sequence", "label", "state", "review_id_after", "whole", "restarted", same.alias("as_batch"))


def event_chain_verify(spark, sf_dir):
    """Chains of daily control events, each with one changed payload and one changed link."""
    daily = _requests(spark, sf_dir, RELEASES).groupBy("window_id").agg(F.count("*").alias("n"))
    day = F.dayofmonth(F.to_date(F.substring_index("window_id", "|", -1))).cast("long")
    events = daily.select(F.substring_index("window_id", "|", 1).alias("chain"), day.alias("sequence"), F.concat_ws(":", "window_id", F.col("n").cast("string")).alias("payload"))
    chain = governance.hash_chain(events).withColumns(
        {
            "payload": F.when(F.col("sequence") == 5, "changed").otherwise(F.col("payload")),
            "previous_sha256": F.when(F.col("sequence") == 9, "changed").otherwise(F.col("previous_sha256")),
        }
    )
    return governance.verify_chain(chain)


def artifact_differences(spark, sf_dir):
    """Artifacts whose hashes differ between two lists, or that one of them lacks."""
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), "p_partkey", "p_name")
    locked = part.where("p_partkey % 11 != 0").select("path", F.sha2("p_name", 256).alias("sha256"))
    found = part.where("p_partkey % 13 != 0").select("path", F.sha2(F.when(F.col("p_partkey") % 7 == 0, F.lit("changed")).otherwise(F.col("p_name")), 256).alias("sha256"))
    return governance.map_differences(locked, found)


#: What the statements of ``attestation_predicates`` are held against.
EXPECTED = {
    "repository": "acme/pricing", "workflow_name": "release", "workflow_path": ".github/workflows/release.yml", "workflow_repository": "https://github.com/acme/pricing",
    "predicate_type": "https://slsa.dev/provenance/v1", "build_type": "https://actions.github.io/buildtypes/workflow/v1",
}


def attestation_predicates(spark, sf_dir):
    """Artifacts beside nested provenance statements, some of another repository or workflow, unsigned, of a short commit, without a subject, or double."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # a row is a document of some kB: few bytes of input are much work
    part = part.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256"), F.sha1("p_name").alias("commit"), F.col("p_partkey").alias("k"))
    every = lambda n, odd, usual: F.when(F.col("k") % n == 0, odd).otherwise(usual)
    named = lambda **c: F.struct(*[(x if not isinstance(x, str) else F.lit(x)).alias(n) for n, x in c.items()])
    subject = F.array(named(name="something else", digest=named(sha256="00")), named(name=F.col("path"), digest=named(sha256=F.col("sha256"))))
    definition = named(buildType=EXPECTED["build_type"], externalParameters=named(workflow=named(path=every(5, "other.yml", EXPECTED["workflow_path"]), repository=EXPECTED["workflow_repository"])))
    certificate = named(githubWorkflowRepository=every(3, "other/pricing", EXPECTED["repository"]), githubWorkflowName=EXPECTED["workflow_name"], sourceRepositoryDigest=every(11, F.substring("commit", 1, 39), F.col("commit")))
    statement = named(subject=every(13, F.slice(subject, 1, 1), subject), predicateType=EXPECTED["predicate_type"], predicate=named(buildDefinition=definition))
    stamps = every(7, F.array().cast("array<long>"), F.array("k"))
    body = F.to_json(named(verificationResult=named(statement=statement, signature=named(certificate=certificate), verifiedTimestamps=stamps)))
    copies = F.explode(every(17, F.array(F.lit("1"), F.lit("2")), F.array(F.lit("1"))))
    statements = part.select("path", body.alias("body"), copies.alias("copy")).select(F.concat_ws("#", "path", "copy").alias("statement_id"), "body")
    return governance.attested(part.select("path", "sha256"), governance.provenance_predicates(statements, EXPECTED))


def _policy_table(spark, sf_dir) -> DataFrame:
    """The three years' valid rows in folders by year and buckets by id."""
    rows = years(spark, sf_dir, TRAIN, CALIBRATION, TEST).select("insured_id", "year", *[f"total_{c}" for c in ("exposure", "claims", "incurred", "premium")])
    name = f"policy_years_{uuid.uuid4().hex}"
    return write_policy_table(rows, name, f"{checkpoint_folder(spark)}/{name}")


def bucketed_year_summary(spark, sf_dir):
    """The year summary from a bucketed table: distinct ids without a shuffle of ids."""
    return rounded(metrics.year_summary(_policy_table(spark, sf_dir)), ("exposure", "claims", "incurred", "premium"), ("claim_frequency", "pure_premium", "observed_loss_ratio"))


def bucketed_seen(spark, sf_dir):
    """The test year's rows by whether their id was seen before, from a bucketed table: a join without a shuffle of ids."""
    table = _policy_table(spark, sf_dir)
    rows = metrics.seen_before(table.where(F.col("year") == TEST), table.where(F.col("year").isin(TRAIN, CALIBRATION)).select("insured_id"))
    return rounded(rows.groupBy("seen_before").agg(F.count("*").alias("rows"), F.sum("total_exposure").alias("exposure")), ("exposure",))


def _new_path(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delimited_year_summary(spark, sf_dir):
    """The year summary of a semicolon-delimited export of the policy years, read as text, pruned to what it needs."""
    path, rows = _new_path(spark, "policies"), policy_year(spark, sf_dir)
    needed = ["insured_id", "year", "total_exposure", "total_claims", "total_incurred", "total_premium"]
    write_csv(rows.select("business_type", *needed, "policy_type"), path, sep=";")
    table = require_columns(delimited(spark, path, columns=needed), *needed)
    out = metrics.year_summary(valid_policy_years(table, (TRAIN, CALIBRATION, TEST)))
    return rounded(out, ("exposure", "claims", "incurred", "premium"), ("claim_frequency", "pure_premium", "observed_loss_ratio"))


def csv_schema_audit(spark, sf_dir):
    """The schema audit of a comma-separated export, read again."""
    path = _new_path(spark, "audit")
    write_csv(_audited(spark, sf_dir), path)
    return rounded(missing_audit(delimited(spark, path, ",")), rates=("rate",))


def json_year_report(spark, sf_dir):
    """The year summary written as one JSON document, read again and unpacked."""
    report, path = year_summary(spark, sf_dir), _new_path(spark, "report")
    write_json_document(report, path, "years")
    schema = StructType([StructField("years", ArrayType(report.schema))])
    return json_document(spark, path, schema).select(F.inline("years"))


def _part_files(spark, sf_dir) -> str:
    """Text files of the names of a thousand parts each; every third begins like a zip archive."""
    part, path = read(spark, sf_dir, "part"), _new_path(spark, "parts")
    block = F.floor(F.col("p_partkey") / 1000).alias("block")
    name = F.when(F.floor(F.col("p_partkey") / 1000) % 3 == 0, F.concat(F.lit("PK"), "p_name")).otherwise(F.col("p_name"))
    write_blocks(part.select(block, "p_partkey", name.alias("value")), path, "block", "p_partkey")
    return path


def _block_of(path: str = "path"):
    return F.regexp_extract(path, "block=([0-9]+)", 1).cast("long").alias("block")


def file_containers(spark, sf_dir):
    """Size, hash, first bytes and kind of container of every file of a folder."""
    found = containers(spark, f"{_part_files(spark, sf_dir)}/*/*.txt")
    return found.select(_block_of(), "bytes", "sha256", "head", "container")


def artifact_bytes(spark, sf_dir):
    """Files, bytes and different hashes of a folder, by a digit of the block they hold."""
    files = artifact_table(spark, _part_files(spark, sf_dir)).where("path LIKE '%.txt'")
    by_digit = files.groupBy((_block_of() % 10).alias("digit"))
    return by_digit.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("sha256").alias("hashes"))


def canonical_features(spark, sf_dir):
    """Of records whose numbers are text, some of it none, and which lack features: values and levels of every canonical feature."""
    rows = policy_year(spark, sf_dir).withColumns(
        {
            "driver_age": F.when(F.col("l_linenumber") == 3, "unknown").otherwise(F.col("driver_age").cast("string")),
            "vehicle_value": F.when(F.col("l_linenumber") == 5, float("nan")).otherwise(F.col("vehicle_value")),
            "business_type": F.when(F.col("l_linenumber") != 4, F.col("business_type")),
            "bonus_score": F.col("l_linenumber"),
        }
    )
    features = canonical(rows)
    counts = features.agg(*[f(c).alias(f"{c}_{n}") for c in FEATURES for n, f in (("values", F.count), ("levels", F.count_distinct))])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_values").alias("values"), F.col(f"{c}_levels").alias("levels")) for c in FEATURES])))


def download_names(spark, sf_dir):
    """The file names that content-disposition headers give, plain and encoded, and safe names made of them."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    plain = F.concat(F.lit('attachment; filename="'), "p_name", F.lit(' & more.csv"'))
    encoded = F.concat(F.lit("attachment; filename=x.csv; filename*=UTF-8''"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%C3%A9.csv"))
    header = F.when(k % 5 == 0, "inline").when(k % 3 == 0, encoded).otherwise(plain)
    named = part.select("p_partkey", X.disposition_name(header).alias("name"))
    return named.select("p_partkey", "name", X.safe_name("name").alias("safe_name"))


def _complexity(spark) -> DataFrame:
    """(model, target, terms): how many fitted numbers a model of the catalogue has.

    A GLM has a coefficient per encoded feature and an intercept; a boosted model, per tree, a threshold for each
    inner node and a value for each leaf.
    """
    inner, leaves = 2**models.DEPTH - 1, 2**models.DEPTH
    terms = lambda m: models.TREES[m] * (inner + leaves) if m in models.TREES else len(FEATURES) + 1
    rows = [(f"{m}_locked", "frequency" if m.endswith("freq") else "loss", terms(m)) for m in MODELS]
    return spark.createDataFrame(rows, "model string, target string, terms long")


def complexity_join(spark, sf_dir):
    return locked_deviances(spark, sf_dir).join(F.broadcast(_complexity(spark)), ["model", "target"])


def parity_audit(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    seen = part.withColumns({"price": F.col("price") + F.col("p_partkey") % 5 * 0.25, "size": F.col("size") * 1.5})
    out = governance.largest_errors(part, seen, "p_partkey", ["price", "size"])
    return rounded(out, rates=("max_abs_error", "max_rel_error"))


def seeded_sample(spark, sf_dir):
    return monitoring.seeded_sample(read(spark, sf_dir, "events").select("event_id", "value"), "event_id", 5000)


def micro_batches(spark, sf_dir):
    return monitoring.micro_batches(read(spark, sf_dir, "events"), "event_id")


def stress_replay(spark, sf_dir):
    """Control, later and stressed records against one baseline: the index of every feature."""
    train = years(spark, sf_dir, TRAIN)
    base = drift.categorical_baseline(train, CATEGORIES)
    later = years(spark, sf_dir, TEST)
    stress = monitoring.stressed(train, {"vehicle_brand": "NEVER_SEEN", "business_type": None})
    stress = stress.withColumn("business_type", F.col("business_type").cast("string"))
    parts = [d.select(F.lit(n).alias("replay"), *CATEGORIES) for n, d in (("control", train), ("temporal", later), ("stress", stress))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = drift.categorical_counts(rows, base, CATEGORIES, ("replay",))
    return rounded(drift.feature_psi(counts, base, ("replay",)), rates=("psi",))


def contract_check(spark, sf_dir):
    """Scoring bodies built from events, checked against the contract."""
    fields = [F.col("value").alias(c) for c in NUMERIC_FEATURES] + [F.col("event_type").alias(c) for c in CATEGORICAL_FEATURES]
    body = F.to_json(F.struct(*fields, F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("insured_id")), {"ignoreNullFields": "true"})
    from ..contracts import json_violations

    rows = read(spark, sf_dir, "events").select(F.concat_ws(",", json_violations(body)).alias("violations"))
    return rows.groupBy("violations").agg(F.count("*").alias("n"), F.lit(len(FEATURES)).alias("features"))


def _training_rows(spark, sf_dir, *wanted: int) -> DataFrame:
    """What fits read of some years, written once: every pass of the preprocessor and of the encoding reads it."""
    return checkpointed(years(spark, sf_dir, *wanted).select(*{*NUMERIC, *CATEGORIES, *models.POWERS, "total_exposure", *ROW_KEY}))


def _fitted(spark, sf_dir) -> tuple[models.Preprocessor, list[DataFrame]]:
    parts = [_training_rows(spark, sf_dir, TRAIN), *[years(spark, sf_dir, y) for y in (CALIBRATION, TEST)]]
    return models.Preprocessor(NUMERIC, CATEGORIES).fit(parts[0]), parts


def _measured(model, target: str, calibration: DataFrame, test: DataFrame) -> DataFrame:
    """(target, scale, rows, deviance, calibration_ratio) of a model locked on one encoded year and measured on another."""
    scale, scored = models.locked_run(model, calibration, test, target)
    unit = X.poisson_deviance if models.POWERS[target] == 1 else X.tweedie_deviance
    return scored.agg(
        F.lit(target).alias("target"), F.lit(float(scale)).alias("scale"), F.count("*").alias("rows"),
        X.weighted_mean(unit(F.col(target) / F.col("total_exposure"), "pred"), "total_exposure").alias("deviance"),
        metrics.calibration(target, "pred").alias("calibration_ratio"),
    )


def glm_fit_scores(spark, sf_dir):
    """Both GLMs fitted on one year, locked on the next, measured on the third."""
    prep, (train, *later) = _fitted(spark, sf_dir)
    packed = models.training(train, prep, boosted=False)
    fitted = models.fit_models(["glm_freq", "glm_loss"], packed)
    packed.release()
    calibration, test = map(prep.transform, later)
    rows = [_measured(m, MODELS[n], calibration, test) for n, m in fitted.items()]
    return rows[0].unionByName(rows[1])


def boosted_fit_scores(spark, sf_dir):
    """Both boosted models fitted on one year (its deviance before and after the rounds), locked on the next, measured on the third."""
    prep, parts = _fitted(spark, sf_dir)
    packed = models.training(parts[0], prep)
    fitted = models.fit_models(list(models.TREES), packed, **BOOSTED)
    packed.release()
    (train, calibration, test), out = map(prep.transform, parts), None
    for name, model in fitted.items():
        target, unit = MODELS[name], X.poisson_deviance if name.endswith("freq") else X.tweedie_deviance
        rate = F.col(target) / F.col("total_exposure")
        fit = model.transform(train).withColumn("start", F.lit(math.exp(model.base))).agg(
            X.weighted_mean(unit(rate, "start"), "total_exposure").alias("deviance_before"),
            X.weighted_mean(unit(rate, "prediction"), "total_exposure").alias("deviance_after"),
        )
        row = _measured(model, target, calibration, test).crossJoin(fit)  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def rolling_refit(spark, sf_dir):
    """Every year after the first tested once by models refitted on all years before it, raw predictions, with the challengers' intervals."""
    out, fitted = None, None
    for before, test in models.rolling_windows([TRAIN, CALIBRATION, TEST]):
        train, rows = _training_rows(spark, sf_dir, *before), years(spark, sf_dir, test).drop(*MODELS)
        prep = models.Preprocessor(NUMERIC, CATEGORIES).fit(train)
        packed = models.training(train, prep)
        fitted = models.fit_models(list(MODELS), packed, fitted, **BOOSTED)
        packed.release()
        scored = checkpointed(prep.transform(rows).withColumns({m: models.held(f.rate()) for m, f in fitted.items()}).drop("features"))
        found = metrics.deviances(scored, ("glm_freq", "xgb_freq"), ("glm_loss", "xgb_loss"))
        tops = None
        for m, actual in MODELS.items():
            top = metrics.top_capture(scored, m, actual, "total_exposure", ROW_KEY).select(F.lit(m).alias("model"), F.col("capture").alias("top10_capture"))
            tops = top if tops is None else tops.unionByName(top)
        gain = resample.summary(_boot(scored, WINDOW_REPS), "x", ("pair",)).withColumnRenamed("pair", "target")
        found = found.join(tops, "model").join(gain, "target").withColumns({"train_years": F.lit(",".join(map(str, before))), "test_year": F.lit(test)})
        out = found if out is None else out.unionByName(found)
    return governance.cohort_diagnostic(out)


def model_complexity(spark, sf_dir):
    """Seconds to fit and to predict, and bytes written, of the four models, measured here and now."""
    prep, (train, _, test) = _fitted(spark, sf_dir)
    packed, fitted = models.training(train, prep), {}
    for m in MODELS:
        began = time.perf_counter()
        model = models.fit_models([m], packed, **BOOSTED)[m]
        fitted[m] = model, time.perf_counter() - began
    packed.release()
    return spark.createDataFrame(models.complexity(fitted, prep.transform(test)), "model string, fit_seconds double, predict_seconds double, bytes long")


def _scorer(rows: DataFrame, prep: models.Preprocessor) -> models.Scorer:
    packed = models.training(rows, prep)
    fitted = models.fit_models(list(MODELS), packed, **BOOSTED)
    packed.release()
    return models.Scorer(prep, fitted, dict.fromkeys(MODELS, 1.0))


def _records(test: DataFrame) -> DataFrame:
    return test.drop(*MODELS).withColumn("key", row_number_key() * 100 + F.col("l_suppkey") % 100)


def scorer_parity(spark, sf_dir):
    """The largest differences between a scorer and the same scorer written and read again, over a year's records: rates and log ratios."""
    prep, (train, _, test) = _fitted(spark, sf_dir)
    scorer = _scorer(train, prep)
    path = f"{checkpoint_folder(spark)}/scorer-{uuid.uuid4().hex}"
    models.save_scorer(scorer, spark, path)
    again, rows = models.load_scorer(spark, path), _records(test)
    fields = [*MODELS, "frequency_log_ratio", "pure_premium_log_ratio"]
    return governance.largest_errors(scorer.score(rows), again.score(rows), "key", fields).drop("worst_key")


def retrain_parity(spark, sf_dir):
    """The largest differences between the four models and the same models fitted again on the rows in another order."""
    prep, (train, _, test) = _fitted(spark, sf_dir)
    one, other = _scorer(train, prep), _scorer(train.orderBy(F.desc("l_orderkey"), "l_linenumber"), prep)
    rows = _records(test)
    return governance.largest_errors(one.score(rows), other.score(rows), "key", list(MODELS)).drop("worst_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        year_summary, schema_audit, audit_year_counts, temporal_split_counts, exposure_from_dates, exposure_audit, renewal_dates,
        locked_scale, calibration_ratio, locked_deviances, top10_capture, segment_calibration, id_transport,
        coverage_decomposition, coverage_reconciliation, tail_summary, tail_sensitivity, transport_points, transport_pivot,
        bootstrap_deviance_ci, bootstrap_ratio_ci, multinomial_deviance_ci, multinomial_ratio_ci, rolling_origin, locked_gate, approval_gates, baseline_numeric,
        baseline_categorical, feature_psi, largest_psi, unseen_category_rate, monitoring_snapshot, monitoring_alerts,
        disagreement_shift, review_lifecycle, review_evidence, review_replay, event_chain_verify, complexity_join, parity_audit, seeded_sample, micro_batches,
        stream_monitor, stress_replay, contract_check, glm_fit_scores, boosted_fit_scores, rolling_refit, model_complexity, scorer_parity, retrain_parity, artifact_differences, attestation_predicates, bucketed_year_summary, bucketed_seen, replay_acceptance,
        delimited_year_summary, csv_schema_audit, json_year_report, file_containers, artifact_bytes, canonical_features, download_names,
    )
}
