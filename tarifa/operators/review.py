"""The review lifecycle: a state machine with hysteresis over a release's monitoring windows.

``step`` says which state follows; streams fold it and tests hold the batch against it.  In batch the
lifecycle is a scan: a state follows from when the last alert, green window, opening and closing were,
and such running maxima are taken in slices.  Severity and the recommended action are column
expressions.  It recommends and never acts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# Alerts by severity, and states.
HIGH = ("error_rate", "unseen_category_rate", "frequency_disagreement", "pure_premium_disagreement")
MEDIUM = ("feature_drift", "p95_latency_ms")
HEALTHY, WATCH, REVIEW, RECOVERING = "HEALTHY", "WATCH", "REVIEW_REQUIRED", "RECOVERING"


def any_of(alerts: Column | str, *names: str) -> Column:
    """Whether an array of alerts has one of these."""
    return F.arrays_overlap(alerts, F.array(*map(F.lit, names)))


def severity(alerts: Column | str) -> Column:
    return F.when(any_of(alerts, *HIGH), "HIGH").when(any_of(alerts, *MEDIUM), "MEDIUM").otherwise("NONE")


def recommended_action(state: Column | str, alerts: Column | str) -> Column:
    """What to do in a state; a required review says what to look into."""
    state = F.col(state) if isinstance(state, str) else state
    serving, model = any_of(alerts, "error_rate", "unseen_category_rate"), any_of(alerts, "frequency_disagreement", "pure_premium_disagreement")
    return (
        F.when(state == HEALTHY, "CONTINUE_SHADOW").when(state == WATCH, "OBSERVE_NEXT_WINDOW").when(state == RECOVERING, "VERIFY_RECOVERY")
        .when(serving & model, "INVESTIGATE_SERVING_DATA_AND_MODEL").when(serving, "INVESTIGATE_SERVING_AND_INPUT_CONTRACT")
        .when(model, "REVIEW_MODEL_DISAGREEMENT").when(any_of(alerts, "feature_drift"), "REVIEW_PORTFOLIO_MIX_AND_SEGMENT_CALIBRATION")
        .when(any_of(alerts, "p95_latency_ms"), "REVIEW_SERVING_PERFORMANCE").otherwise("CONTINUE_SHADOW")
    )


def with_evidence(windows: DataFrame, *columns: str) -> DataFrame:
    """``windows`` with ``evidence`` (JSON of ``columns``, in their order, nulls left out) and its SHA-256."""
    out = windows.withColumn("evidence", F.to_json(F.struct(*columns)))
    return out.withColumn("evidence_sha256", F.sha2("evidence", 256))


def float_text(c: Column) -> Column:
    """A double as JSON writers of other languages put it: plain from 0.0001 up to below 1e16, with a two-digit exponent beyond."""
    text = F.abs(c).cast("string")
    sign, digits = F.when(c < 0, "-").otherwise(""), F.regexp_replace(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), r"\.", "")
    e = F.substring_index(text, "E", -1).cast("int")
    whole = F.rpad(digits, F.greatest(F.length(digits), e + 1), "0")
    plain = F.concat(F.substring(whole, F.lit(1), e + 1), F.lit("."), F.when(F.length(whole) > e + 1, F.substring(whole, e + 2, F.lit(400))).otherwise("0"))
    exponent = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.lit(400)))).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), "0"))
    scientific = F.when(e == -4, F.concat(F.lit("0.000"), digits)).when((e > 0) & (e < 16), plain).otherwise(exponent)
    return F.concat(sign, F.when(text.contains("E"), scientific).otherwise(text))


# The fields of aggregate evidence in order of their names, by kind; each kind has its default.
EVIDENCE = {
    "active_alerts": "list", "error_rate": "float", "feature_drift_alert_eligible": "bool", "frequency_abs_log_ratio_p95": "float",
    "governance_status": "text", "label": "text", "max_feature_psi": "float", "max_feature_psi_feature": "text", "model_version": "text",
    "p95_latency_ms": "float", "privacy_boundary": "text", "pure_premium_abs_log_ratio_p95": "float", "records_scored": "int",
    "request_count": "int", "service_version": "text", "unseen_category_rate": "float",
}


def aggregate_evidence(windows: DataFrame, **columns: Column | str) -> DataFrame:
    """``windows`` with ``evidence``, compact JSON of the sixteen fields by name, and its SHA-256.

    ``columns`` says where fields are that have other names.  A field that isn't there, or is null, has
    its default: 0 or 0.0, false, no alerts, and null for texts.  Texts are as they are, beyond ASCII too.
    """
    kinds = {"float": "double", "int": "long", "bool": "boolean", "text": "string", "list": "array<string>"}
    have, cells = set(windows.columns), []
    for name, kind in EVIDENCE.items():
        c = columns.get(name, name)
        c = c if isinstance(c, Column) else F.col(c) if c in have else F.lit(None)
        c = c.cast(kinds[kind])
        if kind == "float":
            text = float_text(F.coalesce(c, F.lit(0.0)))
        elif kind == "list":
            text = F.to_json(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))))
        elif kind == "text":
            text = F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))
        else:
            text = F.coalesce(c, F.lit(0 if kind == "int" else False)).cast("string")
        cells.append(F.concat(F.lit(f'"{name}":'), text))
    out = windows.withColumn("evidence", F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")))
    return out.withColumn("evidence_sha256", F.sha2("evidence", 256))


@dataclass(frozen=True)
class Lifecycle:
    """Where a release stands."""

    state: str = HEALTHY
    breaches: int = 0
    greens: int = 0
    sequence: int = 0
    review_id: str | None = None


def step(now: Lifecycle, alert: bool, evidence_sha256: str, open_after: int = 2, close_after: int = 2) -> Lifecycle:
    """The lifecycle after one more window.

    ``open_after`` windows with alerts in a row open a review; ``close_after`` green ones in a row
    close it; an alert while recovering reopens the same review at once.
    """
    n = now.sequence + 1
    under_review = now.state in (REVIEW, RECOVERING)
    if alert:
        breaches = now.breaches + 1
        if under_review:
            return replace(now, state=REVIEW, breaches=breaches, greens=0, sequence=n)
        if breaches < open_after:
            return replace(now, state=WATCH, breaches=breaches, greens=0, sequence=n)
        name = now.review_id or f"review-{n:04d}-{evidence_sha256[:8]}"
        return Lifecycle(REVIEW, breaches, 0, n, name)
    if under_review and now.greens + 1 < close_after:
        return replace(now, state=RECOVERING, breaches=0, greens=now.greens + 1, sequence=n)
    return Lifecycle(HEALTHY, 0, 0, n, None if under_review or now.state == WATCH else now.review_id)


FOLDED = (
    "release_id string, sequence long, label string, state string, breach_streak long, recovery_streak long, "
    "review_id_before string, review_id_after string"
)


def folded(release_id: str, now: Lifecycle, rows: pd.DataFrame, **options: int) -> tuple[Lifecycle, pd.DataFrame]:
    """The lifecycle after some windows (label, alert, evidence_sha256), and a row each."""
    out = []
    for r in rows.sort_values("label").itertuples():
        after = step(now, bool(r.alert), r.evidence_sha256, **options)
        out.append((release_id, after.sequence, r.label, after.state, after.breaches, after.greens, now.review_id, after.review_id))
        now = after
    return now, pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])


def _scan(rows: DataFrame, values: dict[str, Column], before: bool = False) -> DataFrame:
    """``rows`` with running maxima of a release's values, up to each window or only ``before`` it: within slices, then from earlier slices."""
    own = Window.partitionBy("slice", "release_id").orderBy("label").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy("release_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("slice", "release_id").agg(*[F.max(v).alias(f"_{n}") for n, v in values.items()])
    ends = ends.select("slice", "release_id", *[F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in values])
    out = rows.withColumns({n: F.max(v).over(own) for n, v in values.items()}).join(ends, ["slice", "release_id"])
    return out.withColumns({n: F.greatest(n, f"_{n}") for n in values}).drop(*[f"_{n}" for n in values])


def lifecycle(windows: DataFrame, open_after: int = 2, close_after: int = 2) -> DataFrame:
    """The events of every release's windows (release_id, label, active_alerts, evidence_sha256), by label.

    Labels are a release's own.  The streak of a window is its distance from the last window of the
    other kind.  A streak of ``open_after`` alerts calls for review, one of ``close_after`` green windows
    ends it, so a release is under review if the last call is later than the last end; the call that
    finds it not under review names the review.  Windows are range-partitioned, so a long release is many
    tasks' work.
    """
    thin = windows.select("release_id", "label", (F.size("active_alerts") > 0).alias("alert"), "evidence_sha256")
    rows = checkpointed(thin.repartitionByRange("release_id", "label").withColumn("slice", F.spark_partition_id()))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("slice", "release_id").orderBy("label")).cast("long"))
    sizes = rows.groupBy("slice", "release_id").agg(F.max("nth").alias("n"))
    begin = F.sum("n").over(Window.partitionBy("release_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(sizes.select("slice", "release_id", F.coalesce(begin, F.lit(0)).alias("begin")), ["slice", "release_id"])
    rows = rows.withColumn("sequence", F.col("begin") + F.col("nth")).drop("begin", "nth")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    rows = _scan(rows, {"alerted": F.when(F.col("alert"), F.col("sequence")), "green": F.when(~F.col("alert"), F.col("sequence"))})
    streak = F.col("sequence") - F.when(F.col("alert"), none("green")).otherwise(none("alerted"))
    rows = rows.withColumn("streak", streak).drop("alerted", "green")
    call, end = F.col("alert") & (F.col("streak") >= open_after), ~F.col("alert") & (F.col("streak") >= close_after)
    rows = _scan(rows, {"called": F.when(call, F.col("sequence")), "ended": F.when(end, F.col("sequence"))}, before=True)
    rows = rows.withColumn("under", none("called") > none("ended"))
    named = F.when(call & ~F.col("under"), F.struct("sequence", "evidence_sha256"))
    rows = _scan(rows, {"review": named})
    name = F.format_string("review-%04d-%s", F.col("review.sequence"), F.substring("review.evidence_sha256", 1, 8))
    # The review before is the one open then: this window's own call, if it opens, isn't it.
    opens, still = call & ~F.col("under"), (call | F.col("under")) & ~end
    state = F.when(F.col("alert"), F.when(still, REVIEW).otherwise(WATCH)).otherwise(F.when(still, RECOVERING).otherwise(HEALTHY))
    events = rows.select(
        "release_id", "sequence", "label", state.alias("state"), F.when(F.col("alert"), F.col("streak")).otherwise(0).alias("breach_streak"),
        F.when(~F.col("alert") & still, F.col("streak")).otherwise(0).alias("recovery_streak"),
        F.when(F.col("under") & ~opens, name).alias("review_id_before"), F.when(still, name).alias("review_id_after"),
    )
    return described(events.join(windows.select("release_id", "label", "active_alerts", "evidence_sha256"), ["release_id", "label"]))


def described(events: DataFrame) -> DataFrame:
    """Folded windows with their alerts sorted, severity and recommended action."""
    alerts = F.array_sort("active_alerts")
    return events.withColumns({"active_alerts": alerts, "severity": severity("active_alerts"), "recommended_action": recommended_action("state", "active_alerts")})

