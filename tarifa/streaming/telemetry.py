"""The monitoring and review operators over streams.

Late rows beyond the watermark are dropped, which the batch operators don't do; batch is the truth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import FOLDED, Lifecycle, described, folded


def windowed_telemetry(requests: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counters and approximate percentiles per event-time window of a stream of requests.

    ``requests`` has ``ts`` (timestamp), ``latency_ms``, ``error``, ``batch_size`` and ``unseen``.  Percentiles are
    sketches, as exact ones can't be kept incrementally.
    """
    return (
        requests.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(
            F.count("*").alias("request_count"),
            F.count_if("error").alias("error_count"),
            F.sum("batch_size").alias("records_scored"),
            F.sum("unseen").alias("unseen_warning_records"),
            F.percentile_approx("latency_ms", 0.95, 10_000).alias("latency_p95"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*")
        .drop("w")
    )


def review_stream(windows: DataFrame, open_after: int = 2, close_after: int = 2) -> DataFrame:
    """The review events of a stream of closed monitoring windows (release_id, label, active_alerts, evidence_sha256).

    State per release is the lifecycle and the last label.  Windows of one micro-batch are put in order by
    label; one that comes after its successors were folded is an error, as its events would be wrong.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *known, last = state.get if state.exists else (*astuple(Lifecycle()), "")
        rows = pd.concat(list(batches))
        if rows.label.min() <= last:
            raise ValueError(f"release {key[0]}: window {rows.label.min()} came after {last} was folded")
        now, events = folded(key[0], Lifecycle(*known), rows, open_after=open_after, close_after=close_after)
        state.update((*astuple(now), rows.label.max()))
        yield events.merge(rows[["label", "active_alerts", "evidence_sha256"]], on="label")

    thin = windows.withColumn("alert", F.size("active_alerts") > 0)
    events = thin.groupBy("release_id").applyInPandasWithState(
        fold, f"{FOLDED}, active_alerts array<string>, evidence_sha256 string",
        "state string, breaches long, greens long, sequence long, review_id string, last string", "append", GroupStateTimeout.NoTimeout,
    )
    return described(events)
