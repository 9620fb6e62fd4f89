"""Streams give what batches give."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarifa import contracts
from tarifa.operators import drift, monitoring, review
from tarifa.operators.models import Glm, Preprocessor, Scorer
from tarifa.streaming import monitor, scoring
from tarifa.streaming.sinks import batches, write_once
from tarifa.streaming.telemetry import review_stream, windowed_telemetry


def test_review_stream_equals_batch(spark, tmp_path):
    rows = [("r1", f"w{k}", ["error_rate"] if k % 4 in (1, 2) else [], "ab" * 32) for k in range(8)]
    schema = "release_id string, label string, active_alerts array<string>, evidence_sha256 string"
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = review_stream(stream).writeStream.format("memory").queryName("reviews").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = review.lifecycle(spark.createDataFrame(rows, schema)).orderBy("sequence").select("sequence", "state", "review_id_after").collect()
    assert spark.table("reviews").orderBy("sequence").select("sequence", "state", "review_id_after").collect() == want


def test_windowed_telemetry_counts(spark):
    rows = spark.range(10).select(
        F.timestamp_seconds(F.col("id") * 40_000).alias("ts"), F.col("id").cast("double").alias("latency_ms"),
        (F.col("id") % 2 == 0).alias("error"), F.lit(2).alias("batch_size"), F.lit(0).alias("unseen"),
    )
    out = windowed_telemetry(rows).agg(F.sum("request_count"), F.sum("error_count"), F.sum("records_scored")).first()
    assert tuple(out) == (10, 5, 20)


REQUEST = "service string, seq long, reset boolean, latency_ms double, error boolean, batch_size long, unseen int, freq_log_ratio double, loss_log_ratio double, age double, brand string"


def _requests(rng, first, n, service, reset_at=None):
    brands = ["a", "b", "c", None, "new"]
    return [
        (service, first + k, first + k == reset_at, float(rng.normal(100, 30)), bool(rng.random() < 0.1), int(rng.integers(1, 9)), int(rng.random() < 0.05),
         float(rng.normal(0, 0.5)) if rng.random() < 0.9 else None, float(rng.normal(0, 0.7)), float(rng.normal(40, 12)) if rng.random() < 0.9 else None, brands[rng.integers(0, 5)])
        for k in range(n)
    ]


def _batch_view(spark, rows, base_n, base_c, last):
    """The same by the batch operators, of the rows since the last reset of each service."""
    begins = {s: max([r[1] for r in rows if r[0] == s and r[2]], default=-1) for s in {r[0] for r in rows}}
    df = spark.createDataFrame([r for r in rows if r[1] >= begins[r[0]]], REQUEST).withColumn("window_id", F.col("service"))
    counts = drift.numeric_counts(df, base_n, ("age",), ("window_id",)).unionByName(drift.categorical_counts(df, base_c, ("brand",), ("window_id",)))
    top = drift.largest(drift.feature_psi(counts, drift.as_buckets(base_n, base_c), ("window_id",)), ("age", "brand"), ("window_id",))
    limits = monitoring.THRESHOLDS | {"p95_latency_ms": 150.0, "min_feature_drift_records": 300}
    return {r.window_id: r for r in monitoring.with_alerts(monitoring.snapshot(df, last).join(top, "window_id", "left"), limits).collect()}, limits


def test_the_monitor_equals_batch_after_every_micro_batch_and_a_restart(spark, tmp_path):
    """Counters, the last values, drift and alerts; a reset within a micro-batch; the stream starts again from its checkpoint each time."""
    rng, last = np.random.default_rng(8), 60
    train = spark.createDataFrame(_requests(rng, 0, 400, "t"), REQUEST).where("brand IS NULL OR brand != 'new'")
    base_n, base_c = drift.numeric_baseline(train, ("age",)), drift.categorical_baseline(train, ("brand",))
    baseline = monitor.Baseline.collected(base_n, base_c, ("age", "brand"))
    parts = [
        _requests(rng, 0, 50, "x") + _requests(rng, 0, 10, "y"), _requests(rng, 50, 70, "x", reset_at=80) + _requests(rng, 10, 5, "y"),
        _requests(rng, 120, 40, "x"), _requests(rng, 15, 90, "y", reset_at=15) + _requests(rng, 160, 3, "x"),
    ]
    seen = []
    for k, part in enumerate(parts):
        seen += part
        want, limits = _batch_view(spark, seen, base_n, base_c, last)
        spark.createDataFrame(part, REQUEST).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        found = monitor.monitor(spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in"), baseline, limits, last)
        query = found.writeStream.foreachBatch(lambda b, i: write_once(b, i, f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/state")
        query.trigger(availableNow=True).start().awaitTermination()
        got = {r.service: r for r in batches(spark, f"{tmp_path}/out").where(F.col("batch") == k).collect()}
        assert set(got) == {r[0] for r in part}
        for service, row in got.items():
            for c in want[service].asDict():
                if c != "window_id":
                    a, b = row[c], want[service][c]
                    assert a == b or abs(a - b) < 1e-9, (k, service, c, a, b)


def test_a_baseline_without_features_has_no_drift(spark, tmp_path):
    rows = [(*r[:3], None, None, None, None, None, None, None, None) for r in _requests(np.random.default_rng(1), 0, 3, None)]
    spark.createDataFrame(rows, REQUEST).write.parquet(f"{tmp_path}/in")
    found = monitor.monitor(spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in"), monitor.Baseline({}, {}, {}))
    query = found.writeStream.foreachBatch(lambda b, i: write_once(b, i, f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    (row,) = batches(spark, f"{tmp_path}/out").collect()
    assert (row.service, row.request_count, row.error_count, row.records_scored, row.latency_p95, row.max_psi, row.alert_status) == (None, 3, 0, 0, 0.0, None, "GREEN")


def test_scoring_a_stream_accounts_for_every_request(spark, tmp_path):
    """Rejected and scored add up to what was read, as in batch; a batch that is run again leaves one copy; a restart goes on."""
    n, c = contracts.NUMERIC_FEATURES, contracts.CATEGORICAL_FEATURES
    prep = Preprocessor(n, c, dict.fromkeys(n, 1.0), dict.fromkeys(n, 0.0), dict.fromkeys(n, 1.0), dict.fromkeys(c, "x"), {k: ["x", "y"] for k in c})
    scorer = Scorer(prep, {m: Glm(0.1 * i, [0.01 * i] * prep.width) for i, m in enumerate(("glm_freq", "xgb_freq", "glm_loss", "xgb_loss"))}, {})
    good = {k: 1.5 for k in n} | {k: "x" for k in c}
    bodies = [json.dumps(good), json.dumps(good | {c[0]: "never"}), json.dumps(good | {"insured_id": 7}), json.dumps({k: v for k, v in good.items() if k != n[0]}), '{"broken": ', "[1]", "7", None, "", json.dumps(good | {n[1]: None})]
    for part in range(2):
        rows = [(10 * part + k, b) for k, b in enumerate(bodies)]
        spark.createDataFrame(rows, "request_id long, body string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("request_id long, body string").parquet(f"{tmp_path}/in")
        scoring.score_stream(stream, scorer, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        scoring.score_batch(spark.createDataFrame(rows, "request_id long, body string"), part, scorer, f"{tmp_path}/out")
    rejected, scored, telemetry = (batches(spark, f"{tmp_path}/out/{t}") for t in ("rejected", "scored", "telemetry"))
    assert sorted(r.request_id % 10 for r in scored.collect()) == [0, 0, 1, 1, 9, 9]
    reasons = {r.request_id: r.reason for r in rejected.collect()}
    assert rejected.count() == 14 and [reasons[k] for k in range(2, 9)] == ["fields:insured_id", f"fields:-{n[0]}", *["unreadable"] * 5]
    assert sorted((r.batch, r.read, r.rejected, r.unseen) for r in telemetry.collect()) == [(0, 10, 7, 1), (1, 10, 7, 1)]
    want = scorer.score(contracts.canonical(spark.read.json(spark.createDataFrame([(bodies[1],)], "value string").rdd.map(lambda r: r[0])))).first()
    one = scored.where("request_id = 1").first()
    assert all(abs(one[m] - want[m]) < 1e-12 for m in scorer.models) and list(one.warnings) == list(want.warnings) == [f"unseen_category:{c[0]}=never"]


def test_requests_of_a_batch_are_read_in_parts():
    """Parts in any order, with resets and equal places, give what the sorted whole gives, and hold little of each request."""
    rng, last = np.random.default_rng(8), 40
    for trial in range(60):
        n = int(rng.integers(1, 300))
        rows = pd.DataFrame({
            "seq": rng.integers(0, 80, n), "reset": rng.random(n) < (0, 0.02, 0.2)[trial % 3], "error": rng.random(n) < 0.3, "batch_size": rng.integers(0, 9, n), "unseen": rng.integers(0, 2, n),
            **{v: rng.normal(size=n) for v in ("latency_ms", "freq_log_ratio", "loss_log_ratio")}, "buckets": [x.tolist() for x in rng.integers(0, 6, (n, 2))],
        })
        whole = rows.sort_values("seq", kind="stable")
        at = np.flatnonzero(whole.reset)
        whole = whole.iloc[at[-1] :] if len(at) else whole
        new = monitor.Arrived(last)
        for k in range(0, n, 37):
            new.add(rows.iloc[k : k + 37])
        counts, values, bins = new.since_reset(6)
        assert new.seq == rows.seq.max() and (new.reset is None) == (not len(at))
        assert counts.tolist() == [len(whole), whole.error.sum(), whole.batch_size.sum(), whole.unseen.sum()]
        assert bins.tolist() == np.bincount(np.concatenate(whole.buckets.to_numpy()), minlength=6).tolist()
        assert all((values[v] == whole[v].to_numpy(float)[-last:]).all() for v in values) and len(new.values[0]) <= last
    held = sum(x.nbytes for part in new.thin for x in part)
    assert held <= 48 * len(whole)
