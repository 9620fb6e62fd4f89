"""The contract, the review lifecycle, files and expressions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarifa import contracts
from tarifa.functions import exprs as X
from tarifa.operators import governance, review
from tarifa.sources import policy, sinks

GOLDEN = "55d45bd12228a8007f17d59cb2fa37f23b90e3b0315f78478db28c7a19622e25"
WINDOWS = "release_id string, label string, active_alerts array<string>, evidence_sha256 string"


def test_contract_hash_and_columns():
    assert contracts.contract_hash() == GOLDEN
    contracts.check_columns(contracts.FEATURES)
    with pytest.raises(contracts.ContractError):
        contracts.check_columns([*contracts.FEATURES, "insured_id"])


def test_lifecycle_opens_recovers_and_reopens(spark):
    alerts = (["feature_drift"], ["feature_drift"], [], ["error_rate", "pure_premium_disagreement"], [], [])
    rows = [(r, f"w{k}", a, "ab" * 32) for k, a in enumerate(alerts) for r in ("a", "b")]
    rows += [("c", f"w{k}", ["p95_latency_ms"] if k == 1 else [], "cd" * 32) for k in range(3)]
    events = review.lifecycle(spark.createDataFrame(rows, WINDOWS)).orderBy("release_id", "sequence").collect()
    name = "review-0002-abababab"
    want = [
        ("WATCH", None, "MEDIUM", "OBSERVE_NEXT_WINDOW"), ("REVIEW_REQUIRED", name, "MEDIUM", "REVIEW_PORTFOLIO_MIX_AND_SEGMENT_CALIBRATION"),
        ("RECOVERING", name, "NONE", "VERIFY_RECOVERY"), ("REVIEW_REQUIRED", name, "HIGH", "INVESTIGATE_SERVING_DATA_AND_MODEL"),
        ("RECOVERING", name, "NONE", "VERIFY_RECOVERY"), ("HEALTHY", None, "NONE", "CONTINUE_SHADOW"),
    ]
    for release in "ab":
        assert [(e.state, e.review_id_after, e.severity, e.recommended_action) for e in events if e.release_id == release] == want
    assert [e.state for e in events if e.release_id == "c"] == ["HEALTHY", "WATCH", "HEALTHY"]


def test_the_scan_equals_the_fold(spark):
    """Random releases under several limits, in many slices: the same events as ``step``, one window after another."""
    import random

    rng = random.Random(6)
    rows = [(f"r{r}", f"w{k:04d}", ["error_rate"] if rng.random() < 0.45 else [], f"{rng.randrange(1 << 60):064x}") for r in range(12) for k in range(rng.choice([1, 2, 7, 60]))]
    windows = spark.createDataFrame(rows, WINDOWS).repartition(5)
    for limits in ((2, 2), (1, 1), (3, 1), (1, 3)):
        found = {(r.release_id, r.label): r for r in review.lifecycle(windows, *limits).collect()}
        now = {}
        for release, label, alerts, digest in rows:
            before = now.get(release, review.Lifecycle())
            now[release] = after = review.step(before, bool(alerts), digest, *limits)
            r = found[release, label]
            assert (r.sequence, r.state, r.breach_streak, r.recovery_streak, r.review_id_before, r.review_id_after) == (after.sequence, after.state, after.breaches, after.greens, before.review_id, after.review_id)


def test_aggregate_evidence_has_all_fields_and_defaults(spark):
    """The digest is that of sorted compact JSON, floats as Python writes them."""
    import json

    floats = [0.0, 1.0, 0.05, 0.0005, 0.00012345, 1e-5, 1.25e-7, 123456.789, 12345678.5, 1e15, 123456789012345678.0, 1e16, 1e22, 1.5e100, 0.1 + 0.2, -0.00025]
    rows = [(f"w{k}", x, k, ["b", "a"] if k % 2 else None, k % 3 == 0 or None, None if k % 4 else 'quo"te') for k, x in enumerate(floats)]
    df = spark.createDataFrame(rows, "label string, error_rate double, request_count int, alerts array<string>, feature_drift_alert_eligible boolean, mv string")
    for r in review.aggregate_evidence(df, active_alerts="alerts", model_version="mv", p95_latency_ms=F.col("error_rate") * 2).collect():
        want = {
            "label": r.label, "service_version": None, "model_version": r.mv, "governance_status": None, "privacy_boundary": None, "request_count": r.request_count,
            "records_scored": 0, "error_rate": r.error_rate, "unseen_category_rate": 0.0, "p95_latency_ms": r.error_rate * 2, "frequency_abs_log_ratio_p95": 0.0,
            "pure_premium_abs_log_ratio_p95": 0.0, "max_feature_psi": 0.0, "max_feature_psi_feature": None, "feature_drift_alert_eligible": bool(r.feature_drift_alert_eligible),
            "active_alerts": sorted(r.alerts or []),
        }
        text = json.dumps(want, sort_keys=True, separators=(",", ":"))
        assert r.evidence == text and r.evidence_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_evidence_is_digested(spark):
    row = review.with_evidence(spark.createDataFrame([("w1", 3, None)], "label string, n long, x double"), "label", "n", "x").first()
    assert row.evidence == '{"label":"w1","n":3}' and row.evidence_sha256 == hashlib.sha256(row.evidence.encode()).hexdigest()


def test_expressions(spark):
    df = spark.createDataFrame([("1.5", "31/12/2020", 24.0), ("x", "32/13/2020", 25.0), (None, None, None)], "n string, d string, age double")
    rows = df.select(X.number("n").alias("n"), X.day_first("d").cast("string").alias("d"), X.age_band("age").alias("b")).collect()
    assert [tuple(r) for r in rows] == [(1.5, "2020-12-31", "<25"), (None, None, "25-34"), (None, None, "nan")]
    names = spark.createDataFrame([('attachment; filename="my file.csv"',), ("attachment; filename*=UTF-8''a%20b.csv",), (None,)], "h string")
    assert [tuple(r) for r in names.select(X.disposition_name("h").alias("n")).select("n", X.safe_name("n").alias("s")).collect()] == [("my file.csv", "my_file.csv"), ("a b.csv", "a_b.csv"), (None, "file")]


def test_delimited_sources(spark, tmp_path):
    """Another separator, a byte-order mark, quoted names, a pruned scan, and comma-separated results read again."""
    (tmp_path / "a.csv").write_text('﻿"ID";Date;Cost\n1;01/02/2020;"3;5"\n2;;NA\n', encoding="utf-8")
    df = policy.delimited(spark, f"{tmp_path}/a.csv")
    assert df.columns == ["ID", "Date", "Cost"] and {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [("1", "01/02/2020", "3;5"), ("2", None, "NA")]
    assert policy.delimited(spark, f"{tmp_path}/a.csv", columns=["ID"]).columns == ["ID"]
    sinks.write_csv(df, f"{tmp_path}/out", one_file=True)
    assert policy.delimited(spark, f"{tmp_path}/out", ",").collect() == df.collect()
    assert {r.column: r.missing for r in policy.missing_audit(df).collect()} == {"ID": 0, "Date": 1, "Cost": 1}
    with pytest.raises(ValueError):
        policy.require_columns(df, "ID", "Premium")
    (tmp_path / "d.json").write_text('{\n "a": {"b": [1, 2]},\n "c": "x"\n}')
    row = policy.json_document(spark, f"{tmp_path}/d.json").first()
    assert row.a.b == [1, 2] and row.c == "x"
    heads = {r.path.rsplit("/", 1)[1]: r.container for r in policy.containers(spark, f"{tmp_path}/*.*").collect()}
    assert heads == {"a.csv": "text_or_other", "d.json": "text_or_other"}


def test_documents_and_blocks_are_written_whole(spark, tmp_path):
    """Nulls and empty results in a JSON document; a file per block, its lines in order, whatever the partitions."""
    rows = spark.createDataFrame([(1, "a|b", None), (2, None, 0.5)], "k long, s string, x double")
    schema = f"years array<{rows.schema.simpleString()}>"
    for df in (rows, rows.limit(0)):
        sinks.write_json_document(df, f"{tmp_path}/doc", "years")
        again = policy.json_document(spark, f"{tmp_path}/doc", T._parse_datatype_string(schema)).select(F.inline("years"))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        sinks.write_json_document(rows, f"{tmp_path}/doc", most=1)
    lines = spark.range(100).select((F.col("id") % 3).alias("block"), (-F.col("id")).alias("n"), F.col("id").cast("string").alias("value"))
    sinks.write_blocks(lines.repartition(7), f"{tmp_path}/blocks", "block", "n")
    for b in range(3):
        (file,) = (tmp_path / "blocks" / f"block={b}").glob("*.txt")
        assert file.read_text() == "".join(f"{i}\n" for i in range(99, -1, -1) if i % 3 == b)


def test_small_results_only(spark, tmp_path):
    rows = spark.range(12).select("id", (F.col("id") / 3).alias("x|y"))
    assert sinks.markdown(rows.limit(1), "T").splitlines() == ["## T", "", "| id | x|y |", "| --- | --- |", "| 0 | 0.00000 |"]
    with pytest.raises(ValueError):
        sinks.markdown(rows, "T", most=10)
    with pytest.raises(ValueError):
        sinks.write_csv(rows, f"{tmp_path}/x", one_file=True, most=10)


def test_artifact_tables_differ_where_files_do(spark, tmp_path):
    for side, files in (("a", {"x": b"1", "y": b"2"}), ("b", {"x": b"1", "y": b"3", "z": b"4"})):
        (tmp_path / side).mkdir()
        for name, data in files.items():
            (tmp_path / side / name).write_bytes(data)
    tables = [sinks.artifact_table(spark, f"{tmp_path}/{side}").withColumn("path", F.substring_index("path", "/", -1)) for side in "ab"]
    assert tables[0].where("path = 'x'").first().sha256 == hashlib.sha256(b"1").hexdigest()
    assert sorted(r.path for r in governance.map_differences(*tables).collect()) == ["y", "z"]


def test_records_and_canonical_features(spark):
    one = {c: 1 for c in contracts.NUMERIC_FEATURES} | {c: "x" for c in contracts.CATEGORICAL_FEATURES}
    frame = contracts.records_frame(spark, [one, one | {contracts.NUMERIC_FEATURES[0]: None}])
    assert frame.columns == list(contracts.FEATURES) and frame.count() == 2
    for bad in ([], [one] * (contracts.MAX_BATCH + 1)):
        with pytest.raises(contracts.ContractError):
            contracts.records_frame(spark, bad)
    odd = spark.createDataFrame([("2.5", float("nan"), 7)], f"{contracts.NUMERIC_FEATURES[0]} string, {contracts.NUMERIC_FEATURES[1]} double, {contracts.CATEGORICAL_FEATURES[0]} int")
    row = contracts.canonical(odd).first()
    assert row[0] == 2.5 and row[1] is None and row[len(contracts.NUMERIC_FEATURES)] == "7" and len(row) == len(contracts.FEATURES)


def test_preprocessing_equals_numpy(spark):
    """Medians, moments, modes, levels and one column per level; what is missing or new."""
    import numpy as np
    from tarifa.operators.models import Glm, Preprocessor, Scorer

    rng = np.random.default_rng(5)
    rows = [(float(x) if x > -1.2 else None, int(n), c) for x, n, c in zip(rng.normal(size=301), rng.integers(0, 4, 301), rng.choice(["a", "b", "c"], 301, p=[0.5, 0.3, 0.2]))] + [(1.0, 2, None)]
    df = spark.createDataFrame(rows, "x double, n int, c string")
    prep = Preprocessor(("x", "n"), ("c",)).fit(df)
    x = np.array([np.nan if r[0] is None else r[0] for r in rows])
    assert abs(prep.medians["x"] - np.nanmedian(x)) < 1e-12 and prep.levels == {"c": ["a", "b", "c"]} and prep.modes == {"c": "a"}
    filled = np.where(np.isnan(x), np.nanmedian(x), x)
    assert abs(prep.means["x"] - filled.mean()) < 1e-12 and abs(prep.scales["x"] - filled.std()) < 1e-12
    new = spark.createDataFrame([(None, 1, "b"), (0.0, None, None), (0.0, 0, "z")], "x double, n int, c string")
    out = [r.features for r in prep.transform(new).collect()]
    assert [f.at for f in out] == [[3], [2], [-1]] and [len(f.x) for f in out] == [2, 2, 2]
    assert abs(out[0].x[0] - (np.nanmedian(x) - filled.mean()) / filled.std()) < 1e-12
    scorer = Scorer(prep, {"glm_freq": Glm(0.1, [0.2, 0, 0, 0.3, 0]), "xgb_freq": Glm(0.4, [0.2, 0, 0, 0.3, 0])}, {"xgb_freq": 2.0})
    row = scorer.score(new).collect()
    assert all(abs(r.frequency_log_ratio - (0.3 + np.log(2))) < 1e-9 for r in row) and [r.warnings for r in row] == [[], [], ["unseen_category:c=z"]]
    with pytest.raises(ValueError, match="too many levels"):
        Preprocessor((), ("c",)).fit(spark.range(1200).select(F.col("id").cast("string").alias("c")))
