"""DuckDB SQL for the query catalogue, over the same parquet tables."""

from __future__ import annotations

from ..contracts import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES, PRIVACY_BOUNDARY, SHADOW_ONLY
from ..operators.governance import DECIDING
from ..operators.resample import MODULUS, POISSON_STEPS
from ..sources.policy import COVERAGES, ROW_KEY

TRAIN, CALIBRATION, TEST = 1999, 2000, 2001
_MODELS = {"glm_freq": "total_claims", "xgb_freq": "total_claims", "glm_loss": "total_incurred", "xgb_loss": "total_incurred"}

BASE = """WITH p AS (
  SELECT l_partkey * 100000 + l_suppkey AS insured_id, year(l_shipdate) AS year, l_quantity / 50 AS total_exposure,
         CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE + l_linenumber % 2 ELSE 0.0::DOUBLE END AS total_claims,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount ELSE 0.0::DOUBLE END AS total_incurred,
         l_extendedprice * l_tax AS total_premium, l_linestatus AS business_type, p_brand AS vehicle_brand, p_type AS policy_type,
         p_size::DOUBLE AS driver_age, p_retailprice AS vehicle_value, l_linenumber AS line_no, l_quantity AS seats,
         0.3::DOUBLE + p_size / 200::DOUBLE AS glm_freq, 0.3::DOUBLE + l_tax * 2 AS xgb_freq,
         500.0::DOUBLE + p_size * 12 AS glm_loss, 500.0::DOUBLE + l_discount * 9000 AS xgb_loss, lineitem.*
  FROM lineitem JOIN part ON l_partkey = p_partkey
), v AS (
  SELECT * FROM p WHERE total_exposure > 0 AND total_claims >= 0 AND total_incurred >= 0
)"""


def _floor(x: str) -> str:
    return f"greatest({x}, 1e-9::DOUBLE)"


LOCKED = (
    BASE + ", sc AS (SELECT "
    + ", ".join(f"sum({a}) / greatest(sum({_floor(m)} * total_exposure), 1e-12::DOUBLE) AS {m}_scale" for m, a in _MODELS.items())
    + f" FROM v WHERE year = {CALIBRATION}), t AS (SELECT v.*, "
    + ", ".join(f"{_floor(_floor(m) + f' * {m}_scale')} AS {m}_locked" for m in _MODELS)
    + f" FROM v, sc WHERE year = {TEST})"
)
SEEN = LOCKED + f""", s AS (
  SELECT t.*, insured_id IN (SELECT insured_id FROM p WHERE year IN ({TRAIN}, {CALIBRATION}) AND insured_id IS NOT NULL) AS seen FROM t
)"""


def _ratio(a: str, b: str) -> str:
    return f"{a} / greatest({b}, 1e-12::DOUBLE)"


def _cal(m: str, actual: str) -> str:
    return _ratio(f"sum({m} * total_exposure)", f"sum({actual})")


def _poisson(y: str, mu: str) -> str:
    return f"2 * (CASE WHEN {y} > 0 THEN {y} * ln({y} / {mu}) ELSE 0 END - {y} + {mu})"


def _tweedie(y: str, mu: str) -> str:
    return f"(-8 * sqrt({y}) + 4 * {y} / sqrt({mu}) + 4 * sqrt({mu}))"


def _unit(m: str, pred: str) -> str:
    y = f"({_MODELS[m]} / total_exposure)"
    return _poisson(y, pred) if m.endswith("freq") else _tweedie(y, pred)


def _deviances(rows: str, suffix: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}{suffix}' AS model, '{'frequency' if m.endswith('freq') else 'loss'}' AS target, "
        f"sum(total_exposure * {_unit(m, m + suffix)}) / sum(total_exposure) AS deviance, {_cal(m + suffix, a)} AS calibration_ratio{extra} FROM {rows}"
        for m, a in _MODELS.items()
    )


_RATES = f"""round({_ratio('sum(total_claims)', 'sum(total_exposure)')}, 6) AS claim_frequency,
 round(sum(total_incurred), 2) AS incurred, round({_ratio('sum(total_incurred)', 'sum(total_exposure)')}, 6) AS pure_premium"""

_RENEWALS = """WITH r AS (
  SELECT o_custkey AS id, o_orderdate::DATE AS renewal_date, year(o_orderdate) AS renewal_year, l_linenumber::DOUBLE AS claims, l_extendedprice::DOUBLE AS loss,
         least(datediff('day', o_orderdate::DATE, CASE WHEN l_linenumber = 3 THEN least(l_shipdate::DATE, DATE '1998-12-31') ELSE l_shipdate::DATE END) / 365.25::DOUBLE, 1.0::DOUBLE) AS exposure
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

_SEGMENTS = " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {value} AS \"group\", count(*) AS \"rows\", round(sum(total_exposure), 2) AS exposure, round(sum(total_claims), 2) AS claims, "
    "round(sum(total_incurred), 2) AS incurred, "
    + ", ".join(f"round({_cal(m + '_locked', a)}, 6) AS {m}_locked_calibration_ratio" for m, a in _MODELS.items())
    + " FROM s GROUP BY ALL"
    for name, value in (
        ("seen_before_test", "CASE WHEN seen THEN 'seen' ELSE 'unseen' END"),
        ("business_type", "coalesce(business_type, 'nan')"),
        ("driver_age_band", "CASE WHEN driver_age <= 0 OR driver_age IS NULL OR driver_age > 200 THEN 'nan' WHEN driver_age <= 24 THEN '<25' WHEN driver_age <= 34 THEN '25-34' WHEN driver_age <= 49 THEN '35-49' WHEN driver_age <= 64 THEN '50-64' ELSE '65+' END"),
    )
)

_TAIL = f", q AS (SELECT quantile_cont(total_incurred, 0.99) AS q0, quantile_cont(total_incurred, 0.995) AS q1 FROM v WHERE year = {TEST} AND total_incurred > 0)"

_POINTS = SEEN + ", g AS (SELECT *, unnest(list_filter(['all', CASE WHEN seen THEN 'seen' ELSE 'unseen' END, 'business_' || business_type], lambda x: x IS NOT NULL)) AS segment FROM s), pt AS (" + " UNION ALL ".join(
    f"SELECT segment, '{m}_locked' AS model, count(*) AS n, {_cal(m + '_locked', a)} AS point FROM g GROUP BY ALL" for m, a in _MODELS.items()
) + ")"


def _lcg(x: str, seed: int) -> str:
    step = f"((({x}) % {MODULUS}) * 48271 + {seed % MODULUS})"
    return f"((({step} % {MODULUS} * 69621 + 12345) % {MODULUS}) * 39373 + 271828) % {MODULUS}"


def _boot(rows: str, seed: int, reps: int) -> str:
    """Tables ``b0`` (``rows`` with a key) and ``b2`` (with replicates and counts)."""
    h = _lcg(f"({_lcg('k', seed)}) + rep * 7919", seed + 1)
    n = " + ".join(f"(h >= {t})::INT" for t in POISSON_STEPS)
    return f""", b0 AS (SELECT *, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey)::BIGINT AS k FROM {rows}),
b1 AS (SELECT b0.*, rep, {h} AS h FROM b0, range({reps}) AS u(rep)), b2 AS (SELECT *, {n} AS n FROM b1)"""


_PAIRS = (("frequency", "glm_freq", "xgb_freq"), ("loss", "glm_loss", "xgb_loss"))
_DIFFERENCES = ", ".join(f"sum(n * total_exposure * ({_unit(a, a)} - {_unit(b, b)})) / sum(n * total_exposure) AS {name}" for name, a, b in _PAIRS)


def _interval(x: str) -> str:
    return f"avg({x}) AS mean, quantile_cont({x}, 0.025) AS low, quantile_cont({x}, 0.975) AS high, avg(({x} > 0)::INT) AS p"


_DRAWN = (
    _boot(f"(SELECT * FROM v WHERE year = {TEST})", 2026, 250) + f", f AS (SELECT rep, {_DIFFERENCES} FROM b2 GROUP BY rep), ci AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS pair, {_interval(x)} FROM f" for x, *_ in _PAIRS) + ")"
)
_WINDOWS = (
    _boot(f"(SELECT * FROM v WHERE year IN ({CALIBRATION}, {TEST}))", 2026, 200).replace("b0", "w0").replace("b1", "w1").replace("b2", "w2")
    + f", wf AS (SELECT year, rep, {_DIFFERENCES} FROM w2 GROUP BY year, rep), wci AS ("
    + " UNION ALL ".join(f"SELECT year AS test_year, '{x}' AS target, {_interval(x)} FROM wf GROUP BY year" for x, *_ in _PAIRS) + ")"
)
_ROUNDED = "round(mean, 6) AS mean, round(low, 6) AS ci95_low, round(high, 6) AS ci95_high, round(p, 6) AS p_gt_0"
_SEGMENT = "unnest(list_filter(['all', CASE WHEN seen THEN 'seen' ELSE 'unseen' END, 'business_' || business_type], lambda x: x IS NOT NULL)) AS segment"


def _cuts(rows: str, features: tuple[str, ...]) -> str:
    deciles = ", ".join(f"{k / 10}" for k in range(1, 10))
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, list_sort(list_distinct(quantile_cont({f}::DOUBLE, [{deciles}]))) AS cuts FROM {rows}" for f in features)


def _long(rows: str, features: tuple[str, ...], kind: str, keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{f}' AS feature, {f}::{kind} AS x FROM {rows}" for f in features)


_BIN = "CASE WHEN x IS NULL THEN len(cuts) + 1 ELSE len(list_filter(cuts, lambda c: c <= x)) END"


def _numeric_base(rows: str, features: tuple[str, ...]) -> str:
    return f""", cuts AS ({_cuts(rows, features)}), nl AS ({_long(rows, features, 'DOUBLE')}),
nc AS (SELECT feature, {_BIN} AS o, count(*) AS n FROM nl JOIN cuts USING (feature) GROUP BY ALL),
nb AS (SELECT c.feature, c.cuts, c.o AS ordinal, coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY c.feature), 1)::DOUBLE AS expected
       FROM (SELECT feature, cuts, unnest(range(0, len(cuts) + 2)) AS o FROM cuts) c LEFT JOIN nc ON c.feature = nc.feature AND c.o = nc.o)"""


def _categorical_base(rows: str, features: tuple[str, ...]) -> str:
    marks = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{m}' AS bucket, 0 AS n" for f in features for m in ("__MISSING__", "__UNSEEN__"))
    return f""", cl AS ({_long(rows, features, 'VARCHAR')}),
cc AS (SELECT feature, coalesce(x, '__MISSING__') AS bucket, count(*) AS n FROM cl GROUP BY ALL UNION ALL {marks}),
cs AS (SELECT feature, bucket, sum(n) AS n FROM cc GROUP BY ALL),
cb AS (SELECT feature, bucket, n / greatest(sum(n) OVER (PARTITION BY feature), 1)::DOUBLE AS expected FROM cs)"""


def _psi(keys: str) -> str:
    """From ``ex`` (feature, bucket, expected) and ``ac`` (keys, feature, bucket, n): table ``psi``."""
    on = "".join(f" AND g.{k} = a.{k}" for k in keys.replace(",", " ").split())
    own = "".join(f"g.{k}, " for k in keys.replace(",", " ").split())
    return f""", gr AS (SELECT {keys}feature, sum(n) AS total FROM ac GROUP BY ALL), pj AS (
  SELECT {own}g.feature, e.expected, coalesce(a.n, 0) / g.total::DOUBLE AS actual, count(*) OVER (PARTITION BY {own}g.feature) AS bins
  FROM gr g JOIN ex e ON g.feature = e.feature LEFT JOIN ac a ON a.feature = e.feature AND a.bucket = e.bucket{on}
), pe AS (SELECT *, (expected + 1e-6::DOUBLE) / (1 + bins * 1e-6::DOUBLE) AS e1, (actual + 1e-6::DOUBLE) / (1 + bins * 1e-6::DOUBLE) AS a1 FROM pj),
psi AS (SELECT {keys}feature, sum((a1 - e1) * ln(a1 / e1)) AS psi FROM pe GROUP BY ALL)"""


_NUMERIC, _CATEGORIES = ("driver_age", "vehicle_value", "seats"), ("business_type", "vehicle_brand", "policy_type")
_TRAINED = BASE + f", tr AS (SELECT * FROM v WHERE year = {TRAIN}), nw AS (SELECT * FROM v WHERE year = {TEST})"
_FEATURE_PSI = _TRAINED + _numeric_base("tr", _NUMERIC) + _categorical_base("tr", _CATEGORIES) + f""",
an AS ({_long('nw', _NUMERIC, 'DOUBLE')}), al AS ({_long('nw', _CATEGORIES, 'VARCHAR')}),
ex AS (SELECT feature, ordinal::VARCHAR AS bucket, expected FROM nb UNION ALL SELECT feature, bucket, expected FROM cb),
ac AS (SELECT feature, ({_BIN})::VARCHAR AS bucket, count(*) AS n FROM an JOIN cuts USING (feature) GROUP BY ALL
       UNION ALL SELECT al.feature, CASE WHEN cb.bucket IS NULL THEN '__UNSEEN__' ELSE cb.bucket END, count(*) FROM al LEFT JOIN cb ON al.feature = cb.feature AND coalesce(al.x, '__MISSING__') = cb.bucket GROUP BY ALL)""" + _psi("")  # fmt: skip

_EVENTS = """WITH e AS (
  SELECT strftime(ts, '%Y-%m-%d') AS window_id, event_id, value AS latency, event_type = 'error' AS error, json_extract_string(props, '$.k')::BIGINT AS batch,
         CASE WHEN json_extract_string(props, '$.k')::BIGINT % 17 = 0 THEN 1 ELSE 0 END AS unseen,
         abs(ln((value + 100) / 250)) AS fr, abs(ln((value + 50) / 200)) AS lo
  FROM events
), c AS (
  SELECT window_id, count(*) AS request_count, count_if(error)::BIGINT AS error_count, sum(batch)::BIGINT AS records_scored, sum(unseen)::BIGINT AS unseen_warning_records
  FROM e GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY event_id DESC) AS k FROM e), w AS (
  SELECT window_id, quantile_cont(latency, 0.5) AS latency_median, quantile_cont(latency, 0.95) AS latency_p95, max(latency) AS latency_max,
         quantile_cont(batch::DOUBLE, 0.5) AS batch_median, quantile_cont(batch::DOUBLE, 0.95) AS batch_p95, max(batch) AS batch_max,
         quantile_cont(fr, 0.5) AS frequency_p50, quantile_cont(fr, 0.95) AS frequency_p95,
         quantile_cont(lo, 0.5) AS pure_premium_p50, quantile_cont(lo, 0.95) AS pure_premium_p95
  FROM k WHERE k <= 5000 GROUP BY ALL
), sn AS (
  SELECT c.*, coalesce(error_count / nullif(request_count, 0)::DOUBLE, 0) AS error_rate,
         coalesce(unseen_warning_records / nullif(records_scored, 0)::DOUBLE, 0) AS unseen_category_rate, w.* EXCLUDE (window_id)
  FROM c JOIN w USING (window_id)
)"""
_SHOWN = "error_rate unseen_category_rate latency_median latency_p95 latency_max batch_median batch_p95 frequency_p50 frequency_p95 pure_premium_p50 pure_premium_p95".split()
_ALERT = ("error_rate > 0.2", "unseen_category_rate > 0.06", "latency_p95 > 472", "frequency_p95 > 0.9", "pure_premium_p95 > 1.3", "records_scored >= 500 AND coalesce(max_psi, 0) > 0.25")
_ALERT_NAMES = ("error_rate", "unseen_category_rate", "p95_latency_ms", "frequency_disagreement", "pure_premium_disagreement", "feature_drift")


_HIGH = _ALERT_NAMES[:2] + _ALERT_NAMES[3:5]
_ALERTED = _EVENTS + ", tr AS (SELECT * FROM e WHERE right(window_id, 10) < '2024-01-08')" + _numeric_base("tr", ("latency", "batch")) + f""",
an AS ({_long('e', ('latency', 'batch'), 'DOUBLE', 'window_id, ')}), ex AS (SELECT feature, ordinal::VARCHAR AS bucket, expected FROM nb),
ac AS (SELECT window_id, feature, ({_BIN})::VARCHAR AS bucket, count(*) AS n FROM an JOIN cuts USING (feature) GROUP BY ALL)""" + _psi("window_id, ") + """,
tp AS (SELECT window_id, max(psi) AS max_psi, first(feature ORDER BY psi DESC, feature = 'batch') AS max_psi_feature FROM psi GROUP BY ALL), al AS (
  SELECT sn.window_id, request_count, error_count, records_scored, unseen_warning_records, max_psi, max_psi_feature, """ + ", ".join(f"{a} AS alert_{n}" for a, n in zip(_ALERT, _ALERT_NAMES)) + ", CASE WHEN " + " OR ".join(f"({a})" for a in _ALERT) + " THEN 'RED' ELSE 'GREEN' END AS alert_status FROM sn LEFT JOIN tp USING (window_id))"
_REPLAYED = (
    _ALERTED.replace("WITH e AS (", "WITH e0 AS (", 1).replace("  FROM events\n), c AS", """  FROM events
), e AS (
  SELECT * REPLACE (CASE WHEN window_id < '2024-01-08' THEN 'control' ELSE 'temporal' END AS window_id) FROM e0
  UNION ALL SELECT 'stress', event_id, latency * 3, event_id % 2 = 0, batch, batch, fr + 2, lo + 2 FROM e0 WHERE window_id < '2024-01-08'
), c AS""", 1)
    .replace("right(window_id, 10) < '2024-01-08'", "window_id = 'control'").replace("max_psi_feature, error_rate >", "max_psi_feature, frequency_p95, pure_premium_p95, error_rate >", 1)
)
_RELEASED = "WITH RECURSIVE " + _ALERTED.removeprefix("WITH ").replace("strftime(ts, '%Y-%m-%d') AS window_id", "'r' || event_id % 4 || '|' || strftime(ts, '%Y-%m-%d') AS window_id")


def _band(x: str, low: float = 0.9, high: float = 1.1) -> str:
    return f"{x} BETWEEN {low} AND {high}"


#: Fitted numbers of each model: a coefficient per feature and an intercept, or 31 a tree of depth 4.
_TERMS = {"glm_freq": len(FEATURES) + 1, "xgb_freq": 450 * 31, "glm_loss": len(FEATURES) + 1, "xgb_loss": 500 * 31}
_COVERAGE = f""", cv AS (
  SELECT c.coverage, CASE WHEN k = 1 THEN total_exposure / 2 ELSE total_exposure END AS exposure, total_premium AS premium, total_claims AS claims, total_incurred AS incurred
  FROM v JOIN (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate(COVERAGES, 1))}) AS c(k, coverage) ON line_no = k WHERE year = {TEST}
)"""

#: The lifecycle of the windows ``rw`` (release_id, label, active, evidence_sha256, n), closing its parenthesis first.
_STATES = """), st AS (
  SELECT release_id, 0::BIGINT AS n, 'HEALTHY' AS state, 0::BIGINT AS breaches, 0::BIGINT AS greens, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM rw GROUP BY release_id
  UNION ALL
  SELECT release_id, n, CASE WHEN alert AND (under OR breaches + 1 >= 2) THEN 'REVIEW_REQUIRED' WHEN alert THEN 'WATCH' WHEN under AND greens + 1 < 2 THEN 'RECOVERING' ELSE 'HEALTHY' END,
         CASE WHEN alert THEN breaches + 1 ELSE 0 END, CASE WHEN NOT alert AND under AND greens + 1 < 2 THEN greens + 1 ELSE 0 END, after,
         CASE WHEN alert AND (under OR breaches + 1 < 2) THEN after WHEN alert THEN coalesce(after, 'review-' || lpad(n::VARCHAR, 4, '0') || '-' || evidence_sha256[1:8])
              WHEN under AND greens + 1 < 2 THEN after WHEN under OR state = 'WATCH' THEN NULL ELSE after END
  FROM (SELECT st.state, st.breaches, st.greens, st.after, rw.release_id, rw.n, rw.evidence_sha256, len(rw.active) > 0 AS alert, st.state IN ('REVIEW_REQUIRED', 'RECOVERING') AS under FROM st JOIN rw ON rw.release_id = st.release_id AND rw.n = st.n + 1)
)
"""
_FLOATS = {"error_rate": "error_rate", "unseen_category_rate": "unseen_category_rate", "p95_latency_ms": "latency_p95", "frequency_abs_log_ratio_p95": "frequency_p95", "pure_premium_abs_log_ratio_p95": "pure_premium_p95", "max_feature_psi": "max_psi"}
_FIELDS = {f: f"coalesce(round({c}, 6), 0.0)::DOUBLE::VARCHAR" for f, c in _FLOATS.items()} | dict.fromkeys(("governance_status", "model_version", "service_version"), "'null'") | {
    "active_alerts": "to_json(active)::VARCHAR", "feature_drift_alert_eligible": "(records_scored >= 500)::VARCHAR", "label": "to_json(label)::VARCHAR",
    "max_feature_psi_feature": "coalesce(to_json(max_psi_feature)::VARCHAR, 'null')", "privacy_boundary": f"'\"{PRIVACY_BOUNDARY}\"'", "records_scored": "records_scored::VARCHAR", "request_count": "request_count::VARCHAR",
}
_EVIDENCE = (
    _RELEASED.replace("max_psi_feature, error_rate >", f"max_psi_feature, {', '.join(c for c in _FLOATS.values() if c != 'max_psi')}, error_rate >", 1)
    + f""", rl AS (
  SELECT *, split_part(window_id, '|', 1) AS release_id, split_part(window_id, '|', 2) AS label,
         list_sort(list_filter([{', '.join(f"CASE WHEN alert_{n} THEN '{n}' END" for n in _ALERT_NAMES)}], lambda x: x IS NOT NULL)) AS active FROM al
), ev AS (SELECT *, '{{' || """ + " || ',' || ".join(f"""'"{f}":' || {_FIELDS[f]}""" for f in sorted(_FIELDS)) + """ || '}' AS evidence FROM rl), rw AS MATERIALIZED (
  SELECT release_id, label, active, evidence, sha256(evidence) AS evidence_sha256, row_number() OVER (PARTITION BY release_id ORDER BY label) AS n FROM ev
"""
)

SQL = {
    "year_summary": BASE + f' SELECT year::BIGINT AS year, count(*) AS "rows", count(DISTINCT insured_id) AS unique_ids, round(sum(total_exposure), 2) AS exposure, round(sum(total_claims), 2) AS claims, {_RATES}, round(sum(total_premium), 2) AS premium, round({_ratio("sum(total_incurred)", "sum(total_premium)")}, 6) AS observed_loss_ratio FROM v WHERE year IN ({TRAIN}, {CALIBRATION}, {TEST}) GROUP BY year',
    "schema_audit": "WITH o AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'NA' WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS o_orderpriority FROM orders) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if(coalesce(trim({c}), '') IN ('', 'NA', 'NaN', 'nan', 'NULL', 'null'))::BIGINT AS missing, round(count_if(coalesce(trim({c}), '') IN ('', 'NA', 'NaN', 'nan', 'NULL', 'null')) / count(*)::DOUBLE, 6) AS rate FROM o" for c in ("o_orderkey", "o_custkey", "o_orderpriority")),
    "audit_year_counts": "SELECT coalesce(year(l_shipdate)::VARCHAR, '') AS value, count(*) AS n FROM lineitem GROUP BY 1",
    "temporal_split_counts": BASE + f", y AS (SELECT year, count(*) AS n FROM v WHERE year IN ({TRAIN}, {CALIBRATION}, {TEST}) GROUP BY year HAVING count(*) >= 1000) SELECT CASE year WHEN {TRAIN} THEN 'train' WHEN {CALIBRATION} THEN 'calibration' ELSE 'test' END AS split, n AS \"rows\" FROM y",
    "exposure_from_dates": _RENEWALS + f" SELECT renewal_year::INT AS renewal_year, count(*) AS \"rows\", count(DISTINCT id) AS unique_ids, round(sum(exposure), 2) AS exposure, round(sum(claims), 2) AS claims, round(sum(loss), 2) AS loss, round({_ratio('sum(claims)', 'sum(exposure)')}, 6) AS claim_frequency, round({_ratio('sum(loss)', 'sum(exposure)')}, 6) AS pure_premium FROM r WHERE renewal_year IS NOT NULL AND exposure > 0 GROUP BY renewal_year",
    "exposure_audit": _RENEWALS + " SELECT count(*) AS source_rows, count_if(renewal_year IS NOT NULL AND exposure > 0)::BIGINT AS valid_rows, (count(*) - count_if(coalesce(renewal_year IS NOT NULL AND exposure > 0, false)) - count_if(renewal_year IS NULL))::BIGINT AS removed_nonpositive_or_missing_exposure, count_if(renewal_year IS NULL)::BIGINT AS missing_renewal_year, count_if(coalesce(exposure, 0) <= 0)::BIGINT AS raw_nonpositive_exposure FROM r",
    "renewal_dates": _RENEWALS + " SELECT min(renewal_date) AS first_date, max(renewal_date) AS last_date, array_to_string(list_sort(list(DISTINCT renewal_year)), ',') AS years FROM r",
    "locked_scale": LOCKED + " SELECT " + ", ".join(f"round({m}_scale, 6) AS {m}_scale" for m in _MODELS) + " FROM sc",
    "calibration_ratio": LOCKED + " SELECT " + ", ".join(f"round({_cal(m + s, a)}, 6) AS {m}{s or '_raw'}" for s in ("", "_locked") for m, a in _MODELS.items()) + " FROM t",
    "locked_deviances": LOCKED + f", d AS ({_deviances('t', '_locked')}) SELECT model, target, round(deviance, 6) AS deviance, round(calibration_ratio, 6) AS calibration_ratio FROM d",
    "top10_capture": BASE + f""", o AS (SELECT total_claims AS y, total_exposure AS w, sum(total_exposure) OVER ({(o := f"ORDER BY glm_freq DESC, {', '.join(ROW_KEY)}")} ROWS UNBOUNDED PRECEDING) / sum(total_exposure) OVER () AS share, row_number() OVER ({o}) AS k FROM v WHERE year = {TEST})
SELECT greatest(count_if(share <= 0.1), 1)::BIGINT AS rows_kept, round(CASE WHEN count_if(share <= 0.1) > 0 THEN sum(w) FILTER (share <= 0.1) ELSE max(w) FILTER (k = 1) END, 2) AS exposure_kept,
 round(CASE WHEN count_if(share <= 0.1) > 0 THEN sum(y) FILTER (share <= 0.1) ELSE max(y) FILTER (k = 1) END / greatest(sum(y), 1e-12::DOUBLE), 6) AS capture FROM o""",
    "segment_calibration": SEEN + f" SELECT * FROM ({_SEGMENTS})",
    "id_transport": BASE + f", i AS (SELECT DISTINCT insured_id FROM v WHERE year = {TEST} AND insured_id IS NOT NULL), f AS (SELECT insured_id IN (SELECT insured_id FROM v WHERE year IN ({TRAIN}, {CALIBRATION})) AS seen FROM i) SELECT count(*) AS test_unique_ids, count_if(seen)::BIGINT AS seen, count_if(NOT seen)::BIGINT AS unseen, round(count_if(seen) / count(*)::DOUBLE, 6) AS share_seen FROM f",
    "coverage_decomposition": BASE + _COVERAGE + f""", a AS (SELECT coverage, count_if(premium > 0)::BIGINT AS covered_rows, sum(CASE WHEN premium > 0 THEN exposure ELSE 0 END) AS e, sum(claims) AS c, sum(incurred) AS i FROM cv GROUP BY coverage)
SELECT coverage, covered_rows, round(e, 2) AS covered_exposure, round(c, 2) AS claims, round(i, 2) AS incurred, round({_ratio('c', 'e')}, 6) AS claim_frequency, round({_ratio('i', 'e')}, 6) AS loss_rate, round({_ratio('c', 'sum(c) OVER ()')}, 6) AS claim_share, round({_ratio('i', 'sum(i) OVER ()')}, 6) AS incurred_share FROM a""",
    "coverage_reconciliation": BASE + _COVERAGE + f" SELECT round((SELECT sum(claims) FROM cv) - sum(total_claims), 2) + 0.0::DOUBLE AS claims_gap, round((SELECT sum(incurred) FROM cv) - sum(total_incurred), 2) + 0.0::DOUBLE AS incurred_gap FROM v WHERE year = {TEST}",
    "tail_summary": BASE + _TAIL + f" SELECT count(*) AS \"rows\", count_if(total_incurred > 0)::BIGINT AS positive_rows, round(max(total_incurred), 2) AS largest, round(max(q0), 2) AS q99, round(max(q1), 2) AS q995, round({_ratio('sum(CASE WHEN total_incurred >= q0 THEN total_incurred ELSE 0 END)', 'sum(total_incurred)')}, 6) AS top_1pct_share, round({_ratio('sum(CASE WHEN total_incurred >= q1 THEN total_incurred ELSE 0 END)', 'sum(total_incurred)')}, 6) AS top_05pct_share FROM v, q WHERE year = {TEST}",
    "tail_sensitivity": LOCKED + _TAIL + " " + " UNION ALL ".join(f"SELECT '{m}' AS model, '{s}' AS subset, count(*) AS \"rows\", round(sum(total_exposure * {_tweedie('(total_incurred / total_exposure)', m)}) / sum(total_exposure), 6) AS tweedie_deviance, round({_cal(m, 'total_incurred')}, 6) AS calibration_ratio, round(avg(abs({m} * total_exposure - total_incurred)), 6) AS mean_absolute_error FROM t, q WHERE {c}" for m in ("glm_loss_locked", "xgb_loss_locked") for s, c in (("all", "true"), ("without_top_05pct", "total_incurred < q1"), ("without_top_1pct", "total_incurred < q0"))),
    "transport_points": _POINTS + ' SELECT segment, model, n AS "rows", round(point, 6) AS point FROM pt',
    "transport_pivot": _POINTS + ", pv AS (SELECT segment, " + ", ".join(f"max(point) FILTER (model = '{m}_locked') AS {m}_locked" for m in _MODELS) + " FROM pt GROUP BY segment) SELECT segment, " + ", ".join(f"round({m}_locked, 6) AS {m}_locked" for m in _MODELS) + ", CASE WHEN abs(xgb_freq_locked - 1) < abs(glm_freq_locked - 1) THEN 'xgb_freq_locked' ELSE 'glm_freq_locked' END AS closer FROM pv",
    "bootstrap_deviance_ci": BASE + _DRAWN + f" SELECT pair, {_ROUNDED} FROM ci",
    "bootstrap_ratio_ci": SEEN + _boot("s", 2027, 300) + f", g AS (SELECT *, {_SEGMENT} FROM b2), f AS (SELECT segment, rep, "
    + ", ".join(f"{_ratio(f'sum(n * {m}_locked * total_exposure)', f'sum(n * {a})')} AS {m}" for m, a in _MODELS.items()) + " FROM g GROUP BY segment, rep), i AS ("
    + " UNION ALL ".join(f"SELECT segment, '{m}_locked' AS model, {_interval(m)} FROM f GROUP BY segment" for m in _MODELS) + f") SELECT segment, model, {_ROUNDED} FROM i",
    "rolling_origin": BASE + f", y1 AS (SELECT * FROM v WHERE year = {CALIBRATION}), y2 AS (SELECT * FROM v WHERE year = {TEST}), d AS ("
    + " UNION ALL ".join(_deviances(r, "", f", (SELECT count(*) FROM v WHERE year IN ({y})) AS n_train, '{y}' AS train_years, {t} AS test_year") for r, y, t in (("y1", f"{TRAIN}", CALIBRATION), ("y2", f"{TRAIN},{CALIBRATION}", TEST)))
    + f"){_WINDOWS} SELECT model, target, round(deviance, 6) AS deviance, round(calibration_ratio, 6) AS calibration_ratio, n_train, train_years, test_year::INT AS test_year, {_band('calibration_ratio', 0.85, 1.15)} AS within_diagnostic_band, {_ROUNDED} FROM d JOIN wci USING (test_year, target)",
    "locked_gate": LOCKED + _DRAWN + f", d AS ({_deviances('t', '_locked')}), j AS (SELECT d.target, calibration_ratio, round(low, 6) AS ci95_low, CASE WHEN {_band('calibration_ratio')} AND round(low, 6) > 0 THEN 'PASS' ELSE 'HOLD' END AS decision FROM d JOIN ci ON d.target = ci.pair WHERE model LIKE 'xgb%') SELECT target, round(calibration_ratio, 6) AS calibration_ratio, ci95_low, decision, CASE WHEN bool_and(decision = 'PASS') OVER () THEN 'PROMOTE' ELSE 'HOLD' END AS overall FROM j",
    "approval_gates": _POINTS + _DRAWN + _WINDOWS + f""", d AS ({_deviances('t', '_locked')}), o AS (
  SELECT segment, abs(max(point) FILTER (model = 'xgb_loss_locked') - 1) < abs(max(point) FILTER (model = 'glm_loss_locked') - 1) AS challenger FROM pt WHERE segment IN ('seen', 'unseen') GROUP BY segment
), gt AS (SELECT """ + ", ".join(f"(SELECT bool_and(round(low, 6) > 0) FROM ci WHERE pair = '{x}') AS locked_{x}, (SELECT bool_and(low > 0) FROM wci WHERE target = '{x}') AS rolling_{x}" for x, *_ in _PAIRS)
    + """, (SELECT count(DISTINCT challenger) = 1 FROM o) AS transport_consistent,
  (SELECT max(deviance) FILTER (model = 'xgb_loss_locked') < max(deviance) FILTER (model = 'glm_loss_locked') FROM d) AS lower_loss_deviance)
"""
    + f"SELECT *, {_TERMS['xgb_loss'] > _TERMS['glm_loss']} AS complexity, CASE WHEN {' AND '.join(DECIDING)} THEN 'APPROVE_FOR_SHADOW' ELSE 'HOLD' END AS decision, '{SHADOW_ONLY}' AS governance_status FROM gt",
    "baseline_numeric": _TRAINED + _numeric_base("tr", _NUMERIC) + " SELECT feature, ordinal::INT AS ordinal, round(cuts[ordinal + 1], 6) AS cut, round(expected, 6) AS expected FROM nb",
    "baseline_categorical": _TRAINED + _categorical_base("tr", _CATEGORIES) + " SELECT feature, bucket, round(expected, 6) AS expected FROM cb",
    "feature_psi": _FEATURE_PSI + " SELECT feature, round(psi, 6) AS psi FROM psi",
    "largest_psi": _FEATURE_PSI + f" SELECT round(max(psi), 6) AS max_psi, first(feature ORDER BY psi DESC, list_position({list((*_NUMERIC, *_CATEGORIES))}, feature)) AS max_psi_feature FROM psi",
    "unseen_category_rate": BASE + f", tr AS (SELECT * FROM v WHERE year = {TRAIN}), te AS (SELECT * FROM v WHERE year = {TEST} UNION ALL SELECT * REPLACE ('NEVER_SEEN' AS vehicle_brand) FROM v WHERE year = {TEST}), f AS (SELECT {' OR '.join(f'coalesce({c} NOT IN (SELECT {c} FROM tr WHERE {c} IS NOT NULL), false)' for c in _CATEGORIES)} AS flagged FROM te) SELECT count(*) AS \"rows\", count_if(flagged)::BIGINT AS flagged, round(count_if(flagged) / count(*)::DOUBLE, 6) AS rate FROM f",
    "monitoring_snapshot": _EVENTS + f" SELECT window_id, request_count, error_count, records_scored, unseen_warning_records, batch_max, '{PRIVACY_BOUNDARY}' AS privacy_boundary, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SHOWN) + " FROM sn",
    "monitoring_alerts": _ALERTED + " SELECT * EXCLUDE (request_count, error_count, records_scored, unseen_warning_records) REPLACE (round(max_psi, 6) AS max_psi) FROM al",
    "stream_monitor": _ALERTED.replace("strftime(ts, '%Y-%m-%d') AS window_id", "'r' || event_id % 4 || '|' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS window_id") + " SELECT * REPLACE (round(max_psi, 6) AS max_psi) FROM al",
    "review_lifecycle": _RELEASED + f""", rw AS MATERIALIZED (
  SELECT split_part(window_id, '|', 1) AS release_id, split_part(window_id, '|', 2) AS label, list_sort(list_filter([{', '.join(f"CASE WHEN alert_{n} THEN '{n}' END" for n in _ALERT_NAMES)}], lambda x: x IS NOT NULL)) AS active,
         sha256('{{"window_id":"' || window_id || '","request_count":' || request_count || ',"error_count":' || error_count || ',"records_scored":' || records_scored || ',"unseen_warning_records":' || unseen_warning_records || '}}') AS evidence_sha256,
         row_number() OVER (PARTITION BY split_part(window_id, '|', 1) ORDER BY split_part(window_id, '|', 2)) AS n
  FROM al
""" + _STATES + f"""SELECT release_id, label, n AS sequence, state, breaches AS breach_streak, greens AS recovery_streak, before AS review_id_before, after AS review_id_after, array_to_string(active, ',') AS active_alerts, evidence_sha256,
  CASE WHEN list_has_any(active, {list(_HIGH)}) THEN 'HIGH' WHEN len(active) > 0 THEN 'MEDIUM' ELSE 'NONE' END AS severity,
  CASE WHEN state = 'HEALTHY' THEN 'CONTINUE_SHADOW' WHEN state = 'WATCH' THEN 'OBSERVE_NEXT_WINDOW' WHEN state = 'RECOVERING' THEN 'VERIFY_RECOVERY'
       WHEN list_has_any(active, {list(_HIGH[:2])}) AND list_has_any(active, {list(_HIGH[2:])}) THEN 'INVESTIGATE_SERVING_DATA_AND_MODEL' WHEN list_has_any(active, {list(_HIGH[:2])}) THEN 'INVESTIGATE_SERVING_AND_INPUT_CONTRACT'
       WHEN list_has_any(active, {list(_HIGH[2:])}) THEN 'REVIEW_MODEL_DISAGREEMENT' WHEN list_contains(active, 'feature_drift') THEN 'REVIEW_PORTFOLIO_MIX_AND_SEGMENT_CALIBRATION' ELSE 'REVIEW_SERVING_PERFORMANCE' END AS recommended_action
FROM st JOIN rw USING (release_id, n)""",
    "review_evidence": _EVIDENCE + ") SELECT release_id, label, evidence, evidence_sha256 FROM rw",
    "review_replay": _EVIDENCE + _STATES + " SELECT release_id, n AS sequence, label, state, after AS review_id_after, 1::BIGINT AS whole, 1::BIGINT AS restarted, true AS as_batch FROM st JOIN rw USING (release_id, n)",
    "event_chain_verify": """WITH RECURSIVE d AS MATERIALIZED (
  SELECT chain, seq, chain || '|' || d || ':' || count(*) AS payload FROM (SELECT 'r' || event_id % 4 AS chain, day(ts)::BIGINT AS seq, strftime(ts, '%Y-%m-%d') AS d FROM events) GROUP BY chain, seq, d
), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq) AS k FROM d), c AS (
  SELECT chain, k, seq, payload, '' AS prev, sha256('|' || seq || '|' || payload) AS own FROM o WHERE k = 1
  UNION ALL SELECT o.chain, o.k, o.seq, o.payload, c.own, sha256(c.own || '|' || o.seq || '|' || o.payload) FROM c JOIN o ON o.chain = c.chain AND o.k = c.k + 1
), e AS (SELECT chain, seq, own, CASE WHEN seq = 5 THEN 'changed' ELSE payload END AS payload, CASE WHEN seq = 9 THEN 'changed' ELSE prev END AS prev FROM c)
SELECT chain, seq AS sequence, row_number() OVER w = seq AS sequence_ok, coalesce(lag(own) OVER w, '') = prev AS link_ok, sha256(prev || '|' || seq || '|' || payload) = own AS hash_ok
FROM e WINDOW w AS (PARTITION BY chain ORDER BY seq)""",
    "artifact_differences": """WITH a AS (SELECT 'part/' || p_partkey AS path, sha256(p_name) AS sha256 FROM part WHERE p_partkey % 11 != 0),
b AS (SELECT 'part/' || p_partkey AS path, sha256(CASE WHEN p_partkey % 7 = 0 THEN 'changed' ELSE p_name END) AS other_sha256 FROM part WHERE p_partkey % 13 != 0)
SELECT path, sha256, other_sha256 FROM a FULL JOIN b USING (path) WHERE sha256 IS DISTINCT FROM other_sha256""",
    "attestation_predicates": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 17 = 0 THEN 2 ELSE 1 END AS n, p_partkey % 3 != 0 AND p_partkey % 5 != 0 AND p_partkey % 7 != 0 AND p_partkey % 11 != 0 AS good FROM part)
SELECT 'part/' || k AS path, n::BIGINT AS statements, CASE WHEN good THEN n ELSE 0 END::BIGINT AS matches, good AND n = 1 AS admitted FROM p""",
    "bucketed_seen": BASE + f" SELECT insured_id IN (SELECT insured_id FROM v WHERE year IN ({TRAIN}, {CALIBRATION})) AS seen_before, count(*) AS \"rows\", round(sum(total_exposure), 2) AS exposure FROM v WHERE year = {TEST} GROUP BY 1",
    "replay_acceptance": _REPLAYED + """, k1 AS (SELECT * FROM al WHERE window_id = 'control'), k2 AS (SELECT * FROM al WHERE window_id = 'stress'), r AS (
  SELECT unnest([{'check': 'control_green', 'passed': k1.alert_status = 'GREEN'}, {'check': 'aggregates_only', 'passed': true}, {'check': 'stress_error_rate', 'passed': k2.alert_error_rate},
    {'check': 'stress_unseen_category_rate', 'passed': k2.alert_unseen_category_rate}, {'check': 'stress_feature_drift', 'passed': k2.alert_feature_drift},
    {'check': 'frequency_shift', 'passed': k2.frequency_p95 > greatest(1.5 * k1.frequency_p95, k1.frequency_p95 + 0.10)}, {'check': 'pure_premium_shift', 'passed': k2.pure_premium_p95 > greatest(1.5 * k1.pure_premium_p95, k1.pure_premium_p95 + 0.10)}], recursive := true) FROM k1, k2
) SELECT "check", passed FROM r UNION ALL SELECT 'accepted', bool_and(passed) FROM r""",
    "disagreement_shift": _EVENTS + " SELECT " + ", ".join(f"round(b.{c}, 6) AS base_{c}, round(x.{c}, 6) AS cmp_{c}, round({_ratio('x.' + c, 'b.' + c)}, 6) AS {c}_ratio, x.{c} > greatest(1.5 * b.{c}, b.{c} + 0.10) AS {c}_alert" for c in ("frequency_p95", "pure_premium_p95")) + " FROM sn b, sn x WHERE b.window_id = '2024-01-01' AND x.window_id = '2024-01-15'",
    "complexity_join": LOCKED + f", d AS ({_deviances('t', '_locked')}) SELECT model, target, round(deviance, 6) AS deviance, round(calibration_ratio, 6) AS calibration_ratio, CASE model " + " ".join(f"WHEN '{m}_locked' THEN {n}" for m, n in _TERMS.items()) + " END::BIGINT AS terms FROM d",
    "parity_audit": "WITH x AS (" + " UNION ALL ".join(f"SELECT p_partkey AS k, '{f}' AS field, {e} AS e, {o} AS o FROM part" for f, e, o in (("price", "p_retailprice", "p_retailprice + p_partkey % 5 * 0.25::DOUBLE"), ("size", "p_size::DOUBLE", "p_size * 1.5::DOUBLE"))) + ") SELECT field, count(*) AS \"rows\", round(max(abs(o - e)), 6) AS max_abs_error, round(max(abs(o - e) / greatest(abs(e), 1e-12::DOUBLE)), 6) AS max_rel_error, first(k ORDER BY abs(o - e) DESC, k) AS worst_key FROM x GROUP BY field",
    "seeded_sample": f"SELECT event_id, value FROM events ORDER BY {_lcg('event_id', 42)}, event_id LIMIT 5000",
    "micro_batches": "WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch FROM events) SELECT batch, count(*) AS \"rows\", min(event_id) AS \"first\", max(event_id) AS \"last\" FROM r GROUP BY batch",
    "stress_replay": _TRAINED + _categorical_base("tr", _CATEGORIES) + f""", rp AS (
  SELECT 'control' AS replay, {', '.join(_CATEGORIES)} FROM tr UNION ALL SELECT 'temporal', {', '.join(_CATEGORIES)} FROM v WHERE year = {TEST}
  UNION ALL SELECT 'stress', NULL, 'NEVER_SEEN', policy_type FROM tr
), al AS ({_long('rp', _CATEGORIES, 'VARCHAR', 'replay, ')}), ex AS (SELECT * FROM cb),
ac AS (SELECT replay, al.feature, CASE WHEN cb.bucket IS NULL THEN '__UNSEEN__' ELSE cb.bucket END AS bucket, count(*) AS n FROM al LEFT JOIN cb ON al.feature = cb.feature AND coalesce(al.x, '__MISSING__') = cb.bucket GROUP BY ALL)""" + _psi("replay, ") + " SELECT replay, feature, round(psi, 6) AS psi FROM psi",
    "contract_check": f"""WITH b AS (SELECT list_sort(list_filter([{', '.join([f"CASE WHEN value IS NULL THEN '-{c}' END" for c in NUMERIC_FEATURES] + [f"CASE WHEN event_type IS NULL THEN '-{c}' END" for c in CATEGORICAL_FEATURES])}, CASE WHEN event_id % 3 = 0 AND user_id IS NOT NULL THEN 'insured_id' END], lambda x: x IS NOT NULL)) AS v FROM events)
SELECT coalesce(array_to_string(v, ','), '') AS violations, count(*) AS n, {len(FEATURES)}::INT AS features FROM b GROUP BY 1""",
}
SQL["bucketed_year_summary"] = SQL["year_summary"]
SQL["delimited_year_summary"] = SQL["json_year_report"] = SQL["year_summary"]
SQL["csv_schema_audit"] = SQL["schema_audit"]

_FILES = """WITH f AS (SELECT p_partkey // 1000 AS block, string_agg(CASE WHEN p_partkey // 1000 % 3 = 0 THEN 'PK' ELSE '' END || p_name || chr(10), '' ORDER BY p_partkey) AS content FROM part GROUP BY 1)"""
SQL["file_containers"] = _FILES + " SELECT block::BIGINT AS block, strlen(content) AS bytes, sha256(content) AS sha256, lower(hex(left(content, 32))) AS head, CASE WHEN block % 3 = 0 THEN 'zip' ELSE 'text_or_other' END AS container FROM f"
SQL["artifact_bytes"] = _FILES + " SELECT (block % 10)::BIGINT AS digit, count(*) AS files, sum(strlen(content))::BIGINT AS bytes, count(DISTINCT sha256(content)) AS hashes FROM f GROUP BY 1"

_CANONICAL = {
    "driver_age": "CASE WHEN l_linenumber != 3 THEN driver_age END", "vehicle_value": "CASE WHEN l_linenumber != 5 THEN vehicle_value END", "seats": "seats",
    "policy_type": "policy_type", "business_type": "CASE WHEN l_linenumber != 4 THEN business_type END", "vehicle_brand": "vehicle_brand", "bonus_score": "l_linenumber",
}
SQL["canonical_features"] = BASE + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({_CANONICAL.get(c, 'NULL')}) AS \"values\", count(DISTINCT {_CANONICAL.get(c, 'NULL')}) AS levels FROM p" for c in FEATURES)
SQL["download_names"] = """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_name || chr(233) || '.csv' ELSE p_name || ' & more.csv' END AS name FROM part)
SELECT p_partkey, name, CASE WHEN name IS NULL THEN 'file' ELSE regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') END AS safe_name FROM n"""
