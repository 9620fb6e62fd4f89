"""What a scoring record may hold, and the constants every part of the library agrees on."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Feature lists, in contract order, and the fields a scoring record must not have.
NUMERIC_FEATURES = (
    "driver_age", "vehicle_age", "age_driving_licence", "vehicle_value", "seats", "power_to_weight_ratio",
)
CATEGORICAL_FEATURES = (
    "policy_type", "business_type", "payment_frequency", "bonus_score",
    "fuel_type", "vehicle_brand", "municipality_type", "circulation_area",
)
FORBIDDEN_FIELDS = frozenset(
    {"insured_id", "year", "policy_status", "total_premium", "total_claims", "total_incurred", "total_exposure"}
)
FEATURES = (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)

SHADOW_ONLY = "HOLD_SHADOW_ONLY"
PRIVACY_BOUNDARY = "aggregate_non_pii_only"
MAX_BATCH = 1000
MISSING, UNSEEN = "__MISSING__", "__UNSEEN__"
TOTAL_EPS, OFFLINE_FLOOR, ONLINE_FLOOR = 1e-12, 1e-9, 1e-12

RECORD_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in NUMERIC_FEATURES] + [T.StructField(c, T.StringType()) for c in CATEGORICAL_FEATURES]
)


class ContractError(ValueError):
    """Records or batches break the scoring contract."""


def contract_hash(numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES, forbidden=FORBIDDEN_FIELDS) -> str:
    """SHA-256 of the contract as compact JSON with sorted keys."""
    body = {"numeric": list(numeric), "categorical": list(categorical), "forbidden": sorted(forbidden)}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_columns(columns, features=FEATURES) -> None:
    """Raise unless the columns are exactly the features; say which are forbidden."""
    extra, absent = sorted(set(columns) - set(features)), sorted(set(features) - set(columns))
    if extra or absent:
        raise ContractError(
            f"missing {absent}; forbidden {sorted(FORBIDDEN_FIELDS & set(extra))}; unknown {sorted(set(extra) - FORBIDDEN_FIELDS)}"
        )


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A request's records as a frame: every feature present (null allowed), nothing else, 1 to ``MAX_BATCH`` of them."""
    if not 1 <= len(records) <= MAX_BATCH:
        raise ContractError(f"a batch has 1 to {MAX_BATCH} records, not {len(records)}")
    for r in records:
        check_columns(r)
    rows = [[None if r[c] is None else float(r[c]) if c in NUMERIC_FEATURES else str(r[c]) for c in FEATURES] for r in records]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def json_violations(body: Column, features=FEATURES) -> Column:
    """Of a JSON object column: the sorted names of keys it has beyond the features, or lacks (marked with ``-``)."""
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, features))
    lacking = F.transform(F.array_except(wanted, keys), lambda k: F.concat(F.lit("-"), k))
    return F.array_sort(F.concat(F.array_except(keys, wanted), lacking))


def canonical(df: DataFrame, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> DataFrame:
    """The features in contract order: numbers or null (NaN is null), categories as strings."""
    from .functions.exprs import number

    have = set(df.columns)
    return df.select(
        *[(number(c) if c in have else F.lit(None).cast("double")).alias(c) for c in numeric],
        *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in categorical],
    )
