"""Gates: from metrics and intervals to a recorded decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import SHADOW_ONLY

BAND, DIAGNOSTIC_BAND = (0.90, 1.10), (0.85, 1.15)


def in_band(ratio: Column | str, band: tuple[float, float] = BAND) -> Column:
    """Whether a calibration ratio lies in a band, ends included."""
    return (F.col(ratio) if isinstance(ratio, str) else ratio).between(*band)


def locked_gate(metrics: DataFrame) -> DataFrame:
    """Per target (target, calibration_ratio, ci95_low): PASS if calibrated and better with confidence."""
    passed = in_band("calibration_ratio") & (F.col("ci95_low") > 0)
    return metrics.select("target", "calibration_ratio", "ci95_low", F.when(passed, "PASS").otherwise("HOLD").alias("decision"))


def promotion(gates: DataFrame) -> DataFrame:
    """PROMOTE if every target passes."""
    return gates.agg(F.when(F.bool_and(F.col("decision") == "PASS"), "PROMOTE").otherwise("HOLD").alias("overall"))


def cohort_diagnostic(rows: DataFrame) -> DataFrame:
    """Calibration by window and model (calibration_ratio) with an illustrative, wider band."""
    return rows.withColumn("within_diagnostic_band", in_band("calibration_ratio", DIAGNOSTIC_BAND))


def closer(pivot: DataFrame, reference: str, challenger: str) -> DataFrame:
    """Per segment, the model whose calibration is nearer to one; a tie goes to the reference."""
    gap = lambda m: F.abs(F.col(m) - 1)
    return pivot.withColumn("closer", F.when(gap(challenger) < gap(reference), challenger).otherwise(reference))


# The gates an approval uses; ``complexity`` is recorded beside them and decides nothing.
DECIDING = ("locked_frequency", "locked_loss", "rolling_frequency", "rolling_loss", "transport_consistent", "lower_loss_deviance")
RECORDED = (*DECIDING, "complexity")


def approval(gates: DataFrame) -> DataFrame:
    """From a table (gate, passed): each gate as a column, ``decision`` and the governance status that stays on hold."""
    wide = gates.groupBy().agg(*[F.bool_or(F.when(F.col("gate") == g, F.col("passed"))).alias(g) for g in RECORDED])
    passed = F.lit(True)
    for g in DECIDING:
        passed = passed & F.coalesce(F.col(g), F.lit(False))
    return wide.withColumns({"decision": F.when(passed, "APPROVE_FOR_SHADOW").otherwise("HOLD"), "governance_status": F.lit(SHADOW_ONLY)})


def largest_errors(expected: DataFrame, observed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, rows, max_abs_error, max_rel_error, worst_key) of two tables of the same records."""
    both = expected.select(key, *[F.col(f).alias(f"e_{f}") for f in fields]).join(observed.select(key, *fields), key)
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.abs(F.col(f) - F.col(f"e_{f}")).alias("abs_error"),
                (F.abs(F.col(f) - F.col(f"e_{f}")) / F.greatest(F.abs(F.col(f"e_{f}")), F.lit(1e-12))).alias("rel_error"),
            )
            for f in fields
        ]
    )
    return both.select(key, F.inline(cells)).groupBy("field").agg(
        F.count("*").alias("rows"), F.max("abs_error").alias("max_abs_error"), F.max("rel_error").alias("max_rel_error"),
        F.max_by(key, F.struct("abs_error", -F.col(key))).alias("worst_key"),
    )


def map_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose hashes differ between two artifact tables (path, sha256), or that one side lacks."""
    b = b.select("path", F.col("sha256").alias("other_sha256"))
    return a.join(b, "path", "full").where(~F.col("sha256").eqNullSafe(F.col("other_sha256")))


# Where a provenance statement says what is checked, and the types it must have.
PROVENANCE = {
    "repository": "$.verificationResult.signature.certificate.githubWorkflowRepository",
    "workflow_name": "$.verificationResult.signature.certificate.githubWorkflowName",
    "workflow_path": "$.verificationResult.statement.predicate.buildDefinition.externalParameters.workflow.path",
    "workflow_repository": "$.verificationResult.statement.predicate.buildDefinition.externalParameters.workflow.repository",
    "predicate_type": "$.verificationResult.statement.predicateType",
    "build_type": "$.verificationResult.statement.predicate.buildDefinition.buildType",
}
SUBJECTS, TIMESTAMPS = "$.verificationResult.statement.subject", "$.verificationResult.verifiedTimestamps"
COMMIT = "$.verificationResult.signature.certificate.sourceRepositoryDigest"


def provenance_predicates(statements: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(statement_id, name, sha256, predicate, passed): what is expected of each subject of each statement (statement_id, body).

    ``expected`` gives the values of the paths of ``PROVENANCE``.  Besides, a statement needs a verified
    timestamp and a commit of forty characters.  What a body lacks isn't passed; a body that isn't JSON,
    or has no subjects, gives no rows.
    """
    body = statements.select("statement_id", F.try_parse_json("body").alias("v"))
    text = lambda path: F.try_variant_get("v", path, "string")
    checks = {n: text(PROVENANCE[n]) == F.lit(x) for n, x in expected.items()}
    checks |= {"timestamps": F.size(F.try_variant_get("v", TIMESTAMPS, "array<variant>")) >= 1, "commit": F.length(text(COMMIT)) == 40}
    passed = body.select("statement_id", "v", *[F.coalesce(c, F.lit(False)).alias(f"c_{n}") for n, c in checks.items()])
    subjects = F.try_variant_get("v", SUBJECTS, "array<struct<name: string, digest: struct<sha256: string>>>")
    rows = passed.select("statement_id", *[f"c_{n}" for n in checks], F.explode(subjects).alias("s"))
    # a stack has always rows: of an array the optimizer asks its size first, below the parse, and parses once more for every predicate
    each = F.stack(F.lit(len(checks)), *[x for n in checks for x in (F.lit(n), F.col(f"c_{n}"))]).alias("predicate", "passed")
    return rows.select("statement_id", F.col("s.name").alias("name"), F.col("s.digest.sha256").alias("sha256"), each)


def attested(artifacts: DataFrame, predicates: DataFrame) -> DataFrame:
    """(path, statements, matches, admitted): artifacts (path, sha256) by how many statements name them, and name them with all predicates passed; exactly one match admits."""
    whole = predicates.groupBy("statement_id", "name", "sha256").agg(F.bool_and("passed").alias("passed"))
    rows = artifacts.join(whole.withColumnRenamed("name", "path"), ["path", "sha256"], "left")
    counts = rows.groupBy("path").agg(F.count("statement_id").alias("statements"), F.count_if("passed").alias("matches"))
    return counts.withColumn("admitted", F.col("matches") == 1)


CHAIN_SCHEMA = "chain string, sequence long, payload string, previous_sha256 string, event_sha256 string"


def hash_chain(events: DataFrame) -> DataFrame:
    """(chain, sequence, payload) with the hash of each event over its predecessor's hash, sequence and payload.

    A chain is one release's control events, a short list; chains are folded in parallel.
    """
    import hashlib

    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        before, out = "", []
        for r in rows.sort_values("sequence").itertuples():
            own = hashlib.sha256(f"{before}|{r.sequence}|{r.payload}".encode()).hexdigest()
            out.append((r.chain, r.sequence, r.payload, before, own))
            before = own
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHAIN_SCHEMA.split(", ")])

    return events.select("chain", "sequence", "payload").groupBy("chain").applyInPandas(fold, CHAIN_SCHEMA)


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per event: whether its sequence, link and hash hold."""
    from pyspark.sql import Window

    w = Window.partitionBy("chain").orderBy("sequence")
    own = F.sha2(F.concat_ws("|", "previous_sha256", F.col("sequence").cast("string"), "payload"), 256)
    return chain.select(
        "chain", "sequence", (F.row_number().over(w) == F.col("sequence")).alias("sequence_ok"),
        (F.coalesce(F.lag("event_sha256").over(w), F.lit("")) == F.col("previous_sha256")).alias("link_ok"),
        (own == F.col("event_sha256")).alias("hash_ok"),
    )
