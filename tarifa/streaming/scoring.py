"""Scoring a stream of JSON requests: what breaks the contract goes one way with its reason, the rest is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contracts import RECORD_SCHEMA, json_violations
from ..operators.models import Scorer
from .sinks import write_once


def reason(body: Column | str) -> Column:
    """Why a request's body is rejected: ``unreadable``, or ``fields:`` and the names it lacks (with ``-``) or has beyond the contract; null if it isn't."""
    body = F.col(body) if isinstance(body, str) else body
    names = json_violations(body)
    readable = F.json_object_keys(body).isNotNull() & F.try_parse_json(body).isNotNull()
    return F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(F.size(names) > 0, F.concat(F.lit("fields:"), F.concat_ws(",", names)))


def judged(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, body) with ``reason``, and the features of those that have none."""
    return requests.select("request_id", "body", reason("body").alias("reason"), F.from_json("body", RECORD_SCHEMA).alias("record"))


def score_batch(requests: DataFrame, batch_id: int, scorer: Scorer, path: str) -> None:
    """One micro-batch: rejected rows, scored rows and a row of telemetry, each to its table, once whatever is run again."""
    rows = judged(requests).persist()
    try:
        scored = scorer.score(rows.where("reason IS NULL").select("request_id", "record.*"))
        write_once(rows.where("reason IS NOT NULL").select("request_id", "body", "reason"), batch_id, f"{path}/rejected")
        write_once(scored, batch_id, f"{path}/scored")
        counts = rows.agg(F.count("*").alias("read"), F.count("reason").alias("rejected"))
        warned = scored.agg(F.count_if(F.size("warnings") > 0).alias("unseen"), F.avg(F.abs("frequency_log_ratio")).alias("mean_frequency_shift"))
        write_once(counts.crossJoin(warned), batch_id, f"{path}/telemetry")  # one row each
    finally:
        rows.unpersist()


def score_stream(requests: DataFrame, scorer: Scorer, path: str, checkpoint: str) -> StreamingQuery:
    """Run ``score_batch`` over all that a stream of requests has, restarting from ``checkpoint``."""
    writer = requests.writeStream.foreachBatch(lambda batch, k: score_batch(batch, k, scorer, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
