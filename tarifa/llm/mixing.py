"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

A source has a *schedule*: its sampling weight over training time, piecewise linear on [0, 1].
The schedule's integral is the weight the source is mixed with.  Its normalised running integral
says which share of the source's words is due by time t; inverting it gives every document (in a
fixed pseudo-random order within its source) the time at which its words fall due.  Documents are
then range-sorted by that position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, key_of, materialize, require, running, text_of

Schedule = Sequence[tuple[float, float]]

#: Sources up to which their targets are broadcast (under 100 bytes each), and parts of a source beyond.
BROADCAST_ROWS, SALTS = 50_000, 16
#: Rows that a slice of a source is meant to have at most, where whole documents are moved.
SLICE_ROWS = 250


def constant(weight: float) -> Schedule:
    """A schedule that keeps one weight throughout."""
    return ((0.0, float(weight)), (1.0, float(weight)))


def integral(schedule: Schedule) -> float:
    """The area under a schedule: the weight of its source in the mix."""
    return sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:]))


def check_schedule(schedule: Schedule) -> Schedule:
    """Reject a schedule that doesn't run from 0 to 1, goes back in time, or has no area."""
    knots = [(float(t), float(w)) for t, w in schedule]
    times = [t for t, _ in knots]
    if times != sorted(set(times)) or times[0] != 0.0 or times[-1] != 1.0:
        raise ValueError("a schedule needs increasing times from 0 to 1")
    if min(w for _, w in knots) < 0 or integral(knots) <= 0:
        raise ValueError("a schedule needs weights of 0 or more and a positive integral")
    return knots


def due_time(share: Column, schedule: Schedule) -> Column:
    """The time by which ``share`` of a source's words is due: the inverse of its running integral.

    Within a segment the integral is w0*u + slope*u*u/2; its root is written so that a slope of
    zero needs no case of its own.  Shares of 1 and more run on at the last weight (or, where that
    is zero, at weight one), so documents beyond the target keep their order after the end.
    """
    total = integral(schedule)
    begun, out = 0.0, None
    for (a, u), (b, v) in zip(schedule, schedule[1:]):
        area = (b - a) * (u + v) / 2
        slope = (v - u) / (b - a)
        left = share * F.lit(total) - F.lit(begun)
        root = F.sqrt(F.greatest(F.lit(u * u) + F.lit(2 * slope) * left, F.lit(0.0)))
        time = F.lit(a) + F.coalesce(F.try_divide(F.lit(2.0) * left, F.lit(u) + root), F.lit(0.0))
        inside = share * F.lit(total) < F.lit(begun + area)
        out = F.when(inside, time) if out is None else out.when(inside, time)
        begun += area
    beyond = F.lit(1.0) + (share - F.lit(1.0)) * F.lit(total / (schedule[-1][1] or 1.0))
    return out.otherwise(beyond)


def source_targets(totals: DataFrame, schedules: Sequence[Schedule], share: float, cap: float) -> DataFrame:
    """Words to take from each source.

    ``totals`` has one row per source (``source``, ``source_key``, ``source_size``).  Sources in
    code-point order, null last, use ``schedules`` in turn.  They share ``share`` times all words by
    weight; a target stops at ``cap`` times its source's size, and the excess goes to the others by
    weight until no target is above.  That fixed point is min(cap * size, level * weight), with one
    level for all: sorted by cap * size / weight, the first source that isn't capped gives it.
    Adds ``schedule_id``, ``target``.
    """
    weights, no_source = F.array(*[F.lit(integral(s)) for s in schedules]), F.col("source").isNull()
    rows = running(totals.withColumn("one", F.lit(1).cast("long")), [no_source, F.col("source")], {"place": "one"}).drop("one")
    rows = rows.withColumn("schedule_id", (F.col("place") % len(schedules)).cast("int"))
    rows = rows.withColumn("weight", F.get(weights, F.col("schedule_id"))).withColumn(
        "most", F.lit(float(cap)) * F.col("source_size")
    )
    by_level = [F.col("most") / F.col("weight"), no_source, F.col("source")]
    rows = running(rows, by_level, {"most_before": "most", "weight_before": "weight"})
    sums = rows.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.lit(float(share)) * F.col("all_size") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before"))
    rows = materialize(rows.crossJoin(F.broadcast(sums)).withColumn("level", level))  # one row
    open_level = F.min_by("level", F.struct(by_level[0].alias("x"), no_source.alias("y"), "source"))
    first = rows.where(F.col("level") * F.col("weight") <= F.col("most")).agg(open_level.alias("open_level"))
    rows = rows.crossJoin(F.broadcast(first))  # one row
    target = F.least(F.col("most"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_key", "source_size", "schedule_id", target.alias("target"))


def mix(docs: DataFrame, schedules: Sequence[Schedule], **options) -> DataFrame:
    """Assign every document its part in the mix and its training position, and range-sort by it.

    Options: ``share``, ``cap``, ``seed`` and the column names, as ``placed`` takes them.

    Returns one row per row of ``docs``: ``doc`` (struct: ``doc_id`` and ``source``), ``size`` (words; null text 0), ``source_size``, ``target``, ``taken`` (words the mix
    takes, passes added up), ``passes`` (times the document is begun), ``position`` (training time
    of its first pass; 1 or more where the source's target was met before it; null in a source
    without words).

    The order within a source is the MD5 of ``seed`` and the id.  Each pass runs through the whole
    source; the target cuts the last pass at a word, so taken words meet the target to within one
    word.  No document is taken more than ``cap`` times.  Ties in the order (repeated rows) fall
    back on the id and the size; equal rows are interchangeable.  An empty table gives no rows.

    Sizes are added up in two steps, within slices of the order and over the slices' sums, so a
    source with any share of the rows is many tasks' work, and so are any number of sources.
    """
    order = (F.col("position").asc_nulls_last(), F.col("order_key"))
    return placed(docs, schedules, **options).repartitionByRange(*order).sortWithinPartitions(*order)


def placed(
    docs: DataFrame,
    schedules: Sequence[Schedule],
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """The rows of ``mix`` before the sort, with what later passes need; ``carry`` keeps all columns in ``doc``."""
    require(docs, id_col, text_col, source_col)
    schedules = [check_schedule(s) for s in schedules]
    payload = F.struct("*") if carry else F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    own = F.col(id_col).cast("string")
    named = F.coalesce(own, F.concat(F.lit("~"), F.xxhash64(text_of(text_col)).cast("string"))) if carry else F.coalesce(own, F.lit(""))
    sized = docs.select(
        payload.alias("doc"),
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        key_of(source_col).alias("source_key"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), named)).alias("order_key"),
    )
    rows = (_begun_where_they_lie if carry else _begun)(sized, docs, schedules, share, cap)
    whole = F.floor("target")
    parts = [
        F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("begin") - k * F.col("source_size")))
        for k in range(-int(-cap // 1))
    ]
    taken, passes = sum(parts[1:], parts[0]), sum([(p > 0).cast("int") for p in parts[1:]], (parts[0] > 0).cast("int"))
    due = F.lit(None).cast("double")
    share_before = F.when(F.col("target") > 0, F.col("begin") / F.col("target"))
    for k, s in reversed(list(enumerate(schedules))):
        due = F.when(F.col("schedule_id") == k, due_time(share_before, s)).otherwise(due)
    return rows.select(
        "doc", "size", "source_size", "target", taken.cast("long").alias("taken"), passes.alias("passes"),
        due.alias("position"), "order_key", "begin", "schedule_id",
    )


def _with_targets(rows: DataFrame, targets: DataFrame, salt: str) -> DataFrame:
    """Rows with their source's columns: by a broadcast of checked size, else by source and a part of it, told by ``salt``."""
    targets = materialize(targets)
    if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(targets), "source_key")
    targets = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(targets, ["source_key", "salt"]).drop("salt")


def _begun(sized: DataFrame, docs: DataFrame, schedules: Sequence[Schedule], share: float, cap: float) -> DataFrame:
    """Narrow rows with their source's target and ``begin``, the words of their source before them."""
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()))
    totals = materialize(sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size")))
    begins = running(totals, [F.col("source_key")], {"source_begin": "source_size"}).select("source_key", "source_begin")
    targets = source_targets(totals, schedules, share, cap).drop("source").join(begins, "source_key")
    order = [F.col(c) for c in ("source_key", "order_key", "id", "size", "row")]  # the row splits what ties
    rows = _with_targets(running(sized, order, {"before": "size"}), targets, "order_key")
    return rows.withColumn("begin", F.col("before") - F.col("source_begin"))


def _begun_where_they_lie(sized: DataFrame, docs: DataFrame, schedules: Sequence[Schedule], share: float, cap: float) -> DataFrame:
    """The same for rows with whole documents, which move once: by source and slice of the order key.

    Slices have as many digits of the key as the number of documents asks for.
    """
    digits = min(max(1, math.ceil(math.log(max(docs.count() / SLICE_ROWS, 1), 16))), 16)
    sized = sized.withColumn("slice", F.substring("order_key", 1, digits))
    slices = materialize(sized.groupBy("source", "source_key", "slice").agg(F.sum("size").alias("slice_size")))
    totals = materialize(slices.groupBy("source", "source_key").agg(F.sum("slice_size").alias("source_size")))
    begins = running(totals, [F.col("source_key")], {"source_begin": "source_size"}).select("source_key", "source_begin")
    targets = source_targets(totals, schedules, share, cap).drop("source").join(begins, "source_key")
    offsets = running(slices.drop("source"), [F.col("source_key"), F.col("slice")], {"slice_begin": "slice_size"})
    offsets = _with_targets(offsets, targets, "slice")
    within = Window.partitionBy("source_key", "slice").orderBy("order_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source_key", "slice"])
    return rows.withColumn("begin", F.col("slice_begin") - F.col("source_begin") + F.col("before"))


def mixed_documents(docs: DataFrame, schedules: Sequence[Schedule], **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document once per pass, in training order.

    A document's later passes stand at their own due times.  Documents the mix takes no word of
    go.  A document cut by its target is emitted whole.
    """
    rows = placed(docs, schedules, carry=True, **options)
    checked = [check_schedule(s) for s in schedules]
    share = (F.col("begin") + F.col("pass") * F.col("source_size")) / F.col("target")
    due = F.lit(None).cast("double")
    for k, s in reversed(list(enumerate(checked))):
        due = F.when(F.col("schedule_id") == k, due_time(share, s)).otherwise(due)
    return (
        rows.where("passes > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("due", due)
        .repartitionByRange("due", "order_key")
        .sortWithinPartitions("due", "order_key")
        .select("doc.*")
    )
