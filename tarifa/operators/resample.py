"""Bootstrap by weights: every (replicate, row) draws a count, and replicates are aggregated once.

The draw is a Poisson(1) count from an integer hash of the row's key and the replicate, so the rows
need no order and any engine reproduces it.  For large tables this is equivalent to drawing as many
rows as there are with replacement.

Rows are never multiplied by the replicates: each batch of rows gives a matrix of counts, the counts
times the rows' terms add to the task's sums, and a task hands on one row per group and replicate.

``fixed_replicates`` draws exactly as many rows as a group has, with replacement.  A replicate's draws
are split between halves of the slices of a group by binomial counts, down to slices, and dealt out to
rows there.  Every split has its own seeded generator, so each task finds its slice's share by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import TOTAL_EPS

MODULUS = (1 << 31) - 1
#: Integer thresholds of the Poisson(1) distribution function, up to 7 draws.
POISSON_STEPS = tuple(int(MODULUS * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(8))
#: Counts drawn at once.
CELLS = 1 << 20


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """``exprs.lcg`` over an array of integers."""
    step = x % MODULUS * 48271 + seed % MODULUS
    step = (step % MODULUS * 69621 + 12345) % MODULUS
    return (step * 39373 + 271828) % MODULUS


def draws(keys: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """How often each replicate draws each key: a row per key, a column per replicate."""
    h = mixed(mixed(keys, seed)[:, None] + reps * 7919, seed + 1)
    return np.searchsorted(np.array(POISSON_STEPS), h, "right").astype(np.float64)


def replicates(df: DataFrame, sums: dict[str, Column], key: Column, reps: int, seed: int, groups: Column | None = None) -> DataFrame:
    """Sums of each replicate: (group, rep, one column per sum), nulls left out.

    ``key`` is an integer.  ``groups``: an array of the names of the groups that a row belongs to, of which
    there are few; without it all rows are the group "".  A group that a replicate draws no row of has sums of 0.
    """
    names = [f"t{i}" for i in range(len(sums))]
    terms = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, sums.values())]
    rows = df.select(key.cast("long").alias("k"), (F.array(F.lit("")) if groups is None else groups).alias("groups"), *terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            lists = batch.column("groups")
            row = np.repeat(np.arange(batch.num_rows), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            members = [(name, row[code == i]) for i, name in enumerate(coded.dictionary.to_pylist())]
            step = max(1, CELLS // len(keys))
            for at in range(0, reps, step):
                n = draws(keys, np.arange(at, min(at + step, reps)), seed)
                for name, own in members:
                    if name not in totals:
                        totals[name] = np.zeros((reps, len(names)))
                    totals[name][at : at + n.shape[1]] += (n if len(own) == len(keys) else n[own]).T @ values[own]
        for name, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * reps, pa.string()), pa.array(range(reps), pa.int32()), *map(pa.array, own.T.copy())], ["group", "rep", *names])

    parts = rows.mapInArrow(run, ", ".join(["group string", "rep int", *[f"{n} double" for n in names]]))
    return parts.groupBy("group", "rep").agg(*[F.sum(n).alias(name) for n, name in zip(names, sums)])


#: Rows a slice is meant to have.
SLICE_ROWS = 1 << 14


def generator(*of: int) -> np.random.Generator:
    """A generator for a seed, a replicate and a place, the same everywhere."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([x % (1 << 63) for x in of])))


def slice_draws(sizes: np.ndarray, at: int, reps: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall to the rows of slice ``at``; all slices' counts add up to all rows.

    ``sizes`` are the rows of each slice.  A range of slices is halved until one is left; each half
    gets a binomial share by its rows.
    """
    low, high, name = 0, len(sizes), 1
    upto = np.concatenate(([0], np.cumsum(sizes)))
    drawn = np.full(reps, upto[-1])
    while high - low > 1:
        middle = (low + high) // 2
        share = (upto[middle] - upto[low]) / max(upto[high] - upto[low], 1)
        left = np.array([generator(seed, r, name).binomial(n, share) for r, n in enumerate(drawn)])
        if at < middle:
            high, name, drawn = middle, 2 * name, left
        else:
            low, name, drawn = middle, 2 * name + 1, drawn - left
    return drawn


def row_draws(rows: int, drawn: np.ndarray, name: int, seed: int, first: int = 0) -> np.ndarray:
    """How often the replicates from ``first`` on draw each row of a slice: a row per row, a column per replicate."""
    return np.stack([np.bincount(generator(seed + 1, r, name).integers(0, rows, n), minlength=rows) for r, n in enumerate(drawn, first)], 1)


def fixed_replicates(df: DataFrame, sums: dict[str, Column], key: Column, reps: int, seed: int, groups: Column | None = None) -> DataFrame:
    """Sums of each replicate as ``replicates`` gives them, each of exactly as many draws as its group has rows: (group, rep, n, one column per sum).

    ``key`` is an integer; rows of a group that share key and terms are alike.  The result depends on
    the rows alone, not on their order or partitions.  Slices are by hash of the key, some ten thousand
    rows each; their sizes, 8 bytes a slice, go to every task.  A group without rows has no replicates.
    """
    names = [f"t{i}" for i in range(len(sums))]
    terms = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, sums.values())]
    rows = df.select(F.explode(F.array(F.lit("")) if groups is None else groups).alias("group"), key.cast("long").alias("k"), *terms)
    counts = {r.group: r["count"] for r in rows.groupBy("group").count().collect()}  # a row a group
    many = {g: max(1, -(-n // SLICE_ROWS)) for g, n in counts.items()}
    of_group = F.create_map(*[F.lit(x) for g, n in many.items() for x in (g, n)]) if many else F.create_map(F.lit(""), F.lit(1))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("k"), F.element_at(of_group, F.col("group"))).cast("int"))
    sizes = {g: np.zeros(n, np.int64) for g, n in many.items()}
    for r in rows.groupBy("group", "slice").count().toLocalIterator():
        sizes[r.group][r.slice] = r["count"]
    order = {g: k for k, g in enumerate(sorted(many, key=str))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def add(group: str, at: int, parts: list[np.ndarray]) -> None:
            values = np.concatenate(parts)
            drawn = slice_draws(sizes[group], at, reps, seed + 7919 * order[group])
            own = totals.setdefault(group, np.zeros((reps, len(names) + 1)))
            own[:, 0] += drawn
            step = max(1, CELLS // len(values))
            for low in range(0, reps, step):
                own[low : low + step, 1:] += row_draws(len(values), drawn[low : low + step], at, seed + 7919 * order[group], low).T @ values

        now, parts = None, []
        for batch in batches:
            group, at = batch.column("group").to_pylist(), batch.column("slice").to_numpy()
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            code = batch.column("group").dictionary_encode().indices.to_numpy()
            opens = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (code[1:] != code[:-1]))))
            for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(at)]):
                if now != (group[a], int(at[a])):
                    if parts:
                        add(*now, parts)
                    now, parts = (group[a], int(at[a])), []
                parts.append(values[a:b])
        if parts:
            add(*now, parts)
        for name, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * reps, pa.string()), pa.array(range(reps), pa.int32()), pa.array(own[:, 0].astype(np.int64)), *map(pa.array, own[:, 1:].T.copy())], ["group", "rep", "n", *names])

    dealt = rows.repartition("group", "slice").sortWithinPartitions("group", "slice", "k", *names).select("group", "slice", *names)
    parts = dealt.mapInArrow(run, ", ".join(["group string", "rep int", "n long", *[f"{n} double" for n in names]]))
    return parts.groupBy("group", "rep").agg(F.sum("n").alias("n"), *[F.sum(n).alias(name) for n, name in zip(names, sums)])


def deviance_differences(
    df: DataFrame, pairs: dict[str, tuple[Column, Column]], key: Column, reps: int = 250, seed: int = 2026, groups: Column | None = None,
    draw: Callable[..., DataFrame] = replicates,
) -> DataFrame:
    """(group, rep, one column per pair): weighted mean deviance of the first less that of the second."""
    w = F.col("total_exposure")
    sums = {f"d_{name}": w * (a - b) for name, (a, b) in pairs.items()} | {"w": w}
    out = draw(df, sums, key, reps, seed, groups)
    return out.select("group", "rep", *[F.try_divide(F.col(f"d_{n}"), F.col("w")).alias(n) for n in pairs])


def ratios(df: DataFrame, models: dict[str, tuple[Column, Column]], key: Column, groups: Column, reps: int = 300, seed: int = 2026, draw: Callable[..., DataFrame] = replicates) -> DataFrame:
    """(group, model, rep, ratio): predicted over actual total of each replicate; ``models`` maps a name to both."""
    sums = {f"p_{m}": p for m, (p, _) in models.items()} | {f"a_{m}": a for m, (_, a) in models.items()}
    found = draw(df, sums, key, reps, seed, groups)
    cells = [F.struct(F.lit(m).alias("model"), (F.col(f"p_{m}") / F.greatest(f"a_{m}", F.lit(TOTAL_EPS))).alias("ratio")) for m in models]
    return found.select("group", "rep", F.inline(F.array(*cells)))


def summary(frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, 95 % interval and share above zero of the replicates, which are some hundreds a group."""
    return frame.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("ci95_low"), F.percentile(value, 0.975).alias("ci95_high"),
        F.avg((F.col(value) > 0).cast("double")).alias("p_gt_0"),
    )
