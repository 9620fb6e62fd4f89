"""Fitting passes over packed training rows: GLMs by weighted Gram sums, boosted trees by histograms.

Training rows are encoded once and written as blocks: a row of the table is some ten thousand policy
rows as arrays of bytes.  A pass reads the blocks where they lie; each task adds up small dense sums,
which are merged by key.  What reaches the driver has the size of the model, not of the data.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, removed
from .drift import unpivot
from .quantiles import quantile_cuts

#: Policy rows of a block, bins of a number, rounds after which running scores are held, and after which they are written.
BLOCK_ROWS, BINS, SCORE_ROUNDS, START_ROUNDS = 1 << 15, 128, 4, 48
#: Rows to one of all rows alike, on average, from which on they are counted.
ALIKE = 2
#: Combinations of bins of columns that are summed together.
CELLS = 1 << 12
#: Bytes of sums that tasks send to the driver at most; more are merged by key in tasks first.
DRIVER_BYTES = 1 << 24
#: Columns of a GLM at most: the driver solves a dense system of that size.
MOST_COLUMNS = 4000
_PARTS = ("x", "at", "bins", "key", "w", "m", "y", "f")
_LINEAR, _BOOSTED = ("x", "at", "w", "m", "y"), ("bins", "key", "w", "m", "y", "f")


@dataclass
class Layout:
    """What the arrays of a block mean: targets, numbers, and each category's first column and levels."""

    targets: tuple[str, ...]
    numbers: int
    starts: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def width(self) -> int:
        return self.numbers + sum(self.sizes)

    def linear(self, block: dict) -> tuple[np.ndarray, ...]:
        """x, at, weight of all rows alike, y of a block: what a GLM reads."""
        x, at, w, m, y = (np.frombuffer(block[p], t) for p, t in zip(_LINEAR, ("f8", "i4", "f8", "f8", "f8")))
        n, k = len(w), len(self.targets)
        return x.reshape(n, self.numbers), at.reshape(n, len(self.starts)), w * m, y.reshape(k, n)

    def boosted(self, block: dict) -> tuple[np.ndarray, ...]:
        """bins, key, w, m, y, f of a block: what boosting reads."""
        bins, key, w, m, y, f = (np.frombuffer(block[p], t) for p, t in zip(_BOOSTED, ("i2", "u8", "f8", "f8", "f8", "f8")))
        n, k = len(w), len(self.targets)
        return bins.reshape(-1, n), key, w, m, y.reshape(k, n), f.reshape(k, n)


@dataclass
class Packed:
    """Encoded training rows: the table of blocks, its folder, number and layout, sums over all rows, and cut points of the numbers.

    A block has the numbers ``x``, the hot column of each category ``at`` (-1 for none), ``bins`` by
    column, a hash of each row, its weight, how many rows are alike in all of these and in their rates,
    and by target its rate and running score in logs.
    """

    blocks: DataFrame
    path: str
    many: int
    layout: Layout
    weight: float
    totals: dict[str, float]
    cuts: list[np.ndarray]

    def release(self) -> None:
        """Remove the blocks once no fit reads them any more."""
        removed(self.blocks.sparkSession, self.path)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def pack(rows: DataFrame, rates: dict[str, Column | str], weight: Column | str, sizes: Sequence[int] = (), binned: bool = False) -> Packed:
    """Encode rows with ``features`` (numbers ``x``, hot columns ``at``) once; rows of no weight are left out, none at all is an error.

    ``sizes`` are the levels of each category; ``binned`` also cuts numbers at quantiles, for trees.
    Rows alike in features, rates and weight are encoded as one and their number, if that halves the rows
    at least: a fit's sums have each of them all the same, and its draws, by hash, take all or none.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    targets = tuple(rates)
    data = rows.select(
        F.col("features.x").alias("x"), F.col("features.at").alias("at"), col(weight).cast("double").alias("w"),
        F.array(*[col(c).cast("double") for c in rates.values()]).alias("y"),
    ).where("w > 0").withColumn("key", F.xxhash64("x", "at", "w", "y"))
    data, narrow = written(data)
    exact = lambda c: F.sum(c.cast("decimal(38,15)")).cast("double")  # noqa: E731  # the same in any order of rows
    sums = [exact(F.col("w") * F.col("y")[k]).alias(f"s{k}") for k in range(len(targets))]
    total = data.agg(F.count("*").alias("n"), exact(F.col("w")).alias("w"), F.first(F.size("x")).alias("numbers"), F.approx_count_distinct("key").alias("different"), *sums).first()
    if not total.n:
        removed(rows.sparkSession, narrow)
        raise ValueError("no rows with positive weight to fit on")
    numbers, starts = total.numbers, tuple(np.cumsum([total.numbers, *sizes])[:-1].tolist())
    cuts: list[np.ndarray] = []
    if binned and numbers:
        each = unpivot(data.select(*[F.col("x")[k].alias(f"x{k}") for k in range(numbers)]), [f"x{k}" for k in range(numbers)], "double")
        found = {r.feature: r.cuts for r in quantile_cuts(each, BINS).collect()}  # a row a number
        cuts = [np.array(found[f"x{k}"]) for k in range(numbers)]
    first = [math.log(max(total[f"s{k}"] / total.w, 1e-12)) for k in range(len(targets))]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            dense = lambda c, k: t[c].combine_chunks().flatten().to_numpy().reshape(len(t), k)
            x, at = dense("x", numbers).astype("f8"), dense("at", len(sizes)).astype("i4")
            bins = [np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)]
            if binned:
                bins += [np.where(at[:, k] < 0, s, at[:, k] - a) for k, (a, s) in enumerate(zip(starts, sizes))]
            bins = np.stack(bins) if bins else np.zeros((0, len(t)))
            y = dense("y", len(targets)).T
            f = np.repeat(np.array(first)[:, None], len(t), 1)
            parts = (x, at, bins.astype("i2"), t["key"].to_numpy(), t["w"].to_numpy(), t["m"].to_numpy(), np.ascontiguousarray(y), f)
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], list(_PARTS))

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    if total.n >= ALIKE * total.different:
        counted = data.groupBy("key", "x", "at", "w", "y").agg(F.count("*").cast("double").alias("m"))
    else:
        counted = data.withColumn("m", F.lit(1.0))
    blocks = counted.mapInArrow(packed, ", ".join(f"{p} binary" for p in _PARTS))
    blocks, path = written(blocks)
    removed(rows.sparkSession, narrow)
    totals = {t: float(total[f"s{k}"]) for k, t in enumerate(targets)}
    return Packed(blocks, path, blocks.count(), Layout(targets, numbers, starts, tuple(sizes)), total.w, totals, cuts)


def written(blocks: DataFrame) -> tuple[DataFrame, str]:
    """A table of blocks, written to the shared folder and read again, and its path."""
    spark = blocks.sparkSession
    path = f"{checkpoint_folder(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.write.parquet(path)
    return spark.read.parquet(path), path


def merged(parts: DataFrame, then: Callable[[int, np.ndarray], list[tuple]], schema: str, size: int) -> list:
    """The sums by ``key`` of arrays of doubles (a row a task and key), and of each what ``then`` makes of it.

    ``size``, the bytes of all tasks' sums at most, says whether the driver adds them up or merging tasks do.
    """
    if size <= DRIVER_BYTES:
        known: dict[int, np.ndarray] = {}
        for row in parts.collect():
            known[row.key] = known.get(row.key, 0.0) + np.frombuffer(row.sums)
        return [Row(*[c.split()[0] for c in schema.split(", ")])(*r) for k, v in known.items() for r in then(k, v)]
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row in blocks_of(batches):
            own = np.frombuffer(row["sums"])
            sums[row["key"]] = sums[row["key"]] + own if row["key"] in sums else own
        yield pa.RecordBatch.from_pylist([dict(zip(fields, r)) for k, s in sums.items() for r in then(k, s)], kinds)

    kinds = pa.schema([(f, {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[f_type]) for f, f_type in (x.split() for x in schema.split(", "))])
    return parts.repartition("key").mapInArrow(run, schema).collect()


def merged_pairs(parts: RDD, then: Callable[[int, np.ndarray], list[tuple]], schema: str, size: int) -> list:
    """``merged`` of pairs of a key and an array."""
    kind = Row(*[f.split()[0] for f in schema.split(", ")])
    if size > DRIVER_BYTES:
        return [kind(*r) for r in parts.reduceByKey(np.add).flatMap(lambda pair: then(*pair)).collect()]
    known: dict[int, np.ndarray] = {}
    for key, sums in parts.collect():
        known[key] = known[key] + sums if key in known else sums
    return [kind(*r) for key, sums in known.items() for r in then(key, sums)]


def _as_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["key", "sums"])


# ---------------------------------------------------------------- generalised linear models


def unit_steps(eta: np.ndarray, y: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and second derivative of half the unit deviance, by the score in logs, and what neither exceeds."""
    up, down = np.exp((2 - power) * eta), y if power == 1 else y * np.exp((1 - power) * eta)
    return up - down, (2 - power) * up + (power - 1) * down, up + down


def unit_loss(eta: np.ndarray, y: np.ndarray, power: float) -> np.ndarray:
    """Half the unit deviance but for what doesn't depend on the score."""
    if power == 1:
        return np.exp(eta) - y * eta
    return np.exp((2 - power) * eta) / (2 - power) - y * np.exp((1 - power) * eta) / (1 - power)


def gram(p: Layout, x: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The sums of h * z z' and of g * z over rows z = (1, numbers, a one per category), as one (width + 1, width + 2) array."""
    wide = p.width + 1
    out, dense = np.zeros((wide, wide + 1)), np.column_stack([np.ones(len(x)), x])
    d = dense.shape[1]
    out[:d, :d], out[:d, wide] = dense.T @ (dense * h[:, None]), dense.T @ g
    for c, (start, size) in enumerate(zip(p.starts, p.sizes)):
        known = at[:, c] >= 0
        own, cols = at[known, c] - start, slice(start + 1, start + 1 + size)
        out[cols, wide] += np.bincount(own, g[known], size)
        for k in range(d):
            out[k, cols] += np.bincount(own, (h * dense[:, k])[known], size)
        for c2 in range(c, len(p.starts)):
            both = known & (at[:, c2] >= 0)
            pair = (at[both, c] - start) * p.sizes[c2] + at[both, c2] - p.starts[c2]
            out[cols, p.starts[c2] + 1 : p.starts[c2] + 1 + p.sizes[c2]] += np.bincount(pair, h[both], size * p.sizes[c2]).reshape(size, -1)
    return out


def fit_coefficients(p: Packed, target: str, power: float, alpha: float = 1e-4, start: np.ndarray | None = None, max_iter: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Intercept and coefficients that minimise sum(w * d / 2) / sum(w) + alpha / 2 * |b|^2, the intercept free, by Newton steps.

    An iteration is one pass over the blocks; a step that doesn't lower the objective is halved.
    ``start`` warms up a fit, such as that of a window before.
    """
    if p.totals[target] <= 0:
        raise ValueError("a log-link model needs a positive total")
    layout = p.layout
    if layout.width >= MOST_COLUMNS:
        raise ValueError(f"a GLM of over {MOST_COLUMNS} columns")
    wide, k = layout.width + 1, layout.targets.index(target)
    begin = np.zeros(wide)
    begin[0] = math.log(p.totals[target] / p.weight)
    penalty = np.full(wide, alpha)
    penalty[0] = 0.0

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros((wide, wide + 1)), 0.0
            for block in blocks_of(batches):
                x, at, w, y = layout.linear(block)
                eta = b[0] + x @ b[1 : 1 + layout.numbers] + np.where(at >= 0, b[at + 1], 0.0).sum(1)
                g, h, _ = unit_steps(eta, y[k], power)
                total += gram(layout, x, at, w * g, w * h)
                loss += float(w @ unit_loss(eta, y[k], power))
            yield _as_rows({0: np.append(total.ravel(), loss)})

        found = merged(blocks.mapInArrow(run, "key int, sums binary"), lambda _, s: [(s.tobytes(),)], "sums binary", most * 8 * wide * (wide + 1))
        flat = np.frombuffer(found[0].sums)
        m = flat[:-1].reshape(wide, wide + 1) / p.weight
        second = np.triu(m[:, :wide])
        second = second + np.triu(second, 1).T + np.diag(penalty)
        return flat[-1] / p.weight + float(penalty @ b**2) / 2, m[:, wide] + penalty * b, second

    blocks = p.blocks.select(*_LINEAR)
    most = min(p.many, blocks.rdd.getNumPartitions())
    b = begin if start is None else start
    loss, slope, second = sums(b)
    for _ in range(max_iter):
        step = np.linalg.solve(second, slope)
        share = 1.0
        while True:
            after = sums(b - share * step)
            if np.isfinite(after[0]) and after[0] <= loss + 1e-14 * abs(loss) or share < 1e-6:
                break
            share /= 2
        b, (loss, slope, second) = b - share * step, after
        if np.abs(share * step).max() <= tol * max(1.0, np.abs(b).max()):
            break
    return b


# ---------------------------------------------------------------- boosted trees


@dataclass
class Tree:
    """A tree over bins, by places of a heap (the root is 1): a column or -1, its bin, and a leaf's value.

    Columns from ``numbers`` on are categories: the level of the bin goes right, all else left; of a
    number what is above the bin.
    """

    depth: int
    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(depth, np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def places(self, bins: Sequence[np.ndarray], numbers: int, rows: int) -> np.ndarray:
        """The place each row comes to; ``bins`` by column."""
        at, own = np.ones(rows, int), np.arange(rows)
        bins = np.stack(bins) if len(bins) else np.zeros((1, rows), int)
        for _ in range(self.depth):
            c, b = self.column[at], self.bin[at]
            v = bins[np.maximum(c, 0), own]
            at = np.where(c >= 0, 2 * at + np.where(c >= numbers, v == b, v > b), at)
        return at

    def masks(self, numbers: int) -> tuple[list[int], list[tuple[int, slice, int]]]:
        """Its ends from left to right, and its tests as of ``Masks``."""
        ends: list[int] = []
        tests: list[tuple[int, slice, int]] = []

        def walk(place: int) -> None:
            c, b = int(self.column[place]), int(self.bin[place])
            if c < 0:
                ends.append(place)
                return
            first = len(ends)
            walk(2 * place)
            tests.append((c, slice(b, b + 1) if c >= numbers else slice(b + 1, None), (1 << len(ends)) - (1 << first)))
            walk(2 * place + 1)

        walk(1)
        return ends, tests


#: Leaves of a tree that ``Masks`` holds at most: the bits of a lane.
MOST_LEAVES = 16


class Masks:
    """Trees of at most ``MOST_LEAVES`` leaves as masks over bins, four trees to a word.

    A test (column, the bins that go right, the bits of the leaves on its left) takes those leaves from
    a row that goes right.  The first leaf that is left, from the left, is the row's own: a look-up by
    column gives it for four trees at once, without a walk from node to node.
    """

    def __init__(self, widths: Sequence[int], trees: Sequence[Sequence[tuple[int, slice, int]]]):
        self.trees, groups = len(trees), -(-len(trees) // 4)
        lanes = [np.full((groups, n, 4), 0xFFFF, "u2") for n in widths]
        for k, tests in enumerate(trees):
            for c, right, bits in tests:
                lanes[c][k // 4, right, k % 4] &= np.uint16(0xFFFF ^ bits)
        words = [m.view("u8")[:, :, 0] for m in lanes]
        whole = np.uint64(2**64 - 1)
        self.words = [[(c, w[g]) for c, w in enumerate(words) if (w[g] != whole).any()] for g in range(groups)]

    def leaves(self, bins: Sequence[np.ndarray], rows: int) -> Iterator[np.ndarray]:
        """Of each tree the bit of every row's leaf; ``bins`` by column."""
        for g, words in enumerate(self.words):
            word = np.full(rows, 2**64 - 1, "u8")
            for c, table in words:
                word &= table.take(bins[c])
            lanes = word.view("u2").reshape(rows, 4)
            lanes &= -lanes
            for k in range(min(4, self.trees - 4 * g)):
                yield lanes[:, k]


def by_bit(values: Sequence, fill: float = 0) -> np.ndarray:
    """A table of the values of a tree's leaves by their bits."""
    values = np.asarray(values)
    out = np.full(1 << MOST_LEAVES, fill, values.dtype) if fill else np.zeros(1 << MOST_LEAVES, values.dtype)
    out[1 << np.arange(len(values))] = values
    return out


def adder(trees: Sequence[Tree], numbers: int, widths: Sequence[int]) -> Callable[[np.ndarray, Sequence[np.ndarray]], None]:
    """What adds the values of trees to scores, tree by tree, given the bins by column."""
    shapes = [t.masks(numbers) if 1 << t.depth <= MOST_LEAVES else None for t in trees]
    if None in shapes:

        def walk(score: np.ndarray, bins: Sequence[np.ndarray]) -> None:
            for tree in trees:
                score += tree.value[tree.places(bins, numbers, len(score))]

        return walk
    masks, values = Masks(widths, [tests for _, tests in shapes]), [by_bit(t.value[ends]) for t, (ends, _) in zip(trees, shapes)]

    def add(score: np.ndarray, bins: Sequence[np.ndarray]) -> None:
        for leaf, v in zip(masks.leaves(bins, len(score)), values):
            score += v.take(leaf)

    return add


@dataclass
class Task:
    """What to boost: a target, its power, and the parameters of its trees."""

    target: str
    power: float
    rounds: int
    learning_rate: float = 0.3
    reg_lambda: float = 1.0
    min_child_weight: float = 5.0
    subsample: float = 0.9
    colsample: float = 0.9
    depth: int = 4
    seed: int = 42


def drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A seeded share of the rows, by their hashes: the same in any order of rows."""
    if share >= 1:
        return np.ones(len(key), bool)
    h = (key ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


def rounded(v: np.ndarray, unit: float) -> np.ndarray:
    """Values to multiples of a power of two, whose sums are exact and so the same in any order."""
    return np.rint(v / unit) * unit


def best_splits(sums: np.ndarray, is_number: bool, allowed: np.ndarray, reg_lambda: float, least: float) -> list[tuple]:
    """(node, gain, bin, left g, left h, g, h) of the best split of each node, from (node, bin, (g, h)) sums; gain 0 for none."""
    out = []
    for node, s in enumerate(sums):
        g, h = s.sum(0)
        left = np.cumsum(s, 0)[:-1] if is_number else (s.sum(0) - s)[:-1]
        score = lambda x: x[..., 0] ** 2 / (x[..., 1] + reg_lambda)
        right = np.array([g, h]) - left
        fits = allowed & (left[:, 1] >= least) & (right[:, 1] >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, score(left) + score(right) - score(np.array([g, h])), 0.0) if len(left) else np.zeros(1)
        k = int(np.argmax(gain))
        pair = left[k] if len(left) else (0.0, 0.0)
        out.append((node, float(max(gain[k], 0.0)), k, float(pair[0]), float(pair[1]), float(g), float(h)))
    return out


def boost(p: Packed, tasks: Sequence[Task]) -> list[tuple[float, list[Tree]]]:
    """Second-order boosting of log-link means, all tasks in the same passes: of each (base score, trees).

    A level of all tasks' trees is one pass: tasks sum gradients and second derivatives by node, column
    and bin, the sums are merged by task and column, and the merging tasks hand on each node's best
    split alone.  Gain is G^2 / (H + lambda) of both sides less that of the node, each side needs
    ``min_child_weight`` of H, a leaf is -learning_rate * G / (H + lambda).  Rows and columns of a tree
    are drawn by hashes.  Gradients are rounded so that sums don't depend on the order of rows.

    Passes read rows held by the executors, in memory and beyond it on disk, as bytes that go to Python
    as they are (``Joint``).  Rows with later scores are made from those of the start, so that what is
    lost is made again in two steps; now and then they are written and become the start.
    """
    layout = p.layout
    numbers, widths = layout.numbers, [len(c) + 1 for c in p.cuts] + [s + 1 for s in layout.sizes]
    order = {t: k for k, t in enumerate(layout.targets)}
    if len({t.target for t in tasks}) < len(tasks):
        raise ValueError("tasks boosted together have a running score for each target")
    base = [math.log(max(p.totals[t.target] / p.weight, 1e-12)) for t in tasks]
    out: list[list[Tree]] = [[] for _ in tasks]
    new: list[list[Tree]] = [[] for _ in tasks]  # since running scores were written
    bound = [2 * p.weight * math.exp((2 - t.power) * b) for t, b in zip(tasks, base)]  # of the sums of gradients of any rows
    joint = Joint(layout, numbers, widths, [order[t.target] for t in tasks])
    cells, powers, draws = joint.cells, [t.power for t in tasks], [(t.seed, t.subsample) for t in tasks]
    rows = p.blocks.select(*_BOOSTED).rdd.map(joint.packed).persist(StorageLevel.MEMORY_AND_DISK)
    most = min(p.many, rows.getNumPartitions())
    columns = [np.array([f"{k}:{b}" for k, n in enumerate(widths) for b in range(n - 1 if k >= numbers else 1)]) for _ in tasks]
    checkpoint_folder(p.blocks.sparkSession)
    rounds, before = max((t.rounds for t in tasks), default=0), []
    start, since = rows, [[] for _ in tasks]  # rows that running scores are counted from, and the trees since
    for round_ in range(rounds):
        live = [k for k, t in enumerate(tasks) if round_ < t.rounds]
        trees = {k: Tree.empty(tasks[k].depth) for k in live}
        units = {k: 2.0 ** (math.ceil(math.log2(bound[k])) - 52) for k in live}
        allowed = {}
        for k in live:
            t = tasks[k]
            some = np.random.default_rng((t.seed, round_)).permutation(len(columns[k]))[: max(1, math.ceil(t.colsample * len(columns[k])))]
            names = set(columns[k][some])
            allowed[k] = [np.array([f"{c}:0" in names] * (n - 1)) if c < numbers else np.array([f"{c}:{b}" in names for b in range(n - 1)]) for c, n in enumerate(widths)]
        open_nodes = {k: [1] for k in live}
        spread = dict.fromkeys(live, 0.0)
        for level in range(max(tasks[k].depth for k in live)):
            asked = {k: nodes for k, nodes in open_nodes.items() if nodes and level < tasks[k].depth}
            if not asked:
                break

            def run(raws: Iterator[bytes]) -> Iterator[tuple[int, np.ndarray]]:
                sums: dict[int, np.ndarray] = {}
                spreads, places = np.zeros(len(tasks)), joint.places(new, trees if level else {}, asked)
                for raw in raws:
                    code, key, w, m, y, f = joint.block(raw)
                    drawn_by: dict[tuple[int, float], np.ndarray] = {}
                    for k, place in places(code, f):
                        g, h, wide = unit_steps(f[k], y[k], powers[k])
                        if level == 0:  # the score is the same at all levels
                            spreads[k] += float((w if m is None else w * m) @ wide)
                        seed, share = draws[k]
                        if draws[k] not in drawn_by:
                            use = drawn(key, seed * 100_003 + round_, share)
                            drawn_by[draws[k]] = use if m is None else use * m
                        g, h = (rounded(w * v, units[k]) * drawn_by[draws[k]] for v in (g, h))
                        for j, n in enumerate(cells):
                            at, size = (code[j], n) if place is None else (place * n + code[j], (len(asked[k]) + 1) * n)
                            name = k * len(cells) + j
                            if name not in sums:
                                sums[name] = np.zeros((2, size))
                            for total, v in zip(sums[name], (g, h)):
                                total += np.bincount(at, v, size)
                for name, v in sums.items():
                    k, j = divmod(name, len(cells))
                    yield from ((k * len(widths) + c, own) for c, own in joint.marginals(j, v, len(asked[k])))
                yield from ((-1 - k, np.array([v])) for k, v in enumerate(spreads) if k in asked and level == 0)

            def split(name: int, sums: np.ndarray) -> list[tuple]:
                if name < 0:
                    return [(-1 - name, -1, 0, float(sums[0]), 0, 0.0, 0.0, 0.0, 0.0)]
                k, c = divmod(name, len(widths))
                t = tasks[k]
                found = best_splits(sums.reshape(len(asked[k]), widths[c], 2), c < numbers, allowed[k][c], t.reg_lambda, t.min_child_weight)
                return [(k, c, *r) for r in found]

            schema = "task int, col int, node int, gain double, bin int, gl double, hl double, g double, h double"
            size = most * 16 * sum(widths) * sum(map(len, asked.values()))
            found = merged_pairs(rows.mapPartitions(run), split, schema, size)  # a row a task, column and node
            for r in found:
                if r.col < 0:
                    spread[r.task] = r.gain
            for k, nodes in asked.items():
                t, open_nodes[k] = tasks[k], []
                for j, place in enumerate(nodes):
                    best = max((r for r in found if r.task == k and r.col >= 0 and r.node == j), key=lambda r: (r.gain, -r.col))
                    tree, leaf = trees[k], lambda g, h: -t.learning_rate * g / (h + t.reg_lambda) if h + t.reg_lambda > 0 else 0.0  # noqa: B023
                    if place == 1:
                        tree.value[1] = leaf(best.g, best.h)
                    if best.gain > 0:
                        tree.column[place], tree.bin[place] = best.col, best.bin
                        tree.value[2 * place], tree.value[2 * place + 1] = leaf(best.gl, best.hl), leaf(best.g - best.gl, best.h - best.hl)
                        open_nodes[k] += [2 * place, 2 * place + 1]
        for k in live:
            leaves = np.abs(trees[k].value[trees[k].column < 0]).max()
            bound[k] = spread[k] * math.exp(leaves)
            out[k].append(trees[k])
            new[k].append(trees[k])
        while before:  # what has been read instead was held on the way
            released(before.pop())
        if max(map(len, new)) >= SCORE_ROUNDS and round_ + 1 < rounds:
            since, new = [a + b for a, b in zip(since, new)], [[] for _ in tasks]
            if rows is not start:
                before.append(rows)
            rows = start.mapPartitions(joint.scored(since)).persist(StorageLevel.MEMORY_AND_DISK)
            if max(map(len, since)) >= START_ROUNDS:
                rows.checkpoint()
                before.append(start)
                start, since = rows, [[] for _ in tasks]
    for old in {id(r): r for r in [*before, rows, start]}.values():
        released(old)
    return list(zip(base, out))


def released(rows: RDD) -> None:
    """Give up rows that are held, and their folder if they were written."""
    rows.unpersist()
    if rows.isCheckpointed():
        removed(SparkSession.active(), rows.getCheckpointFile())


class Joint:
    """Rows of blocks as bytes for boosting, columns joined to groups of at most ``CELLS`` combinations of bins.

    Sums are by code of a group and a column's own follow from them, exactly, as gradients are rounded.
    Trees are masks over codes, those of all tasks together.
    """

    def __init__(self, layout: Layout, numbers: int, widths: Sequence[int], order: Sequence[int]):
        self.layout, self.numbers, self.widths, self.order = layout, numbers, list(widths), list(order)
        self.groups: list[list[int]] = []
        size = lambda cs: math.prod(self.widths[c] for c in cs)
        for c in sorted(range(len(self.widths)), key=lambda c: -self.widths[c]):
            room = next((g for g in self.groups if size([*g, c]) <= CELLS), None)
            if room is None:
                self.groups.append([c])
            else:
                room.append(c)
        self.cells = [size(g) for g in self.groups]
        self.code = "u2" if max(self.cells, default=0) <= 1 << 16 else "u4"
        self.bins = {c: b for g, n in zip(self.groups, self.cells) for c, b in zip(g, np.unravel_index(np.arange(n), [self.widths[c] for c in g]))}
        self.group = {c: j for j, g in enumerate(self.groups) for c in g}

    def packed(self, block: Row) -> bytes:
        """A block's codes, hashes, weights, numbers (none if all are 1), rates and scores."""
        bins, key, w, m, y, f = self.layout.boosted(block)
        code = [np.ravel_multi_index([bins[c].astype(np.intp) for c in g], [self.widths[c] for c in g]).astype(self.code) for g in self.groups]
        many = np.empty(0) if (m == 1).all() else m
        return b"".join(np.ascontiguousarray(v).tobytes() for v in (np.array([len(w), len(many)]), key, w, many, y[self.order], f[self.order], np.array(code, self.code)))

    def block(self, raw: bytes) -> tuple:
        """code, key, w, m (or None), y, f of ``packed``; codes as places of tables, scores to be written to."""
        n, many = np.frombuffer(raw, "i8", 2).tolist()
        at, k, out = 16, len(self.order), []
        for kind, size in (("u8", n), ("f8", n), ("f8", many), ("f8", k * n), ("f8", k * n), (self.code, len(self.groups) * n)):
            out.append(np.frombuffer(raw, kind, size, at))
            at += out[-1].nbytes
        key, w, m, y, f, code = out
        return [c.astype(np.intp) for c in code.reshape(len(self.groups), n)], key, w, m if many else None, y.reshape(k, n), f.reshape(k, n).copy()

    def masks(self, trees: Sequence[Tree]) -> tuple[Masks, list[list[int]]] | None:
        """Trees as masks over codes, and the ends of each; none if one has too many leaves."""
        if any(1 << t.depth > MOST_LEAVES for t in trees):
            return None
        shapes = [t.masks(self.numbers) for t in trees]
        tests = []
        for _, own in shapes:
            right = []
            for c, side, bits in own:
                goes = np.zeros(self.widths[c], bool)
                goes[side] = True
                right.append((self.group[c], goes[self.bins[c]], bits))
            tests.append(right)
        return Masks(self.cells, tests), [ends for ends, _ in shapes]

    def by_column(self, code: Sequence[np.ndarray]) -> list[np.ndarray]:
        return [self.bins[c].take(code[self.group[c]]) for c in range(len(self.widths))]

    def places(self, new: Sequence[Sequence[Tree]], trees: dict[int, Tree], asked: dict[int, list[int]]) -> Callable[..., Iterator[tuple[int, np.ndarray | None]]]:
        """What adds trees to the scores of a block, and gives each task asked for with its rows' open nodes: their numbers, one more for none, or None for a root."""
        nodes_of = {k: nodes for k, nodes in asked.items() if k in trees}
        added = [(k, t) for k in asked for t in new[k]]
        found = self.masks([*[t for _, t in added], *[trees[k] for k in nodes_of]])
        if found is None:
            adds = {k: adder(new[k], self.numbers, self.widths) for k in asked}
            slots = {k: slotter(trees[k], nodes, self.numbers, self.widths) for k, nodes in nodes_of.items()}

            def walk(code: list[np.ndarray], f: np.ndarray) -> Iterator[tuple[int, np.ndarray | None]]:
                bins = self.by_column(code)
                for k in asked:
                    adds[k](f[k], bins)
                    place = slots[k](bins, f.shape[1]) if k in slots else None
                    yield k, None if place is None else np.where(place < 0, len(asked[k]), place)

            return walk
        masks, ends = found
        values = [by_bit(t.value[e]) for (_, t), e in zip(added, ends)]
        known = []
        for (k, nodes), e in zip(nodes_of.items(), ends[len(added) :]):
            slot = np.full(2 << trees[k].depth, len(nodes))
            slot[nodes] = np.arange(len(nodes))
            known.append(by_bit(slot[e]))

        def go(code: list[np.ndarray], f: np.ndarray) -> Iterator[tuple[int, np.ndarray | None]]:
            leaves = masks.leaves(code, f.shape[1])
            for (k, _), v in zip(added, values):
                f[k] += v.take(next(leaves))
            place = {k: v.take(next(leaves)) for k, v in zip(nodes_of, known)}
            for k in asked:
                yield k, place.get(k)

        return go

    def marginals(self, j: int, sums: np.ndarray, nodes: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of a group's sums by (g and h, node, code) those of its columns, by (node, bin, g and h); sums of no open node go."""
        group = self.groups[j]
        shaped = sums.reshape(2, -1, *[self.widths[c] for c in group])[:, :nodes]
        for a, c in enumerate(group):
            own = shaped.sum(tuple(2 + b for b in range(len(group)) if b != a))
            yield c, np.ascontiguousarray(np.moveaxis(own, 0, -1)).ravel()

    def scored(self, new: list[list[Tree]]) -> Callable[[Iterator[bytes]], Iterator[bytes]]:
        """What adds the values of new trees to the running scores."""

        def run(raws: Iterator[bytes]) -> Iterator[bytes]:
            add = self.places(new, {}, {k: [1] for k in range(len(new))})
            for raw in raws:
                code, *_, f = self.block(raw)
                for _ in add(code, f):
                    pass
                end = len(raw) - len(self.groups) * f.shape[1] * np.dtype(self.code).itemsize
                yield b"".join((raw[: end - f.nbytes], f.tobytes(), raw[end:]))

        return run


def slotter(tree: Tree, nodes: Sequence[int], numbers: int, widths: Sequence[int]) -> Callable[[Sequence[np.ndarray], int], np.ndarray]:
    """What gives each row the number of its open node, or -1, from the bins by column."""
    slot = np.full(2 << tree.depth, -1)
    slot[list(nodes)] = np.arange(len(nodes))
    if 1 << tree.depth > MOST_LEAVES:
        return lambda bins, rows: slot[tree.places(bins, numbers, rows)]
    ends, tests = tree.masks(numbers)
    masks, known = Masks(widths, [tests]), by_bit(slot[ends], -1)
    return lambda bins, rows: known.take(next(masks.leaves(bins, rows)))
