"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits of each other must agree, up to a threshold, on one of m bit
partitions whose thresholds add up to radius - m + 1 (a threshold of -1 leaves a partition out).
Correlated bits share a partition, and dynamic programming hands out the thresholds so that the
estimated work is least.  A partition with threshold t is probed with every way to leave t of its
bits out, so each probe is a *mask*: fingerprints that agree on a mask's bits meet in a bucket and
are verified there.

A bucket that is too full is divided again: its fingerprints agree on the mask, so their
differences lie in the free bits, which go through the same principle.  Every division fixes a
third of the free bits; once few bits are free the bucket is small, since its fingerprints differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpoint_dir, firsts, gathered, materialize, remove, require, text_of

BITS = 64
#: Fingerprints above which a bucket is divided, unless so few bits are free that it can't be large.
BUCKET = 4096
#: Estimated costs of writing a probe and of verifying a pair, in the same unit.
PROBE_COST, PAIR_COST = 1.0, 0.01
#: Dropped ids up to which they are broadcast (16 bytes each) rather than joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Edges of a part, which a task holds at once (some 20 MB).
EDGES = 1 << 18
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 16
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined word shingles of a text, A-Z lower-cased, in chunks."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    for at in range(0, len(starts), _CHUNK):
        cut = slice(at, at + _CHUNK)
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[cut], ends[cut])], np.uint64)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, as a signed integer: a bit is set if over half the hashes have it set."""
    counts, n = np.zeros(2048, np.int64), 0
    offsets = np.arange(8, dtype=np.int64) * 256
    for h in shingle_hashes(text, width, seed):
        counts += np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + offsets).ravel(), minlength=2048)
        n += len(h)
    ones = (counts.reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a text without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- the probing plan


@dataclass(frozen=True)
class Plan:
    """Bit partitions, their thresholds, and the masks that probe them."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    masks: tuple[int, ...]
    cost: float


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, how many have both set: over all rows, added up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = unpack(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            both, n = both + bits.T @ bits, n + len(bits)
        a, b = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *(a * BITS + b)], pa.int32()), pa.array([n, *both[a, b].astype(np.int64)], pa.int64())],
            ["cell", "n"],
        )

    sums = prints.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = {r.cell: r.n for r in sums.collect()}  # BITS * (BITS + 1) / 2 + 1 rows, whatever the input
    out = np.zeros((BITS, BITS))
    for k, n in cells.items():
        if k >= 0:
            out[k // BITS, k % BITS] = out[k % BITS, k // BITS] = n
    return cells.get(-1, 0), out


def unpack(prints: np.ndarray) -> np.ndarray:
    """Bits of unsigned fingerprints, bit 0 first."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two random fingerprints agree on a bit, and on two bits."""
    ones = np.diag(both) / max(n, 1)
    p11 = both / max(n, 1)
    p10, p01 = ones[:, None] - p11, ones[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return ones**2 + (1 - ones) ** 2, p11**2 + p10**2 + p01**2 + p00**2


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Split the bits into m partitions of nearly equal size, most correlated bits together.

    A partition starts with the free bit most correlated to the other free bits and takes on, one at
    a time, the free bit most correlated to those it has.
    """
    ones = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread)
    free, out = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, out))) // (m - k)
        part = [free.pop(int(np.argmax(corr[np.ix_(free, free)].sum(1))))]
        while len(part) < size:
            part.append(free.pop(int(np.argmax(corr[np.ix_(free, part)].sum(1)))))
        out.append(part)
    return out


def distance_chances(part: Sequence[int], one: np.ndarray, two: np.ndarray, most: int) -> np.ndarray:
    """Chances that two random fingerprints differ in 0..most bits of a partition.

    The bits are taken as a Markov chain in the order of their grouping, so that neighbours'
    correlation counts.
    """
    chance = {(0, 0): one[part[0]], (1, 1): 1 - one[part[0]]}  # (bits that differ, last bit differs)
    for a, b in zip(part, part[1:]):
        agree, step = two[a, b], {}
        joint = {(0, 0): agree, (0, 1): one[a] - agree, (1, 0): one[b] - agree, (1, 1): 1 - one[a] - one[b] + agree}
        for (k, last), p in chance.items():
            base = one[a] if last == 0 else 1 - one[a]
            for now in (0, 1):
                if k + now <= most and base > 0:
                    step[k + now, now] = step.get((k + now, now), 0.0) + p * max(joint[last, now], 0.0) / base
        chance = step
    return np.array([sum(p for (k, _), p in chance.items() if k == d) for d in range(most + 1)])


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Hand out ``units`` (threshold + 1 each) so that the sum of costs[i][units of i] is least."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, given) in best.items():
            for u, more in enumerate(row[: units - used + 1]):
                if used + u not in step or cost + more < step[used + u][0]:
                    step[used + u] = (cost + more, [*given, u])
        best = step
    return best[units]


def masks_of(part: Sequence[int], threshold: int) -> list[int]:
    """Every way to leave ``threshold`` bits of a partition out."""
    whole = sum(1 << b for b in part)
    return [whole & ~sum(1 << b for b in out) for out in combinations(part, threshold)] if threshold >= 0 else []


def make_plan(n: int, both: np.ndarray, radius: int) -> Plan:
    """The plan of least estimated cost over 1 to radius + 2 partitions."""
    one, two = agreement(n, both)
    pairs, best = n * (n - 1) / 2, None
    for m in range(1, radius + 3):
        parts = group_bits(both, n, m)
        costs = []
        for part in parts:
            chances, row = distance_chances(part, one, two, radius), [0.0]
            for t in range(radius + 1):
                probes = float(len(list(combinations(range(len(part)), t))))
                meets = sum(chances[d] * len(list(combinations(range(len(part) - d), t - d))) for d in range(t + 1) if d <= len(part))
                row.append(PROBE_COST * n * probes + PAIR_COST * pairs * meets)
            costs.append(row)
        cost, units = allocate(costs, radius + 1)
        if best is None or cost < best.cost:
            thresholds = tuple(u - 1 for u in units)
            masks = [x for part, t in zip(parts, thresholds) for x in masks_of(part, t)]
            best = Plan(tuple(map(tuple, parts)), thresholds, tuple(dict.fromkeys(masks)), cost)
    return best


# ---------------------------------------------------------------- probing and verifying


def signed(x: int) -> int:
    """A 64-bit pattern as a signed integer."""
    return x - (1 << BITS) if x >> (BITS - 1) else x


def divide(mask: int, radius: int) -> list[int]:
    """Masks that fix, beyond ``mask``, one of radius + 1 shares of its free bits each."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: radius + 1]) for k in range(radius + 1)]


def with_masks(prints: DataFrame, masks: Sequence[int]) -> DataFrame:
    """(mask, key, fp): every fingerprint under every mask."""
    spread = F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks]))
    return prints.select("fp", spread.alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def link_bucket(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect, within a bucket, all fingerprints that chains of links connect: each
    fingerprint with the smallest of its chain."""
    x = np.unique(prints).view(np.uint64)
    root = np.arange(len(x))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, (1 << 21) // max(len(x), 1))
    for at in range(0, len(x), step):
        near = np.bitwise_count(x[at : at + step, None] ^ x[None, :]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, at + 1))):
            a, b = find(int(i) + at), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    y = x.view(np.int64)
    return [(int(y[i]), int(y[r])) for i in range(len(x)) if (r := find(i)) != i]


def links(prints: DataFrame, masks: Sequence[int], radius: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) at ``radius`` bits or fewer, enough
    of them to connect whatever chains of such links connect."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for bucket in batch.column(0) for pair in link_bucket(bucket.values.to_numpy(), radius)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out, probes, masks = None, with_masks(prints, masks), list(masks)
    while True:
        counts = probes.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        counts = materialize(counts)
        bound = {m: 1 << (BITS - m.bit_count()) for m in masks}
        may_divide = [signed(m) for m in masks if bound[m] > BUCKET]
        full = counts.where((F.col("n") > BUCKET) & F.col("mask").isin(may_divide)) if may_divide else counts.limit(0)
        divided = sorted({r.mask for r in full.select("mask").distinct().collect()})  # a subset of the masks
        use = counts if not divided else counts.join(full.select("mask", "key"), ["mask", "key"], "left_anti")
        buckets = probes.join(use.select("mask", "key"), ["mask", "key"], "left_semi")
        part = buckets.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(verify, "a long, b long")
        out = part if out is None else out.unionByName(part)
        if not divided:
            return out
        hot = materialize(probes.join(full.select("mask", "key"), ["mask", "key"], "left_semi"))
        masks, step = [], None
        for mask in divided:
            own = divide(mask & ((1 << BITS) - 1), radius)
            rows = with_masks(hot.where(F.col("mask") == mask).select("fp"), own).distinct()
            step = rows if step is None else step.unionByName(rows)
            masks += own
        probes = step


# ---------------------------------------------------------------- components


def star_forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of every ``most`` edges (a, b) of a task or fewer, in the order read: each node but the smallest
    of what they connect, with that smallest one."""

    def forest(edges: pa.Table) -> pa.RecordBatch:
        nodes = pa.concat_arrays([chunk for c in ("a", "b") for chunk in edges[c].chunks]).dictionary_encode()
        order = pc.sort_indices(nodes.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b = np.split(rank[nodes.indices.to_numpy()], 2)
        label = np.arange(len(order))
        while len(a):
            # Roots go to the smallest root they have an edge to, and chains of them are shortened.
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
            a, b = label[a], label[b]
            a, b = a[a != b], b[a != b]
        node = np.flatnonzero(label != np.arange(len(label)))
        ends = [nodes.dictionary.take(pa.array(order[x])) for x in (node, label[node])]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    kept, n = [], 0
    for batch in batches:
        while len(batch):
            kept.append(batch.slice(0, most - n))
            batch, n = batch.slice(len(kept[-1])), n + len(kept[-1])
            if n == most:
                yield forest(pa.Table.from_batches(kept))
                kept, n = [], 0
    if n:
        yield forest(pa.Table.from_batches(kept))


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root): the smallest node of the component of every node with an edge.

    Edges lie in parts of ``most``.  A task makes its part a forest of stars, which connects the same;
    between parts large-star and small-star steps alternate, until all parts together are a forest of
    stars or what is left is one part.  Nodes of any degree are handled by minima and joins, never by
    collecting neighbours.  Every step is a table written to the shared folder and read again, so that a
    hub's rows are split in joins and plans don't carry over from round to round what the optimiser
    knew of the one before; a round's tables go with the next.

    No step adds edges or lets the sum of their ends' ranks grow, and one that leaves both as they were
    changes nothing: so rounds end, and a round that changes nothing has met a forest of stars.
    """
    spark, folder, tables = edges.sparkSession, f"{checkpoint_dir(edges.sparkSession)}/components-{uuid.uuid4().hex}", []

    def written(df: DataFrame) -> DataFrame:
        tables.append(f"{folder}/{len(tables)}")
        df.write.parquet(tables[-1])
        return spark.read.parquet(tables[-1])

    def forests(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda batches: star_forest(batches, most), ", ".join(f"{n} {kind}" for n, kind in df.dtypes))

    edges = written(forests(edges.select("a", "b").where("a != b")))
    state = _state(edges)
    while state[0] > most:
        # Large star: neighbours above a node go to the smallest node around it.
        begun = len(tables)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(around, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        below = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = written(forests(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct()))
        for path in tables[begun - 1 : -1]:
            remove(spark, path)
        before, state = state, _state(edges)
        if state == before:
            break
    out = edges if state[0] > most else forests(edges.coalesce(1))
    out = materialize(out.select(F.col("a").alias("node"), F.col("b").alias("root")))
    remove(spark, folder)
    return out


def _state(edges: DataFrame) -> tuple:
    """The number of edges and the sums of two hashes, by which sets of edges are told apart."""
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))
    ).first())


def near_duplicates(
    docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: components of documents whose fingerprints chain
    at ``radius`` differing bits or fewer, named by their smallest doc_id.

    Texts are read whole: A-Z lower-cased, words joined by a space, ``width``-word shingles with
    repeats; a shorter text is one shingle; null, empty and blank texts have fingerprint 0 and link
    like any other.  Null ids are ignored when a component is named (its name is null if it has no
    other).  Repeated rows are returned as often.  An empty table gives no rows.

    Copies share a fingerprint, and all work past the first pass is on distinct fingerprints.
    """
    return _components(docs, radius, width, id_col, text_col).select("doc_id", "fp", "component_id")


def _components(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``near_duplicates`` with ``root``, the smallest fingerprint of their component."""
    require(docs, id_col, text_col)
    rows = materialize(fingerprints(docs, id_col, text_col, width))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    n, both = bit_counts(distinct)
    plan = make_plan(n, both, radius)
    # Written first: verifying and making forests in one stage would hold two Python workers for every task.
    found = components(gathered(links(distinct.select("fp"), plan.masks, radius)))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    names = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(roots.join(names, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def first_of_each(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates``, with the columns of ``docs``: the one of smallest id.

    Null ids come last; of rows that share the id, the one of smallest fingerprint stays, and of those
    (repeated rows included) one, any.  An empty table gives no rows.

    Rows whose id is theirs alone are told by the id.  Rows of repeated and null ids are told by their
    fingerprint, computed again where they lie.
    """
    found = materialize(_components(docs, radius, width, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp"))
    best = materialize(found.groupBy("root").agg(first.alias("b")).select("b.doc_id", "b.fp"))
    repeated = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = found.where("doc_id IS NOT NULL").join(best.where("doc_id IS NOT NULL").withColumn("stays", F.lit(True)), ["doc_id", "fp"], "left")
    gone = gone.where("stays IS NULL").select("doc_id").unionByName(repeated).distinct()
    packed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"))
    alone = packed.where("doc_id IS NOT NULL").join(_broadcast_if_small(materialize(gone)), "doc_id", "left_anti").select("doc.*")
    if repeated.isEmpty() and found.where("doc_id IS NULL").isEmpty():
        return alone
    again = packed.join(_broadcast_if_small(repeated), "doc_id", "left_semi").unionByName(packed.where("doc_id IS NULL"))
    again = again.select("doc", text_of(F.col("doc")[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc", "fp"])

    kinds = StructType([StructField("doc", docs.schema), StructField("fp", LongType())])
    rows = again.mapInArrow(run, kinds).select("doc", "fp", F.col("doc")[id_col].alias("doc_id"))
    known = _broadcast_if_small(best.select(F.col("doc_id").alias("best_id"), F.col("fp").alias("best_fp")))
    rows = rows.join(known, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("fp") == F.col("best_fp")), "left_semi")
    return alone.unionByName(firsts(rows, "doc_id", "fp").where("first_of_key").select("doc.*"))


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it is small."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
