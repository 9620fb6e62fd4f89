"""MinHash near-duplicates by tensored banding, verified on full sets of word shingles.

Two small collections of half keys, each made of a few minimum hashes, stand for all the tables that
a pair of half keys, one of each collection, would make: two documents meet if they share a half key
of the first and one of the second, so m half keys a side do the work of m * m tables.  The first
collection deals documents into buckets; within a bucket, or where it is too full by a key of both,
the second one is compared.

Documents of equal sets are one class, and all work past the first pass is on classes.  In a bucket
bitmaps of the shingles leave out, exactly, most pairs that can't be similar.  A pair counts in its
first common table alone, and a bucket hands on no pair that others make needless: a spanning forest of pairs that are similar by a wide margin, and
the doubtful pairs between its trees.  All that counts is then verified on the sets themselves; should
a pair of the forest not be similar, its buckets alone are gone through again, with what is linked
known and the pair doubtful, until no pair of a forest fails.  Of a bucket of several blocks,
what isn't linked meets all others once; where that would copy rows more often than there are second
half keys, these divide the bucket first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, gathered, in_bitmap, materialize, require, text_of
from .simhash import components

#: Similarity as a fraction: intersection over union of 4/5.
PART, OF = 4, 5
#: Half keys of each collection, and minimum hashes of a half key.
#: At a similarity of 0.8 a pair misses all half keys of a collection at a chance of (1 - 0.8 ** 2) ** 14, below one in a million.
HALVES, HASHES = 14, 2
#: Classes of a bucket or block at most, and pairs of one looked at, at once.
BLOCK, PAIRS = 1000, 1 << 18
#: Classes above which a bucket is divided by the second half keys: below, its blocks copy a row less often than as many tables would.
DIVIDED = HALVES * BLOCK
#: Bits of a bitmap a shingle, and bits at least and at most (powers of two).
BITS_A_SHINGLE, LEAST_BITS, MOST_BITS = 8, 1 << 11, 1 << 16
#: Deviations by which the estimated difference must stay below the limit for a pair to be near for sure.
MARGIN = 4.0
#: Sets a task remembers having sketched; beyond, it starts afresh.
SEEN = 100_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 12
_FACTORS, _TURNS = np.random.default_rng(12).integers(1, 1 << 63, (2, 2 * HALVES * HASHES), np.uint64)
_FACTORS = _FACTORS * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- sets and sketches


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several columns of hashes, in their order."""
    out = columns[0].copy()
    for c in columns[1:]:
        out = (out ^ (out >> np.uint64(29))) * _MIX + c
    return (out ^ (out >> np.uint64(32))) * _MIX


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of a text, sorted; A-Z lower-cased, fewer words are one shingle."""
    words = text.translate(_LOWER).split()
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    if len(words) < width:
        return mixed([np.array([len(words)], np.uint64), *h[:, None]]) if len(words) else h
    return np.unique(mixed([h[k : len(h) - width + 1 + k] for k in range(width)]))


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), _CHUNK):
        x = (shingles[None, low : low + _CHUNK] ^ _TURNS[:, None]) * _FACTORS[:, None]
        out = np.minimum(out, x.min(1))
    return out


def half_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half keys of both collections: the first with their places mixed in, the second in 32 bits."""
    least = minimum_hashes(shingles).reshape(2, HALVES, HASHES)
    one = mixed([np.arange(HALVES, dtype=np.uint64), *least[0].T])
    return one.view(np.int64), (mixed(list(least[1].T)) >> np.uint64(32)).astype(np.uint32)


def bits_of(shingles: np.ndarray) -> bytes:
    """A bit for the trailing bits of every shingle; twice the width is two bitmaps to be joined."""
    width = min(max(1 << (len(shingles) * BITS_A_SHINGLE - 1).bit_length(), LEAST_BITS), MOST_BITS)
    out = np.zeros(width, bool)
    out[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n, set_id, keys, others, bits) of every row; the sketch only where a task first sees a set, no set without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                x = shingle_set(text.as_buffer().to_pybytes(), width)
                row = [len(x), None, None, None, None]
                if len(x):
                    row[1] = digest = xxhash.xxh3_128_digest(x.tobytes())
                    if digest not in seen:
                        seen = seen if len(seen) < SEEN else set()
                        seen.add(digest)
                        keys, others = half_keys(x)
                        row[2:] = keys, others.tobytes(), bits_of(x)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["doc_id", "n", "set_id", "keys", "others", "bits"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n long, set_id binary, keys array<long>, others binary, bits binary"
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- pairs of a bucket


class Members(NamedTuple):
    """Rows of whole buckets: which bucket, the half keys it is of (``mth`` is -1 where it isn't divided), set, its size,
    its half keys, bitmap, what it is linked to, and its side (0 both, 1 or 2)."""

    bucket: np.ndarray
    nth: np.ndarray
    mth: np.ndarray
    set_id: list[bytes]
    n: np.ndarray
    keys: np.ndarray
    others: np.ndarray
    bits: list[bytes]
    root: np.ndarray
    side: np.ndarray


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Members]:
    """The sorted rows (key, part, nth, mth, set_id, n, keys, others, bits, root, side) of a task by whole buckets."""

    def members(t: pa.Table) -> Members:
        t = t.combine_chunks()
        key, part = t["key"].to_numpy(), t["part"].to_numpy()
        bucket = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        others = np.frombuffer(b"".join(t["others"].to_pylist()), np.uint32).reshape(-1, HALVES)
        root = t["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(-1, HALVES)
        return Members(bucket, t["nth"].to_numpy(), t["mth"].to_numpy(), t["set_id"].to_pylist(), t["n"].to_numpy(), keys, others, t["bits"].to_pylist(), root, t["side"].to_numpy())

    kept: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if kept is None else pa.concat_tables([kept, t])
        key, part = t["key"].to_numpy(), t["part"].to_numpy()
        last = len(t) - int(np.argmax((key[::-1] != key[-1]) | (part[::-1] != part[-1]))) if (key[0], part[0]) != (key[-1], part[-1]) else 0
        if last:
            yield members(t.slice(0, last))
        kept = t.slice(last)
    if kept is not None and len(kept):
        yield members(kept)


def pairs_of(m: Members) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within buckets, in pieces: of either side, or one of each."""
    opens = np.flatnonzero(np.concatenate(([True], m.bucket[1:] != m.bucket[:-1])))
    sizes, sided = np.diff(np.append(opens, len(m.bucket))), m.side.any()
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = opens[sizes == size][:, None] + np.arange(size)
        many = max(1, PAIRS // size)
        step = max(1, many // len(at))
        for low in range(0, size - 1, step):
            high = min(low + step, size - 1)
            upper = np.arange(low, high)[:, None] < np.arange(low + 1, size)[None, :]
            for top in range(0, len(at), many):
                i, j = np.broadcast_arrays(at[top : top + many, low:high, None], at[top : top + many, None, low + 1 :])
                i, j = i[:, upper].ravel(), j[:, upper].ravel()
                if sided:
                    across = (m.side[i] == 0) | (m.side[i] != m.side[j])
                    i, j = i[across], j[across]
                yield i, j


def candidates(m: Members, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ratio, sure): pairs of different roots whose first common table is here, and that size and bitmap don't rule out.

    ``ratio`` is the difference of the bitmaps over the most that similar sets can have.
    """
    words = np.array([len(b) // 8 for b in m.bits])
    place, matrix = np.zeros(len(words), np.int64), {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        place[own] = np.arange(len(own))
        matrix[w] = np.frombuffer(b"".join([m.bits[k] for k in own]), np.uint64).reshape(-1, w)
    out = []
    for i, j in pairs_of(m):
        a, b = m.n[i], m.n[j]
        keep = (PART * np.maximum(a, b) <= OF * np.minimum(a, b)) & (m.root[i] != m.root[j])
        i, j = i[keep], j[keep]
        same, whole = m.others[i] == m.others[j], m.mth[i] < 0
        keep = np.where(whole, same.any(1), same.argmax(1) == m.mth[i]) & ((m.keys[i] == m.keys[j]).argmax(1) == m.nth[i])
        i, j = i[keep], j[keep]
        i, j = np.where(words[i] <= words[j], i, j), np.where(words[i] <= words[j], j, i)
        differ, full = np.zeros(len(i), np.int64), np.zeros(len(i))
        for w in np.unique(words[i]).tolist():
            for v in np.unique(words[j[words[i] == w]]).tolist():
                at = np.flatnonzero((words[i] == w) & (words[j] == v))
                for piece in np.array_split(at, -(-len(at) * v * 8 // (1 << 24))):
                    x, y = matrix[w][place[i[piece]]], matrix[v][place[j[piece]]]
                    while y.shape[1] > w:
                        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
                    differ[piece] = np.bitwise_count(x ^ y).sum(1)
                    full[piece] = np.bitwise_count(x | y).sum(1) / (64 * w)
        most = (m.n[i] + m.n[j]) * (OF - PART) / (OF + PART)
        keep = differ <= most
        i, j, differ, full, most = i[keep], j[keep], differ[keep], full[keep], most[keep]
        room = np.maximum(1 - full, 1e-9)
        out.append((i, j, differ / most, differ / room + margin * np.sqrt((differ + 1) * full) / room <= most))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, bool))


def forest(n: int, i: np.ndarray, j: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a spanning forest of least ratios, and the tree of each of ``n`` rows: every tree takes its best pair, until none is left."""
    order, label, chosen = np.lexsort((j, i, ratio)), np.arange(n), []
    while True:
        a, b = label[i[order]], label[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            return np.array(chosen, np.int64), label
        best = np.full(n, len(order))
        np.minimum.at(best, a, np.arange(len(order)))
        np.minimum.at(best, b, np.arange(len(order)))
        picks, to = np.unique(best[best < len(order)]), np.arange(n)
        for x, y in zip(a[picks].tolist(), b[picks].tolist()):
            while to[x] != x:
                x = to[x]
            while to[y] != y:
                y = to[y]
            to[max(x, y)] = min(x, y)
        chosen += order[picks].tolist()
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def pair_hash(a: bytes, b: bytes) -> int:
    """A 64-bit hash of two sets, of whatever order."""
    return xxhash.xxh3_64_intdigest(min(a, b) + max(a, b))


def bucket_links(batches: Iterator[pa.RecordBatch], wrong: np.ndarray | None = None, margin: float = MARGIN) -> Iterator[pa.RecordBatch]:
    """(a, b, ratio, sure): the forest of sure pairs of each bucket, and the doubtful pairs between its trees.

    Pairs in the bitmap ``wrong`` are doubtful.
    """
    for m in whole_buckets(batches):
        i, j, ratio, sure = candidates(m, margin)
        if wrong is not None and sure.any():
            at = np.flatnonzero(sure)
            hashes = np.array([pair_hash(m.set_id[x], m.set_id[y]) for x, y in zip(i[at].tolist(), j[at].tolist())], np.uint64)
            sure[at[in_bitmap(wrong, hashes)]] = False
        at = np.flatnonzero(sure)
        picks, tree = forest(len(m.n), i[at], j[at], ratio[at])
        use = np.concatenate((at[picks], np.flatnonzero(~sure & (tree[i] != tree[j]))))
        ends = [sorted((m.set_id[x], m.set_id[y])) for x, y in zip(i[use].tolist(), j[use].tolist())]
        columns = [pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ratio[use]), pa.array(sure[use])], ["a", "b", "ratio", "sure"])


# ---------------------------------------------------------------- buckets


def shared(keys: DataFrame) -> DataFrame:
    """A table of (key, ...) with ``size``: the rows of keys that several have; the key's size is joined as a written table."""
    keys = materialize(keys)
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    return keys.join(sizes, "key")


def by_second_keys(rows: DataFrame, sketch: DataFrame, *more: str) -> DataFrame:
    """(set_id, mth, nth, key, more) of rows (key, nth, set_id, more), divided by the second half keys of their sets."""
    second = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(HALVES - 1)), lambda k: F.substring(F.col("others"), 4 * k + 1, F.lit(4))))
    tables = rows.select("set_id", "nth", "key", *more).join(sketch.select("set_id", "others"), "set_id").select("set_id", "nth", "key", *more, second.alias("mth", "half"))
    return tables.select("set_id", "mth", "nth", F.xxhash64("key", "mth", "half").alias("key"), *more)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, nth, mth, set_id, size): the buckets of the first half keys; one of over ``DIVIDED`` sets is divided by the second half keys."""
    found = materialize(shared(classes.select("set_id", F.lit(-1).alias("mth"), F.posexplode("keys").alias("nth", "key"))))
    full = found.where(F.col("size") > DIVIDED)
    if full.isEmpty():
        return found
    return materialize(found.where(F.col("size") <= DIVIDED).unionByName(shared(by_second_keys(full, classes))))


_LINKS = "a binary, b binary, ratio double, sure boolean"
_SKETCH = ("set_id", "n", "keys", "others", "bits")
_MEMBER = ("key", "part", "nth", "mth", *_SKETCH, "root", "side")


def sketches_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The sketches of the sets that ``rows``, written, have: a bitmap tells tasks which to send, so that no join moves those of all classes."""
    bitmap = bitmap_of(materialize(rows.select(F.xxhash64("set_id").alias("h")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = in_bitmap(bitmap, batch.column(0).to_numpy().view(np.uint64))
            yield batch.select(list(_SKETCH)).filter(pa.array(use, pa.bool_()))

    sketch = classes.select(*_SKETCH)
    return classes.select(F.xxhash64("set_id").alias("h"), *_SKETCH).mapInArrow(run, sketch.schema)


def linked(members: DataFrame, wrong: np.ndarray | None = None) -> DataFrame:
    """(a, b, ratio, sure), each pair once, of dealt members."""
    margin = MARGIN
    rows = members.select(*_MEMBER).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lambda batches: bucket_links(batches, wrong, margin), _LINKS)
    return gathered(rows.groupBy("a", "b").agg(F.min("ratio").alias("ratio"), F.max("sure").alias("sure")))


def first_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links within buckets; those of over ``BLOCK`` sets are dealt into blocks, which share one member."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    h = F.xxhash64("set_id")
    leads = rows.where(F.col("size") > BLOCK).groupBy("key").agg(F.min(h).alias("lead"))
    own = F.pmod(h, blocks).cast("int")
    dealt = rows.join(leads, "key", "left").select("key", "nth", "mth", "set_id", F.explode(F.when(h == F.col("lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("part"))
    return linked(dealt.join(sketches_of(rows, classes), "set_id").withColumns({"root": F.col("set_id"), "side": F.lit(0)}))


def still_open(rows: DataFrame) -> DataFrame:
    """The rows (key, root, ...) of buckets that more than one root has, with the bucket's ``size``, its most frequent root ``top`` and
    the blocks of ``BLOCK`` that all rows and those of other roots fill (``wide`` and ``high``), written."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    per_key = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("roots"))
    blocks = (F.ceil(F.col("size") / BLOCK).alias("wide"), F.ceil((F.col("size") - F.col("top.n")) / BLOCK).alias("high"))
    per_key = materialize(per_key.where("roots > 1").select("key", F.col("top.root").alias("top"), "size", *blocks, (F.col("size") - F.col("top.n")).alias("others_of_top")))
    return materialize(rows.join(per_key, "key"))


def dealt_again(rows: DataFrame) -> DataFrame:
    """The rows of open buckets by parts: one of up to two blocks is one part, of a larger one those of other roots than its most
    frequent meet all rows, by blocks of both."""
    h = F.xxhash64("set_id")
    x, y = F.pmod(h, "high"), F.pmod(F.xxhash64(h), "wide")
    own = ("key", "nth", "mth", "set_id", "root")
    whole, large = rows.where(F.col("size") <= 2 * BLOCK), rows.where(F.col("size") > 2 * BLOCK)
    few = large.where("root != top").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("y"))
    every = large.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("x"))
    out = whole.select(*own, F.lit(0).alias("side"), F.lit(0).cast("long").alias("part"))
    out = out.unionByName(few.select(*own, F.lit(1).alias("side"), (x * F.col("wide") + F.col("y")).alias("part")))
    return out.unionByName(every.select(*own, F.lit(2).alias("side"), (F.col("x") * F.col("wide") + y).alias("part")))


def later_links(rows: DataFrame, classes: DataFrame, roots: DataFrame, wrong: np.ndarray | None = None) -> DataFrame:
    """Links between sets of a bucket that aren't linked yet: those outside of its largest component against all.

    A bucket whose blocks would copy its rows more often than there are second half keys is divided by these
    first, and only rows that share one with another component go on.  Pairs in the bitmap ``wrong`` are doubtful.
    """
    rows = still_open(materialize(rows.join(roots, "set_id", "left").select("key", "nth", "mth", "set_id", F.coalesce("root", "set_id").alias("root"))))
    sketch = sketches_of(rows, classes)
    copies = F.col("others_of_top") * F.col("wide") + F.col("size") * F.col("high")
    full = (F.col("mth") < 0) & (F.col("size") > 2 * BLOCK) & (copies > HALVES * F.col("size"))
    divided = rows.where(full)
    if not divided.isEmpty():
        tables = by_second_keys(divided, sketch, "root")
        rows = rows.where(~full).unionByName(still_open(materialize(tables)))
    return linked(dealt_again(rows).join(sketch, "set_id"), wrong)


def buckets_of(buckets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key), written: the buckets in which both sets of one of the pairs lie."""
    keys = buckets.select("key", "set_id")
    ends = pairs.join(keys.withColumnRenamed("set_id", "a"), "a").join(keys.withColumnRenamed("set_id", "b"), ["b", "key"])
    return gathered(ends.select("key").distinct())


# ---------------------------------------------------------------- verifying


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(set_id, shingles): the sets of the wanted classes (set_id, first_id), from the rows of those ids, where they lie."""
    bitmap = bitmap_of(wanted.select(F.xxhash64("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = np.flatnonzero(in_bitmap(bitmap, batch.column(0).to_numpy().view(np.uint64))).tolist()
            sets = [shingle_set(batch.column(1)[k].as_buffer().to_pybytes(), width).tobytes() for k in use]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["set_id", "shingles"])

    rows = docs.select(F.xxhash64(F.col(id_col)).alias("h"), text_of(text_col).alias("text")).mapInArrow(run, "set_id binary, shingles binary")
    return materialize(rows.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))


def similar(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``links`` (a, b, sure), written, with ``holds``: whether the similarity of the full sets is PART / OF or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = []
            for x, y in zip(batch.column(3), batch.column(4)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                holds.append(common * (PART + OF) >= PART * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(holds, pa.bool_())], ["a", "b", "sure", "holds"])

    rows = materialize(links.select("a", "b", "sure")).join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a")
    rows = rows.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "sure", "x", "y")
    return gathered(rows.mapInArrow(run, "a binary, b binary, sure boolean, holds boolean"))


def rooted(edges: DataFrame) -> DataFrame:
    """(set_id, root) of the sets that links connect, written."""
    return components(edges).select(F.col("node").alias("set_id"), "root")


def across(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links between different components."""
    for c in ("a", "b"):
        links = links.join(roots.select(F.col("set_id").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return links.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def confirmed(links: DataFrame, sets: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges that connect what similar pairs of ``links`` (and the ``known`` edges) connect, the roots, and the sure pairs (a, b) that failed, written.

    Every set's best pair is verified first, then the pairs between what isn't connected by then.
    """
    each = links.select(F.inline(F.array(*[F.struct(F.col(c).alias("set_id"), "ratio", "a", "b") for c in ("a", "b")])))
    best = each.groupBy("set_id").agg(F.min(F.struct("ratio", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    tested = similar(links.join(best, ["a", "b"], "left_semi"), sets)
    edges = tested.where("holds").select("a", "b")
    edges = edges if known is None else edges.unionByName(known)
    roots = rooted(edges)
    tested_too = similar(across(links.join(tested.select("a", "b"), ["a", "b"], "left_anti"), roots), sets)
    failed = materialize(tested.unionByName(tested_too).where("sure AND NOT holds").select("a", "b"))
    more = tested_too.where("holds").select("a", "b")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        roots = rooted(edges)
    return edges, roots, failed


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``: components of documents linked by a Jaccard similarity of 0.8 or more.

    A document's set is that of its distinct ``width``-word shingles, A-Z lower-cased; fewer words are
    one shingle.  Null, empty and blank texts have no set, link with nothing and are their own
    component.  A component is named by its smallest doc_id; null ids are ignored in that (the name is
    null if there is no other), and ``kept`` says whether a row's id is the name.  Repeated rows are
    returned as often; an empty table gives no rows.
    """
    require(docs, id_col, text_col)
    rows = materialize(sketches(docs, id_col, text_col, width))
    firsts = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_id"))
    sketch = rows.where("keys IS NOT NULL").select("set_id", "n", "keys", "others", "bits").dropDuplicates(["set_id"])
    classes = materialize(sketch.join(firsts, "set_id"))
    buckets = bucket_rows(classes)
    links = first_links(buckets, classes)
    roots = sets = edges = wrong = None
    while not links.isEmpty():
        wanted = wanted_sets(links, classes)
        wanted = wanted if sets is None else materialize(wanted.join(sets.select("set_id"), "set_id", "left_anti"))
        if sets is None or not wanted.isEmpty():
            more = full_sets(docs, wanted, id_col, text_col, width)
            sets = more if sets is None else sets.unionByName(more)
        full = F.col("size") > BLOCK if edges is None else F.lit(False)
        edges, roots, failed = confirmed(links, sets, edges)
        if failed.isEmpty():
            again = buckets.where(full)
        else:
            wrong = failed if wrong is None else wrong.unionByName(failed)
            again = buckets.join(buckets_of(buckets, failed).withColumn("failed", F.lit(True)), "key", "left").where(full | F.col("failed")).drop("failed")
        if again.isEmpty():
            break
        links = later_links(again, classes, roots, None if wrong is None else bitmap_of(pair_hashes(wrong)))
    found = classes.select("set_id", "first_id")
    if roots is not None:
        roots = found.join(roots, "set_id", "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root"))
        names = roots.groupBy("root").agg(F.min("first_id").alias("first_id"))
        found = materialize(roots.select("set_id", "root")).join(materialize(names), "root").select("set_id", "first_id")
    out = rows.select("doc_id", "n", "set_id").join(materialize(found), "set_id", "left")
    name = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def pair_hashes(pairs: DataFrame) -> DataFrame:
    """``pair_hash`` of every pair (a, b), as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [pair_hash(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64))], ["h"])

    return pairs.select("a", "b").mapInArrow(run, "h long")


def wanted_sets(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, first_id) of the ends of links, written."""
    ends = links.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    return gathered(classes.select("set_id", "first_id").join(ends, "set_id", "left_semi"))
