"""Exact deduplication over a log-structured merge index of text digests.

1. Tasks read texts into a *memtable* keyed by the digest of the normalised text.  A hit inside a
   memtable is verified byte by byte.  A full memtable flushes a sorted run of entries
   (digest, rows, longest text, smallest id), so a text with any number of copies leaves one entry
   per flush.
2. Entries are dealt by digest to parts of a bounded number of entries.  Each part keeps an index of
   sorted runs, each with a Bloom filter; a new run looks its digests up in the older ones, and
   size-tiered compaction merges runs, keeping per digest the longest text and, of those, the
   smallest id.
3. Digests hit in different flushes are verified: tasks read the texts again, a bitmap of the hit
   digests tells them which to send, once a flush, and these are grouped by their bytes.  Should
   texts differ under one digest, they end in classes of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bitmap_of, firsts, in_bitmap, materialize, require, text_of

#: Bytes of text and number of digests at which a memtable is flushed.
MEMTABLE_BYTES, MEMTABLE_ENTRIES = 32 << 20, 50_000
#: Classes up to which they are broadcast (under 200 bytes each) rather than joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Stands for a null id: it sorts last and is given back as null.
NO_ID = 2**63 - 1

#: Entries that a part of the index is meant to have: under 100 bytes each.
PART = 1_000_000

_ENTRY = "digest binary, n long, length long, id long, ties long"
_DROP = SPACES.encode()


def normalised(text: Column) -> Column:
    """A non-null text without its white space."""
    return F.translate(text, SPACES, "")


def digest_of(text: Column, digest_bytes: int = 32) -> Column:
    """SHA-256 of the normalised text, cut to ``digest_bytes``."""
    return F.substring(F.unhex(F.sha2(normalised(text), 256)), 1, digest_bytes)


class Memtable:
    """Texts seen since the last flush: per digest, the distinct normalised texts with their rows.

    An entry has the rows, the longest text's code points, the smallest id of a row with that many,
    and how many rows have both.
    """

    def __init__(self, digest_bytes: int, texts: bool = False):
        self.digest_bytes, self.rows, self.bytes, self.texts = digest_bytes, {}, 0, texts

    def put(self, doc_id: int, length: int, digest: bytes, data: bytes) -> None:
        same = self.rows.setdefault(digest, [])
        new = (-length, doc_id)
        for entry in same:
            if entry[0] == data:  # the hit is verified
                entry[1] += 1
                old = (entry[2], entry[3])
                if new <= old:
                    entry[2:] = [*new, entry[4] + 1 if new == old else 1]
                return
        same.append([data, 1, *new, 1])
        self.bytes += len(data) + 200

    def full(self) -> bool:
        return self.bytes >= MEMTABLE_BYTES or len(self.rows) >= MEMTABLE_ENTRIES

    def flush(self) -> pa.RecordBatch:
        """The entries, sorted by digest; the memtable is empty afterwards."""
        flat = [(d, e[1], -e[2], e[3], e[4], e[0]) for d in sorted(self.rows) for e in self.rows[d]]
        self.rows, self.bytes = {}, 0
        kinds = (pa.binary(), *[pa.int64()] * 4, pa.string())[: 5 + self.texts]
        columns = list(zip(*flat)) or [()] * 6
        if self.texts:
            columns[5] = [x.decode("utf-8", "surrogatepass") for x in columns[5]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "n", "length", "id", "ties", "same"][: 5 + self.texts]
        )


def flush_runs(digest_bytes: int, wanted=None):
    """The map task of step 1, over batches of (id, text); of step 3 with ``wanted``, a broadcast bitmap of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memtable(digest_bytes, wanted is not None)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                data = text.encode("utf-8", "surrogatepass").translate(None, _DROP)
                digest = hashlib.sha256(data).digest()[:digest_bytes]
                if wanted is not None and not in_bitmap(wanted.value, np.array([leading(digest)], np.uint64))[0]:
                    continue
                table.put(doc_id, len(text), digest, data)
                if table.full():
                    yield table.flush()
        yield table.flush()

    return run


def leading(digest: bytes) -> int:
    """The first 64 bits of a digest."""
    return int.from_bytes(digest[:8].ljust(8, b"\0"), "big")


def fold(keys, n, length, ids, ties, hit) -> tuple:
    """Sort entries by key and fold equal keys: rows added up, the longest text's smallest id and its rows, any hit."""
    order = np.lexsort((ids, -length, keys))
    keys, n, length, ids, ties, hit = (x[order] for x in (keys, n, length, ids, ties, hit))
    if not len(keys):
        return keys, n, length, ids, ties, hit
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys)))
    best = np.repeat(first, count)
    ties = np.where((length == length[best]) & (ids == ids[best]), ties, 0)
    return keys[first], np.add.reduceat(n, first), length[first], ids[first], np.add.reduceat(ties, first), np.logical_or.reduceat(hit, first) | (count > 1)


class Run:
    """An immutable run of entries, sorted by digest, with a Bloom filter of its digests."""

    PROBES, BITS = 4, 12

    def __init__(self, keys, n, length, ids, ties, hit):
        self.parts = keys, n, length, ids, ties, hit
        self.size = max(64, self.BITS * len(keys))
        bits = np.zeros(self.size, bool)
        for at in self._places(keys):
            bits[at] = True
        self.filter = np.packbits(bits)

    def _places(self, keys) -> Iterator[np.ndarray]:
        words = np.frombuffer(np.ascontiguousarray(keys.astype("S32")).tobytes(), "<u8").reshape(-1, 4)
        for k in range(self.PROBES):
            yield (words[:, 0] + np.uint64(k) * (words[:, 1] | np.uint64(1))) % np.uint64(self.size)

    def holds(self, keys) -> np.ndarray:
        """Which keys the run holds: those the filter lets through are searched."""
        there = np.ones(len(keys), bool)
        for at in self._places(keys):
            there &= (self.filter[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
        asked = np.flatnonzero(there)
        own = self.parts[0]
        if len(asked) and len(own):
            at = np.minimum(np.searchsorted(own, keys[asked]), len(own) - 1)
            there[asked] = own[at] == keys[asked]
        return there & (len(own) > 0)


class MergeIndex:
    """Runs by level; a run goes one level down when its level has ``FANOUT`` runs to merge."""

    FANOUT = 4

    def __init__(self):
        self.levels: list[list[Run]] = []

    def put(self, keys, n, length, ids, ties) -> None:
        keys, n, length, ids, ties, hit = fold(keys, n, length, ids, ties, np.zeros(len(keys), bool))
        for older in (r for level in self.levels for r in level):
            hit |= older.holds(keys)
        self._add(0, Run(keys, n, length, ids, ties, hit))

    def _add(self, level: int, run: Run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.FANOUT:
            merged = self.merge(self.levels[level])
            self.levels[level] = []
            self._add(level + 1, merged)

    @staticmethod
    def merge(runs: list[Run]) -> Run:
        return Run(*fold(*(np.concatenate(parts) for parts in zip(*(r.parts for r in runs)))))

    def compacted(self) -> tuple:
        runs = [r for level in self.levels for r in level]
        return self.merge(runs).parts if runs else ()


def compact(digest_bytes: int):
    """The task of step 2, over batches of entries that share their digests with no other task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MergeIndex()
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"S{digest_bytes}")
            index.put(keys, *(batch.column(i).to_numpy() for i in (1, 2, 3, 4)))
        for part in [index.compacted()] if index.levels else []:
            keys = [k.ljust(digest_bytes, b"\0") for k in part[0].tolist()]
            for at in range(0, len(keys), 50_000):
                cut = slice(at, at + 50_000)
                columns = [pa.array(keys[cut], pa.binary()), *(pa.array(p[cut]) for p in part[1:])]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "length", "id", "ties", "hit"])

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """The classes of equal texts that have two rows or more.

    Columns: ``digest``, ``variant`` (SHA-512 of the normalised text, only where a digest has several
    classes), ``group_size``, ``keep_id`` and ``keep_length`` (of the row that stays), ``ties`` (rows
    that have both).
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_col).alias("text"))
    entries = materialize(texts.mapInArrow(flush_runs(digest_bytes), _ENTRY))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // PART))
    index = materialize(entries.repartition(parts, "digest").mapInArrow(compact(digest_bytes), f"{_ENTRY}, hit boolean"))
    single = index.where("NOT hit").select("digest", F.lit(None).cast("string").alias("variant"), "n", "length", "id", "ties")
    lead = F.conv(F.rpad(F.hex(F.substring("digest", 1, 8)), 16, "0"), 16, -10).cast("long")
    wanted = spark.sparkContext.broadcast(bitmap_of(index.where("hit").select(lead)))
    verified = (
        texts.mapInArrow(flush_runs(digest_bytes, wanted), f"{_ENTRY}, same string")
        .groupBy("digest", "same")
        .agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("length")).alias("shorter"), "id")).alias("best"))
    )
    variant, length = F.sha2("same", 512).alias("variant"), (-F.col("best.shorter")).alias("length")
    verified = materialize(verified.select("digest", variant, "n", length, F.col("best.id").alias("id")))
    split = materialize(verified.groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("split")))
    found = verified.join(index.where("hit").select("digest", "ties"), "digest").join(split, "digest", "left")
    found = found.select("digest", F.when(F.col("split"), F.col("variant")).alias("variant"), "n", "length", "id", F.when(F.col("split"), F.lit(2)).otherwise(F.col("ties")).alias("ties"))
    keep = F.when(F.col("id") != NO_ID, F.col("id")).alias("keep_id")
    both = found.unionByName(single).where("n > 1 OR variant IS NOT NULL")
    return materialize(both.select("digest", "variant", F.col("n").alias("group_size"), keep, F.col("length").alias("keep_length"), "ties"))


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per row of ``docs``: its columns (or ``keep``) as the struct ``doc``, then ``keep_id``,
    ``group_size``, ``kept``, ``digest``.

    Texts are equal if they are the same without white space; null counts as empty.  Of equal texts
    the row with most code points stays, then the one with the smallest id (a whole number), null ids
    last; of rows that have both in common, repeated rows included, one stays, any.  So each class keeps
    exactly one row, whatever ids repeat.  An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    groups = classes(docs, id_col, text_col, digest_bytes)
    text = text_of(text_col)
    rows = docs.select(
        F.struct(*(keep or ["*"])).alias("doc"), F.col(id_col).cast("long").alias("id"), digest_of(text, digest_bytes).alias("digest"),
        F.length(text).cast("long").alias("length"), F.sha2(normalised(text), 512).alias("own_variant"),
    )
    on = rows["digest"] == groups["digest"]
    if groups.where("variant IS NOT NULL").isEmpty():
        rows = rows.drop("own_variant")
    else:  # a digest with several texts
        on &= groups["variant"].isNull() | (groups["variant"] == rows["own_variant"])
    no_ties = groups.where("ties > 1").isEmpty()
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    single = F.col("group_size").isNull()
    joined = rows.join(groups, on, "left").select(
        "doc", F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))).alias("kept"), rows["digest"].alias("digest"),
        "variant", F.coalesce("ties", F.lit(1)).alias("ties"),
    )
    out = ("doc", "keep_id", "group_size", "kept", "digest")
    if no_ties:
        return joined.select(*out)
    tied = F.col("kept") & (F.col("ties") > 1)
    one = firsts(joined.where(tied).withColumn("variant", F.coalesce("variant", F.lit(""))), "digest", "variant")
    return joined.where(~tied).select(*out).unionByName(one.withColumn("kept", F.col("first_of_key")).select(*out))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``assign`` keeps, with their columns: exactly one of each class of equal texts.

    Null and empty texts are one class, repeated and null ids make no difference; an empty table gives
    no rows.
    """
    return assign(docs, **options).where("kept").select("doc.*")
