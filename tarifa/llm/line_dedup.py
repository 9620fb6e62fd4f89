"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words.  Words are ordered from rare to frequent, so two lines at Jaccard
4/5 or more share a word in the first part of both, the *prefix*.  The order goes by 32 bits of a
word's hash, its *name* (in how many lines the name's slot occurs, then the name), and lines meet
in buckets of names.  A pair counts in the bucket of its first common name alone: where the names
before it are equal too, the pair has met already.  Pairs are filtered by length, by the name's
position and by parity bitmaps, wider ones for longer lines; what is left is verified on the words.

Lines of equal word sets are one class, joined once.  The texts are read three times where they lie
and never shuffled:

1. every line's class is written, and the words' counts are added up;
2. prefixes go to the buckets, packed: a blob holds what a task has for a range of names.  Buckets
   report the classes that pass the filters with some other class;
3. the words of these classes are sent (a bitmap of their hashes tells tasks which lines to cut)
   and verified.

Buckets report classes with the number of their links and their earliest match, never the pairs.  A
name that may have too many classes goes its own way: its rows are dealt out in blocks, each pair of
blocks a bucket.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bitmap_of, checkpoint_dir, firsts, in_bitmap, materialize, require, text_of

#: Similarity as a fraction: intersection over union of 4/5.
UP, DOWN = 4, 5
#: Bits of slots that words are counted in: by the number of words, within these bounds.
LEAST_BITS, MOST_BITS = 16, 26
#: Bits of names that a row of counts covers.
NAME_BLOCK = 22
#: Classes in a bucket or block at most, and pairs filtered at once.
BLOCK, PAIRS = 2000, 1 << 20
#: Classes a task remembers; beyond, it starts afresh.
CACHE = 400_000
#: Bytes of text and lines worked on at once; a longer line is worked on alone.
SLICE, SLICE_LINES = 2 << 20, 1 << 19
#: Names whose counts a task keeps, and rows for buckets, before it hands them on.
COUNTED, GATHERED = 1_500_000, 300_000
#: Rows of buckets a part is meant to have, and parts at most.
PART, MOST_PARTS = 250_000, 20_000
#: Words up to which a line's bitmap has 64 bits; twice as many for each doubling.
NARROW, WIDEST = 100, 16
#: Large buckets up to which their table is broadcast (12 bytes each).
BROADCAST_ROWS = 100_000
#: Stands for a null id: it sorts last and is given back as null.
NO_ID = 2**63 - 1


def prefix_length(size):
    """Words of a line of ``size`` that its prefix has."""
    return size + (-UP * size // DOWN) + 1


def least_overlap(a, b):
    """Common words that two lines of these sizes need."""
    return -(-UP * (a + b) // (UP + DOWN))


def level_of(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of a byte: 0 for none, 1 for one, eight steps a doubling."""
    scale = np.floor(8 * np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    return np.where(count > 0, np.minimum(scale, 255), 0).astype(np.uint8)


# ---------------------------------------------------------------- lines as arrays


class Lines(NamedTuple):
    """Some lines with a word: their text's place in the batch, number, and the words of line k from ``begins[k]`` on.

    ``code`` has a number for every word of a line, once; ``hashes`` two hashes for every number.
    """

    doc: np.ndarray
    number: np.ndarray
    begins: np.ndarray
    code: np.ndarray
    hashes: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(np.append(self.begins, len(self.code)))

    def classes(self) -> np.ndarray:
        """Two sums of hashes a line, which stand for its set of words."""
        return np.stack([np.add.reduceat(self.hashes[self.code, k], self.begins) for k in (0, 1)], 1)

    def take(self, lines: np.ndarray) -> Lines:
        """Some of the lines, in order."""
        size = self.size[lines]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[lines] - ends + size, size)
        return Lines(self.doc[lines], self.number[lines], ends - size, self.code[at], self.hashes)

    def ranked(self, levels: np.ndarray) -> np.ndarray:
        """The words' codes, within each line from rare to frequent."""
        name = names_of(self.hashes[:, 0])
        rank = levels[name >> np.uint32(32 - bits_of(levels))].astype(np.uint64) << np.uint64(32) | name
        line = np.repeat(np.arange(len(self.begins), dtype=np.uint64), self.size)
        return self.code[np.argsort(line << np.uint64(40) | rank[self.code], kind="stable")]


def bits_of(levels: np.ndarray) -> int:
    """Bits of a slot's number."""
    return len(levels).bit_length() - 1


def names_of(h: np.ndarray) -> np.ndarray:
    """The 32 bits of words that name their buckets."""
    return (h >> np.uint64(32)).astype(np.uint32)


def pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of values of these lengths, each of ``SLICE`` bytes and ``SLICE_LINES`` values or a single one."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + SLICE, "right"))), at + SLICE_LINES)
        yield at, to
        at = to


def lines_of(texts: pa.Array) -> Iterator[Lines]:
    """The lines of texts, split at line feeds and, into words, at ASCII white space."""
    for a, b in pieces(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
        split = pc.split_pattern(texts.slice(a, b - a), "\n")
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        flat = split.flatten()
        doc = np.repeat(np.arange(a, b), count)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        for c, d in pieces(pc.binary_length(flat).to_numpy(zero_copy_only=False)):
            words = pc.ascii_split_whitespace(flat.slice(c, d - c))
            coded = words.flatten().dictionary_encode()
            line = np.repeat(np.arange(c, d), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            some = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[coded.indices.to_numpy()]
            key = (line.astype(np.int64) << 32 | coded.indices.to_numpy())[some]
            if not len(key):
                continue
            key.sort()
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            line, code = key >> 32, key & 0xFFFFFFFF
            begins = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            digest = xxhash.xxh3_128_digest
            vocabulary = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            hashes = np.frombuffer(b"".join([digest(w) for w in vocabulary]), "<u8").reshape(-1, 2)
            yield Lines(doc[line[begins]], number[line[begins]], begins, code, hashes)


# ---------------------------------------------------------------- classes and counts


_LINES = "id long, row long, hash long, line_no int, id_low long, id_high long, size int, parity long"


def line_table(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """A row per line with a word (id, row, hash, line_no, id_low, id_high, size, parity), and the names' counts (block, n, counts).

    ``row`` numbers the rows of ``docs`` and ``hash`` is its text's.  Both tables are written once.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]

        def added_up() -> tuple[np.ndarray, np.ndarray]:
            name, n = (np.concatenate(x) for x in zip(*counted))
            order = np.argsort(name, kind="stable")
            name, n = name[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, int)
            return name[first], np.add.reduceat(n, first) if len(first) else n

        def handed_on() -> pa.RecordBatch:
            name, n = added_up()
            cuts = np.flatnonzero(np.diff(name >> np.uint32(NAME_BLOCK), prepend=np.uint32(2**32 - 1))) if len(name) else []
            parts = [(x, np.minimum(y, 2**32 - 1)) for x, y in zip(np.split(name, cuts)[1:], np.split(n, cuts)[1:])]
            blobs = [packed([np.diff(x, prepend=x[:1]), y]) for x, y in parts]
            columns = [pa.nulls(len(parts), t) for t in (pa.int64(),) * 3 + (pa.int32(),) + (pa.int64(),) * 2 + (pa.int32(), pa.int64())]
            columns += [pa.array([int(x[0]) >> NAME_BLOCK for x, _ in parts], pa.int32()), pa.array([int(x[0]) for x, _ in parts], pa.int64())]
            columns += [pa.array([len(x) for x, _ in parts], pa.int64()), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        total = 0
        for batch in batches:
            ids, rows, hashes = (batch.column(k).to_numpy() for k in range(3))
            for some in lines_of(batch.column(3)):
                n = np.bincount(some.code, minlength=len(some.hashes))
                used = n > 0
                counted.append((names_of(some.hashes[used, 0]), n[used]))
                total += int(used.sum())
                if total > COUNTED:
                    counted = [added_up()]
                    total = len(counted[0][0])
                    if 2 * total > COUNTED:
                        yield handed_on()
                        counted, total = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], 0
                low, high = some.classes().view(np.int64).T.copy()
                parity = np.bitwise_xor.reduceat(np.uint64(1) << (some.hashes[some.code, 0] & np.uint64(63)), some.begins)
                k = len(low)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[some.doc]), pa.array(rows[some.doc]), pa.array(hashes[some.doc]), pa.array(some.number.astype(np.int32)),
                        pa.array(low), pa.array(high), pa.array(some.size.astype(np.int32)), pa.array(parity.view(np.int64)),
                        pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
                    ],
                    names,
                )
        yield handed_on()

    names = [x.split()[0] for x in _LINES.split(", ")] + ["block", "first_name", "n", "counts"]
    text = text_of("text")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.monotonically_increasing_id(), F.xxhash64(text), text)
    path = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows.mapInArrow(run, f"{_LINES}, block int, first_name long, n long, counts binary").write.parquet(path)
    both = spark.read.parquet(path)
    return both.where("block IS NULL").drop("block", "first_name", "n", "counts"), both.where("block IS NOT NULL").select("block", "first_name", "n", "counts")


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 32-bit numbers as compressed bytes."""
    return pa.compress(np.concatenate([x.astype(np.uint32) for x in arrays]).tobytes(), "zstd", asbytes=True)


def word_levels(counts: DataFrame) -> np.ndarray:
    """How frequent the words of each slot are (``level_of`` lines): an array of fixed size, at most 2**MOST_BITS bytes."""
    n = counts.agg(F.sum("n")).first()[0] or 1  # at least the number of names, as tasks count apart
    bits = min(max(LEAST_BITS, math.ceil(math.log2(n))), MOST_BITS)
    shift, block_bits = 32 - bits, NAME_BLOCK - (32 - bits)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([known], pa.int32()), pa.array([level_of(table).tobytes()], pa.binary())], ["block", "levels"])

        for batch in batches:
            for block, first, n, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if block != known:
                    if known is not None:
                        yield done()
                    known, table = block, np.zeros(1 << block_bits, np.int64)
                both = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), np.uint32)
                name = np.uint32(first) + np.cumsum(both[:n], dtype=np.uint32)
                table += np.bincount(name >> np.uint32(shift) & np.uint32((1 << block_bits) - 1), both[n:], 1 << block_bits).astype(np.int64)
        if known is not None:
            yield done()

    out = np.zeros((1 << (32 - NAME_BLOCK), 1 << block_bits), np.uint8)
    for r in counts.repartition("block").sortWithinPartitions("block").mapInArrow(fold, "block int, levels binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.levels, np.uint8)
    return out.ravel()


# ---------------------------------------------------------------- buckets


def width_of(size: np.ndarray) -> np.ndarray:
    """64-bit words of a line's bitmap."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(size / NARROW, 1))).astype(np.int64), WIDEST)


def bitmaps(h: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bitmaps of lines, one after another: bits are parities of the words that hash to them, so
    the bits in which two lines differ never exceed the words in which they do."""
    width = width_of(size)
    start = np.cumsum(width) - width
    wide, at = np.repeat(width, size), np.repeat(start, size)
    out = np.zeros(width.sum(), np.uint64)
    np.bitwise_xor.at(out, at + ((h >> np.uint64(6)).astype(np.int64) & (wide - 1)), np.uint64(1) << (h & np.uint64(63)))
    return out


def prefixes(docs: DataFrame, levels, parts: int) -> DataFrame:
    """(part, often, n, raw, data): the rows of buckets, ``n`` in a blob; those of names that may be too frequent apart.

    A row of a bucket has the name, 32 bits of the class's id, the name before, the line's size, the
    name's place in it, and the line's bitmap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        held, total, table = [], 0, levels.value
        frequent = level_of(np.array([BLOCK]))[0]
        shift = np.uint32(32 - bits_of(table))

        def handed_on() -> pa.RecordBatch:
            name, tag, prev, size, place, often = (np.concatenate(x) for x in zip(*(x[:6] for x in held)))
            flat = np.concatenate([x[6] for x in held])
            start = np.concatenate([x[7] + b for x, b in zip(held, np.cumsum([0] + [len(x[6]) for x in held]))])
            part = np.where(often, tag.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF), name).astype(np.uint64) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort((part << np.uint64(33) | often.astype(np.uint64) << np.uint64(32) | name), kind="stable")
            key = (part[order] << np.uint64(1) | often[order]).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                o = order[a:b]
                w = width_of(size[o])
                at = np.repeat(start[o] - np.cumsum(w) + w, w) + np.arange(w.sum())
                raw = np.concatenate([np.diff(name[o], prepend=np.uint32(0)), tag[o], prev[o], size[o], place[o], flat[at].view(np.uint32)]).astype(np.uint32).tobytes()
                rows.append((int(key[a]) >> 1, bool(key[a] & 1), int(b - a), len(raw), pa.compress(raw, "zstd", asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))], ["part", "often", "n", "raw", "data"])

        for batch in batches:
            for some in lines_of(batch.column(0)):
                cls = some.classes()
                keys = [c.tobytes() for c in cls]
                if len(known) > CACHE:
                    known.clear()
                new = np.array([not (c in known or known.add(c)) for c in keys])
                if not new.any():
                    continue
                some = some.take(np.flatnonzero(new))
                h = some.hashes[some.ranked(table), 0]
                size = some.size
                first = prefix_length(size)
                line = np.repeat(np.arange(len(size)), first)
                place = np.arange(len(line)) - (np.cumsum(first) - first)[line]
                at = some.begins[line] + place
                name = names_of(h)
                prev, name = np.where(place > 0, name[np.maximum(at - 1, 0)], np.uint32(0)), name[at]
                level = table[name >> shift]
                # A name counted once is in no other line; one that a line has twice is taken once.
                own = np.flatnonzero((level > 1) & ((place == 0) | (prev != name)))
                flat = bitmaps(h, some.begins, size)
                width = width_of(size)
                start = (np.cumsum(width) - width)[line[own]]
                tag = cls[new, 0].astype(np.uint32)[line[own]]
                held.append((name[own], tag, prev[own], size[line[own]].astype(np.uint32), place[own].astype(np.uint32), level[own] > frequent, flat, start))
                total += len(own)
                if total > GATHERED:
                    yield handed_on()
                    held, total = [], 0
        if total:
            yield handed_on()

    return docs.select(text_of("text")).mapInArrow(run, "part int, often boolean, n long, raw long, data binary")


class Bucketed(NamedTuple):
    """Rows of buckets as arrays; ``start`` says where in ``flat`` a row's bitmap begins."""

    name: np.ndarray
    tag: np.ndarray
    prev: np.ndarray
    size: np.ndarray
    place: np.ndarray
    start: np.ndarray
    flat: np.ndarray

    @classmethod
    def unpacked(cls, blobs: list[tuple[int, int, bytes]]) -> Bucketed:
        columns, flats, base = [], [], 0
        for n, raw, data in blobs:
            words = np.frombuffer(pa.decompress(data, raw, "zstd"), np.uint32)
            name, tag, prev, size, place = words[: 5 * n].reshape(5, n)
            width = width_of(size)
            columns.append((np.cumsum(name, dtype=np.uint32), tag, prev, size.astype(np.int64), place.astype(np.int64), np.cumsum(width) - width + base))
            flats.append(words[5 * n :].copy().view(np.uint64))
            base += len(flats[-1])
        return cls(*(np.concatenate(x) for x in zip(*columns)), np.concatenate(flats))

    def take(self, rows: np.ndarray) -> Bucketed:
        return Bucketed(*(x[rows] for x in self[:6]), self.flat)

    def parity(self) -> np.ndarray:
        """The bitmaps, folded to 64 bits."""
        width = width_of(self.size)
        out = self.flat[self.start]
        for w in np.unique(width[width > 1]).tolist():
            rows = np.flatnonzero(width == w)
            out[rows] = np.bitwise_xor.reduce(self.flat[self.start[rows, None] + np.arange(w)], 1)
        return out


def near_pairs(rows: Bucketed, group: np.ndarray, parity: np.ndarray, block: np.ndarray | None = None, one: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of a group that the length, position and bitmap filters let through, some at a time.

    Rows are sorted by group and size.  With ``block``, only pairs of different blocks, or where there is ``one``.
    """
    size, place, prev = rows.size, rows.place, rows.prev
    key = group.astype(np.int64) << 32
    last = np.searchsorted(key + size, key + size * DOWN // UP, "right")
    row = np.arange(len(size))
    more = last - row - 1
    begin, total = 0, np.concatenate(([0], np.cumsum(more)))
    while begin < len(row):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, "right")) - 1)
        n = more[begin:end]
        i = np.repeat(row[begin:end], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        begin = end
        x, y = size[i], size[j]
        need = least_overlap(x, y)
        apart = x + y - 2 * need  # words that may differ
        fine = np.bitwise_count(parity[i] ^ parity[j]) <= apart
        i, j, x, y, need, apart = (v[fine] for v in (i, j, x, y, need, apart))
        a, b = place[i], place[j]
        fine = (np.minimum(x - a, y - b) >= need) & (a + b <= apart) & ~((a > 0) & (b > 0) & (prev[i] == prev[j]))
        if block is not None:
            fine &= one[i] | (block[i] != block[j])
        i, j, apart = i[fine], j[fine], apart[fine]
        if len(rows.flat):
            fine = wide_apart(rows, i, j) <= apart
            i, j = i[fine], j[fine]
        yield i, j


def wide_apart(rows: Bucketed, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of rows differ, the wider one folded."""
    a, b = width_of(rows.size[i]), width_of(rows.size[j])
    out = np.zeros(len(i), np.int64)
    for wa, wb in set(zip(a.tolist(), b.tolist())):
        if min(wa, wb) == 1:
            continue
        at = np.flatnonzero((a == wa) & (b == wb))
        w = min(wa, wb)
        fold = lambda k, full: np.bitwise_xor.reduce(rows.flat[rows.start[k, None] + np.arange(full)].reshape(len(k), full // w, w), 1)  # noqa: E731, B023
        for cut in np.array_split(at, 1 + len(at) // 100_000):
            out[cut] = np.bitwise_count(fold(i[cut], wa) ^ fold(j[cut], wb)).sum(1)
    return out


def without_twins(rows: Bucketed, keys: tuple[np.ndarray, ...]) -> tuple[Bucketed, tuple[np.ndarray, ...]]:
    """Rows sorted by ``keys`` and size, repeated ones once."""
    parity = rows.parity()
    order = np.lexsort((parity, rows.prev, rows.place, rows.tag, rows.size, *reversed(keys)))
    rows, keys, parity = rows.take(order), tuple(k[order] for k in keys), parity[order]
    same = np.ones(len(order), bool)
    for x in (*keys, rows.size, rows.tag, rows.place, rows.prev, parity):
        same[1:] &= x[1:] == x[:-1]
    same[:1] = False
    return rows.take(~same), tuple(k[~same] for k in keys)


_PASSED = "bucket int, deal long, second int, parity long, id_part int, size int"


def found_in(rows: Bucketed, deal: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """The rows that pass the filters with another row of their bucket and deal."""
    rows, (name, deal, second) = without_twins(rows, (rows.name, deal, second))
    order = np.lexsort((rows.size, deal, name))
    rows, name, deal, second = rows.take(order), name[order], deal[order], second[order]
    group = np.cumsum(np.concatenate(([0], (name[1:] != name[:-1]) | (deal[1:] != deal[:-1]))))
    parity, keep = rows.parity(), np.zeros(len(name), bool)
    for i, j in near_pairs(rows, group, parity, second, deal >> 32 == deal & 0xFFFFFFFF):
        keep[i] = keep[j] = True
    k = np.flatnonzero(keep)
    signed = lambda x: x[k].astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(name)), pa.array(deal[k]), pa.array(second[k].astype(np.int32)), pa.array(parity[k].view(np.int64)), pa.array(signed(rows.tag)), pa.array(signed(rows.size))],
        ["bucket", "deal", "second", "parity", "id_part", "size"],
    )


def joined(blobs: DataFrame) -> DataFrame:
    """The buckets' rows that pass the filters; and, with ``data``, those of names that may be too frequent, as they came."""
    names = ["bucket", "deal", "second", "parity", "id_part", "size", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            rows = Bucketed.unpacked(held)
            zero = np.zeros(len(rows.name), np.int64)
            found = found_in(rows, zero, zero)
            return pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.binary())], names)

        def apart(n: int, raw: int, data: bytes) -> pa.RecordBatch:
            rows = Bucketed.unpacked([(n, raw, data)])
            width, signed = width_of(rows.size), lambda x: pa.array(x.astype(np.uint32).view(np.int32))
            maps = [rows.flat[a : a + w].tobytes() for a, w in zip(rows.start, width)]
            head = np.stack([rows.prev, rows.place], 1).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [signed(rows.name), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(rows.parity().view(np.int64)), signed(rows.tag), signed(rows.size), pa.array([x.tobytes() + m for x, m in zip(head, maps)], pa.binary())],
                names,
            )

        for batch in batches:
            for own, often, n, raw, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if often:
                    yield apart(n, raw, data)
                    continue
                if own != part and held:
                    yield done()
                    held = []
                part = own
                held.append((n, raw, data))
        if held:
            yield done()

    return blobs.mapInArrow(run, f"{_PASSED}, row binary")


def dealt(often: DataFrame) -> DataFrame:
    """The buckets' rows that pass the filters, of names that may be too frequent: buckets of over ``BLOCK`` classes in pairs of blocks."""
    counts = often.groupBy("bucket").agg(F.approx_count_distinct(F.struct("parity", "id_part")).alias("n"))
    large = materialize(counts.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = often
    n_large = large.limit(BROADCAST_ROWS + 1).count()
    if n_large:
        rows = rows.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("parity", "id_part"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
        rows = rows.withColumns({"deal": F.shiftleft(low, 32).bitwiseOR(high), "second": (F.col("block") > F.col("other")).cast("int")})
    else:
        rows = rows.withColumns({"second": F.lit(0), "deal": F.lit(0).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            name, tag, size = (batch.column(k).to_numpy().view(np.uint32) for k in ("bucket", "id_part", "size"))
            data = batch.column("row").to_pylist()
            prev, place = np.frombuffer(b"".join([x[:8] for x in data]), "<u4").reshape(-1, 2).T
            flat = np.frombuffer(b"".join([x[8:] for x in data]), np.uint64)
            width = width_of(size.astype(np.int64))
            rows = Bucketed(name, tag, prev, size.astype(np.int64), place.astype(np.int64), np.cumsum(width) - width, flat)
            yield found_in(rows, batch.column("deal").to_numpy(), batch.column("second").to_numpy())

    rows = rows.select("bucket", "deal", "second", "id_part", "size", "row")
    return rows.repartition("bucket", "deal").sortWithinPartitions("bucket", "deal").mapInArrow(run, _PASSED)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``bucket`` and ``deal``, so that no group is cut."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, deal = batch.column("bucket").to_numpy(), batch.column("deal").to_numpy()
        cut = int(np.flatnonzero((bucket != bucket[-1]) | (deal != deal[-1]))[-1]) + 1 if (bucket[0], deal[0]) != (bucket[-1], deal[-1]) else 0
        if cut or rest and (rest[0].column("bucket")[0].as_py(), rest[0].column("deal")[0].as_py()) != (bucket[0], deal[0]):
            rest.append(batch.slice(0, cut))
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


# ---------------------------------------------------------------- words


def class_words(docs: DataFrame, wanted, levels) -> DataFrame:
    """(id_low, id_high, words) of the classes that the bitmap ``wanted`` lets through, from rare to frequent, once a class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        bitmap, table = wanted.value, levels.value
        for batch in batches:
            for some in lines_of(batch.column(0)):
                cls = some.classes()
                there = np.flatnonzero(in_bitmap(bitmap, cls[:, 0]))
                if len(known) > CACHE:
                    known.clear()
                there = np.array([k for k in there.tolist() if not ((c := cls[k].tobytes()) in known or known.add(c))], np.int64)
                if not len(there):
                    continue
                some, cls = some.take(there), cls[there].view(np.int64)
                h = some.hashes[some.ranked(table), 0].view(np.int64)
                words = pa.ListArray.from_arrays(pa.array(np.append(some.begins, len(h)), pa.int32()), pa.array(h))
                yield pa.RecordBatch.from_arrays([pa.array(cls[:, 0].copy()), pa.array(cls[:, 1].copy()), words], ["id_low", "id_high", "words"])

    return docs.select(text_of("text")).mapInArrow(run, "id_low long, id_high long, words array<long>")


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets' rows with the words: per class, links and earliest linked place."""
    for batch in whole_groups(batches):
        words = batch.column("words")
        ends = words.offsets.to_numpy()
        h = words.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]]
        begins, size = (ends - ends[0])[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
        row, name = np.repeat(np.arange(len(size)), size), names_of(h)
        bucket, deal = batch.column("bucket").to_numpy().view(np.uint32), batch.column("deal").to_numpy()
        at = np.flatnonzero(name == bucket[row])
        found = row[at]
        place = np.full(len(size), np.int64(1) << 40)  # not in this bucket: passes no filter
        np.minimum.at(place, found, at - begins[found])
        prev = name[np.where(place < size, np.maximum(begins + place - 1, 0), 0)]
        rows = Bucketed(bucket, bucket, prev, size, place, begins, np.zeros(0, np.uint64))
        group = np.cumsum(np.concatenate(([0], (bucket[1:] != bucket[:-1]) | (deal[1:] != deal[:-1]))))
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), begins)
        places = list(zip(*(batch.column(k).to_pylist() for k in ("first_id", "first_row", "first_no"))))
        sets: dict[int, tuple[set[int], set[int]]] = {}
        links, best = np.zeros(len(size), np.int64), [None] * len(size)

        def own(k: int) -> tuple[set[int], set[int]]:
            """All words of a row, and the names before the bucket's."""
            if k not in sets:
                sets[k] = set(h[begins[k] : begins[k] + size[k]].tolist()), set(name[begins[k] : begins[k] + place[k]].tolist())  # noqa: B023
            return sets[k]

        for i, j in near_pairs(rows, group, parity, batch.column("second").to_numpy(), deal >> 32 == deal & 0xFFFFFFFF):
            for x, y in zip(i.tolist(), j.tolist()):
                (mine, my_names), (other, its_names) = own(x), own(y)
                if not my_names.isdisjoint(its_names):
                    continue  # counted in another bucket
                if len(mine & other) < least_overlap(len(mine), len(other)):
                    continue
                for k, o in ((x, y), (y, x)):
                    links[k] += 1
                    if best[k] is None or places[o] < best[k]:
                        best[k] = places[o]
        some = np.flatnonzero(links)
        first = [pa.array([best[k][c] for k in some], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id_low").take(pa.array(some)), batch.column("id_high").take(pa.array(some)), pa.array(links[some], pa.int64()), *first],
            ["id_low", "id_high", "n_links", "match_id", "match_row", "match_no"],
        )


# ---------------------------------------------------------------- the operator


_CLASS = ("id_low", "id_high")


def line_classes(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The lines of ``docs`` (id, row, hash, line_no, id_low, id_high) and their classes (id_low, id_high, first, n_links, match).

    ``first`` and ``match`` are places (id, row, line_no): of the class's first line and of the first
    line of the classes it links to.
    """
    require(docs, id_col, "text")
    spark = docs.sparkSession
    lines, counts = line_table(docs, id_col)
    levels = spark.sparkContext.broadcast(word_levels(counts))  # a byte a slot
    rows = lines.agg(F.sum(F.col("size") - F.ceil(F.col("size") * UP / DOWN) + 1)).first()[0] or 0
    parts = min(max(1, int(rows) // PART), MOST_PARTS)
    blobs = prefixes(docs, levels, parts).repartition("part").sortWithinPartitions("part", "often")
    passed = materialize(joined(blobs))
    often = passed.where("row IS NOT NULL")
    passed = passed.where("row IS NULL").drop("row")
    if not often.isEmpty():
        passed = materialize(passed.unionByName(dealt(often)))
    place = F.struct("id", "row", "line_no")
    first = materialize(lines.groupBy(*_CLASS, "size", "parity").agg(F.min(place).alias("first")))
    # Classes that these columns don't tell apart all come along; what wasn't in the bucket is told by its words.
    asked = first.withColumn("id_part", F.shiftright(F.shiftleft("id_low", 32), 32).cast("int")).join(passed, ["parity", "size", "id_part"])
    asked = materialize(
        asked.select(*_CLASS, "bucket", "deal", "second", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.line_no").alias("first_no"))
    )
    wanted = spark.sparkContext.broadcast(bitmap_of(asked.select("id_low").distinct()))
    words = class_words(docs, wanted, levels).dropDuplicates(_CLASS)
    ready = words.join(asked, [*_CLASS]).withColumn("size", F.size("words"))
    found = (
        ready.repartition("bucket", "deal").sortWithinPartitions("bucket", "deal", "size")
        .mapInArrow(verify, "id_low long, id_high long, n_links long, match_id long, match_row long, match_no int")
        .groupBy(*_CLASS)
        .agg(F.sum("n_links").alias("n_links"), F.min(F.struct(F.col("match_id").alias("id"), F.col("match_row").alias("row"), F.col("match_no").alias("line_no"))).alias("match"))
    )
    classes = first.select(*_CLASS, "first").join(materialize(found), [*_CLASS], "left")
    # Written, so that a join with the lines is a plain one, in which a class of many lines is split.
    return lines, materialize(classes.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")))


def judged(docs: DataFrame, id_col: str) -> DataFrame:
    """The lines with their class's columns and ``removed``."""
    lines, classes = line_classes(docs, id_col)
    place = F.struct("id", "row", "line_no")
    removed = (F.col("first") < place) | F.coalesce(F.col("match") < place, F.lit(False))
    return lines.drop("size", "parity").join(classes, [*_CLASS]).withColumn("removed", removed)


def line_matches(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per line with a word: doc_id, line_no, its class's first line (class_doc_id,
    class_line_no), n_links (other classes at Jaccard 4/5 or more), removed.

    Lines are split at line feeds and numbered from 0; words are runs of anything but ASCII white
    space, compared as they are.  Lines go by doc_id (a whole number), null ids last, then by row
    where rows share an id, then by line number.  A line is removed if any earlier line, kept or not,
    is as similar, one of the same words included; so of repeated rows one keeps its lines, and rows of one id
    and different texts are judged apart.  Null and empty texts have no lines.  An empty table gives
    no rows.
    """
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return judged(docs, id_col).select(
        known("id").alias("doc_id"), "line_no", known("first.id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "n_links", "removed"
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that ``line_matches`` removes taken out of ``text``; rows and other columns stay.

    Lines without a word stay.  Each row loses its own lines, whatever ids repeat or are null; of rows
    that repeat an id and a text one keeps the lines that aren't removed elsewhere.  Null texts stay
    null, an empty table gives no rows.
    """
    lines = materialize(judged(docs, id_col).select("id", "row", "hash", "line_no", "removed"))
    by_text = lines.groupBy("id", "hash").agg(F.min("row").alias("row"), (F.min("row") != F.max("row")).alias("copies"))
    own = lines.where("removed").groupBy("id", "hash", "row").agg(F.collect_set("line_no").alias("gone"))  # bounded by a text's lines
    fates = by_text.join(own, ["id", "hash", "row"], "left").where("copies OR gone IS NOT NULL")
    fates = fates.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "copies", "gone")
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_of("text")).alias("_hash"))
    rows = rows.join(fates, ["_id", "_hash"], "left")
    split = F.split("doc.text", "\n")
    left = lambda keep: F.array_join(F.filter(split, keep), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left(lambda x, k: ~F.array_contains("gone", k)))

    def whole(rows: DataFrame, text) -> DataFrame:
        return rows.select(*[text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])

    single = whole(rows.where("copies IS NULL OR NOT copies"), text)
    if by_text.where("copies").isEmpty():
        return single
    twins = firsts(rows.where("copies"), "_id", "_hash")
    blank = left(lambda x, k: ~x.rlike(rf"[^{SPACE[1:]}"))
    return single.unionByName(whole(twins, F.when(F.col("first_of_key"), text).otherwise(blank)))
