"""Periodic runs of words, by way of the longest-previous-factor array.

A run is a stretch of words that repeats with a smallest period and that no neighbour extends.  The
documents of a batch are laid end to end, each closed by a word of its own, and no word of one counts
as equal to a word of another.  Prefix doubling gives the suffix array, and its ranks by level answer
longest-common-extension queries both ways.  The nearest smaller neighbours in suffix order give, for
every position, the longest factor that begins earlier too; taken greedily they cut a document into
blocks.  Every run touches a boundary of blocks, where Main's extensions find it, or lies inside a
block: those are copied from where the block occurred before, by buckets of starts.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, require, text_of

#: Words of a batch of documents, and pairs of a boundary and a period looked at, at once.
BATCH_WORDS, BATCH_PAIRS = 1 << 19, 1 << 20

Run = tuple[int, int, int]


def suffix_order(symbols: np.ndarray, most: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks by level, the order of the suffixes, and the positions not told apart yet.

    Two positions have the same rank at level k if the same 2**k symbols begin there.  The levels end
    when all positions differ, or at ``most``.  The last symbol must be the only one of its kind.
    """
    order = np.argsort(symbols, kind="stable")
    n, rank, levels = len(order), np.empty(len(order), np.int64), []
    slots, at, key = np.arange(n), order, symbols[order]
    while True:
        opens = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(opens, len(key)))
        order[slots], rank[at] = at, np.repeat(slots[opens], size)
        together = np.repeat(size > 1, size)
        slots, at = slots[together], at[together]
        if not len(slots) or len(levels) == most:
            return levels, order, at
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        key = rank[at] * n + rank[at + (1 << len(levels) - 1)]
        by_key = np.argsort(key, kind="stable")
        at, key = at[by_key], key[by_key]


def common_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from ``i`` and from ``j`` on are the same; no two of a pair are one position."""
    i, j, begin = i.copy(), j.copy(), i
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - begin


def common_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols up to and with ``i`` and ``j`` are the same; -1 stands before all symbols."""
    i, j, begin = i + 1, j + 1, i + 1
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - (1 << k), j - (1 << k)
        inside = np.minimum(a, b) >= 0
        step = (inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])).astype(np.int64) << k
        i -= step
        j -= step
    return begin - i


def nearest_smaller(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Follow ``to`` from neighbour to neighbour until a smaller value; the last value is smaller than all."""
    wait = np.flatnonzero(values[to] > values[:-1])
    while len(wait):
        to[wait] = to[to[wait]]
        wait = wait[values[to[wait]] > values[wait]]
    return to


def previous_factors(levels: list[np.ndarray], order: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position, the length of the longest factor that begins earlier too, and where it does."""
    n = len(order)
    values, edge = np.append(order, -1), owner[order]
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    inner = np.flatnonzero(edge[1:] == edge[:-1])
    for one, other in ((inner + 1, inner), (inner, inner + 1)):
        to = np.full(n, n)
        to[one] = other
        to = nearest_smaller(values, to)
        some = np.flatnonzero(to < n)
        here, there = order[some], order[to[some]]
        found = common_after(levels, here, there)
        longer = found > length[here]
        length[here[longer]], source[here[longer]] = found[longer], there[longer]
    return length, source


def blocks_of(length: np.ndarray) -> np.ndarray:
    """Where the blocks begin: each is the longest previous factor at its place, or one new symbol."""
    steps, begins, at = np.maximum(length, 1).tolist(), [], 0
    while at < len(steps):
        begins.append(at)
        at += steps[at]
    return np.array(begins, np.int64)


def at_boundaries(levels: list[np.ndarray], begins: np.ndarray, sizes: np.ndarray, owner: np.ndarray, first: np.ndarray, min_length: int, exponent: int) -> Iterator[np.ndarray]:
    """(start, end, period) of runs that touch a boundary of blocks, by Main's extensions to both sides.

    With the right part as long as the period, the period is at most the block; with the left part,
    at most the block and the one before, which would else have been a longer factor.
    """
    inside = np.flatnonzero(begins > first[owner[begins]])
    at, own, before = begins[inside], sizes[inside], sizes[inside - 1]
    closes = np.append(owner[1:] != owner[:-1], True)[at]  # the document's closing symbol has nothing to its right
    most = np.concatenate((np.where(closes, 0, own), np.minimum(at - first[owner[at]], own + before)))
    at, ends = np.concatenate((at, at)), np.cumsum(most)
    symbols = levels[0]
    for low in range(0, int(ends[-1]) if len(ends) else 0, BATCH_PAIRS):
        flat = np.arange(low, min(low + BATCH_PAIRS, int(ends[-1])))
        h = np.searchsorted(ends, flat, "right")
        p, a = flat - (ends[h] - most[h]) + 1, at[h]
        a = np.where(h >= len(inside), a - p, a)  # the left case is the right one, a period earlier
        near = (symbols[a] == symbols[a + p]) | ((a > 0) & (symbols[a - 1] == symbols[a + p - 1]))
        p, a = p[near], a[near]
        left, right = common_before(levels, a - 1, a + p - 1), common_after(levels, a, a + p)
        whole = left + p + right
        keep = whole >= np.maximum(min_length, exponent * p)
        yield np.stack((a - left, a + p + right - 1, p), 1)[keep]


def copied(runs: dict[int, dict[int, int]], begins: np.ndarray, sizes: np.ndarray, source: np.ndarray, min_length: int) -> None:
    """Add the runs inside blocks: those inside the block's earlier occurrence, bucketed by start, in order of blocks."""
    starts = sorted(runs)
    for h in np.flatnonzero(sizes >= min_length + 2).tolist():
        a, end = int(begins[h]), int(source[begins[h]] + sizes[h] - 1)
        move = a - int(source[a])
        k = bisect_right(starts, a - move)
        while k < len(starts) and starts[k] < end:
            s = starts[k]
            here = {e + move: p for e, p in runs[s].items() if e < end}
            if here:
                if s + move not in runs:
                    insort(starts, s + move)
                runs[s + move].update(here)
            k += 1


def runs_of(symbols: np.ndarray, owner: np.ndarray, count: int, min_length: int = 24, exponent: int = 3) -> list[list[Run]]:
    """(start, length, period) of the runs of each of ``count`` documents laid end to end, by start, then period.

    ``owner`` is the document of each symbol; a document's symbols are its alone and rise with the
    documents, and the last one closes it.  A run of some length repeats all of it but a period, so
    documents where no factor of that length repeats end with the first levels of the suffix order.
    """
    out: list[list[Run]] = [[] for _ in range(count)]
    repeats = -(-min_length * (exponent - 1) // exponent)
    _, _, unclear = suffix_order(symbols, repeats.bit_length() - 1)
    some = np.unique(owner[unclear])
    if not len(some):
        return out
    keep = np.isin(owner, some)
    symbols, owner = symbols[keep], np.searchsorted(some, owner[keep])
    levels, order, _ = suffix_order(symbols)
    length, source = previous_factors(levels, order, owner)
    begins = blocks_of(length)
    sizes, first = np.diff(np.append(begins, len(symbols))), np.searchsorted(owner, np.arange(len(some)))
    found: dict[int, dict[int, int]] = defaultdict(dict)
    for part in at_boundaries(levels, begins, sizes, owner, first, min_length, exponent):
        for s, e, p in part.tolist():  # a multiple of the period covers the same stretch: the smallest counts
            found[s][e] = min(p, found[s].get(e, p))
    copied(found, begins, sizes, source, min_length)
    for s in sorted(found):
        d = int(owner[s])
        out[some[d]] += sorted(((s - int(first[d]), e - s + 1, p) for e, p in found[s].items()), key=lambda r: r[2])
    return out


def greatest(runs: list[Run]) -> Run | None:
    """The run of greatest length over period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that stay when each run keeps only its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g])


def judged(texts: list[list[bytes]], min_length: int, exponent: int) -> list[list[Run]]:
    """The runs of each of some documents, given as words."""
    sizes = np.array([len(t) + 1 for t in texts])
    codes = pa.array([w for t in texts for w in (*t, b"")], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    closing = np.cumsum(sizes) - 1
    codes[closing] = most = len(codes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return runs_of(owner * (most + 1) + codes, owner, len(texts), min_length, exponent)


def find_runs(docs: DataFrame, min_length: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row: its runs of words, the one that repeats most, and its text without repetition.

    A run has at least ``min_length`` words and ``exponent`` periods (2 or more); ``runs`` are structs
    of start (word number from 0), length and period.  In ``collapsed`` every run keeps its first
    period only; words are joined by one space.  Null and empty texts have no words and no runs, null
    ids and repeated rows are rows like any other, an empty table gives no rows.

    One pass where texts lie.  A batch has some hundred thousand words, or one longer document, whose
    ranks take 4 bytes a word and level, with as many levels as its longest repeat has bits.
    """
    require(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = judged(texts, min_length, exponent)
        as_row = lambda r: r and dict(zip(("start", "length", "period"), r))
        columns = [
            ids, pa.array(map(len, texts), pa.int64()), pa.array([list(map(as_row, r)) for r in found], kind),
            pa.array([as_row(greatest(r)) for r in found], kind.value_type), pa.array([collapse(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "best", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, low = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_buffer().to_pybytes().split() if text.is_valid else [])
                words += len(texts[-1])
                if words >= BATCH_WORDS or k == len(batch) - 1:
                    yield rows(batch.column(0).slice(low, len(texts)), texts)
                    texts, words, low = [], 0, k + 1

    run_type = "struct<start: long, length: long, period: long>"
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, runs array<{run_type}>, best {run_type}, collapsed string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the documents, told by the CRC-32 of their decimal id, repeat a stretch of theirs to the end.

    With g a tenth of the hash, the stretch begins at word g % n and has 1 + (n - g % n) / (3 + g % 8)
    words.  Texts of null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    trimmed, n, start, period = F.btrim(text_of("text"), F.lit(SPACES)), F.size("words"), F.col("start"), F.col("period")
    rows = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & (trimmed != ""), F.split(trimmed, f"{SPACE}+")))
    rows = rows.withColumn("start", (F.col("g") % n).cast("int"))
    rows = rows.withColumn("period", F.floor(1 + (n - start) / (3 + F.col("g") % 8)).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", start + 1, period), F.ceil((n - start) / period).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), start), again), F.lit(1), n), " ")
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
