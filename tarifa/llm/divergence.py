"""How the sources of a language differ in what words they use, in exact integers.

Terms are counted in the tasks that read the texts.  A group (language and source) gives each kept
term a smoothed share in billionths.  Two groups' distance sums over all kept terms, but most of them
occur in neither: those, and the terms of one group alone, are a closed form of the groups' baseline
shares (the share of a term that doesn't occur), and only terms of both are corrected, pair by pair of
what a term's row holds.  The first terms of each group are found by radix selection: histograms over
the bits of the values, each only of the bin that holds the wanted rank, then over the bytes of ties.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, require, text_of

#: Parts of a whole share, what is added to each count, documents of a language a term needs, terms listed.
WHOLE, ADDED, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Counted terms a task keeps before it hands them on, and pairs of groups added up at once.
TASK_TERMS, TASK_PAIRS = 200_000, 1 << 20
#: Bits of a value, and of it that one histogram tells apart; bytes of a term that one histogram tells apart.
VALUE_BITS, DIGIT_BITS, DIGIT_BYTES = 30, 10, 2
#: Ties that are sorted rather than divided further.
FEW = 1024
#: Groups up to which their table is broadcast.
BROADCAST_ROWS = 50_000
#: Bytes read as what a term has: letters in lower case and all beyond ASCII; the rest divides.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; several rows a term, from tasks."""

    def flush(counts: dict, having: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            seen = having[lang, source]
            columns = [
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                pa.array(list(terms.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, having, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                terms, own = text.as_buffer().to_pybytes().translate(_LETTERS).split(), counts[lang, source]
                held -= len(own)
                own.update(terms)
                having[lang, source].update(set(terms))
                held += len(own)
                if held > TASK_TERMS:
                    yield from flush(counts, having)
                    counts, having, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from flush(counts, having)

    rows = docs.select(text_of(text_col).alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * terms)), exactly; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(terms > 0, 1 + F.call_function("div", wide(count + ADDED) * F.lit(WHOLE).cast("decimal(10,0)"), wide(total + ADDED * terms)))


def small(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def kept_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Every group with its totals and baseline share, and every kept term of every group that has it, with both shares.

    Groups: (gid, lang, source, terms, total, base); gid is a number from 0.  Terms: (gid, lang, term,
    p, q, base); all counts are exact sums over all documents.
    """
    counts = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    whole = materialize(whole.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    each = whole.select("lang", "term", "lang_n", F.inline("by"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(groups.withColumns({"nth": number, "base": share(F.lit(0), F.col("total"), F.col("terms"))}))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("size"))
    before = sizes.select("lang", (F.coalesce(F.sum("size").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    groups = materialize(groups.join(before, "lang").withColumn("gid", F.col("before") + F.col("nth")).drop("before", "nth"))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = each.join(small(groups), ["lang", "source"]).select("gid", "lang", "term", p.alias("p"), q.alias("q"), "base")
    return groups.select("gid", "lang", "source", "terms", "total", "base"), materialize(terms)


def corrections(terms: DataFrame) -> DataFrame:
    """(a, b, x), a < b: over the terms that both groups have, what |p - q| is beyond the parts of each group alone."""

    def pairs(gid: np.ndarray, p: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs within each row of matrices of the same width, in pieces; rows are by rising gid."""
        n, width = gid.shape
        many = max(1, TASK_PAIRS // width)
        for low in range(0, width - 1, max(1, many // n)):
            high = min(low + max(1, many // n), width - 1)
            for top in range(0, n, many):
                one, two = (slice(top, top + many), slice(low, high), None), (slice(top, top + many), None, slice(low + 1, None))
                upper = np.arange(low, high)[:, None] < np.arange(low + 1, width)[None, :]
                x = np.abs(p[one] - p[two]) - np.abs(p[one] - base[two]) - np.abs(p[two] - base[one]) + np.abs(base[one] - base[two])
                a, b = np.broadcast_arrays(gid[one], gid[two])
                yield a[:, upper].ravel(), b[:, upper].ravel(), x[:, upper].ravel()

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, x = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((b, a))
        a, b, x = a[order], b[order], x[order]
        opens = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return a[opens], b[opens], np.add.reduceat(x, opens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            lists = batch.column(0)
            sizes, first = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1]
            gid, p, base = (lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            for width in np.unique(sizes[sizes > 1]).tolist():
                at = first[sizes == width][:, None] + np.arange(width)
                for part in pairs(gid[at], p[at], base[at]):
                    held.append(part)
                    rows += len(part[0])
                    if rows > 4 * TASK_PAIRS:
                        held = [added(held)]
                        rows = len(held[0][0])
                        if rows > 2 * TASK_PAIRS:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["a", "b", "x"])
                            held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in added(held)], ["a", "b", "x"])

    by_term = terms.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "base"))).alias("items"))
    found = by_term.select("items").where(F.size("items") > 1).mapInArrow(run, "a long, b long, x long")
    return found.groupBy("a", "b").agg(F.sum("x").alias("x"))


def distances(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(a, b, value) for every two groups of a language, in both orders: the sum of |p - q| over all kept terms.

    That is terms * |base - base'|, plus for each side the sum over its own terms of
    |p - base'| - |base - base'|, plus the corrections of common terms.  A side's sum needs how many
    of its shares lie below the other's baseline, and their sum: a running total over its distinct
    shares and the baselines it is asked for.
    """
    g = groups.select("gid", "lang", "terms", "base")
    other = g.select(F.col("gid").alias("b"), "lang", F.col("base").alias("other"))
    both = materialize(g.withColumnRenamed("gid", "a").join(other, "lang").where("a != b").select("a", "b", "terms", "base", "other"))
    shares = terms.groupBy(F.col("gid").alias("a"), F.col("p").alias("at")).agg(F.count("*").alias("n"), (F.count("*") * F.col("p")).alias("s"))
    asked = both.select("a", F.col("other").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s")).distinct()
    upto = Window.partitionBy("a").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy("a")
    points = shares.unionByName(asked).select(
        "a", "at", F.sum("n").over(upto).alias("n_low"), F.sum("s").over(upto).alias("s_low"), F.sum("n").over(everything).alias("n_all"), F.sum("s").over(everything).alias("s_all")
    )
    points = points.distinct().withColumnRenamed("at", "other")
    gap = F.abs(F.col("base") - F.col("other"))
    own = (F.col("s_all") - F.col("n_all") * F.col("other")) + 2 * (F.col("n_low") * F.col("other") - F.col("s_low")) - F.col("n_all") * gap
    sides = both.join(points, ["a", "other"], "left").select("a", "b", (F.col("terms") * gap).alias("plain"), F.coalesce(own, F.lit(0)).alias("own"))
    one = sides.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("plain")).otherwise(0).alias("plain"), "own")
    one = one.select("a", "b", (F.coalesce("plain", F.lit(0)) + F.col("own")).alias("x")).unionByName(corrections(terms))
    once = one.groupBy("a", "b").agg(F.sum("x").alias("value"))
    return once.select(F.inline(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))))


def first_rows(rows: DataFrame, k: int = TOP) -> DataFrame:
    """The first ``k`` rows of every gid by value descending, then item by UTF-8 bytes, with ``rank`` from 1.

    ``rows``, a written table of (gid, item, value) with distinct items, is never sorted.  A histogram
    over the leading bits of the values tells in which bin a group's k-th value lies, and that bin
    alone is divided by the next bits, down to the value itself.  If more ties than needed have it,
    the same goes on over the bytes of their items.  What is left, k rows and few ties, is sorted.
    """
    low, reach = F.lit(0).cast("long"), rows
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.least(F.shiftright(F.col("value") - low, shift), F.lit((1 << DIGIT_BITS) - 1))
        bins = reach.groupBy("gid", digit.alias("digit"), *([] if reach is rows else ["low", "need"])).agg(F.count("*").alias("n"))
        bins = bins if reach is not rows else bins.withColumns({"low": low, "need": F.lit(k).cast("long")})
        upto = F.sum("n").over(Window.partitionBy("gid").orderBy(F.desc("digit")))
        bins = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        bound = materialize(bins.select("gid", (F.col("low") + F.shiftleft("digit", shift)).alias("low"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), "n"))
        reach = rows.join(small(bound.drop("n")), "gid").where((F.col("value") >= F.col("low")) & (F.col("value") < F.col("low") + (1 << shift)))
        low = F.col("low")
    item = F.encode("item", "UTF-8")
    bound = bound.withColumn("prefix", F.lit(b""))
    done, size = bound.where((F.col("n") == F.col("need")) | (F.col("n") <= FEW)), 0
    wait = bound.where((F.col("n") != F.col("need")) & (F.col("n") > FEW))
    while not wait.isEmpty():
        reach = rows.join(small(wait.select("gid", "low", "need", "prefix")), "gid").where((F.col("value") == F.col("low")) & (F.substring(item, 1, size) == F.col("prefix")))
        bins = reach.groupBy("gid", "low", "need", "prefix", F.substring(item, size + 1, DIGIT_BYTES).alias("digit")).agg(F.count("*").alias("n"))
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("gid").orderBy("digit")))
        bins = bins.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        left = F.col("need") - (F.col("upto") - F.col("n"))
        bound, size = materialize(bins.select("gid", "low", left.alias("need"), "n", F.concat("prefix", "digit").alias("prefix"))), size + DIGIT_BYTES
        over = (F.col("n") == F.col("need")) | (F.col("n") <= FEW)
        done, wait = done.unionByName(bound.where(over)), bound.where(~over)
    done = small(materialize(done.select("gid", "low", "prefix")))
    ahead = F.col("low").isNull() | (F.col("value") > F.col("low"))
    tied = (F.col("value") == F.col("low")) & (F.substring(item, F.lit(1), F.octet_length("prefix")) <= F.col("prefix"))
    found = rows.join(done, "gid", "left").where(ahead | tied)
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))
    return found.select("gid", "item", "value", rank.alias("rank")).where(F.col("rank") <= k)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for every group of language and source, how far it is from
    each other source of its language (part ``pair``), and the terms it has most beyond its language (part ``term``).

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased; a language keeps those of
    ``LEAST_DOCS`` of its documents.  Null text, lang and source count as empty; repeated rows count as
    often; a group without terms still is one, at distance 0 where its language keeps no term; a table
    without rows gives none.
    """
    require(docs, text_col, lang_col, source_col)
    groups, terms = kept_terms(docs, text_col, lang_col, source_col)
    names = groups.select("gid", "lang", "source")
    pairs = distances(groups, terms).join(small(names.select(F.col("gid").alias("b"), F.col("source").alias("item"))), "b").select(F.col("a").alias("gid"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("gid", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    beyond = materialize(terms.where("p > q").select("gid", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    ranked = first_rows(beyond).select("gid", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(ranked).join(small(names), "gid").select("lang", "source", "part", "item", "value", "rank")
