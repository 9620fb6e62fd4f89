"""Quality rules whose thresholds adapt to each language and source (DataFrame functions only).

Fixed rules give ``base_failed``.  Beyond them, a document fails if one of its measures lies
outside a fence set by quantiles of the same measure among the documents of its language and
source.  The quantiles come from mergeable sketches: counts by bucket, where a bucket keeps the
six leading bits of an integer, so a quantile is off by 1/32 of itself at most.  Sketches of
small groups are merged up, to the language and then to all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACES, key_of, materialize, require, text_of

#: Rows up to which the table of limits is broadcast: with keys of some tens of bytes, a few MB.  Beyond, both sides of
#: the join are written tables, so that a hot language and source is split.
BROADCAST_ROWS = 50_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Fence:
    """A measure (an integer SQL expression over the base features) and its fence.

    Above ``q3 + reach * (q3 - q1) + slack`` a document is out; with ``low``, also below
    ``q1 - reach * (q3 - q1) - slack``.  The slack keeps groups whose quartiles coincide from
    rejecting what differs a little.
    """

    name: str
    measure: str
    slack: int
    reach: int = 3
    low: bool = False


#: Symbols per 1000 word characters, hundredths of a character per word, repeated lines per 1000.
FENCES = (
    Fence("symbols", "1000 * n_symbols div word_chars", 20),
    Fence("word_length", "100 * word_chars div n_words", 150, low=True),
    Fence("dup_lines", "1000 * n_dup_lines div n_lines", 400),
)


def words_of(text: Column) -> Column:
    """The words of a non-null text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def pinned(value: Column) -> Column:
    """``value``, computed where it stands: the optimizer moves no filter across an expression that isn't
    deterministic, and a filter moved below the counts would compute them once per element."""
    return F.when(F.spark_partition_id() >= 0, value)


def base_features(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` and the counts of the fixed rules, each over the whole text (null: none).

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``; ``n_lines``: lines with a
    word; ``n_dup_lines``: of those, the ones equal to an earlier line; ``n_repeat_words``: words
    inside 5-word windows that occur twice or more in the text.  Windows are compared by a 64-bit
    hash within their text.
    """
    kept = [c.alias(f"keep{i}") for i, c in enumerate(keep)]
    names = [f"keep{i}" for i in range(len(kept))]
    text, lines = F.col("the_text"), F.col("the_lines")
    df = docs.select(*kept, text_of(text_col).alias("the_text"))
    df = df.select(
        *names,
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("h"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("the_lines"),
    )
    h, n = F.col("h"), F.size("h")
    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    df = df.select(
        *names, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).alias("windows"),
    )
    windows = F.col("windows")
    by_hash = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), by_hash))
    s = F.col("sorted")
    twin = lambda x, k: (F.get(s, k - 1)["x"] == x["x"]) | (F.get(s, k + 1)["x"] == x["x"])
    places = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.select(
        *[F.col(f"keep{i}").alias(name) for i, name in enumerate(_names(docs, keep))],
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        pinned(F.coalesce(F.when(s.isNotNull(), covered), F.lit(0)).cast("long")).alias("n_repeat_words"),
    )


def _names(docs: DataFrame, columns: list[Column]) -> list[str]:
    return docs.select(*columns).columns


def base_failed() -> Column:
    """The fixed rules: under 10 words, or over a fifth of the words repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bucket(value: Column) -> Column:
    """The bucket of an integer of 0 or more, named by its smallest member: six leading bits stay."""
    bits = F.length(F.bin(value))
    scale = F.pow(F.lit(2.0), F.greatest(bits - 6, F.lit(0))).cast("long")
    return value - value % scale


def sketches(features: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """Quantile sketches of every measure: (lang_key, source_key, measure, bucket, n)."""
    pairs = [F.struct(F.lit(f.name).alias("measure"), F.expr(f.measure).alias("value")) for f in fences]
    return (
        features.where(~F.col("base_failed"))
        .select("lang_key", "source_key", F.explode(F.array(*pairs)).alias("m"))
        .groupBy("lang_key", "source_key", F.col("m.measure").alias("measure"), bucket(F.col("m.value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches that agree on ``keys``."""
    return parts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """First and third quartile of every sketch, and the number of documents in it."""
    group = Window.partitionBy(*keys, "measure")
    below = F.sum("n").over(group.orderBy("bucket"))
    rows = sketch.withColumn("below", below).withColumn("docs", F.sum("n").over(group))
    return rows.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("below") >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("docs"), F.col("bucket"))).alias("q3"),
        F.max("docs").alias("docs"),
    )


def thresholds(sketch: DataFrame, min_docs: int, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """A row per language and source: ``low_<measure>`` and ``high_<measure>``.

    A group of fewer than ``min_docs`` documents uses its language's sketch; a language of fewer,
    the sketch of all documents.
    """
    q = ("q1", "q3", "docs")
    own = quartiles(sketch, "lang_key", "source_key")
    lang = quartiles(merge(sketch, "lang_key"), "lang_key").select("lang_key", "measure", *[F.col(c).alias(f"lang_{c}") for c in q])
    all_docs = quartiles(merge(sketch)).select("measure", *[F.col(c).alias(f"all_{c}") for c in q])
    rows = own.join(lang, ["lang_key", "measure"]).join(all_docs, "measure")
    for c in ("q1", "q3"):
        chosen = F.when(F.col("docs") >= min_docs, F.col(c)).when(F.col("lang_docs") >= min_docs, F.col(f"lang_{c}"))
        rows = rows.withColumn(f"use_{c}", chosen.otherwise(F.col(f"all_{c}")))
    spread = F.col("use_q3") - F.col("use_q1")
    out = []
    for f in fences:
        of = lambda value, f=f: F.max(F.when(F.col("measure") == f.name, value))
        out.append(of(F.col("use_q3") + f.reach * spread + f.slack).alias(f"high_{f.name}"))
        if f.low:
            out.append(of(F.col("use_q1") - f.reach * spread - f.slack).alias(f"low_{f.name}"))
    return rows.groupBy("lang_key", "source_key").agg(*out)


def outside(fences: tuple[Fence, ...]) -> Column:
    """Whether a measure of a row lies outside its limits (false where there are none)."""
    out = F.lit(False)
    for f in fences:
        value = F.expr(f"CASE WHEN n_words > 0 THEN {f.measure} END")
        out = out | F.coalesce(value > F.col(f"high_{f.name}"), F.lit(False))
        if f.low:
            out = out | F.coalesce(value < F.col(f"low_{f.name}"), F.lit(False))
    return out


def judge(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    min_docs: int = 100,
    fences: tuple[Fence, ...] = FENCES,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Measure and judge every row of ``docs``: ``keep``, the base features, ``base_failed``, ``kept``.

    Only documents that pass the fixed rules enter the sketches.  Null language and null source
    are groups of their own; null and empty texts have no words and fail the fixed rules.  Repeated
    rows are judged alike.  An empty table gives no rows.

    One pass measures the texts and writes the counts; sketches and the join read those.  The hot
    group is added up before the shuffle, and the join's rows carry no text.
    """
    require(docs, *keep, text_col, lang_col, source_col)
    columns = [F.struct(*keep).alias("kept_columns"), key_of(lang_col).alias("lang_key"), key_of(source_col).alias("source_key")]
    features = materialize(base_features(docs, columns, text_col).withColumn("base_failed", base_failed()))
    limits = materialize(thresholds(sketches(features, fences), min_docs, fences))
    small = limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = features.join(F.broadcast(limits) if small else limits, ["lang_key", "source_key"], "left")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("kept_columns.*", *counts, "base_failed", (~F.col("base_failed") & ~outside(fences)).alias("kept"))


def kept_documents(docs: DataFrame, min_docs: int = 100, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns.

    Null, empty and blank texts go; null languages and sources are groups of their own; repeated rows
    stay or go alike, whatever their ids; an empty table gives no rows.

    Two passes over the texts: one fills the sketches, one judges each row where it lies, so that
    no text is shuffled while the limits fit a broadcast; beyond that, a plain join follows.
    """
    require(docs, "text", "lang", "source")
    columns = [F.struct("*").alias("row"), key_of("lang").alias("lang_key"), key_of("source").alias("source_key")]
    rows = base_features(docs, columns).withColumn("base_failed", base_failed())
    keys = base_features(docs, columns[1:]).withColumn("base_failed", base_failed())
    limits = materialize(thresholds(materialize(sketches(keys, fences)), min_docs, fences))
    small = limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    judged = rows.join(F.broadcast(limits) if small else limits, ["lang_key", "source_key"], "left")
    return judged.where(~F.col("base_failed") & ~outside(fences)).select("row.*")
