"""A quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of the target (texts labelled
good) and one of all raw texts, give each document a log weight: how much likelier the target
model is to write it.  Adding Gumbel noise to the weights and keeping the largest sums draws
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, text_of

#: Hash buckets of the models, and the pseudo-count a bucket has on average.
BUCKETS, SMOOTHING = 10_000, 1.0
#: Labelled texts that the target model is fitted on at most (those of smallest hash of the id).
TARGET_ROWS = 100_000
#: Words whose hash a task remembers; words hashed at once.
CACHE_WORDS, CHUNK = 300_000, 1 << 18
_BINS = 4096


class Grams:
    """Bucket counts of texts; remembers the hashes of words."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def counts(self, text: str) -> np.ndarray:
        """How often each bucket's unigrams and bigrams occur in a text, A-Z lower-cased."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        out, last, known = np.zeros(self.buckets, np.int64), None, self.known
        for at in range(0, len(words), CHUNK):
            if len(known) > CACHE_WORDS:
                known.clear()
            h = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words[at : at + CHUNK]], np.uint64)
            before = h[:-1] if last is None else np.concatenate(([last], h[:-1]))
            pairs = (before * np.uint64(0x9E3779B97F4A7C15) ^ h[len(h) - len(before) :]) * np.uint64(0xC2B2AE3D27D4EB4F)
            last = h[-1]
            grams = np.concatenate((h, pairs ^ (pairs >> np.uint64(29)))) % np.uint64(self.buckets)
            out += np.bincount(grams.astype(np.int64), minlength=self.buckets)
        return out


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log(target model / raw model) per bucket.

    The raw model counts every row; the target model counts those labelled good, up to ``target_rows``
    ids of them (those of smallest hash).  The result has ``buckets`` entries whatever the input.

    Null texts count nothing, repeated rows count as often, a null id is labelled nothing; labels that
    repeat or lack a document make no difference.  Without good labels, or documents, all are 0.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("good", F.lit(True))
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(good), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1)):
                counts = grams.counts(text.as_py())
                sums[0] += counts
                if is_good.as_py():
                    sums[1] += counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(buckets), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"]
        )

    sums = rows.select("text", "good").mapInArrow(run, "bucket int, raw long, target long")
    table = np.zeros((2, buckets))
    for r in sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        table[:, r.bucket] = r.raw, r.target
    prior = SMOOTHING * buckets
    raw = (table[0] + SMOOTHING) / (table[0].sum() + prior)
    target = (table[1] + prior * raw) / (table[1].sum() + prior)  # drawn to the raw model, so that few labels tell little
    return np.log(target / raw)


def log_weights(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) per row, over the whole text.

    Null, empty and blank texts have no grams and weight 0; repeated rows weigh alike; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        grams = Grams(len(ratio))
        for batch in batches:
            n, weight = [], []
            for text in batch.column(1):
                counts = grams.counts(text.as_py())
                n.append(int(counts.sum()))
                weight.append(float(counts @ ratio))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_grams", "log_weight"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of("text")).mapInArrow(run, f"doc_id {kind}, n_grams long, log_weight double")


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise that depends on the seed and the doc_id alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column (k from 1 to the number of rows), by histograms of fixed size.

    Each round finds the bin of the k-th largest value and goes on inside it.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        share = (F.col(key) - F.lit(low)) / F.lit(high - low)
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        bins = inside.groupBy(F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).alias("bin"))
        found = bins.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.bin):
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def resample(
    docs: DataFrame, labels: DataFrame, share: float = 0.9, seed: int = 7, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """(doc_id, n_grams, log_weight, sample_key, kept) per row of ``docs``: ``share`` of the rows kept.

    Null and empty texts have weight 0 (the models tell nothing).  Rows that tie with the last one
    kept, as repeated rows do, are kept too.  Without good labels all weights are 0 and the sample is
    uniform.  Labels of missing documents are ignored.
    An empty table gives no rows.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality")
    model = fit(docs, labels, buckets, target_rows)
    scored = materialize(log_weights(docs, model).withColumn("sample_key", F.col("log_weight") + gumbel(seed)))
    k = int(scored.count() * share)
    kept = F.col("sample_key") >= F.lit(kth_largest(scored, "sample_key", k)) if k else F.lit(False)
    return scored.withColumn("kept", kept)
