"""The monitor of a running service as streaming state.

State per service is what the monitor holds: counters and drift counts since the last reset, and the
last values of latency, batch size and both log ratios, of bounded number.  After every micro-batch
a service with new requests gives one row, equal to the batch snapshot of its requests since the reset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..contracts import MISSING, PRIVACY_BOUNDARY, UNSEEN
from ..functions.exprs import bin_index, number, psi_of
from ..operators.monitoring import LAST, THRESHOLDS, share, with_alerts

#: Buckets of a baseline at most: it is held by every task.
MOST_BUCKETS = 20_000
_VALUES = ("latency_ms", "batch_size", "freq_log_ratio", "loss_log_ratio")
_STATE = "requests long, errors long, records long, unseen long, " + ", ".join(f"{v} array<double>" for v in _VALUES) + ", bins array<long>"
_SHOWN = ("latency_median", "latency_p95", "latency_max", "batch_median", "batch_p95", "batch_max", "frequency_p50", "frequency_p95", "pure_premium_p50", "pure_premium_p95")
_SNAPSHOT = (
    "service string, seq long, request_count long, error_count long, records_scored long, unseen_warning_records long, "
    + ", ".join(f"{c} double" for c in _SHOWN) + ", bins array<long>"
)


@dataclass(frozen=True)
class Baseline:
    """Cut points of numbers, levels of categories, and the share expected of each bucket, by feature in order."""

    cuts: dict[str, list[float]]
    levels: dict[str, list[str]]
    expected: dict[str, list[float]]

    @classmethod
    def collected(cls, numeric: DataFrame | None, categorical: DataFrame | None, features: tuple[str, ...]) -> Baseline:
        """From the tables of ``drift.numeric_baseline`` and ``drift.categorical_baseline``, whose size is checked."""
        cuts, levels, expected = {}, {}, {}
        for frame, order in ((numeric, "ordinal"), (categorical, "bucket")):
            rows = [] if frame is None else frame.limit(MOST_BUCKETS + 1).collect()
            if len(rows) > MOST_BUCKETS:
                raise ValueError(f"a baseline of over {MOST_BUCKETS} buckets")
            for r in sorted(rows, key=lambda r: r[order]):
                expected.setdefault(r.feature, []).append(r.expected)
                if order == "ordinal":
                    cuts[r.feature] = list(r.cuts)
                else:
                    levels.setdefault(r.feature, []).append(r.bucket)
        return cls(cuts, levels, {f: expected[f] for f in features})

    def offsets(self) -> dict[str, int]:
        """Where each feature's buckets begin in one array."""
        sizes = [len(e) for e in self.expected.values()]
        return dict(zip(self.expected, np.cumsum([0, *sizes])[:-1].tolist()))

    def buckets(self) -> Column:
        """The bucket of each feature of a record, as places of that array."""
        out = []
        for f, begin in self.offsets().items():
            if f in self.cuts:
                place = bin_index(number(f), F.array(*map(F.lit, self.cuts[f])).cast("array<double>"))
            else:
                known = F.array(*map(F.lit, self.levels[f]))
                at = F.array_position(known, F.coalesce(F.col(f).cast("string"), F.lit(MISSING)))
                place = F.when(at > 0, at - 1).otherwise(self.levels[f].index(UNSEEN)).cast("int")
            out.append(place + begin)
        return F.array(*out).cast("array<int>")

    def largest(self, bins: str = "bins") -> tuple[Column, Column]:
        """The largest stability index of counted buckets, and its feature; null without records, ties to the first feature."""
        cells = []
        for k, (f, begin) in enumerate(self.offsets().items()):
            counts = F.slice(bins, begin + 1, len(self.expected[f]))
            total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
            psi = psi_of(F.array(*map(F.lit, self.expected[f])).cast("array<double>"), F.transform(counts, lambda n: n / total))  # noqa: B023
            cells.append(F.when(total > 0, F.struct(psi.alias("psi"), F.lit(-k).alias("rank"), F.lit(f).alias("feature"))))
        top = F.array_max(F.array(*cells)) if cells else F.lit(None).cast("struct<psi: double, rank: int, feature: string>")
        return top["psi"], top["feature"]


class Arrived:
    """A service's requests of a micro-batch, read part by part in any order and never held as a frame.

    Of each request after the last reset known so far stay its place, flag, two counts and buckets, as
    arrays; of the values only those of the last requests.  Requests rank by ``seq``, equal ones as they came.
    """

    def __init__(self, last: int):
        self.last, self.read, self.seq, self.reset = last, 0, None, None
        self.thin: list[tuple[np.ndarray, ...]] = []
        self.values: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_VALUES))))

    def _after(self, seq: np.ndarray, came: np.ndarray) -> np.ndarray:
        if self.reset is None:
            return np.ones(len(seq), bool)
        return (seq > self.reset[0]) | (seq == self.reset[0]) & (came >= self.reset[1])

    def add(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            return
        seq, came = rows.seq.to_numpy(np.int64), np.arange(self.read, self.read + len(rows))
        self.read += len(rows)
        self.seq = int(seq.max()) if self.seq is None else max(self.seq, int(seq.max()))
        if (at := np.flatnonzero(rows.reset.to_numpy(bool))).size:
            top = max(zip(seq[at].tolist(), came[at].tolist()))
            if self.reset is None or top > self.reset:
                self.reset = top
                known, self.thin = self.thin, []
                for part in known:
                    self._keep(part)
        buckets = np.array(rows.buckets.tolist(), np.int32).reshape(len(rows), -1)
        self._keep((seq, came, rows.error.to_numpy(bool), rows.batch_size.to_numpy(np.int64), rows.unseen.to_numpy(np.int64), buckets))
        seq, came, values = (np.concatenate(x) for x in zip(self.values, (seq, came, rows[list(_VALUES)].to_numpy(float))))
        order = np.lexsort((came, seq))[-self.last :]
        self.values = seq[order], came[order], values[order]

    def _keep(self, part: tuple[np.ndarray, ...]) -> None:
        after = self._after(*part[:2])
        if after.any():
            self.thin.append(part if after.all() else tuple(x[after] for x in part))

    def since_reset(self, width: int) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Counters, last values in order, and counts of buckets of the requests from the last reset on."""
        counts, bins = np.zeros(4, np.int64), np.zeros(width, np.int64)
        for _, _, error, batch_size, unseen, buckets in self.thin:
            counts += [len(error), int(error.sum()), int(batch_size.sum()), int(unseen.sum())]
            if width:
                bins += np.bincount(buckets.ravel(), minlength=width)
        shown = self.values[2][self._after(*self.values[:2])]
        return counts, {v: shown[:, k] for k, v in enumerate(_VALUES)}, bins


def monitor(requests: DataFrame, baseline: Baseline, thresholds: dict[str, float] = THRESHOLDS, last: int = LAST) -> DataFrame:
    """Snapshots with drift and alerts of a stream of requests, a row per service and micro-batch.

    ``requests`` has ``service``, ``seq``, ``latency_ms``, ``error``, ``batch_size``, ``unseen``, the two log
    ratios, ``reset`` and the baseline's features.  A row with ``reset`` is the first one after a reset:
    what came before it is forgotten.  Requests of a micro-batch are taken in order of ``seq``.  A null
    value is of its request's place among the last ones, and no value; a null flag is false, a null count 0.
    """
    width = sum(map(len, baseline.expected.values()))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, values, bins = np.zeros(4, np.int64), {v: np.zeros(0) for v in _VALUES}, np.zeros(width, np.int64)
        if state.exists:
            known = state.get
            counts, values, bins = np.array(known[:4]), dict(zip(_VALUES, map(np.array, known[4:8]))), np.array(known[8], np.int64)
        new = Arrived(last)
        for rows in parts:
            new.add(rows)
        seq = new.seq
        if new.reset is not None:
            counts, values, bins = counts * 0, {v: np.zeros(0) for v in _VALUES}, bins * 0
        more, own, buckets = new.since_reset(width)
        counts, bins = counts + more, bins + buckets
        for v in _VALUES:
            values[v] = np.concatenate((values[v], own[v]))[-last:]
        state.update((*map(int, counts), *[values[v].tolist() for v in _VALUES], bins.tolist()))
        at = lambda v, *qs: [float(x) for x in np.quantile(v, qs)] if len(v) else [0.0] * len(qs)
        latency, batch, frequency, premium = (values[v][~np.isnan(values[v])] for v in _VALUES)
        shown = [*at(latency, 0.5, 0.95, 1.0), *at(batch, 0.5, 0.95, 1.0), *at(np.abs(frequency), 0.5, 0.95), *at(np.abs(premium), 0.5, 0.95)]
        yield pd.DataFrame([[key[0], seq, *counts, *shown, bins.tolist()]], columns=[c.split()[0] for c in _SNAPSHOT.split(", ")])

    flag, count = (lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)), (lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c))
    thin = requests.select("service", F.col("seq").cast("long"), flag("reset"), flag("error"), count("unseen"), count("batch_size"), *[F.col(v).cast("double") for v in _VALUES if v != "batch_size"], baseline.buckets().alias("buckets"))
    found = thin.groupBy("service").applyInPandasWithState(fold, _SNAPSHOT, _STATE, "update", GroupStateTimeout.NoTimeout)
    psi, feature = baseline.largest()
    rates = found.withColumns(
        {
            "error_rate": share(F.col("error_count"), F.col("request_count")), "unseen_category_rate": share(F.col("unseen_warning_records"), F.col("records_scored")),
            "privacy_boundary": F.lit(PRIVACY_BOUNDARY), "max_psi": psi, "max_psi_feature": feature,
        }
    )
    return with_alerts(rates.drop("bins"), thresholds)
