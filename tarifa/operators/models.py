"""Models: preprocessing, penalised GLMs, boosted trees, locked scaling and the batch scorer.

Fitting is in passes over packed rows (``fitting``).  The boosted model is a second-order histogram
booster: it stands in for a gradient-boosting library and is not bit-equal to any.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CATEGORICAL_FEATURES, NUMERIC_FEATURES, OFFLINE_FLOOR, ONLINE_FLOOR, SHADOW_ONLY
from ..functions.exprs import number, unseen_warnings
from .drift import unpivot
from .fitting import MOST_LEAVES, Masks, Packed, Task, Tree, boost, by_bit, fit_coefficients, pack
from .quantiles import exact_quantiles

#: The catalogue: name, target, role, estimator.
CATALOGUE = (
    ("glm_freq", "frequency", "reference", "poisson_glm"), ("xgb_freq", "frequency", "challenger", "boosted_poisson"),
    ("glm_loss", "pure_premium", "reference", "tweedie_glm"), ("xgb_loss", "pure_premium", "challenger", "boosted_tweedie"),
)

#: Levels of a category that become columns.
MOST_LEVELS = 1000
#: Depth of boosted trees, and trees and learning rate of the catalogue's boosted models.
DEPTH, TREES, RATES = 4, {"xgb_freq": 450, "xgb_loss": 500}, {"xgb_freq": 0.035, "xgb_loss": 0.03}
#: Targets of the catalogue's models and their powers.
POWERS = {"total_claims": 1.0, "total_incurred": 1.5}


@dataclass
class Preprocessor:
    """Constants fitted on training rows: median, mean and deviation of numbers, mode and levels of categories."""

    numeric: tuple[str, ...] = NUMERIC_FEATURES
    categorical: tuple[str, ...] = CATEGORICAL_FEATURES
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Preprocessor:
        """Exact medians, counts of levels, then moments of the imputed numbers.  Mode ties go to the smallest.

        A category of more than ``MOST_LEVELS`` levels is an error: every level becomes a column.
        """
        if self.categorical:
            counts = unpivot(df, self.categorical, "string").where("value IS NOT NULL").groupBy("feature", "value").count()
            most = MOST_LEVELS * len(self.categorical)
            found = counts.limit(most + 1).collect()
            by = {c: sorted((r["value"], r["count"]) for r in found if r.feature == c) for c in self.categorical}
            if wide := [c for c, x in by.items() if len(x) > MOST_LEVELS] or ["together"] * (len(found) > most):
                raise ValueError(f"categories of too many levels: {wide}")
            self.levels = {c: [v for v, _ in x] for c, x in by.items()}
            self.modes = {c: max(x, key=lambda y: y[1])[0] if x else None for c, x in by.items()}
        if self.numeric:
            medians = {r.feature: r.q[0] for r in exact_quantiles(unpivot(df, self.numeric, "double"), (0.5,)).collect()}  # a row a feature
            self.medians = {c: medians.get(c, 0.0) for c in self.numeric}
            two = df.agg(
                *[F.avg(self.imputed(c)).alias(f"a_{c}") for c in self.numeric],
                *[F.stddev_pop(self.imputed(c)).alias(f"s_{c}") for c in self.numeric],
            ).first()
            self.means = {c: two[f"a_{c}"] or 0.0 for c in self.numeric}
            self.scales = {c: two[f"s_{c}"] or 1.0 for c in self.numeric}
        return self

    def imputed(self, c: str) -> Column:
        return F.coalesce(number(c), F.lit(self.medians[c]))

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(map(len, self.levels.values()))

    @property
    def sizes(self) -> tuple[int, ...]:
        """How many levels each category has."""
        return tuple(len(self.levels[c]) for c in self.categorical)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features``: the standardised numbers ``x``, and ``at``, for each category the column of its level.

        Columns count the numbers first, then the levels of each category; an unknown level has -1.
        Levels are looked up by hash in Arrow batches, so the plan is the same for any number of them.
        """
        x = F.array(*[(self.imputed(c) - self.means[c]) / self.scales[c] for c in self.numeric]).cast("array<double>")
        at = F.array().cast("array<int>")
        if self.categorical:
            at = self._columns()(*[F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c])) for c in self.categorical])
        return df.withColumn("features", F.struct(x.alias("x"), at.alias("at")))

    def _columns(self):
        levels, first = [pa.array(self.levels[c], pa.string()) for c in self.categorical], len(self.numeric)
        starts = np.cumsum([first, *map(len, levels)])[:-1].tolist()

        @F.arrow_udf("array<int>")
        def columns(*values: pa.Array) -> pa.Array:
            found = [pc.index_in(v, known).fill_null(-1).to_numpy(zero_copy_only=False) for v, known in zip(values, levels)]
            flat = np.stack([np.where(k < 0, -1, k + start) for k, start in zip(found, starts)], 1).astype("i4")
            return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(starts), "i4"), flat.ravel())

        return columns


@dataclass
class Glm:
    """A fitted log-link GLM on the preprocessor's features."""

    intercept: float
    coefficients: list[float]

    def rate(self) -> Column:
        b = F.array(*map(F.lit, self.coefficients)).cast("array<double>")
        numbers = F.transform("features.x", lambda x, k: x * F.get(b, k))
        levels = F.transform(F.filter("features.at", lambda k: k >= 0), lambda k: F.get(b, k))
        return F.exp(F.aggregate(F.concat(numbers, levels), F.lit(float(self.intercept)), lambda a, x: a + x))


def scale_of(rows: DataFrame, target: str, weight: str, pred: Column) -> float:
    """Actual over predicted total of a calibration year; a year without rows is an error."""
    sums = rows.agg(F.sum(target).alias("a"), F.sum(pred * F.col(weight)).alias("p")).first()
    if sums.a is None or sums.p is None:
        raise ValueError("no rows to calibrate on")
    return sums.a / max(sums.p, 1e-12)


def fit_glm(rows: DataFrame, rate: str, weight: str, power: float, alpha: float = 1e-4, sizes: Sequence[int] = (), **options) -> Glm:
    """Minimise sum(w * d / 2) / sum(w) + alpha / 2 * |b|^2 over ``features``, the intercept free.

    ``sizes`` are the levels of each category of ``features``.
    """
    packed = pack(rows, {"rate": rate}, weight, sizes)
    b = fit_coefficients(packed, "rate", power, alpha, **options)
    packed.release()
    return Glm(float(b[0]), b[1:].tolist())


@dataclass
class Booster:
    """A fitted sum of trees: base score in logs, and trees as arrays.

    Node 0 is a tree's root; ``feature`` is -1 at a leaf; values of ``threshold`` or less go left.
    """

    base: float
    trees: list[dict[str, list]] = field(default_factory=list)

    def margins(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Scores in logs of rows of numbers and of hot columns."""
        return self.scoring(x.shape[1], 0 if at is None else at.shape[1])(x, at)

    def scoring(self, d: int, positions: int) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
        """What scores rows of ``d`` numbers and ``positions`` hot columns: masks of the trees, made once for many rows."""
        leaves = [self._leaves(t) for t in self.trees]
        if max((len(values) for values, _ in leaves), default=0) > MOST_LEAVES:
            return self._walked
        cuts = [np.unique([t for _, tests in leaves for f, t, _ in tests if f == c]) for c in range(d)]
        top = max((f for _, tests in leaves for f, _, _ in tests), default=-1)
        hot, widths = range(d, d + positions), [len(c) + 1 for c in cuts] + [top + 3] * positions
        trees = []
        for _, tests in leaves:
            own = []
            for f, t, bits in tests:
                if f < d:
                    own.append((f, slice(int(np.searchsorted(cuts[f], t)) + 1, None), bits))
                else:  # a row goes right if any of its hot columns is the test's
                    own += [(c, slice(f + 1, f + 2), bits) for c in hot]
            trees.append(own)
        masks, tables = Masks(widths, trees), [by_bit(values) for values, _ in leaves]

        def score(x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
            out = np.full(len(x), self.base)
            bins = [np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)] + [np.clip(at[:, k], -1, top + 1).astype(np.intp) + 1 for k in range(positions)]
            for leaf, v in zip(masks.leaves(bins, len(x)), tables):
                out += v.take(leaf)
            return out

        return score

    @staticmethod
    def _leaves(t: dict[str, list]) -> tuple[list[float], list[tuple[int, float, int]]]:
        """A tree's values of leaves from left to right, and its tests: (feature, threshold, bits of the leaves on the left)."""
        values, tests = [], []

        def walk(node: int) -> None:
            if t["feature"][node] < 0:
                values.append(float(t["value"][node]))
                return
            first = len(values)
            walk(t["left"][node])
            tests.append((t["feature"][node], t["threshold"][node], (1 << len(values)) - (1 << first)))
            walk(t["right"][node])

        walk(0)
        return values, tests

    def _walked(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The same for trees of more leaves than masks hold, from node to node."""
        out, rows, d = np.full(len(x), self.base), np.arange(len(x)), x.shape[1]
        for t in self.trees:
            feature, threshold, left, right, value = (np.array(t[k]) for k in ("feature", "threshold", "left", "right", "value"))
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                asked = feature[node]
                low = np.zeros(len(x), bool)
                if d:
                    low = x[rows, np.clip(asked, 0, d - 1)] <= threshold[node]
                if at is not None and at.shape[1]:
                    low = np.where(asked < d, low, ~(at == asked[:, None]).any(1))
                node = np.where(inner, np.where(low, left[node], right[node]), node)
            out += value[node]
        return out

    def rate(self) -> Column:
        """The mean as a column over ``features``, by Arrow batches."""
        own, made = self, {}

        @F.arrow_udf("double")
        def score(features: pa.Array) -> pa.Array:
            n = len(features)
            if not n:
                return pa.array([], pa.float64())
            x, at = (features.field(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for k in (0, 1))
            wide = x.shape[1], at.shape[1]
            if wide not in made:  # once a task
                made[wide] = own.scoring(*wide)
            return pa.array(np.exp(made[wide](x, at)), pa.float64())

        return score("features")

    def transform(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        return rows.withColumn(out, self.rate())


def tree_arrays(tree: Tree, packed: Packed) -> dict[str, list]:
    """A tree over bins as the arrays of ``Booster``."""
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    d, starts = packed.layout.numbers, packed.layout.starts

    def add(place: int) -> int:
        k, c, b = len(out["feature"]), int(tree.column[place]), int(tree.bin[place])
        feature, threshold = (-1, 0.0) if c < 0 else (c, float(packed.cuts[c][b])) if c < d else (starts[c - d] + b, 0.5)
        for key, x in (("feature", feature), ("threshold", threshold), ("left", -1), ("right", -1), ("value", 0.0 if c >= 0 else float(tree.value[place]))):
            out[key].append(x)
        if c >= 0:
            out["left"][k], out["right"][k] = add(2 * place), add(2 * place + 1)
        return k

    add(1)
    return out


def boosters(packed: Packed, tasks: Sequence[Task]) -> list[Booster]:
    """Boosted models of several targets, fitted in the same passes."""
    return [Booster(base, [tree_arrays(t, packed) for t in trees]) for base, trees in boost(packed, tasks)]


def fit_booster(rows: DataFrame, rate: str, weight: str, power: float, rounds: int = 20, sizes: Sequence[int] = (), **options) -> Booster:
    """Second-order boosting of a log-link Poisson (power 1) or Tweedie (1 < power < 2) mean over ``features``.

    ``options`` are the parameters of ``fitting.Task``.
    """
    packed = pack(rows, {"rate": rate}, weight, sizes, binned=True)
    (out,) = boosters(packed, [Task("rate", power, rounds, **options)])
    packed.release()
    return out


@dataclass
class Scorer:
    """A sealed set of models for batch scoring: one transform chain, no row-at-a-time code."""

    prep: Preprocessor
    models: dict[str, Glm | Booster]
    scales: dict[str, float]
    version: str = "1"

    def score(self, records: DataFrame) -> DataFrame:
        """Rates of every model, log ratios of challenger to reference where both are there, and warnings."""
        rows = self.prep.transform(records)
        rows = rows.withColumns(
            {m: F.greatest(g.rate(), F.lit(ONLINE_FLOOR)) * F.lit(self.scales.get(m, 1.0)) for m, g in self.models.items()}
        )
        pairs = {"frequency": ("xgb_freq", "glm_freq"), "pure_premium": ("xgb_loss", "glm_loss")}
        return rows.withColumns(
            {f"{n}_log_ratio": F.log(F.col(a) / F.col(b)) for n, (a, b) in pairs.items() if a in self.models and b in self.models}
            | {
                "model_version": F.lit(self.version), "governance_status": F.lit(SHADOW_ONLY),
                "warnings": unseen_warnings(self.prep.categorical, self.prep.levels),
            }
        ).drop("features")

    def to_json(self) -> str:
        return json.dumps({"prep": asdict(self.prep), "models": {m: asdict(g) for m, g in self.models.items()}, "scales": self.scales, "version": self.version}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Scorer:
        d = json.loads(text)
        prep = Preprocessor(**d["prep"])
        prep.numeric, prep.categorical = tuple(prep.numeric), tuple(prep.categorical)
        return cls(prep, {m: (Booster if "trees" in g else Glm)(**g) for m, g in d["models"].items()}, d["scales"], d["version"])


def training(rows: DataFrame, prep: Preprocessor, boosted: bool = True) -> Packed:
    """Rows with totals and exposure, encoded and written once for all models of the catalogue."""
    rates = {t: F.col(t) / F.col("total_exposure") for t in POWERS}
    return pack(prep.transform(rows), rates, "total_exposure", prep.sizes, boosted)


def fit_models(names: Sequence[str], packed: Packed, warm: dict[str, Glm | Booster] | None = None, **options) -> dict[str, Glm | Booster]:
    """Models of the catalogue fitted on one written table; the boosted ones in the same passes.

    ``options`` change the parameters of boosted models, which have the catalogue's trees and
    learning rates; GLMs start from those of ``warm`` that have as many columns.
    """
    target = {n: ("total_claims" if t == "frequency" else "total_incurred") for n, t, _, _ in CATALOGUE}
    trees = [n for n in names if n in TREES]
    tasks = [Task(target[n], POWERS[target[n]], **({"rounds": TREES[n], "learning_rate": RATES[n], "depth": DEPTH} | options)) for n in trees]
    out: dict[str, Glm | Booster] = dict(zip(trees, boosters(packed, tasks) if tasks else ()))
    for n in names:
        if n not in TREES:
            before = (warm or {}).get(n)
            start = np.array([before.intercept, *before.coefficients]) if before and len(before.coefficients) == packed.layout.width else None
            b = fit_coefficients(packed, target[n], POWERS[target[n]], start=start)
            out[n] = Glm(float(b[0]), b[1:].tolist())
    return {n: out[n] for n in names}


def held(c: Column | str) -> Column:
    """A rate held above the offline floor."""
    return F.greatest(c, F.lit(OFFLINE_FLOOR))


def locked_run(model: Glm | Booster, calibration: DataFrame, test: DataFrame, target: str) -> tuple[float, DataFrame]:
    """A model's scale locked on one year, and another scored: (scale, test with ``pred``); both with ``features``."""
    scale = scale_of(calibration, target, "total_exposure", held(model.rate()))
    return scale, test.withColumn("pred", held(held(model.rate()) * scale))


def rolling_windows(years: Sequence[int]) -> list[tuple[list[int], int]]:
    """Every year after the first is tested once, trained on all years before it."""
    return [(list(years[:k]), years[k]) for k in range(1, len(years))]


def save_scorer(scorer: Scorer, spark: SparkSession, path: str) -> None:
    """Write a scorer as one JSON document through Spark, to any store it reaches."""
    spark.createDataFrame([(scorer.to_json(),)], "body string").coalesce(1).write.mode("overwrite").text(path)


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    return Scorer.from_json(spark.read.text(path, wholetext=True).first()[0])


def complexity(models: dict[str, tuple[Glm | Booster, float]], rows: DataFrame) -> list[tuple[str, float, float, int]]:
    """(model, fit_seconds, predict_seconds, bytes) of fitted models with the seconds their fits took, measured over ``rows`` with ``features``."""
    out = []
    for name, (model, fit_seconds) in models.items():
        began = time.perf_counter()
        rows.agg(F.sum(model.rate())).first()
        out.append((name, fit_seconds, time.perf_counter() - began, len(json.dumps(asdict(model)))))
    return out
