"""Column expressions: coercion, exposure, bands, deviances, drift terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import TOTAL_EPS

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: ColumnLike) -> Column:
    """A double; null where it can't be read, and for NaN."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def day_first(c: ColumnLike) -> Column:
    """A date written day/month/year; null where it can't be read."""
    return F.coalesce(
        F.try_to_timestamp(col(c), F.lit("d/M/yyyy")), F.try_to_timestamp(col(c), F.lit("d-M-yyyy"))
    ).cast("date")


def term_end(next_renewal: ColumnLike, lapse: ColumnLike | None) -> Column:
    """The earlier of the next renewal and the lapse; either alone where the other is null."""
    return col(next_renewal) if lapse is None else F.least(col(next_renewal), col(lapse))


def exposure_years(start: ColumnLike, end: ColumnLike) -> Column:
    """Days over 365.25, at most 1; null where a date is; not floored."""
    years = F.datediff(col(end), col(start)) / F.lit(365.25)
    return F.when(years > 1, F.lit(1.0)).otherwise(years)


def zero_or_more(c: ColumnLike) -> Column:
    return F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0))


def at_least(c: ColumnLike, floor: float) -> Column:
    """The value or the floor; null stays null."""
    return F.when(col(c) < floor, F.lit(floor)).otherwise(col(c))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b with b held above zero."""
    return col(a) / F.greatest(col(b), F.lit(TOTAL_EPS))


# Upper ends, inclusive, and names of the age bands.
AGE_BANDS = ((24, "<25"), (34, "25-34"), (49, "35-49"), (64, "50-64"), (200, "65+"))


def age_band(age: ColumnLike) -> Column:
    """The band (lower, upper] an age falls in; ``nan`` outside (0, 200] and for null."""
    age, out = col(age), None
    for upper, name in AGE_BANDS:
        test = (age > 0) & (age <= upper) if out is None else age <= upper
        out = F.when(age <= 0, "nan").when(test, name) if out is None else out.when(test, name)
    return out.otherwise("nan")


def poisson_deviance(y: ColumnLike, mu: ColumnLike) -> Column:
    """Unit deviance of a Poisson rate."""
    y, mu = col(y), col(mu)
    return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - y + mu)


def tweedie_deviance(y: ColumnLike, mu: ColumnLike) -> Column:
    """Unit deviance of a Tweedie mean with power 1.5."""
    y, mu = col(y), col(mu)
    return -8 * F.sqrt(y) + 4 * y / F.sqrt(mu) + 4 * F.sqrt(mu)


def weighted_mean(value: ColumnLike, weight: ColumnLike) -> Column:
    """Aggregate: sum(w * v) / sum(w)."""
    return F.sum(col(weight) * col(value)) / F.sum(col(weight))


def bin_index(x: ColumnLike, cuts: Column) -> Column:
    """How many of the sorted cut points are x or less; the number of bins where x is null."""
    x = col(x)
    return F.when(x.isNull(), F.size(cuts) + 1).otherwise(F.size(F.filter(cuts, lambda c: c <= x)))


def psi_term(expected: ColumnLike, actual: ColumnLike, bins: ColumnLike, eps: float = 1e-6) -> Column:
    """A bucket's part of the population stability index: shares smoothed, then scaled to add to one again."""
    total = F.lit(1.0) + col(bins) * F.lit(eps)
    e, a = (col(expected) + eps) / total, (col(actual) + eps) / total
    return (a - e) * F.log(a / e)


def psi_of(expected: ColumnLike, actual: ColumnLike, eps: float = 1e-6) -> Column:
    """The index of two array columns of shares or counts, each scaled to add to one after smoothing."""

    def scaled(c: Column) -> Column:
        smooth = F.transform(c, lambda x: x + eps)
        total = F.aggregate(smooth, F.lit(0.0), lambda a, x: a + x)
        return F.transform(smooth, lambda x: x / total)

    terms = F.zip_with(scaled(col(expected)), scaled(col(actual)), lambda e, a: (a - e) * F.log(a / e))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def unseen_warnings(record_fields: Sequence[str], levels: dict[str, Sequence[str]]) -> Column:
    """Warnings ``unseen_category:field=value`` for values outside the training levels, in field order; null warns not."""
    each = [
        F.when(F.col(f).isNotNull() & ~F.col(f).isin(*levels[f]), F.concat(F.lit(f"unseen_category:{f}="), F.col(f)))
        for f in record_fields
    ]
    return F.filter(F.array(*each), lambda w: w.isNotNull())


# Texts that stand for a missing value.
MISSING_TOKENS = ("", "NA", "NaN", "nan", "NULL", "null")


def is_missing(c: ColumnLike) -> Column:
    """Whether a text column says that its value is missing."""
    return col(c).isNull() | F.trim(col(c)).isin(*MISSING_TOKENS)


def safe_name(c: ColumnLike, fallback: str = "file") -> Column:
    """A file name of letters, digits, dots, dashes and underscores; other runs become one underscore."""
    clean = F.regexp_replace(F.trim(F.btrim(F.trim(col(c)), F.lit('"'))), "[^A-Za-z0-9._-]+", "_")
    return F.when(col(c).isNull() | (col(c) == "") | (clean == ""), F.lit(fallback)).otherwise(clean)


def disposition_name(header: ColumnLike) -> Column:
    """The file name of a content-disposition header: the encoded form first, then the plain one."""
    encoded = F.regexp_extract(col(header), r"(?i)filename\*=UTF-8''([^;]+)", 1)
    plain = F.trim(F.regexp_extract(col(header), r'(?i)filename="?([^";]+)"?', 1))
    return F.when(encoded != "", F.url_decode(encoded)).when(plain != "", plain)


def lcg(x: Column, seed: int) -> Column:
    """A pseudo-random integer below 2**31 - 1 from an integer key; in steps that stay inside 64 bits."""
    m = (1 << 31) - 1
    step = F.pmod(x, F.lit(m)) * 48271 + seed % m
    step = F.pmod(F.pmod(step, F.lit(m)) * 69621 + 12345, F.lit(m))
    return F.pmod(step * 39373 + 271828, F.lit(m))
