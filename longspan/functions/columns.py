"""Column expressions: code maps, coercing parses, id and date building.

Everything here returns a ``Column`` and stays inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_if_nan(value: Column | str) -> Column:
    """NaN is stored as NULL so comparisons and averages skip it."""
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def coerce_number(value: Column | str) -> Column:
    """Double when the text parses as a finite-or-infinite number, else NULL."""
    return null_if_nan(as_column(value).try_cast("double"))


def coerce_integer(value: Column | str) -> Column:
    """Integer by truncating a parsed number, else NULL."""
    return coerce_number(value).try_cast("int")


def coerce_date(value: Column | str) -> Column:
    """Date from ISO or month/day/year text; anything else is NULL."""
    value = as_column(value).cast("string")
    return F.coalesce(value.try_cast("date"), F.try_to_date(value, "M/d/yyyy"))


def date_from_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Date from three numeric text columns; NULL when any part is missing or invalid."""
    parts = [coerce_integer(part).cast("string") for part in (year, month, day)]
    text = F.concat(F.lpad(parts[0], 4, "0"), F.lit("-"), parts[1], F.lit("-"), parts[2])
    return text.try_cast("date")


def map_codes(value: Column | str, codes: Mapping, default: object = None) -> Column:
    """Look a value up in a literal map; unmapped and NULL give ``default``."""
    pairs = [F.lit(item) for pair in codes.items() for item in pair]
    found = F.try_element_at(F.create_map(*pairs), as_column(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def first_substring_rule(value: Column | str, rules: Sequence[tuple[Iterable[str], str]], default: str) -> Column:
    """First rule whose any substring occurs in the lower-cased text wins."""
    text = F.lower(as_column(value))
    result = None
    for needles, label in rules:
        hit = None
        for needle in needles:
            hit = text.contains(needle) if hit is None else hit | text.contains(needle)
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return F.coalesce(result, F.lit(default))


def prefixed_id(prefix: str, value: Column | str, width: int = 0) -> Column:
    """``prefix`` + id text, zero-padded on the left; longer ids stay whole."""
    text = as_column(value).cast("string")
    if width:
        text = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.concat(F.lit(prefix), text)


def month_visit_codes(step: int, last: int, zero_codes: Sequence[str], unit: int, padded: bool) -> dict[str, int]:
    """Visit codes ``m<months>`` -> ``months // unit``, generated from a rule."""
    codes = {code: 0 for code in zero_codes}
    for months in range(step, last + 1, step):
        codes[f"m{months}"] = months // unit
        if padded:
            codes[f"m{months:02d}"] = months // unit
    return codes


def pick(df: DataFrame, name: str, default: object = None, cast: str = "string") -> Column:
    """Column ``name`` when the frame has it, else a typed constant."""
    if name in df.columns:
        return F.col(f"`{name}`")
    return F.lit(default).cast(cast)


def flag(predicate: Column) -> Column:
    """1.0 / 0.0; a NULL comparison counts as 0.0."""
    return F.coalesce(predicate, F.lit(False)).cast("double")


def mean_ignoring_nulls(columns: Sequence[str]) -> Column:
    """Row-wise mean over the non-null values; NULL when there are none."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(count > 0, total / count)


def any_present(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in columns]).isNotNull()


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


ERFC_TERMS = 80
ERFC_SERIES_BELOW = 2.0


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 to about 13 digits, also far in the tail.

    Below 2 one minus the all-positive series of erf, from there on the continued fraction, both summed
    from the last term inwards.
    """
    terms = F.sequence(F.lit(ERFC_TERMS), F.lit(1))
    square = F.lit(2.0) * x * x
    series = F.aggregate(terms, F.lit(1.0), lambda acc, n: F.lit(1.0) + acc * square / (F.lit(2.0) * n + F.lit(1.0)))
    fraction = F.aggregate(terms, F.lit(0.0), lambda acc, n: n / F.lit(2.0) / (x + acc))
    scale = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    near = F.lit(1.0) - F.lit(2.0) * x * scale * series
    return F.when(x < ERFC_SERIES_BELOW, near).otherwise(scale / (x + fraction))


def dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return sum((c * F.lit(float(w)) for c, w in zip(columns, weights)), F.lit(0.0))


# Two primes: keys share a draw only if they agree modulo both, that is modulo their product near 2**62.
DRAW_MODULI = (2_147_483_647, 2_147_483_629)


def seeded_draw(key: Column | str, seed: int | Column = 0) -> Column:
    """Uniform draw in [0, 1) from an integer key, in 64-bit integer arithmetic.

    The draw depends on nothing but key and seed, so recomputed tasks repeat
    it, and any SQL engine can reproduce it. Squaring modulo a prime keeps
    draws of neighbouring keys and seeds apart; two primes keep keys apart
    that agree modulo one of them. ``seed`` may be a column, so
    that one row can yield one draw per replicate.
    """

    def whole(value: int) -> Column:
        return F.lit(value).cast("long")

    s = (F.lit(seed) if isinstance(seed, int) else seed).cast("long")

    def part(modulus: int) -> Column:
        m = whole(modulus)
        k = F.pmod(as_column(key).cast("long"), m)
        a = (k * whole(1_103_515_245) + s * whole(12_345) + whole(6_789)) % m
        return ((a * a + k) % m).cast("double") / F.lit(float(modulus))

    total = part(DRAW_MODULI[0]) + part(DRAW_MODULI[1])
    return total - F.floor(total)


def seeded_draws(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same draws as ``seeded_draw`` from arrays of 64-bit integers, for use inside a task."""
    total = np.zeros(np.broadcast(keys, seeds).shape)
    for m in DRAW_MODULI:
        k = keys % m
        a = (k * 1_103_515_245 + seeds * 12_345 + 6_789) % m
        total = total + ((a * a + k) % m) / float(m)
    return total - np.floor(total)


# Cumulative Poisson(1) probabilities P(X <= k), k = 0..7.
POISSON_ONE_CDF = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.999916758850712,
    0.9999897508033253,
)


def poisson_one(draw: Column) -> Column:
    """Poisson(1) count from a uniform draw by its cumulative thresholds."""
    return sum(((draw >= F.lit(p)).cast("int") for p in POISSON_ONE_CDF), F.lit(0))
