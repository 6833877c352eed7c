"""Numeric column helpers that give the same bits in every engine.

Two things make naive results engine-dependent: the order in which doubles
are summed (it differs with partitioning) and the rounding rule of the
built-in ROUND. Sums here are taken over integers (the value in units of
10^-8, rounded half away from zero), which is order-free, and rounding is
written out as one fixed formula.

Integer sums run on Spark's primitive-long fast path, where DECIMAL sums cost
about five times as much. A sum that leaves the 64-bit range, or a value that
would, falls back to the plain double sum: large values are never saturated
and never fail the job.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order-free sums hold their inputs to this many decimals, and to magnitudes below EXACT_LIMIT.
EXACT_SCALE = 8
EXACT_LIMIT = 9e9
# Doubles from here on have no fraction left to round.
WHOLE_FROM = 2.0 ** 52

# A number as text: optional sign, digits with optional fraction (or a bare
# fraction), optional exponent. Rejects Spark-only forms such as "12.5f" or
# "1d", DuckDB-only ones such as "1_000", and "inf"/"nan".
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c, digits: int = 2) -> Column:
    """sign(x) * floor(|x| * 10^d + 0.5) / 10^d; a value with no fraction left (or NaN) as it is.

    Spark's floor of a double is a BIGINT, so the formula must not see values
    beyond its range.
    """
    c = col_(c).cast("double")
    scale = float(10 ** digits)
    rounded = F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(F.abs(c) < F.lit(WHOLE_FROM / scale), rounded).otherwise(c)


SCALE = float(10 ** EXACT_SCALE)


def scaled(c) -> Column:
    """The value in units of 10^-8 as BIGINT, rounded half away from zero; null from EXACT_LIMIT on."""
    c = col_(c).cast("double")
    units = (F.signum(c) * F.floor(F.abs(c) * F.lit(SCALE) + F.lit(0.5))).cast("bigint")
    return F.when(F.abs(c) < F.lit(EXACT_LIMIT), units)


def exact_sum(c, over=None) -> Column:
    """Order-independent sum as DOUBLE (null when no non-null input), optionally over a window.

    With a value from EXACT_LIMIT on, or a sum outside 64 bits, the plain double
    sum.
    """
    c = col_(c).cast("double")
    agg = (lambda a: a.over(over)) if over is not None else (lambda a: a)
    plain = agg(F.sum(c))
    exact = agg(F.try_sum(scaled(c))).cast("double") / F.lit(SCALE)
    return F.when(agg(F.max(F.abs(c))) >= F.lit(EXACT_LIMIT), plain).otherwise(F.coalesce(exact, plain))


def exact_mean(c) -> Column:
    """Order-independent mean: exact integer sum, then fixed double divisions."""
    return exact_sum(c) / F.nullif(F.count(col_(c)), F.lit(0))


def sample_stddev(c) -> Column:
    """Sample standard deviation (n - 1), null for fewer than two values.

    The built-in merges centred moments, so equal values give exactly 0 and
    large values with a small spread do not cancel.
    """
    return F.stddev_samp(col_(c).cast("double"))


def coerce_numeric(c, fill: float | None = 0.0) -> Column:
    """Text or number to DOUBLE; anything not a plain number becomes ``fill``.

    NaN and infinities become ``fill`` as well, so downstream averages never
    see them.
    """
    c = col_(c)
    text = c.cast("string")
    parsed = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    finite = F.when(~F.isnan(parsed) & (F.abs(parsed) != F.lit(float("inf"))), parsed)
    return F.coalesce(finite, F.lit(fill).cast("double")) if fill is not None else finite


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(~F.isnan(c), c)


def row_total(cols: list[str]) -> Column:
    """Row-wise sum over the given columns, nulls counted as 0, 0 total -> null."""
    total = reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]) if cols else F.lit(0.0)
    return F.nullif(total, F.lit(0.0))


def share_pct(part_cols: list[str], all_cols: list[str], digits: int = 2) -> Column:
    """(sum of part columns) / (row total) * 100, rounded; null when total is 0."""
    present = [c for c in part_cols if c in all_cols]
    part = reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in present]) if present else F.lit(0.0)
    return round_half_away(F.try_divide(part, row_total(all_cols)) * F.lit(100.0), digits)
