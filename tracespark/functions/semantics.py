"""Rules that hold for all operators: missing values, windows and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities are missing values."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def frames_of(seconds: float, rate: float) -> int:
    """A duration as whole frames; the fraction is cut."""
    return int(seconds * rate)


def rounded(x: Column) -> Column:
    """Six digits, for comparing results; see ``exact`` for values that may lie on a tie.

    As DuckDB rounds: the product is a double, so that large values lie on a tie where their
    shortest decimals, which ``F.round(x, 6)`` takes, do not.
    """
    return F.round(x.cast("double") * 1e6, 0) / 1e6


def exact(x: Column, parts: Column | int, digits: int = 6) -> Column:
    """``x``, known to be a whole number of 1 / ``parts``, rounded half up in whole numbers.

    Sums of doubles differ in their last bits with the order of the rows; where a value lies
    halfway between two results, only whole numbers round it alike everywhere.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    parts = F.lit(parts) if isinstance(parts, int) else parts
    n = whole(F.round(x * parts.cast("double"), 0))
    top = whole(whole(2 * n) * 10**digits + whole(parts))
    low = whole(2 * whole(parts))
    return whole((top - F.pmod(top, low)) / low).cast("double") / float(10**digits)


def exact_sql(x: str, parts: str, digits: int = 6) -> str:
    """The same as DuckDB SQL."""
    low = f"(2 * ({parts})::HUGEINT)"
    top = f"(2 * round(({x}) * ({parts})::DOUBLE)::HUGEINT * {10**digits} + ({parts})::HUGEINT)"
    return f"((({top} - (({top} % {low}) + {low}) % {low}) // {low})::DOUBLE / {10**digits}.0::DOUBLE)"


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing where b is zero or missing."""
    return F.try_divide(a, b)


def median(x) -> Column:
    return F.percentile(x, 0.5)
