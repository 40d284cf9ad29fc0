"""Null-safe numeric expressions shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-12


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with NULL for a zero denominator (Spark 4 raises on it otherwise)."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing marker used downstream."""
    c = as_col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp that keeps NULL (``greatest`` and ``least`` alone would skip it)."""
    c = as_col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def share_where(cond: Column) -> Column:
    """Mean of a condition that keeps NULL rows in the denominator."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation aggregate that is NULL, not an error, when a side is constant.

    Both sides must be NULL together; callers drop or mask incomplete pairs first.
    """
    x, y = as_col(x), as_col(y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_of(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def seeded(seed: int, *cols: Column) -> Column:
    """A 60-bit number from the MD5 of a seed and columns: an order that other engines can repeat."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
