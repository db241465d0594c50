"""Numeric column expressions shared by all operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Round to six decimals; never returns a negative zero.

    The small shift keeps exact ties (averages over 2^k rows) from depending on
    the last bit of the sum.
    """
    return F.rint(col(c).cast("double") * F.lit(1e6) + F.lit(1e-4)) / F.lit(1e6) + F.lit(0.0)


def clamp(c: Column | str, low: float | Column | None, high: float | Column | None) -> Column:
    """Limit to [low, high]; a missing bound leaves that side open."""
    out = col(c)
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return out


def finite(c: Column | str) -> Column:
    """NULL for NaN and the infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL when either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).cast("double")
    cov = F.covar_pop(x, y)
    return F.when((n > 1) & (spread > 0), F.try_divide(cov, spread))


def pct_change(ref: Column, value: Column) -> Column:
    """(value - ref) / ref in percent, NULL for a missing or zero reference."""
    return F.when(ref != 0, F.try_divide(value - ref, ref) * 100.0)


def pct_saved(ref: Column, value: Column) -> Column:
    """(1 - value / ref) in percent, NULL for a missing or zero reference."""
    return F.when(ref != 0, (F.lit(1.0) - F.try_divide(value, ref)) * 100.0)


def relative_pct(ref: Column, value: Column) -> Column:
    return F.when(ref != 0, F.try_divide(value, ref) * 100.0)


def md5_uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the leading 32 bits of an md5 over ``parts``."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + F.lit(1e-8))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(col(ts).cast("timestamp"))


def hash_uniform(*identity: Column) -> Column:
    """Uniform number in (0, 1) that depends only on the row's identity.

    Unlike ``rand`` it does not change with the partitioning or a retried task.
    """
    text = F.concat_ws(":", *[p.cast("string") for p in identity])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def hash_normal(*identity: Column) -> Column:
    """Standard normal number that depends only on the row's identity."""
    radius = F.sqrt(F.lit(-2.0) * F.log(hash_uniform(F.lit("a"), *identity)))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform(F.lit("b"), *identity))


def descending(c: Column | str) -> Column:
    """Sort key that orders a number from high to low."""
    return F.lit(0.0) - col(c)
