"""Stateless tick masks and budget arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import md5_uniform


def n_of_m(tick: Column, n: Column | int, m: Column | int, phase: Column | int = 0) -> Column:
    """Balanced n-of-m: true on exactly n of every m consecutive ticks."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.pmod(tick * lit(n) + lit(phase), lit(m)) < lit(n)


def n_of_m_interval(n: int, m: int) -> int:
    """Nominal interval reported for an n-of-m mask."""
    return max(1, -(-m // n))


def bernoulli(rate: Column | float, seed: int, *identity: Column) -> Column:
    """Seeded selection that depends only on the row's identity."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return md5_uniform(F.lit(seed), *identity) < rate


def even_positions(n: Column, k: Column | int) -> Column:
    """Array of distinct positions ``rint(i * (n-1) / (k-1))``, i < k."""
    k = k if isinstance(k, Column) else F.lit(k)
    step = (n - 1).cast("double") / (k - 1)
    spread = F.transform(F.sequence(F.lit(0).cast("long"), (k - 1).cast("long")),
                         lambda i: F.rint(i * step).cast("long"))
    return F.when(k <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(spread))


def thin_evenly(df: DataFrame, n: Column, k: int, tick: Column) -> DataFrame:
    """Rows at positions ``floor(i (n-1) / (k-1))`` for i < k, decided per row.

    Tick t is such a position iff the smallest i with i(n-1)/(k-1) >= t maps to t,
    so no list of positions is built and nothing is joined.
    """
    if k <= 1:
        return df.where(tick == 0)
    span = n - 1
    i = F.ceil(tick.cast("double") * (k - 1) / span)
    exact = F.floor(i * span / (k - 1))
    return df.where((n <= k) | (exact == tick))


def fixed_interval(ratio: Column) -> Column:
    """Interval of a fixed sampler with about the same ratio (half rounds up)."""
    return F.greatest(F.lit(1), F.floor(F.lit(1.0) / ratio + 0.5)).cast("int")


def shortest_period(df: DataFrame, ratio: str, tolerance: float = 0.001,
                    max_period: int = 128) -> DataFrame:
    """Adds ``n``, ``m``: the shortest n/m within tolerance of a ratio, in lowest terms.

    NULL when no period up to ``max_period`` is close enough. The candidates are an
    array inside each row, so nothing is shuffled.
    """
    r = F.col(ratio)
    periods = F.sequence(F.lit(1), F.lit(max_period))
    tried = F.transform(periods, lambda m: F.struct(
        m.alias("m"),
        F.least(m, F.greatest(F.lit(1), F.floor(r * m + 0.5).cast("int"))).alias("n")))
    close = F.filter(tried, lambda c: F.abs(c["n"] / c["m"] - r) <= tolerance + 1e-12)
    best = F.try_element_at(close, F.lit(1))
    divides = F.filter(F.sequence(F.lit(1), best["n"]),
                       lambda d: (best["n"] % d == 0) & (best["m"] % d == 0))
    gcd = F.array_max(divides)
    return df.withColumn("__best", best).withColumn("__gcd", gcd).withColumn(
        "n", (F.col("__best.n") / F.col("__gcd")).cast("int")).withColumn(
        "m", (F.col("__best.m") / F.col("__gcd")).cast("int")).drop("__best", "__gcd")
