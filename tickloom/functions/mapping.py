"""Urgency -> interval mappings, as column expressions and for the replay loop."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted names; the two linear spellings mean the original mapping.
ALIASES = {"linear_rate": "original_interval", "linear_interval": "original_interval"}
MAPPINGS = (
    "original_interval", "smoothstep_interval", "power_rate", "geometric_rate",
    "logistic_rate", "exponential_ease_out_rate",
)


def canonical(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in MAPPINGS:
        raise ValueError(f"unknown interval mapping {name!r}")
    return name


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logistic(u: Column, mid: Column, steep: Column) -> Column:
    low = _sigmoid(-steep * mid)
    high = _sigmoid(steep * (F.lit(1.0) - mid))
    shaped = (_sigmoid(steep * (u - mid)) - low) / (high - low)
    return F.when(high - low <= 1e-12, u).otherwise(
        F.least(F.greatest(shaped, F.lit(0.0)), F.lit(1.0)))


def interval_column(
    urgency: Column, mapping: Column, min_interval: Column, max_interval: Column,
    power: Column, midpoint: Column, steepness: Column, ease: Column,
) -> Column:
    """Interval for an urgency; every argument may vary by row."""
    lo, hi, u = min_interval.cast("double"), max_interval.cast("double"), urgency
    span = hi - lo
    shaped = (
        F.when(mapping == "smoothstep_interval", u * u * (F.lit(3.0) - F.lit(2.0) * u))
        .when(mapping == "power_rate", F.pow(u, power))
        .when(mapping == "logistic_rate", _logistic(u, midpoint, steepness))
        .when(mapping == "exponential_ease_out_rate", F.expm1(-ease * u) / F.expm1(-ease))
        .otherwise(u)
    )
    raw = F.when(mapping == "geometric_rate", lo * F.pow(hi / lo, F.lit(1.0) - u)).otherwise(
        hi - span * shaped)
    return F.when(span == 0, min_interval).otherwise(
        F.least(F.greatest(F.rint(raw), lo), hi)).cast("int")


def interval_of_config(urgency: Column) -> Column:
    """As ``interval_column`` with the parameters taken from configuration columns."""
    name = F.col("interval_mapping")
    for alias, target in ALIASES.items():
        name = F.when(F.col("interval_mapping") == alias, F.lit(target)).otherwise(name)
    return interval_column(
        urgency, name, F.col("min_interval"), F.col("max_interval"), F.col("power"),
        F.col("logistic_midpoint"), F.col("logistic_steepness"), F.col("exponential_steepness"))


def interval_function(cfg: Mapping[str, object]) -> Callable[[float], int]:
    """The mapping of one configuration for the sequential replay loop."""
    name = canonical(str(cfg["interval_mapping"]))
    lo, hi = int(cfg["min_interval"]), int(cfg["max_interval"])
    span = hi - lo
    if span == 0:
        return lambda u: lo
    if name == "geometric_rate":
        ratio = hi / lo
        return lambda u: min(hi, max(lo, round(lo * ratio ** (1.0 - u))))
    if name == "smoothstep_interval":
        shape = lambda u: u * u * (3.0 - 2.0 * u)
    elif name == "power_rate":
        power = float(cfg["power"])
        shape = lambda u: u ** power
    elif name == "exponential_ease_out_rate":
        ease = float(cfg["exponential_steepness"])
        shape = lambda u: math.expm1(-ease * u) / math.expm1(-ease)
    elif name == "logistic_rate":
        mid, steep = float(cfg["logistic_midpoint"]), float(cfg["logistic_steepness"])
        sig = lambda x: 1.0 / (1.0 + math.exp(-x))
        low, high = sig(-steep * mid), sig(steep * (1.0 - mid))
        if high - low <= 1e-12:
            shape = lambda u: u
        else:
            shape = lambda u: min(1.0, max(0.0, (sig(steep * (u - mid)) - low) / (high - low)))
    else:
        shape = lambda u: u
    return lambda u: min(hi, max(lo, round(hi - span * shape(u))))
