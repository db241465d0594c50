"""Signal shaping as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import hash_normal


def trend(v: Column, tick: Column, slope: Column | float) -> Column:
    return v + tick * slope


def season(v: Column, tick: Column, period: Column | float, amplitude: Column | float) -> Column:
    period = period if isinstance(period, Column) else F.lit(float(period))
    return v + amplitude * F.sin(F.lit(2.0 * math.pi) * tick / period)


def noise(v: Column, std: Column | float, *identity: Column) -> Column:
    """Adds gaussian noise that depends only on the row's identity."""
    return v + hash_normal(*identity) * std


def signal(delta: Column, duration: Column, mode: str) -> Column:
    """Signal of a request: the raw delta, its positive part, or the duration."""
    if mode == "raw":
        return delta
    if mode == "positive":
        return F.greatest(delta, F.lit(0.0))
    if mode == "duration":
        return duration.cast("double")
    raise ValueError(f"unknown signal mode {mode!r}")


def group_uid(name: Column) -> Column:
    """Member id inside a control-group name, with dashes."""
    # Fixed value: pattern of the id part of the name.
    return F.translate(F.regexp_extract(name, r"pod([0-9a-f_-]+)(?:\.slice)?$", 1), "_", "-")


def bridge(left: Column, right: Column, i: Column, k: Column, method: str) -> Column:
    """Point i of a k-point transition from left to right."""
    share = F.when(k > 1, i / (k - 1)).otherwise(0.0)
    if method == "linear":
        return left + (right - left) * share
    if method == "cosine":
        return left + (right - left) * ((1.0 - F.cos(share * F.lit(math.pi))) / 2.0)
    raise ValueError(f"unknown bridge method {method!r}")
