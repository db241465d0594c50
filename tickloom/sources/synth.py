"""Synthetic traces composed of segments.

All randomness is a function of (seed, series, segment, tick), so a trace does not
depend on partitioning or retries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import hash_normal, hash_uniform
from tickloom.functions.shaping import bridge, season, trend
from tickloom.operators.scans import number_rows, previous, running_sum, scan
from tickloom.sources.json_traces import tick_spine

# The two default components of the mixture as (mean, std, weight).
MIXTURE = ((20.0, 5.0, 0.6), (75.0, 8.0, 0.4))


def uniform(identity: list[Column]) -> Column:
    return F.col("p1") + (F.col("p2") - F.col("p1")) * hash_uniform(F.lit("u"), *identity)


def normal(identity: list[Column]) -> Column:
    return F.col("p1") + F.col("p2") * hash_normal(F.lit("n"), *identity)


def lognormal(identity: list[Column]) -> Column:
    return F.exp(F.col("p1") + F.col("p2") * hash_normal(F.lit("l"), *identity))


def mixture(identity: list[Column]) -> Column:
    total = sum(w for _, _, w in MIXTURE)
    pick, z = hash_uniform(F.lit("m"), *identity), hash_normal(F.lit("mz"), *identity)
    out, edge = None, 0.0
    for mean, std, weight in MIXTURE:
        edge += weight / total
        value = F.lit(mean) + F.lit(std) * z
        out = F.when(pick < edge, value) if out is None else out.when(pick < edge, value)
    return out.otherwise(F.lit(MIXTURE[-1][0]) + F.lit(MIXTURE[-1][1]) * z)


def constant(identity: list[Column]) -> Column:
    return F.col("p1")


@F.pandas_udf(T.DoubleType())
def _beta(seed: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([np.random.default_rng(int(s)).beta(x, y) for s, x, y in zip(seed, a, b)], dtype="float64")


def beta(identity: list[Column]) -> Column:
    """Beta(p1, p2) on the scale ``p3``; the only shape without a column expression."""
    seed = F.abs(F.xxhash64(*identity))
    return _beta(seed, F.col("p1"), F.col("p2")) * F.col("p3")


# Distribution name -> value expression over the segment columns p1, p2, p3.
GENERATORS: dict[str, Callable[[list[Column]], Column]] = {
    "uniform": uniform, "normal": normal, "lognormal": lognormal,
    "mixture": mixture, "constant": constant, "beta": beta,
}

SEGMENT = ("series_id string, seq long, label string, distribution string, n long, seed long, p1 double, p2 double, "
           "p3 double, trend_slope double, season_period double, season_amplitude double, noise_std double, "
           "anomaly_fraction double, anomaly_magnitude double, clip_low double, clip_high double")


def segment_bounds(spec: DataFrame, bridge_length: int = 0) -> DataFrame:
    """Adds ``start_tick`` and ``end_tick`` (half-open) of every segment."""
    wide = scan(spec, ["series_id"], ["seq"], {
        "__before": running_sum(F.col("n"), inclusive=False), "__gaps": running_sum(F.lit(bridge_length), inclusive=False)})
    start = F.coalesce("__before", F.lit(0)) + F.coalesce("__gaps", F.lit(0))
    return wide.withColumn("start_tick", start.cast("long")).withColumn(
        "end_tick", (F.col("start_tick") + F.col("n")).cast("long")).drop("__before", "__gaps")


def segment_values(spec: DataFrame, generators: tuple[str, ...] = tuple(GENERATORS)) -> DataFrame:
    """``series_id, seq, i, value``: every segment on its own tick axis."""
    rows = tick_spine(spec, F.lit(0), F.col("n") - 1, "i")
    identity = [F.col("seed"), F.col("series_id"), F.col("seq"), F.col("i")]
    value = F.lit(None).cast("double")
    for name in generators:
        value = F.when(F.col("distribution") == name, GENERATORS[name](identity)).otherwise(value)
    value = trend(value, F.col("i"), F.coalesce("trend_slope", F.lit(0.0)))
    value = F.when(F.col("season_period") > 0, season(value, F.col("i"), F.col("season_period"), F.col("season_amplitude"))).otherwise(value)
    value = F.when(F.col("noise_std") > 0, value + F.col("noise_std") * hash_normal(F.lit("z"), *identity)).otherwise(value)
    return inject_anomalies(rows.withColumn("value", value), identity)


def inject_anomalies(rows: DataFrame, identity: list[Column]) -> DataFrame:
    """Adds U(-m, m) to exactly max(1, int(n f)) ticks of a segment, then clips."""
    hit = rows.where(F.col("anomaly_fraction") > 0)
    ranked = number_rows(hit.withColumn("__h", hash_uniform(F.lit("pick"), *identity)),
                         ["series_id", "seq"], ["__h", "i"], "__rank", small=False)  # the size of a plan's tables says nothing of generated rows
    k = F.greatest(F.lit(1), F.floor(F.col("n") * F.col("anomaly_fraction")))
    jump = (hash_uniform(F.lit("jump"), *identity) * 2.0 - 1.0) * F.col("anomaly_magnitude")
    changed = ranked.withColumn("value", F.when(F.col("__rank") < k, F.col("value") + jump).otherwise(F.col("value")))
    calm = rows.where(~F.coalesce(F.col("anomaly_fraction") > 0, F.lit(False)))
    both = calm.unionByName(changed.drop("__h", "__rank"))
    clipped = F.least(F.greatest(F.col("value"), F.coalesce("clip_low", F.col("value"))),
                      F.coalesce("clip_high", F.greatest(F.col("value"), F.coalesce("clip_low", F.col("value")))))
    return both.select("series_id", "seq", "i", clipped.alias("value"))


def bridges(spec: DataFrame, values: DataFrame, length: int, method: str) -> DataFrame:
    """``series_id, seq, i, value``: points between a segment and the one before it."""
    edges = values.join(spec.select("series_id", "seq", "n"), ["series_id", "seq"]).groupBy("series_id", "seq").agg(
        F.max(F.when(F.col("i") == 0, F.col("value"))).alias("__first"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("value"))).alias("__last"))
    wide = scan(edges, ["series_id"], ["seq"], {"__left": previous(F.col("__last"))})
    points = wide.where(F.col("__left").isNotNull()).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    return points.select("series_id", "seq", "i",
                         bridge(F.col("__left"), F.col("__first"), F.col("i"), F.lit(length), method).alias("value"))


def compose(spec: DataFrame, bridge_length: int = 0, bridge_method: str = "cosine",
            generators: tuple[str, ...] = tuple(GENERATORS)) -> DataFrame:
    """``series_id, tick, value`` of all segments in order, with bridges between them."""
    bounds = segment_bounds(spec, bridge_length).select("series_id", "seq", "start_tick")
    values = segment_values(spec, generators)
    placed = values.join(bounds, ["series_id", "seq"]).select(
        "series_id", (F.col("start_tick") + F.col("i")).alias("tick"), "value")
    if bridge_length == 0:
        return placed
    between = bridges(spec, values, bridge_length, bridge_method).join(bounds, ["series_id", "seq"]).select(
        "series_id", (F.col("start_tick") - bridge_length + F.col("i")).alias("tick"), "value")
    return placed.unionByName(between)
