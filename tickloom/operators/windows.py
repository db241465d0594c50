"""Window-shaped operators: smoothing, trimming, change points, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scans import group_stats, halo_windows, last_known, next_known, previous, scan


def centred_mean(df: DataFrame, by: Sequence[str], tick: str, value: str, width: int, name: str = "smooth") -> DataFrame:
    """Centred moving average with zero-padded edges; series shorter than the width stay as they are."""
    by = list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    summed = halo_windows(df, by, tick, width // 2, (width - 1) // 2, {"__s": F.sum(value)}).join(n, by)
    return summed.withColumn(name, F.when(F.col("__n") < width, F.col(value)).otherwise(F.col("__s") / width)).drop("__s", "__n")


def trim_start(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Cut the ramp-up: start at the first forward average >= p10 + (p90 - p10) / 4.

    Input needs a dense ``tick``. Short (< 6 points) and flat series keep all points.
    ``x`` is shifted to start at 0; ``trim_x`` is the x of the first kept point.
    """
    by = list(by)
    stats = group_stats(df, by, [F.count(F.lit(1)).alias("__n")],
                        {"__p10": (F.col(y), 0.1), "__p90": (F.col(y), 0.9)})
    sums = halo_windows(df, by, "tick", 0, 6, {f"__s{w}": (F.sum(y), 0, w - 1) for w in range(3, 8)})
    spread = F.col("__p90") - F.col("__p10")
    flat = (F.col("__n") < 6) | (spread <= F.greatest(F.abs("__p90") * 0.05, F.lit(1e-6)))
    width = F.greatest(F.lit(3), F.least(F.lit(7), F.floor(F.col("__n") / 8)))
    total = F.element_at(F.array(*[F.col(f"__s{w}") for w in range(3, 8)]), (width - 2).cast("int"))
    high = (F.col("tick") + width <= F.col("__n")) & (total / width >= F.col("__p10") + spread * 0.25)
    begin = sums.join(stats, by).groupBy(*by).agg(
        F.coalesce(F.min(F.when(high & ~flat, F.col("tick"))), F.lit(0)).alias("__begin"))
    kept = df.join(begin, by).where(F.col("tick") >= F.col("__begin"))
    first = kept.where(F.col("tick") == F.col("__begin")).select(*by, F.col(x).alias("trim_x"))
    return kept.join(first, by).withColumn(x, F.col(x) - F.col("trim_x")).drop("__begin")


def fill_valid(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Forward fill of the last observation >= 1; before any, 1."""
    specs = {f"__f_{c}": last_known(F.when(F.col(c) >= 1, F.col(c))) for c in columns}
    wide = scan(df, by, [order], specs)
    keep = [c for c in df.columns if c not in columns]
    return wide.select(*keep, *[F.coalesce(f"__f_{c}", F.lit(1)).cast("int").alias(c) for c in columns])


def change_points(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows where the value rose or fell, with direction and size."""
    wide = scan(df, by, [order], {"__p": previous(F.col(value))})
    step = F.col(value) - F.col("__p")
    return wide.where(step != 0).select(
        *by, order, F.when(step > 0, "up").otherwise("down").alias("direction"), step.alias("size"))


def flapping(df: DataFrame, by: Sequence[str], order: str, value: str, within: float = 60.0) -> DataFrame:
    """Number of rises followed by a fall within ``within`` seconds."""
    by = list(by)
    wide = scan(df, by, [order], {"__p": previous(F.col(value))})
    falls = F.when(F.col(value) < F.col("__p"), F.col(order))
    ahead = scan(wide, by, [order], {"__fall": next_known(falls, inclusive=False)})
    flap = (F.col(value) > F.col("__p")) & (F.col("__fall") - F.col(order) <= within)
    return ahead.groupBy(*by).agg(F.count(F.when(flap, 1)).alias("flapping_events"))


def rolling_share(df: DataFrame, by: Sequence[str], tick: str, flag: Column, width: int, name: str) -> DataFrame:
    """Share of flagged rows among the last ``width`` rows (numbered by ``tick``)."""
    return halo_windows(df, by, tick, width - 1, 0, {name: F.avg(F.when(flag, 1.0).otherwise(0.0))})


def history_median(df: DataFrame, by: Sequence[str], tick: str, value: str, width: int, name: str) -> DataFrame:
    """Upper-middle element of the last ``width`` values (numbered by ``tick``)."""
    lists = halo_windows(df, by, tick, width - 1, 0, {"__l": F.collect_list(value)})
    middle = F.get(F.sort_array("__l"), F.floor(F.size("__l") / 2).cast("int"))
    return lists.withColumn(name, middle).drop("__l")


def region_scores(df: DataFrame, by: Sequence[str], window: int, stride: int) -> DataFrame:
    """Score of each window start: anomalies * 2 + max urgency * W + std of urgency * W."""
    by = list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    k = F.col("tick")
    first = F.greatest(F.lit(0), F.ceil((k - window + 1) / stride))
    starts = F.sequence(first, F.floor(k / stride))
    odd = F.coalesce(F.col("status").isin("OUTLIER", "DRIFT_RESET"), F.lit(False))
    spread = df.join(n, by).withColumn("__k", F.explode(starts)).withColumn("start", F.col("__k") * stride).where(F.col("start") + window <= F.col("__n"))
    w = F.lit(float(window))
    anomalies = F.sum(F.when(odd, 1).otherwise(0))
    return spread.groupBy(*by, "start").agg(
        anomalies.alias("anomalies"),
        (anomalies * 2.0 + F.max("urgency") * w + F.stddev_pop("urgency") * w).alias("score"))


def best_variance_window(df: DataFrame, by: Sequence[str], configs: str, value: str, window: int) -> DataFrame:
    """Start of the window with the largest variance summed over configurations."""
    by = list(by)
    keys = by + [configs]
    frames = halo_windows(df, keys, "tick", 0, window - 1, {
        "__var": F.var_pop(value), "__len": F.count(F.lit(1))})
    full = frames.where(F.col("__len") == window)
    total = full.groupBy(*by, F.col("tick").alias("start")).agg(F.sum("__var").alias("total_variance"))
    # the earliest of equal windows wins
    return total.groupBy(*by).agg(
        F.max_by("start", F.struct(F.rint(F.col("total_variance") * 1e6), -F.col("start"))).alias("start"),
        F.max("total_variance").alias("total_variance"))
