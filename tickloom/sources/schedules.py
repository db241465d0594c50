"""Load schedules: phases, observed phases and transition windows. Phase tables are an input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.reconstruct import asof_forward, interval_join
from tickloom.operators.scans import next_known, previous, running_sum, scan


def phase_bounds(phases: DataFrame, by: Sequence[str] = ("shape",), order: str = "seq") -> DataFrame:
    """Adds ``start_s`` and ``end_s`` from the running total of the durations."""
    wide = scan(phases, by, [order], {"__end": running_sum(F.col("duration_s"))})
    return wide.withColumn("start_s", (F.col("__end") - F.col("duration_s")).cast("double")).withColumn(
        "end_s", F.col("__end").cast("double")).drop("__end")


def observed_phases(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Phases from their recorded start and end events; unpaired ones are left out."""
    by = list(by)
    starts = events.where(F.col("event") == "phase_start").select(
        *by, F.col("phase").alias("name"), F.col("observed_offset_s").alias("start_s"), "direction",
        F.col("scheduled_offset_s").alias("scheduled_start_s"))
    ends = events.where(F.col("event") == "phase_end").select(
        *by, F.col("phase").alias("name"), F.col("observed_offset_s").alias("end_s"),
        F.col("scheduled_offset_s").alias("scheduled_end_s"))
    return starts.join(ends, by + ["name"])


def effective_phases(static: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed bounds where recorded, the schedule's bounds elsewhere."""
    by = list(by)
    seen = observed.select(*by, "name", F.col("start_s").alias("__s"), F.col("end_s").alias("__e"))
    return static.join(seen, by + ["name"], "left").withColumn(
        "start_s", F.coalesce("__s", "start_s")).withColumn("end_s", F.coalesce("__e", "end_s")).drop("__s", "__e")


def transition_windows(phases: DataFrame, by: Sequence[str], horizon: str | None = None) -> DataFrame:
    """Non-stable phases, each lasting until the next of the same direction.

    The last one ends at ``horizon`` (a column), or at the end of the last phase.
    """
    by = list(by)
    last = phases.groupBy(*by).agg(F.max_by("end_s", "start_s").alias("__last"))
    moving = phases.where(F.col("direction") != "stable")
    wide = scan(moving, [*by, "direction"], ["start_s"],
                {"__next": next_known(F.col("start_s"), inclusive=False)})
    joined = wide.join(last, by)
    end = F.coalesce("__next", F.col(horizon) if horizon else F.col("__last"), F.col("__last"))
    return joined.withColumn("window_end_s", end).drop("__next", "__last")


def directional_windows(phases: DataFrame, by: Sequence[str], direction: str = "up") -> DataFrame:
    """Phases of one direction, extended through the stable phases that follow."""
    by = list(by)
    moves = F.col("direction") != "stable"
    ended = scan(phases, by, ["start_s"], {"__before": previous(F.col("end_s"))})
    moves = F.when(F.col("direction") != "stable", F.col("__before"))
    wide = scan(ended, by, ["start_s"], {"__until": next_known(moves, inclusive=False)})
    last = phases.groupBy(*by).agg(F.max_by("end_s", "start_s").alias("__last"))
    return (
        wide.where(F.col("direction") == direction).join(last, by)
        .withColumn("window_end_s", F.coalesce("__until", "__last"))
        .drop("__before", "__until", "__last")
    )


def stage_at(points: DataFrame, phases: DataFrame, by: Sequence[str], at: str = "elapsed_s") -> DataFrame:
    """Phase active at each point; NULL before the start and after the end."""
    return interval_join(points, phases, by, at, "start_s", "end_s", ["name", "users"], how="left")


def crossed_boundaries(clock: DataFrame, phases: DataFrame, by: Sequence[str], at: str = "elapsed_s") -> DataFrame:
    """Schedule events passed in (previous, current] of the clock readings.

    The reading that passes a boundary is the first one at or after it.
    """
    by = list(by)
    edges = phases.select(*by, F.explode(F.array(
        F.struct(F.lit("phase_start").alias("event"), F.col("name").alias("phase"), F.col("start_s").alias(at)),
        F.struct(F.lit("phase_end").alias("event"), F.col("name").alias("phase"), F.col("end_s").alias(at)),
    )).alias("e")).select(*by, "e.*")
    whole = phases.groupBy(*by).agg(F.max("end_s").alias("__end")).select(*by, F.explode(F.array(
        F.struct(F.lit("load_start").alias("event"), F.lit(None).cast("string").alias("phase"), F.lit(0.0).alias(at)),
        F.struct(F.lit("load_end").alias("event"), F.lit(None).cast("string").alias("phase"), F.col("__end").alias(at)),
    )).alias("e")).select(*by, "e.*")
    readings = clock.select(*by, at, F.col(at).alias("seen_at"))
    hit = asof_forward(edges.unionByName(whole), readings, by, at, ["seen_at"])
    return hit.where(F.col("seen_at").isNotNull()).withColumnRenamed(at, "scheduled_offset_s")
