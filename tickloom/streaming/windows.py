"""Windowed aggregates that read the same on a stream and on a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling_counts(rows: DataFrame, ts: str, width: str, by: Sequence[str] = (), kinds: Sequence[str] | None = None,
                    kind: str = "event_type", delay: str | None = None) -> DataFrame:
    """Events per tumbling base tick; with ``delay`` the stream keeps state only that long."""
    kept = rows if kinds is None else rows.where(F.col(kind).isin(*kinds))
    timed = kept if delay is None else kept.withWatermark(ts, delay)
    return timed.groupBy(*by, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        *by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding_scores(rows: DataFrame, ts: str, width: str, stride: str, by: Sequence[str], odd: Column, urgency: str,
                   weight: float, delay: str | None = None) -> DataFrame:
    """Region score of every sliding time window: anomalies * 2 + (max + std of urgency) * weight."""
    timed = rows if delay is None else rows.withWatermark(ts, delay)
    anomalies = F.sum(F.when(odd, 1).otherwise(0))
    return timed.groupBy(*by, F.window(ts, width, stride).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), anomalies.alias("anomalies"),
        (anomalies * 2.0 + F.max(urgency) * weight + F.stddev_pop(urgency) * weight).alias("score")).select(
        *by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "anomalies", "score")


def split_late(rows: DataFrame, second: str, horizon: int) -> DataFrame:
    """Seconds past the horizon are moved into the last bucket and marked."""
    late = F.col(second) > horizon
    return rows.withColumn("capped", late).withColumn(second, F.least(F.col(second), F.lit(horizon)))


def unmatched_within(rows: DataFrame, other: DataFrame, by: Sequence[str], ts: str, reach: str, delay: str, match: str) -> DataFrame:
    """Every row of a stream with the column ``match`` of the rows of ``other`` up to ``reach`` before it; null if there is none.

    A stream-stream outer join: both sides keep rows only as long as their watermarks need them, and a row without
    a partner comes out once the watermark has passed it.
    """
    left = rows.withWatermark(ts, delay).alias("l")
    right = other.select(*by, ts, match).withWatermark(ts, delay).alias("r")
    near = (F.col(f"r.{ts}") <= F.col(f"l.{ts}")) & (F.col(f"r.{ts}") > F.col(f"l.{ts}") - F.expr(f"INTERVAL {reach}"))
    for k in by:
        near = near & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.join(right, near, "leftOuter").select("l.*", F.col(f"r.{match}").alias(f"matched_{match}"))
