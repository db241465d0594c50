"""Choosing the most interesting, non-overlapping regions of a trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import descending
from tickloom.operators.scans import number_rows


def pick_regions(scores: DataFrame, by: Sequence[str], window: int, count: int, min_gap: int) -> DataFrame:
    """Greedy top regions: best score first, skipping starts close to a chosen one.

    A chosen start blocks at most ``blocked`` other starts, so the best
    ``count * (blocked + 1)`` candidates of a series always contain the answer;
    only those few rows per series reach the pick, whatever the length of the trace.
    """
    by = list(by)
    starts = scores.select(*by, "start", "score")
    blocked = 2 * min_gap + 1  # starts are integers, so no more can lie within the gap
    ranked = number_rows(starts, by, [descending("score"), F.col("start")], "__rank")
    best = ranked.where(F.col("__rank") < count * (blocked + 1))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("__rank", "start", "score"))),
        lambda s: F.struct(s["start"].alias("start"), s["score"].alias("score")))
    row = "array<struct<start:bigint,score:double>>"
    chosen = F.aggregate(
        ordered, F.array().cast(row),
        lambda acc, s: F.when(
            (F.size(acc) < count) & ~F.exists(acc, lambda a: F.abs(a["start"] - s["start"]) < min_gap),
            F.concat(acc, F.array(s).cast(row))).otherwise(acc))
    picked = best.groupBy(*by).agg(chosen.alias("__c"))
    return picked.select(*by, F.explode("__c").alias("r")).select(
        *by, "r.start", (F.col("r.start") + window).alias("end"), "r.score")
