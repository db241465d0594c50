"""Rebuilding a dense signal from the ticks that were read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scans import last_known, next_known, number_rows, scan
from tickloom.session import MAX_RANGES, cut, is_small, is_small_union, task_count

KEYS = ("series_id",)
# Points of a block, windows that meet one copy of it, and results of a task (about) where windows overlap.
BLOCK_ROWS = 1 << 10
PART_WINDOWS = 1 << 16
TASK_ROWS = 1 << 27


def hold_last(df: DataFrame, by: Sequence[str] = KEYS, value: str = "value",
              sampled: str = "sampled", name: str = "held") -> DataFrame:
    """Zero-order hold: the latest read value; before the first read, the first one."""
    return hold_masks(df, by, {name: F.col(sampled)}, value)


def hold_masks(df: DataFrame, by: Sequence[str], masks: Mapping[str, Column], value: str = "value") -> DataFrame:
    """Zero-order holds of several masks, one column each, from one scan over the rows."""
    specs = {}
    for n, mask in masks.items():
        seen = F.when(mask, F.col(value))
        specs |= {f"__last_{n}": last_known(seen), f"__next_{n}": next_known(seen)}
    wide = scan(df, by, ["tick"], specs, "tick")
    kept = [c for c in df.columns if c not in masks]
    return wide.select(*kept, *[F.coalesce(f"__last_{n}", f"__next_{n}").alias(n) for n in masks])


def lerp(x: Column, left: Column, right: Column) -> Column:
    """Line through two (x, y) structs; a missing side is held constant."""
    run = right["x"] - left["x"]
    inner = left["y"] + (right["y"] - left["y"]) * (x - left["x"]) / run
    return (
        F.when(left.isNull(), right["y"])
        .when(right.isNull() | (run == 0), left["y"])
        .otherwise(inner)
    )


def interpolate(
    df: DataFrame,
    by: Sequence[str],
    known: Mapping[str, Column],
    x: str = "tick",
    position: str | None = "tick",
) -> DataFrame:
    """Fill each column of ``known`` (NULL where unknown) linearly along ``x``.

    Values outside the known range are held; a series without known values gets 0.
    """
    at = F.col(x).cast("double")
    specs = {}
    for n, c in known.items():
        point = F.when(c.isNotNull(), F.struct(at.alias("x"), c.cast("double").alias("y")))
        specs[f"__l_{n}"] = last_known(point)
        specs[f"__r_{n}"] = next_known(point)
    wide = scan(df, by, [x], specs, position)
    filled = [
        F.coalesce(lerp(at, F.col(f"__l_{n}"), F.col(f"__r_{n}")), F.lit(0.0)).alias(n)
        for n in known
    ]
    return wide.select(*df.columns, *filled)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    take: Sequence[str],
    strict: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row (``strict``: before)."""
    by = list(by)
    payload = F.struct(*[F.col(c) for c in take])
    lrows = left.select(*by, on, F.struct("*").alias("__row"), F.lit(0 if strict else 1).alias("__side"))
    rrows = right.select(*by, on, payload.alias("__hit"), F.lit(1 if strict else 0).alias("__side"))
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    wide = scan(both, by, [on, "__side"], {"__found": last_known(F.col("__hit"))},
                small=is_small_union(both, [left, right], by) if small is None else small)
    return wide.where(F.col("__row").isNotNull()).select(
        "__row.*", *[F.col(f"__found.{c}").alias(c) for c in take])


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str,
                 take: Sequence[str]) -> DataFrame:
    """Earliest ``right`` row at or after each ``left`` row."""
    by = list(by)
    payload = F.struct(*[F.col(c) for c in take])
    lrows = left.select(*by, on, F.struct("*").alias("__row"), F.lit(0).alias("__side"))
    rrows = right.select(*by, on, payload.alias("__hit"), F.lit(1).alias("__side"))
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    wide = scan(both, by, [on, "__side"], {"__found": next_known(F.col("__hit"))},
                small=is_small_union(both, [left, right], by))
    return wide.where(F.col("__row").isNotNull()).select(
        "__row.*", *[F.col(f"__found.{c}").alias(c) for c in take])


def _known(cols: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in cols])


def _same(pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(and_, [F.col(a) == F.col(b) for a, b in pairs])


def _point_blocks(points: DataFrame, by: list[str], on: str, rest: list[str], small: bool) -> DataFrame:
    """Consecutive points of a key in ``__block``s of ``BLOCK_ROWS``: an array of ``on``, one of each other column."""
    # other columns break ties, so that a point stays in its block if a task is run again
    ties = [c for c, kind in points.dtypes if c in rest and "map<" not in kind]
    numbered = number_rows(points.where(_known([*by, on])), by, [on, *ties], "__n", small)
    blocks = numbered.groupBy(*by, F.floor(F.col("__n") / F.lit(BLOCK_ROWS)).alias("__block")).agg(
        F.min(on).alias("__first"), F.collect_list(F.struct(on, *rest)).alias("__rows"))
    arrays = [F.col("__rows").getField(c).alias(f"__p{i}") for i, c in enumerate([on, *rest])]
    return blocks.select(*by, "__block", "__first", *arrays)


def _place_windows(windows: DataFrame, blocks: DataFrame, by: list[str], small: bool) -> DataFrame:
    """Windows with the first and the last block that may hold points of them (``__low``, ``__high``).

    Points before the last block that begins before a window are before the window, ties included.
    """
    first = blocks.groupBy(*by, F.col("__first").alias("__x")).agg(F.max("__block").alias("__before"))
    first = first if small else cut(first)
    for edge, name in (("__start", "__low"), ("__end", "__high")):
        windows = asof_backward(windows.withColumn("__x", F.col(edge)), first, by, "__x", ["__before"], strict=True,
                                small=small or None).withColumnRenamed("__before", name)
    return windows.where(F.col("__high").isNotNull()).drop("__x").withColumn("__low", F.coalesce("__low", F.lit(0)))


def overlap_join(points: DataFrame, windows: DataFrame, by: Sequence[str], on: str, start: str, end: str,
                 take: Sequence[str], how: str = "inner") -> DataFrame:
    """Points with every window ``[start, end)`` of their key that holds them, however the windows overlap.

    The points of a window are consecutive in the order of ``on``, so points are cut into blocks of consecutive ones and a
    window is sent to the blocks from its start to its end: one row for up to ``BLOCK_ROWS`` results, and a point moves with
    its block, not once for each length of window. Only in the blocks at its two ends a window meets points that it does not
    hold. In large inputs a copy of a block meets ``PART_WINDOWS`` windows at most, so a crowded moment is split as well.
    Windows that are empty or lack an end hold nothing; ``how`` is ``inner`` or ``left``.
    """
    by = list(by)
    rest = [c for c in points.columns if c not in (*by, on)]
    small = is_small(points) and is_small(windows)
    blocks = _point_blocks(points, by, on, rest, small)
    taken = [f"__w{i}" for i in range(len(take))]
    sized = windows.where(_known([*by, start, end]) & (F.col(start) < F.col(end))).select(
        *by, F.col(start).alias("__start"), F.col(end).alias("__end"), *[F.col(c).alias(w) for c, w in zip(take, taken)])
    if not small:
        blocks, sized = cut(blocks), cut(sized)
    placed, tasks, part, of = _place_windows(sized, blocks, by, small), task_count(points), [], []
    if not small:
        part, of = ["__part"], ["__of"]
        placed = cut(placed.withColumn("__part", F.floor(F.monotonically_increasing_id() / F.lit(PART_WINDOWS))))
        pairs = placed.agg(F.sum(F.col("__high") - F.col("__low") + 1)).first()[0] or 0
        tasks = max(tasks, min(MAX_RANGES, pairs * BLOCK_ROWS // TASK_ROWS))
    keys, home = [*[f"__k{i}" for i in range(len(by))], "__at", *part], [*by, "__block", *of]
    sent = placed.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *part, "__start", "__end", *taken,
                         F.explode(F.sequence("__low", "__high")).alias("__at"))
    met = blocks.drop("__first")
    if not small:
        asked = sent.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys[:-1])], F.col("__part").alias("__of")).distinct()
        met = met.join(asked.hint("merge"), _same((c, f"__q{i}") for i, c in enumerate(home[:-1]))).select(*met.columns, *of)
    # merged, and in a number of tasks that counts results: sizes of files say nothing of the rows that a pair gives
    pair = sent.repartition(tasks, *keys).join(met.repartition(tasks, *home).hint("merge"), _same(zip(keys, home)))
    each = pair.select("*", F.posexplode("__p0").alias("__i", "__x")).where(
        (F.col("__x") >= F.col("__start")) & (F.col("__x") < F.col("__end")))
    values = {on: F.col("__x")} | {c: F.col(f"__p{i}")[F.col("__i")] for i, c in enumerate(rest, 1)}
    hit = each.select(*[values.get(c, F.col(c)).alias(c) for c in points.columns], *[F.col(w).alias(c) for w, c in zip(taken, take)])
    if how == "inner":
        return hit
    none = points.join(hit.select(*by, on).distinct(), [*by, on], "left_anti")
    return hit.unionByName(none, allowMissingColumns=True)


def interval_join(points: DataFrame, windows: DataFrame, by: Sequence[str], on: str,
                  start: str, end: str, take: Sequence[str], how: str = "inner") -> DataFrame:
    """Points inside ``[start, end)`` of windows that do not overlap within ``by``.

    The last window that began is the only candidate, so this is an as-of look-up
    and one row per point is moved, whatever the number of windows. Where windows
    may overlap, ``overlap_join`` finds them all.
    """
    extra = [c for c in (start, end) if c not in take]
    ranges = windows.withColumn(on, F.col(start)) if start != on else windows
    hit = asof_backward(points, ranges.select(*by, on, *take, *extra), by, on, [*take, *extra])
    inside = F.col(start).isNotNull() & (F.col(on) < F.col(end))
    if how == "inner":
        return hit.where(inside).drop(*extra)
    kept = [F.when(inside, F.col(c)).alias(c) for c in take]
    return hit.select(*points.columns, *kept)
