"""Ordered scans over keyed rows that never need one whole key in one task.

Numbering, look-back, look-ahead and running totals over ``(key, order)`` are
windows. A window puts a key into one task, so a key that holds a third of a
large table would stop the job. Each operator here has two plans with equal results:

* *single* - one plain window per key, for inputs of a checked small size;
* *chunked* - a key is cut into consecutive chunks, each chunk is scanned in
  parallel, one summary row per chunk is scanned per key, and the summary of
  everything before (or after) a chunk is joined back to it.

Chunks come from an integer position (``tick div chunk``), or from a written
range partitioning of the rows when no such position exists yet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import chunk_ticks, cut, is_small, range_count

CHUNK = "__chunk"


@dataclass(frozen=True)
class Scan:
    """One output column of a scan."""

    kind: str  # last | next | sum | min | max | lag | lead
    expr: Column
    inclusive: bool = True


def last_known(expr: Column, inclusive: bool = True) -> Scan:
    """Latest non-null value at or before the row."""
    return Scan("last", expr, inclusive)


def next_known(expr: Column, inclusive: bool = True) -> Scan:
    """Earliest non-null value at or after the row."""
    return Scan("next", expr, inclusive)


def running_sum(expr: Column, inclusive: bool = True) -> Scan:
    return Scan("sum", expr, inclusive)


def running_min(expr: Column, inclusive: bool = True) -> Scan:
    return Scan("min", expr, inclusive)


def running_max(expr: Column, inclusive: bool = True) -> Scan:
    return Scan("max", expr, inclusive)


def suffix_min(expr: Column, inclusive: bool = True) -> Scan:
    """Minimum over the rows from here to the end of the key."""
    return Scan("sufmin", expr, inclusive)


def previous(expr: Column) -> Scan:
    """Value of the row before (NULL values included)."""
    return Scan("lag", expr, False)


def following(expr: Column) -> Scan:
    """Value of the row after (NULL values included)."""
    return Scan("lead", expr, False)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "sufmin": F.min}
_BACKWARD = {"next", "sufmin"}


def _upto(window, inclusive: bool):
    return window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def _inside(scan: Scan, by: Sequence[str], cols: Sequence[Column]) -> Column:
    """The scan over one window partition.

    Looking ahead is looking back in the reverse order: a frame that grows backwards is
    extended row by row, one that ends at the last row would be re-read for every row.
    """
    ahead = Window.partitionBy(*by).orderBy(*cols)
    if scan.kind == "lag":
        return F.lag(scan.expr).over(ahead)
    if scan.kind == "lead":
        return F.lead(scan.expr).over(ahead)
    window = Window.partitionBy(*by).orderBy(*[c.desc() for c in cols]) if scan.kind in _BACKWARD else ahead
    frame = _upto(window, scan.inclusive)
    if scan.kind in ("last", "next"):
        return F.last(scan.expr, ignorenulls=True).over(frame)
    return _AGG[scan.kind](scan.expr).over(frame)


def _summary(scan: Scan, order: Column) -> Column:
    """What one chunk hands to the chunks after (or before) it."""
    known = F.when(scan.expr.isNotNull(), order)
    if scan.kind == "last":
        return F.max_by(scan.expr, known)
    if scan.kind == "next":
        return F.min_by(scan.expr, known)
    if scan.kind == "lag":
        return F.max_by(F.struct(scan.expr.alias("v")), order)
    if scan.kind == "lead":
        return F.min_by(F.struct(scan.expr.alias("v")), order)
    return _AGG[scan.kind](scan.expr)


def _carry(scan: Scan, name: str, by: Sequence[str]) -> Column:
    """Summary of all chunks before (or, for look-ahead, after) a chunk."""
    back = scan.kind in _BACKWARD or scan.kind == "lead"
    order = F.col(CHUNK).desc() if back else F.col(CHUNK)
    frame = _upto(Window.partitionBy(*by).orderBy(order), inclusive=False)
    if scan.kind in _AGG:
        return _AGG[scan.kind](name).over(frame)
    return F.last(name, ignorenulls=True).over(frame)


def _combine(scan: Scan, inside: Column, carried: Column, edge: Column) -> Column:
    if scan.kind in ("last", "next"):
        return F.coalesce(inside, carried)
    if scan.kind in ("lag", "lead"):
        return F.when(edge, carried.getField("v")).otherwise(inside)
    if scan.kind == "sum":
        return F.when(inside.isNull(), carried).otherwise(
            F.when(carried.isNull(), inside).otherwise(inside + carried))
    pick = F.greatest if scan.kind == "max" else F.least
    return pick(inside, carried)


def range_chunks(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``__chunk``: consecutive row ranges of about equal size, written once.

    Order columns sort ascending; for a descending number pass its negative.
    Spark samples the sort key, so a hot key (or a hot moment) is spread over as
    many ranges as its share of the rows. The written copy fixes the ranges for
    every later pass, also when executors are lost.
    """
    keyed = df.select("*", *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    names = [f"__o{i}" for i in range(len(order))]
    ranged = keyed.repartitionByRange(range_count(df), *by, *names)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id().cast("long"))).drop(*names)


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    out: Mapping[str, Scan],
    position: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Add the columns ``out``, scanning each key in the given total order.

    ``position`` names a leading integer order column with few rows per value (a
    tick); without it the chunks are row ranges.
    """
    by = list(by)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if is_small(df, by) if small is None else small:
        return df.select("*", *[_inside(s, by, cols).alias(n) for n, s in out.items()])

    if position is not None:
        # written, as the rows are read twice: a replay below runs once however many scans stand on it
        size = chunk_ticks(df.sparkSession)
        chunked = cut(df.withColumn(CHUNK, F.floor(F.col(position) / F.lit(size))))
    else:
        chunked = range_chunks(df, by, cols)
    return scan_chunks(chunked, by, cols, out).drop(CHUNK)


def scan_chunks(chunked: DataFrame, by: list[str], cols: list[Column], out: Mapping[str, Scan]) -> DataFrame:
    """The chunked plan over rows that already carry ``__chunk``."""
    keys = by + [CHUNK]
    window = Window.partitionBy(*keys).orderBy(*cols)
    inside = chunked.select(
        "*",
        *[_inside(s, keys, cols).alias(f"__i_{n}") for n, s in out.items()],
        F.row_number().over(window).alias("__pos"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__len"),
    )
    # one plain column is compared without a struct, which lets Spark aggregate by hash
    order = cols[0] if len(cols) == 1 else F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])
    summary = chunked.groupBy(*keys).agg(*[_summary(s, order).alias(n) for n, s in out.items()])
    carried = summary.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[_carry(s, n, by).alias(f"__c_{n}") for n, s in out.items()],
    )
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & inside[k].eqNullSafe(carried[f"__k{i}"])
    edge = {"lag": F.col("__pos") == 1, "lead": F.col("__pos") == F.col("__len")}
    result = [
        _combine(s, F.col(f"__i_{n}"), F.col(f"__c_{n}"), edge.get(s.kind, F.lit(False))).alias(n)
        for n, s in out.items()
    ]
    kept = [F.col(c) for c in chunked.columns]
    return inside.join(carried, match, "left").select(*kept, *result)


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    name: str = "tick",
    small: bool | None = None,
) -> DataFrame:
    """Zero-based position of each row inside its key.

    The chunked plan numbers each row range on its own and adds the count of the
    key's rows in earlier ranges. Only a key that continues across a range border
    needs that offset, so there are at most as many offsets as ranges and the
    table of them is broadcast whatever the size of the data.
    """
    by = list(by)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if is_small(df, by) if small is None else small:
        window = Window.partitionBy(*by).orderBy(*cols)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))

    ranged = range_chunks(df, by, cols)
    keys = by + [CHUNK]
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("__skip", F.sum("__n").over(before))
        .where(F.col("__skip").isNotNull())
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__skip")
    )
    inside = ranged.withColumn(
        "__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*cols)) - 1)
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & inside[k].eqNullSafe(offsets[f"__k{i}"])
    kept = [F.col(c) for c in df.columns]
    number = (F.col("__pos") + F.coalesce(F.col("__skip"), F.lit(0))).cast("long")
    return inside.join(F.broadcast(offsets), match, "left").select(*kept, number.alias(name))


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column,
    points: Mapping[str, float],
    small: bool | None = None,
) -> DataFrame:
    """Exact linear-interpolation percentiles per key (NULL values left out).

    Every key keeps its row, NULL keys too; a key without values has NULL percentiles. The built-in ``percentile`` keeps all distinct values of a group in one
    buffer; above the small size the order statistics are found by position.
    """
    by = list(by)
    if is_small(df, by) if small is None else small:
        return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in points.items()])

    # written, as it is read three times; few values of a large input (a summary) then need no ranks
    plain = cut(df.select(*by, value.cast("double").alias("__v")))
    if small is None and is_small(plain):
        return percentiles(plain, by, F.col("__v"), points, small=True)
    groups = plain.select(*by).distinct() if by else plain.sparkSession.range(1).select()
    known = plain.where(F.col("__v").isNotNull())
    ranked = number_rows(known.withColumn("__id", F.monotonically_increasing_id()),
                         by, ["__v", "__id"], "__rank", small=False)
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    wanted = sizes.select(
        *by,
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"),
                     (F.lit(p) * (F.col("__n") - 1)).alias("at")) for n, p in points.items()
        ])).alias("w"),
    ).select(*by, F.col("w.name").alias("__name"), F.col("w.at").alias("__at"))
    sides = wanted.select(
        *by, "__name", "__at",
        F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank"))
    sides = sides.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(by)], "__name", "__at", F.col("__rank").alias("__side"))
    match = F.col("__rank") == F.col("__side")
    for i, k in enumerate(by):
        match = match & F.col(k).eqNullSafe(F.col(f"__s{i}"))
    found = ranked.join(sides, match)
    frac = F.col("__at") - F.floor("__at")
    weight = F.when(F.floor("__at") == F.ceil("__at"), F.lit(1.0)).otherwise(
        F.when(F.col("__rank") == F.floor("__at"), 1.0 - frac).otherwise(frac))
    exact = found.groupBy(*by).agg(*[
        F.sum(F.when(F.col("__name") == n, F.col("__v") * weight)).alias(n) for n in points
    ])
    return _join_groups(groups, exact, by, list(points))


def rank_share(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank",
    small: bool | None = None,
) -> DataFrame:
    """One-based rank of each row inside its key."""
    return number_rows(df, by, order, name, small).withColumn(name, F.col(name) + 1)


def group_stats(
    df: DataFrame,
    by: Sequence[str],
    stats: Sequence[Column],
    points: Mapping[str, tuple[Column, float]],
    small: bool | None = None,
) -> DataFrame:
    """Aggregates and exact percentiles of one grouping in one result."""
    by = list(by)
    small = is_small(df, by) if small is None else small
    if small:
        exact = [F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in points.items()]
        return df.groupBy(*by).agg(*stats, *exact)
    result = df.groupBy(*by).agg(*stats)
    groups: dict[str, tuple[Column, dict[str, float]]] = {}
    for n, (c, p) in points.items():
        groups.setdefault(str(c), (c, {}))[1][n] = p
    for c, wanted in groups.values():
        found = percentiles(df, by, c, wanted, small=False)
        result = _join_groups(result, found, by, list(wanted))
    return result


def _join_groups(left: DataFrame, right: DataFrame, by: list[str], take: list[str]) -> DataFrame:
    keys = [F.col(k) for k in by] or [F.lit(0)]
    renamed = right.select(*[k.alias(f"__g{i}") for i, k in enumerate(keys)], *take)
    keyed = left.select("*", *[k.alias(f"__h{i}") for i, k in enumerate(keys)])
    match = F.lit(True)
    for i in range(len(keys)):
        match = match & F.col(f"__h{i}").eqNullSafe(F.col(f"__g{i}"))
    extra = [f"__g{i}" for i in range(len(keys))] + [f"__h{i}" for i in range(len(keys))]
    return keyed.join(renamed, match, "left").drop(*extra)


def halo_windows(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    before: int,
    after: int,
    out: Mapping[str, Column | tuple[Column, int, int]],
    small: bool | None = None,
) -> DataFrame:
    """Bounded frames over a dense integer position, one row per position.

    ``out`` maps a name to an aggregate (or offset function) over the frame
    ``[-before, after]``, or to ``(expression, low, high)`` with a smaller frame. In
    the chunked plan a chunk also receives the few rows around its borders, so the
    data is moved once and a frame never needs a whole key.
    """
    by = list(by)

    def columns(window) -> list[Column]:
        cols = []
        for n, spec in out.items():
            expr, low, high = spec if isinstance(spec, tuple) else (spec, -before, after)
            cols.append(expr.over(window.rowsBetween(low, high)).alias(n))
        return cols

    if is_small(df, by) if small is None else small:
        window = Window.partitionBy(*by).orderBy(position)
        return df.select("*", *columns(window))

    size = F.lit(max(chunk_ticks(df.sparkSession), before + after + 1))
    at = F.col(position)
    home = F.floor(at / size)
    needed = F.sequence(F.floor((at - after) / size), F.floor((at + before) / size))
    spread = df.select("*", home.alias("__home"), F.explode(needed).alias(CHUNK))
    window = Window.partitionBy(*by, CHUNK).orderBy(position)
    wide = spread.select("*", *columns(window))
    return wide.where(F.col("__home") == F.col(CHUNK)).drop("__home", CHUNK)


def with_size(df: DataFrame, by: Sequence[str], name: str, small: bool | None = None) -> DataFrame:
    """Adds the number of rows of the key."""
    by = list(by)
    if is_small(df, by) if small is None else small:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return _join_groups(df, sizes, by, [name])
