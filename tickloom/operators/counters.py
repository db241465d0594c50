"""Turning successive counter snapshots into rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators.fidelity import mark_runs
from tickloom.operators.scans import previous, running_sum, scan


def with_deltas(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str],
                position: str | None = None) -> DataFrame:
    """Adds ``d_<column>``: difference to the snapshot before (NULL on the first)."""
    wide = scan(df, by, [order], {f"__p_{c}": previous(F.col(c)) for c in columns}, position)
    return wide.select(*df.columns, *[(F.col(c) - F.col(f"__p_{c}")).alias(f"d_{c}") for c in columns])


def busy_percent(df: DataFrame, by: Sequence[str], order: str, position: str | None = None) -> DataFrame:
    """CPU busy share from ``total, idle, iowait`` counters; 0 when nothing elapsed."""
    snap = df.withColumn("__idle", F.col("idle") + F.col("iowait"))
    d = with_deltas(snap, by, order, ["total", "__idle"], position)
    busy = F.when(F.col("d_total") == 0, F.lit(0.0)).otherwise(
        (F.lit(1.0) - safe_div(F.col("d___idle"), F.col("d_total"))) * 100.0)
    return d.withColumn("busy_pct", busy).drop("__idle", "d_total", "d___idle")


def used_percent(total: Column, available: Column, free: Column) -> Column:
    """Gauge: (1 - available / total) percent, free memory when available is missing."""
    return F.when(total > 0, (F.lit(1.0) - safe_div(F.coalesce(available, free), total)) * 100.0).otherwise(0.0)


def summed_rate(df: DataFrame, by: Sequence[str], order: str, seconds: Column, amount: Column,
                keep: Column | None = None) -> DataFrame:
    """Rate of a counter summed over devices: d(sum) / d(seconds), 0 when time stands still."""
    rows = df if keep is None else df.where(keep)
    total = rows.groupBy(*by, order).agg(F.sum(amount).alias("__sum"), F.max(seconds).alias("__sec"))
    d = with_deltas(total, by, order, ["__sum", "__sec"])
    rate = F.when(F.col("d___sec").isNull(), F.lit(None)).when(F.col("d___sec") <= 0, F.lit(0.0)).otherwise(
        safe_div(F.col("d___sum"), F.col("d___sec")))
    return d.select(*by, order, rate.alias("rate"))


def cpu_fraction(df: DataFrame, by: Sequence[str], order: str, usage_us: str, seconds: str,
                 position: str | None = None) -> DataFrame:
    """Cores used: d(usage us) / 1e6 / d(seconds); may exceed one."""
    d = with_deltas(df, by, order, [usage_us, seconds], position)
    rate = F.when(F.col(f"d_{seconds}") <= 0, F.lit(0.0)).otherwise(
        safe_div(F.col(f"d_{usage_us}") / 1e6, F.col(f"d_{seconds}")))
    return d.withColumn("cpu_fraction", rate).drop(f"d_{usage_us}", f"d_{seconds}")


def memory_use(current: Column, limit: Column) -> Column:
    """Percent of the limit where there is one, else MiB."""
    return F.when(limit > 0, safe_div(current, limit) * 100.0).otherwise(current / 1048576.0)


def fleet_cpu(df: DataFrame, member: str, at: str, usage_us: str, seconds: str) -> DataFrame:
    """CPU percent per member and in total (member NULL) at each sweep.

    The first snapshot of a member and negative steps (a restarted counter) give nothing.
    """
    d = with_deltas(df, [member], at, [usage_us, seconds])
    ok = (F.col(f"d_{usage_us}") >= 0) & (F.col(f"d_{seconds}") > 0)
    pct = safe_div(F.col(f"d_{usage_us}") / 1e6, F.col(f"d_{seconds}")) * 100.0
    return d.where(ok).withColumn("__pct", pct).rollup(at, member).agg(
        F.sum("__pct").alias("cpu_pct"), F.grouping(at).alias("__all")).where(F.col("__all") == 0).drop("__all")


def interval_accounting(df: DataFrame, by: Sequence[str], order: str,
                        position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Host, own and foreign busy share per interval, and the rejected intervals.

    Needs ``total, busy, own, identity`` counters; an interval with a counter that runs
    backwards, no elapsed total, or another identity is rejected.
    """
    wide = scan(df, by, [order], {f"__p_{c}": previous(F.col(c)) for c in ("total", "busy", "own", "identity")}, position)
    d = lambda c: F.col(c) - F.col(f"__p_{c}")
    seen = wide.where(F.col("__p_total").isNotNull())
    bad = (d("total") <= 0) | (d("busy") < 0) | (d("own") < 0) | (F.col("identity") != F.col("__p_identity"))
    marked = seen.withColumn("__bad", bad)
    foreign = F.greatest(F.lit(0.0), (d("busy") - d("own")).cast("double"))
    good = marked.where(~F.col("__bad")).select(
        *by, order, d("busy").alias("busy_ticks"), d("own").alias("own_ticks"), foreign.alias("foreign_ticks"),
        safe_div(d("busy"), d("total")).alias("busy_fraction"),
        safe_div(d("own"), d("total")).alias("own_fraction"),
        safe_div(foreign, d("total")).alias("foreign_fraction"))
    return good, marked.where(F.col("__bad")).select(*by, order)


def sustained(df: DataFrame, by: Sequence[str], tick: str, over: Column, k: int) -> DataFrame:
    """Ticks at which the k-th (or later) consecutive flagged interval is reached."""
    rows = df if tick == "tick" else df.withColumnRenamed(tick, "tick")
    marked = mark_runs(rows, by, over)
    alarm = F.col("run_start").isNotNull() & (F.col("tick") - F.col("run_start") + 1 >= k)
    out = marked.withColumn("alarm", F.coalesce(alarm, F.lit(False))).drop("run_start")
    return out if tick == "tick" else out.withColumnRenamed("tick", tick)


def process_cpu(df: DataFrame, by: Sequence[str], order: str, position: str | None = None) -> DataFrame:
    """CPU percent and cumulative seconds of a process from ``user_s, system_s, total_s, wall_s``.

    A missing total is user + system; a missing user share is the whole total, a
    missing system share the rest of it.
    """
    zero = F.lit(0.0)
    total = F.coalesce("total_s", F.col("user_s") + F.col("system_s"))
    filled = df.withColumn("__total", total)
    d = with_deltas(filled, by, order, ["__total", "wall_s"], position)
    used = F.greatest(zero, F.col("d___total"))
    pct = F.greatest(zero, used / F.greatest(F.col("d_wall_s").cast("double"), F.lit(1e-9)) * 100.0)
    user = F.coalesce("user_s", F.greatest(F.col("__total"), zero))
    return d.select(*by, order, F.when(used.isNotNull() & F.col("d_wall_s").isNotNull(), pct).alias("cpu_pct"),
                    user.alias("user_total_s"),
                    F.coalesce(F.col("system_s"), F.greatest(F.col("__total") - user, zero)).alias("system_total_s"),
                    F.col("__total").alias("cpu_total_s"))


def per_tick_value(df: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Counter value of a read divided by the ticks since the last read."""
    kept = df.where("sampled")
    wide = scan(kept, by, ["tick"], {"__pt": previous(F.col("tick"))}, "tick")
    window = F.coalesce(F.col("tick") - F.col("__pt"), F.lit(1))
    return wide.withColumn("sample_window_ticks", window.cast("long")).withColumn(
        "per_tick", F.col("value") / F.greatest(F.lit(1), window)).drop("__pt")


def cumulative(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str = "counter",
               position: str | None = None) -> DataFrame:
    return scan(df, by, [order], {name: running_sum(value)}, position)
