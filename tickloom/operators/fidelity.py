"""What is lost by not reading some ticks: the quality metrics of a kept-tick mask.

Every function takes rows ``by…, tick, value, sampled`` (one row per tick) and
returns one row per ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import descending, safe_corr, safe_div
from tickloom.operators.reconstruct import KEYS, hold_last, interpolate
from tickloom.operators.scans import group_stats, last_known, next_known, number_rows, previous, running_sum, scan, with_size
from tickloom.session import reuse

# Shares of the largest magnitudes that count as peaks.
PEAK_SHARES = (0.01, 0.02, 0.05, 0.10, 0.20)


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def sampling_gaps(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Kept ticks with the distance to the kept tick before (NULL on the first)."""
    kept = df.where("sampled").select(*by, "tick")
    return scan(kept, by, ["tick"], {"__prev": previous(F.col("tick"))}, "tick").select(
        *by, "tick", (F.col("tick") - F.col("__prev")).alias("gap"))


def _gap(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``gap``: on kept ticks, the distance to the kept tick before."""
    kept_at = F.when(F.col("sampled"), F.col("tick"))
    wide = scan(df, by, ["tick"], {"__prev": last_known(kept_at, inclusive=False)}, "tick")
    return wide.withColumn("gap", F.when(F.col("sampled"), F.col("tick") - F.col("__prev"))).drop("__prev")


def _efficiency(by: Sequence[str]) -> tuple[list[Column], dict, list[Column]]:
    """Aggregates, percentiles and final columns of the efficiency metrics."""
    gap = F.col("gap").cast("double")
    stats = [F.count(F.lit(1)).alias("n_total"), F.sum(_flag(F.col("sampled"))).alias("n_sampled"),
             F.max("gap").alias("__max"), F.avg(gap).alias("__mean")]
    n = F.col("n_total").cast("double")
    final = [
        F.col("n_total"), F.col("n_sampled"),
        (F.col("n_sampled") / F.col("n_total")).alias("sample_ratio"),
        F.coalesce("__max", "n_total").cast("long").alias("max_gap"),
        F.coalesce("__mean", n).alias("mean_gap"),
        F.coalesce("__p95", n).alias("p95_gap")]
    return stats, {"__p95": (gap, 0.95)}, final


def sampling_efficiency(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """n, kept, ratio and max / mean / p95 gap; with one kept tick the gaps equal n."""
    stats, points, final = _efficiency(by)
    return group_stats(_gap(df, by), by, stats, points).select(*by, *final)


def signal_range(by: Sequence[str], value: Column) -> Column:
    """max - min as an aggregate; an all but flat signal counts as range 1."""
    spread = F.max(value) - F.min(value)
    return F.when(spread < 1e-8, F.lit(1.0)).otherwise(spread)


def linear_reconstruction(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``recon``: linear interpolation through the kept ticks."""
    return interpolate(df, by, {"recon": F.when(F.col("sampled"), F.col("value"))})


def _rmse(by: Sequence[str], estimate: str, prefix: str) -> list[Column]:
    off = F.col("value") - F.col(estimate)
    rmse = F.sqrt(F.avg(off * off))
    return [rmse.alias(f"{prefix}_rmse"), (rmse / signal_range(by, F.col("value"))).alias(f"{prefix}_nrmse")]


def error_rmse(df: DataFrame, by: Sequence[str], estimate: str, prefix: str) -> DataFrame:
    return df.groupBy(*by).agg(*_rmse(by, estimate, prefix))


def linear_error(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return error_rmse(linear_reconstruction(df, by), by, "recon", "raw_recon")


def causal_error(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Error of the zero-order hold."""
    return error_rmse(hold_last(df, by), by, "held", "causal")


def peak_ranks(df: DataFrame, by: Sequence[str] = KEYS, small: bool | None = None) -> DataFrame:
    """Adds ``peak_rank`` (1 = largest magnitude, ties by tick) and ``n_ticks``."""
    ranked = number_rows(df, by, [descending(F.abs("value")), F.col("tick")], "__rank", small)
    return with_size(ranked, by, "n_ticks", small).withColumn("peak_rank", F.col("__rank") + 1).drop("__rank")


def top_count(share: float, n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(share)))


def peak_recall(df: DataFrame, by: Sequence[str] = KEYS,
                shares: Sequence[float] = PEAK_SHARES) -> DataFrame:
    """Share of the largest magnitudes whose tick was kept, for several set sizes."""
    return _ranked(df, by).groupBy(*by).agg(*_recalls(shares))


def _ranked(df: DataFrame, by: Sequence[str], small: bool | None = None) -> DataFrame:
    return df if "peak_rank" in df.columns else peak_ranks(df, by, small)


def _recalls(shares: Sequence[float]) -> list[Column]:
    return [
        F.avg(F.when(F.col("peak_rank") <= top_count(s, F.col("n_ticks")),
                     _flag(F.col("sampled")))).alias(f"recall_top{round(s * 100)}")
        for s in shares
    ]


def peak_recall_top5(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Recall of the n div 20 largest magnitudes."""
    ranked = peak_ranks(df, by)
    top = F.col("peak_rank") <= F.greatest(F.lit(1), F.floor(F.col("n_ticks") / 20))
    return ranked.groupBy(*by).agg(
        F.avg(F.when(top, _flag(F.col("sampled")))).alias("peak_recall_top5"))


def mark_runs(df: DataFrame, by: Sequence[str], flag: Column, name: str = "run_start") -> DataFrame:
    """Tick at which the unbroken run of flagged ticks began (NULL when not flagged)."""
    flagged = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    first = scan(flagged, by, ["tick"], {"__pf": previous(F.col("__f"))}, "tick")
    begins = F.when(F.col("__f") & ~F.coalesce(F.col("__pf"), F.lit(False)), F.col("tick"))
    held = scan(first.withColumn("__b", begins), by, ["tick"],
                {"__s": last_known(F.col("__b"))}, "tick")
    return held.withColumn(name, F.when(F.col("__f"), F.col("__s"))).drop("__f", "__pf", "__b", "__s")


def runs(df: DataFrame, by: Sequence[str], flag: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per run of consecutive flagged ticks: start, end (inclusive), length."""
    return (
        mark_runs(df, by, flag).where(F.col("run_start").isNotNull())
        .groupBy(*by, F.col("run_start").alias("start_tick"))
        .agg(F.max("tick").alias("end_tick"), F.count(F.lit(1)).alias("length"), *extra)
    )


def top_events(df: DataFrame, by: Sequence[str] = KEYS, share: float = 0.05) -> DataFrame:
    """Events = runs of top-share ticks, with the first kept tick inside each."""
    peak = F.col("peak_rank") <= top_count(share, F.col("n_ticks"))
    hit = F.min(F.when(F.col("sampled"), F.col("tick"))).alias("first_hit")
    return runs(_ranked(df, by), by, peak, [hit])


def event_recall(df: DataFrame, by: Sequence[str] = KEYS, share: float = 0.05) -> DataFrame:
    """Events, hits, recall, mean and p95 delay (NULL without hits)."""
    delay = (F.col("first_hit") - F.col("start_tick")).cast("double")
    return group_stats(
        top_events(df, by, share), by,
        [
            F.count(F.lit(1)).alias("n_events"),
            F.count("first_hit").alias("n_hit"),
            (F.count("first_hit") / F.count(F.lit(1))).alias("event_recall"),
            F.avg(delay).alias("mean_delay"),
        ],
        {"p95_delay": (delay, 0.95)})


def sampling_quality(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Peak recalls, causal error and event recall in one row per key."""
    by = list(by)
    ranked = reuse(peak_ranks(hold_last(df, by), by), by)
    recalls, causal = _recalls(PEAK_SHARES), _rmse(by, "held", "causal")
    return ranked.groupBy(*by).agg(*recalls, *causal).join(event_recall(ranked, by), by)


def mask_report(df: DataFrame, by: Sequence[str], together: int = 0, small: bool | None = None) -> DataFrame:
    """Ratio, largest gap, causal error and peak recalls of masks, from one scan over the rows.

    Ranks that the rows bring along are used. With ``together``, ``sampled`` is an array of at most so many masks, whose
    first is that of the last column of ``by``, an integer; the others count on from it. Rows are multiplied only for partial sums.
    """
    by = list(by)
    masks = {f"__m{i}": F.get("sampled", F.lit(i)) for i in range(together)} or {"__m0": F.col("sampled")}
    specs = {}
    for n, mask in masks.items():
        seen = F.when(mask, F.col("value"))
        specs |= {f"__last{n}": last_known(seen), f"__next{n}": next_known(seen),
                  f"__prev{n}": last_known(F.when(mask, F.col("tick")), inclusive=False)}
    wide = _ranked(scan(df, by, ["tick"], specs, "tick", small), by, small)
    found = [F.struct(
        F.lit(i).alias("__i"), mask.alias("sampled"), F.when(mask, F.col("tick") - F.col(f"__prev{n}")).alias("gap"),
        F.coalesce(f"__last{n}", f"__next{n}").alias("held")) for i, (n, mask) in enumerate(masks.items())]
    shared = [*by, "value", "peak_rank", "n_ticks"]
    if together:
        rows = wide.select(*shared, F.explode(F.array(*found)).alias("__r")).select(*shared, "__r.*").where(F.col("sampled").isNotNull())
        rows = rows.withColumn(by[-1], F.col(by[-1]) + F.col("__i"))
    else:
        rows = wide.select(*shared, found[0].alias("__r")).select(*shared, "__r.*")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(F.when(F.col("sampled"), 1.0).otherwise(0.0)).alias("sample_ratio"),
        F.max("gap").alias("__gap"), *_rmse(by, "held", "causal"), *_recalls(PEAK_SHARES))
    rest = [c for c in out.columns if c not in (*by, "__n", "__gap", "sample_ratio")]
    return out.select(*by, "sample_ratio", F.coalesce("__gap", "__n").cast("long").alias("max_gap"), *rest)


def compare_tracks(dense: DataFrame, kept: DataFrame, dense_by: Sequence[str] = KEYS,
                   by: Sequence[str] = ("series_id", "config_id")) -> DataFrame:
    """Dense and reconstructed tracker columns side by side, one row per tick."""
    full = dense.select(*dense_by, "tick", F.col("mean").alias("full_mean"),
                        F.col("std").alias("full_std"), F.col("status").alias("full_status"))
    read = F.col("sampled")
    filled = interpolate(kept, by, {
        "est_mean": F.when(read, F.col("mean")),
        "est_std": F.when(read, F.col("std")),
        "recon": F.when(read, F.col("value")),
    })
    return filled.join(full, [*dense_by, "tick"])


def _track_stats(by: Sequence[str]) -> tuple[list[Column], dict]:
    err = F.abs(F.col("full_mean") - F.col("est_mean"))
    serr = F.abs(F.col("full_std") - F.col("est_std"))
    rmse = F.sqrt(F.avg(err * err))
    recon = F.col("value") - F.col("recon")
    recon_rmse = F.sqrt(F.avg(recon * recon))
    spread = signal_range(by, F.col("value"))
    inside = F.col("value").between(F.col("est_mean") - 3 * F.col("est_std"),
                                    F.col("est_mean") + 3 * F.col("est_std"))
    stats = [
        F.avg(err).alias("mae_mean"),
        rmse.alias("rmse_mean"),
        (rmse / spread).alias("nrmse_mean"),
        F.max(err).alias("max_mean_error"),
        safe_corr(F.col("full_mean"), F.col("est_mean")).alias("correlation"),
        recon_rmse.alias("raw_recon_rmse"),
        (recon_rmse / spread).alias("raw_recon_nrmse"),
        F.avg(serr).alias("mae_std"),
        F.sqrt(F.avg(serr * serr)).alias("rmse_std"),
        F.avg(_flag(inside)).alias("coverage_3sigma"),
    ]
    points = {f"p{round(p * 100)}_error": (err, p) for p in (0.5, 0.9, 0.95, 0.99)}
    return stats, points


def track_error(tracks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Errors of tracked mean and std, correlation and band coverage."""
    return group_stats(tracks, by, *_track_stats(by))


def info_loss(dense: DataFrame, kept: DataFrame, dense_by: Sequence[str] = KEYS,
              by: Sequence[str] = ("series_id", "config_id")) -> DataFrame:
    """The full information-loss report, one row per key.

    All columns are added along one chain, so the replay below is run once.
    """
    by = list(by)
    tracks = peak_ranks(_gap(compare_tracks(reuse(dense, dense_by), reuse(kept, by), dense_by, by), by), by)
    stats, points = _track_stats(by)
    more, gaps, final = _efficiency(by)
    top = F.col("peak_rank") <= F.greatest(F.lit(1), F.floor(F.col("n_ticks") / 20))
    recall = F.avg(F.when(top, _flag(F.col("sampled")))).alias("peak_recall_top5")
    report = group_stats(reuse(tracks, by), by, [*more, *stats, recall], {**gaps, **points})
    names = ["mae_mean", "rmse_mean", "nrmse_mean", "max_mean_error", *points, "correlation", "raw_recon_rmse",
             "raw_recon_nrmse", "peak_recall_top5", "mae_std", "rmse_std", "coverage_3sigma"]
    return report.select(*by, *final, *names)


def outlier_overlap(dense: DataFrame, kept: DataFrame, dense_by: Sequence[str] = KEYS,
                    by: Sequence[str] = ("series_id", "config_id")) -> DataFrame:
    """Outlier ticks seen densely and by the sampler: union, intersection, Jaccard."""
    full = dense.select(*dense_by, "tick", (F.col("status") == "OUTLIER").alias("__d"))
    both = kept.join(full, [*dense_by, "tick"]).withColumn(
        "__a", F.coalesce(F.col("status") == "OUTLIER", F.lit(False)))
    inter = F.sum(_flag(F.col("__a") & F.col("__d")))
    union = F.sum(_flag(F.col("__a") | F.col("__d")))
    return both.groupBy(*by).agg(
        inter.alias("n_both"), union.alias("n_either"),
        F.coalesce(safe_div(inter, union), F.lit(1.0)).alias("jaccard"))


def running_ratio(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``kept_so_far`` and ``ratio_so_far``."""
    wide = scan(df, by, ["tick"], {"kept_so_far": running_sum(_flag(F.col("sampled")))}, "tick")
    return wide.withColumn("ratio_so_far", F.col("kept_so_far") / (F.col("tick") + 1))
