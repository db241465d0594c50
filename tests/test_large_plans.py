"""Which plan a large input takes: sizes of written results, short series, joins of exploded rows."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import fidelity as fd
from tickloom.operators import scans as sc
from tickloom.operators.masks import n_of_m
from tickloom.operators.reconstruct import hold_last, hold_masks, overlap_join
from tickloom.operators.replay import replay
from tickloom.params import make_config
from tickloom.session import count_short, cut, input_bytes, is_small, mark_short, range_count
from tickloom.sources.tables import user_trace
from tests.test_scale_paths import close, rows_of


@pytest.fixture
def large(spark):
    """Every input counts as large, without forcing a plan."""
    spark.conf.set("spark.tickloom.smallInputBytes", "0")
    yield spark
    spark.conf.unset("spark.tickloom.smallInputBytes")


@pytest.fixture
def noisy(spark):
    rows = [(s, i, float((i * 37 + n) % 53)) for s, n in (("a", 90), ("b", 40), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, tick long, value double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_joins_count_as_their_files(spark, tmp_path):
    spark.range(50000).withColumn("v", F.rand(1)).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    joined = t.join(t.withColumnRenamed("v", "w"), "id")
    joined = joined.join(t.withColumnRenamed("v", "x"), "id")
    written = cut(joined)
    assert 50000 * 8 < input_bytes(written) < 50 << 20  # the estimate is the product of the three sizes
    assert range_count(written) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_short_series_need_no_chunks(large, noisy):
    assert count_short(noisy, ["series_id"]) and not is_small(noisy, ["series_id"])
    short = mark_short(noisy, ["series_id"])
    assert is_small(short, ["series_id"]) and is_small(short, ["series_id", "config_id"])
    assert not is_small(short, ["config_id"]) and not is_small(short)
    config = make_config(outlier_threshold=3.0)
    kept = replay(short, [config], by=["series_id"])
    assert is_small(kept, ["series_id"])
    report = lambda trace: fd.info_loss(replay(trace, [config], "dense").drop("config_id"), replay(trace, [config]))
    one = report(short)
    assert sc.CHUNK not in plan(one)
    close(rows_of(one.na.fill(-1.0)), rows_of(report(noisy).na.fill(-1.0)))


def test_long_series_are_still_cut(large, noisy):
    large.conf.set("spark.tickloom.shortRows", "89")
    try:
        assert not count_short(noisy, ["series_id"])
    finally:
        large.conf.unset("spark.tickloom.shortRows")


def test_user_trace_notes_short_series(large):
    folder = "/root/testdata/sf0.001"
    trace = user_trace(large, folder)
    assert is_small(trace, ["series_id"])
    large.conf.set("spark.tickloom.shortRows", "0")
    try:
        other = user_trace(large, folder)
        assert not is_small(other, ["series_id"])
        assert rows_of(trace) == rows_of(other)
    finally:
        large.conf.unset("spark.tickloom.shortRows")


def test_holds_of_several_masks(chunked, noisy):
    masks = {"h1": n_of_m(F.col("tick"), 2, 5), "h2": n_of_m(F.col("tick"), 1, 7, 3)}
    odd = noisy.withColumn("value", F.when(F.col("tick") % 4 > 0, F.col("value")))
    many = hold_masks(odd, ["series_id"], masks)
    one = odd
    for name, mask in masks.items():
        one = hold_last(one.withColumn("sampled", mask), name=name).drop("sampled")
    assert many.columns == one.columns
    close(rows_of(many.na.fill(-1.0)), rows_of(one.na.fill(-1.0)))


def test_overlap_join_broadcasts_no_exploded_rows(spark, tmp_path):
    spark.range(300).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("t"), (F.col("id") % 9 + 1).alias("v")).write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    windows = points.where("v > 5").select("k", F.col("t").alias("s"), (F.col("t") + F.col("v")).alias("e"), F.col("t").alias("w"))
    hit = overlap_join(points, windows, ["k"], "t", "s", "e", ["w"])
    assert "Broadcast" not in plan(hit)
    found = hit.select("t", "w")
    wanted = points.alias("p").join(windows.alias("q"), F.expr("p.k = q.k and t >= s and t < e")).select("t", "w")
    assert rows_of(found) == rows_of(wanted)


def test_percentiles_of_a_written_summary(large, noisy):
    points = {"p25": 0.25, "p95": 0.95}
    close(rows_of(sc.percentiles(noisy, ["series_id"], F.col("value"), points)),
          rows_of(sc.percentiles(noisy, ["series_id"], F.col("value"), points, small=True)))


def test_short_series_replay_together(spark):
    """Many series of a few ticks in one task, NULL keys among them, equal to one replay a series."""
    keys = [(None if s % 50 == 7 else s, s % 3) for s in range(400)]
    rows = [(k, r, i, float((i * 37 + (k or 0)) % 53)) for k, r in sorted(set(keys), key=str) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, r long, tick long, value double").coalesce(1)
    config = make_config(outlier_threshold=3.0)
    got = replay(df, [config], by=["k", "r"], small=True)
    assert "MapInArrow" in plan(got)
    assert got.count() == len(rows) and got.groupBy("k", "r").count().where("count != 12").isEmpty()
    for k, r in ((None, 0), (None, 1), (5, 2)):
        mine = F.col("k").eqNullSafe(F.lit(k)) & (F.col("r") == r)
        alone = replay(df.where(mine).drop("k"), [config], by=["r"], small=True)
        fill = lambda d: rows_of(d.select(*alone.columns).na.fill(-1.0).na.fill("-"))
        assert fill(got.where(mine)) == fill(alone)
