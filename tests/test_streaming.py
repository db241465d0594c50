"""Streams give the results of the batch replay."""

import random

from pyspark.sql import functions as F

from tickloom.operators.replay import replay
from tickloom.params import make_config
from tickloom.streaming.drain import drain
from tickloom.streaming.stateful import member_lifecycle, stream_replay
from tickloom.streaming.windows import sliding_scores, split_late, tumbling_counts

SCHEMA = "series_id string, tick long, value double"


def write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{i:02d}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, i, rng.expovariate(0.05)) for i in range(200) for s in ("a", "b")]
    cut = [rows[k:k + 80] for k in range(0, 400, 80)]
    for part in cut:
        rng.shuffle(part)
    write_batches(spark, tmp_path / "in", cut)
    cfg = make_config(outlier_threshold=3.0)
    got = drain(stream_replay(source(spark, tmp_path / "in"), cfg))
    want = replay(spark.createDataFrame(rows, SCHEMA), [cfg])
    cols = ["series_id", "tick", "sampled", "urgency", "status", "mean"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert got.where("late").count() == 0 and got.where("held is null").count() == 0


def test_late_rows_are_marked_and_not_applied(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [[("a", i, 1.0 * i) for i in range(10)], [("a", 5, 99.0), ("a", 10, 3.0)]])
    got = drain(stream_replay(source(spark, tmp_path / "in"), make_config()))
    late = got.where("late").collect()
    assert [(r.tick, r.value, r.status) for r in late] == [(5, 99.0, None)] and got.count() == 12


def test_member_lifecycle(spark, tmp_path):
    hours = lambda h: (h + 1000) * 3600  # rows at the epoch would be at the initial watermark
    batches = [[("a", hours(0), 1.0), ("b", hours(0), 1.0)], [("b", hours(30), 1.0)], [("b", hours(31), 1.0)], [("a", hours(32), 1.0)]]
    write_batches(spark, tmp_path / "in", batches)
    rows = source(spark, tmp_path / "in").select("series_id", F.timestamp_seconds("tick").alias("ts")).withWatermark("ts", "1 hour")
    got = drain(member_lifecycle(rows, "series_id", "ts", 10 * 3600 * 1000)).collect()
    a = sorted((r.event, r.at_ms // 3600000 - 1000) for r in got if r.member == "a")
    assert a == [("track_start", 0), ("track_start", 32), ("track_stop", 0)]


def test_windows_on_streams(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [[("a", i * 600, 1.0) for i in range(12)], [("a", 90000, 1.0)], [("a", 180000, 1.0)]])
    timed = lambda df: df.select("series_id", F.timestamp_seconds("tick").alias("ts"))
    got = drain(tumbling_counts(timed(source(spark, tmp_path / "in")), "ts", "1 hour", delay="1 hour"))
    assert sorted(r.n for r in got.where(F.unix_timestamp("start") < 7200).collect()) == [6, 6]
    batch = tumbling_counts(timed(spark.createDataFrame([("a", i * 600, 1.0) for i in range(12)], SCHEMA)), "ts", "1 hour")
    assert sorted(r.n for r in batch.collect()) == [6, 6]


def test_rows_past_the_horizon(spark):
    rows = split_late(spark.createDataFrame([(5,), (11,)], "second long"), "second", 10).orderBy("second").collect()
    assert [(r.second, r.capped) for r in rows] == [(5, False), (10, True)]


def test_sliding_scores(spark):
    rows = spark.createDataFrame([("a", i, 0.5, i in (3, 4)) for i in range(8)], "k string, tick long, urgency double, odd boolean")
    timed = rows.withColumn("ts", F.timestamp_seconds("tick"))
    got = sliding_scores(timed, "ts", "4 seconds", "2 seconds", ["k"], F.col("odd"), "urgency", 4.0)
    best = got.orderBy(F.desc("score")).first()
    assert (best.anomalies, best.score) == (2, 6.0) and got.count() == 5
