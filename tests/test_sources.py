"""Reading files, and the plans of the scans."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.sources import json_files as jf
from tickloom.sources import json_traces as jt
from tickloom.sources import text_logs as tl
from tickloom.sources.tables import table

DATA = "/root/testdata/sf0.001"


def test_json_trace_files(spark, tmp_path):
    cases = {
        "flat.json": ([1.0, 2, 3.5], None, [1.0, 2.0, 3.5]),
        "objects.json": ([{"cpus": "8e-4", "memory": "0.003"}, {"cpus": "9e-4", "memory": "0"}], None, [8e-4, 9e-4]),
        "nested.json": ([{"name": "x", "average_usage": {"kind": "y", "cpus": "0.5"}}], None, [0.5]),
        "wrapped.json": ([[{"a": {"b": 1}}, {"a": {"b": "2"}}]], "a.b", [1.0, 2.0]),
    }
    for name, (content, field, want) in cases.items():
        path = tmp_path / name
        path.write_text(json.dumps(content, indent=1))
        got = jf.read_json_trace(spark, str(path), field).orderBy("tick").collect()
        assert [r.value for r in got] == want, name
    capped = jf.read_json_trace(spark, str(tmp_path / "flat.json"), max_points=2)
    assert capped.count() == 2


def test_no_numeric_field(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('[{"a": "x"}]')
    with pytest.raises(ValueError):
        jf.read_json_trace(spark, str(path))


ELEMENTS = [1, "2.5", "a,b", '"', "[", "]}", "x\\", {"a": [1, {"b": "},{"}], "c": '\\",'}, [], {}, [[1, 2], [3]], None, True, "é, ,\n", -7.5e3, ""]


@pytest.mark.parametrize("plan", ["auto", "chunked"])
@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_array_files_in_byte_ranges(spark, tmp_path, plan, split):
    """Elements equal those of a JSON parser, wherever the files are split."""
    rng = random.Random(split)
    want = {}
    for i in range(6 if plan == "auto" else 3):
        rows = rng.choices(ELEMENTS, k=rng.choice([1, 5, 40]))
        rows[0] = [3.5, rows[0]][i > 3 and not isinstance(rows[0], list)]
        whole = [rows, [9, [10]], "z"] if i % 2 else rows
        text = json.dumps(whole, indent=i % 3 or None, ensure_ascii=bool(i % 2))
        (tmp_path / f"f{i}.json").write_text("  " + text + "\n", encoding="utf-8")
        want[f"f{i}.json"] = rows
    for name, text in {"empty.json": "[]", "inner.json": "[ [ ] ]", "nothing.json": "", "object.json": '{"a": [1, 2]}', "number.json": "5"}.items():
        (tmp_path / name).write_text(text)
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.tickloom.path": plan}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {}
        for r in jf.read_array_elements(spark, str(tmp_path)).orderBy("file", "tick").collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.tick, json.loads(r.element)))
        assert got == {f: list(enumerate(rows)) for f, rows in want.items()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pieces_are_ranged_once_and_carry_no_path(chunked, tmp_path, monkeypatch):
    from tickloom.operators import scans

    for n in range(2):
        (tmp_path / f"f{n}.json").write_text(json.dumps([{"v": i, "t": "a, [\\ \"{"} for i in range(60 + n)]))
    seen, plain = [], scans.range_chunks
    monkeypatch.setattr(scans, "range_chunks", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    got = jf.read_json_trace(chunked, str(tmp_path), "v").orderBy("file", "tick").collect()
    assert [r.value for r in got] == [*map(float, range(60)), *map(float, range(61))]
    assert len({r.file for r in got}) == 2
    assert len(seen) == 1 and "file" not in seen[0]


def test_one_line_array_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "line.json")
    with open(path, "w") as f:
        f.write("[" + ",".join(f'{{"v": {i}, "s": "a,b"}}' for i in range(100_000)) + "]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert jf._pieces(spark, path).rdd.getNumPartitions() >= 10
        got = jf.read_json_trace(spark, path)
        assert tuple(got.agg(F.count("*"), F.sum("value"), F.sum((F.col("value") == F.col("tick")).cast("int"))).first()) == (100_000, 4999950000.0, 100_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_event_log_with_gzip_and_corrupt_lines(spark, tmp_path):
    lines = ['{"event": "track_start", "pod": "a", "namespace": "d", "pod_name": "web-1"}', "", "{oops",
             '{"pod": "a", "value": 1.5, "t": 0}', '{"pod": "b", "value": 2.0, "t": 0}']
    with gzip.open(tmp_path / "log.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    log = jt.read_event_log(spark, str(tmp_path / "log.jsonl.gz"))
    assert log.count() == 3
    got = jt.member_readings(log, "d", "^web").collect()
    assert [(r.pod, r.value) for r in got] == [("a", 1.5)]


def test_text_lines_keep_their_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text("\n".join(f"{name}{i}" for i in range(50)))
    rows = tl.read_lines(spark, str(tmp_path / "*.log")).collect()
    assert len(rows) == 100 and all(r.line[1:] == str(r.line_no) for r in rows)


def test_logs_of_known_tools(spark):
    def lines(text):
        return spark.createDataFrame([("f", i, s) for i, s in enumerate(text.splitlines())], "file string, line_no long, line string")

    pg = tl.progress_series(lines("progress: 1.0 s, 100.5 tps, lat 1\nnoise\ntps = 7.0\nprogress: 2.0 s, 90.0 tps"), ["file"])
    assert sorted((r.x, r.y) for r in pg.collect()) == [(1.0, 100.5), (2.0, 90.0)]
    final = tl.progress_series(lines("tps = 7.0 (x)\nnoise\ntps = 8.0"), ["file"])
    assert sorted((r.x, r.y) for r in final.collect()) == [(1.0, 7.0), (2.0, 8.0)]
    rd = tl.paired_requests(lines("SET: 10 requests per second\nGET: 20 requests per second\nSET: 5 requests per second"), ["file"])
    assert sorted((r.x, r.y) for r in rd.collect()) == [(1.0, 30.0), (2.0, 5.0)]
    fio = tl.latency_p99(lines("  lat percentiles (msec):\n | 99.00th=[  2k], 99.50th=[ 9]\n | 99.00th=[ 7]\n"
                               "  clat percentiles (usec):\n | 99.00th=[ 5]\n  lat percentiles (nsec):\n | 99.00th=[ 500]"), ["file"])
    assert sorted((r.x, round(r.y, 6)) for r in fio.collect()) == [(1.0, 2e6), (2.0, 0.5)]
    run = tl.run_summary(lines("last sec: 5\nTotal operations: 10 ; Sec: 4\nlast sec: 20\nTotal operations: 100 ; Sec: 19"), ["file"]).first()
    assert (run.wall, run.operations, run.last_bucket, run.throughput) == (20, 100, 19, 5.0)


def test_list_column_dataset(spark, tmp_path):
    rows = [(5, [float(10 * i + j) for j in range(6)]) for i in range(4)] + [(6, [1.0] * 6)]
    path = str(tmp_path / "ds")
    spark.createDataFrame(rows, "tasks int, tr array<double>").coalesce(1).write.partitionBy("tasks").parquet(path)
    trace = jt.read_list_column(spark, path, "tr", 3, 1, task=5)
    got = trace.orderBy("tick").collect()
    assert [r.tick for r in got] == list(range(8))
    assert sorted(r.value for r in got) == sorted(10.0 * i + j for i in range(4) for j in (1, 4))
    plan = trace._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tasks" in plan and jt.read_list_column(spark, path, "tr", 3, 1, 5, 3).count() == 3
    with pytest.raises(ValueError):
        jt.read_list_column(spark, path, "tr", 3, 3)


def test_columns_and_filters_reach_the_scan(spark):
    df = table(spark, DATA, "events").where(F.col("value") > 60).groupBy("event_type").agg(F.sum("value"))
    plan = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan and "GreaterThan(value,60.0)" in plan


def test_long_spine(spark):
    bounds = spark.createDataFrame([("a", 0, 9), ("b", 5, 4), ("c", 3, 3)], "k string, lo long, hi long")
    got = jt.tick_spine(bounds, F.col("lo"), F.col("hi"), step=4).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("tick").alias("m"))
    assert {(r.k, r.n, r.m) for r in got.collect()} == {("a", 10, 9), ("c", 1, 3)}
