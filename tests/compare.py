"""Run a registered query on Spark and its SQL on DuckDB and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tzinfo is None else v.isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "dtype"):
        return str([_cell(x) for x in v])
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(_cell(r[i])) for i in order) for r in rows])


def compare(spark, con, fn, sql: str, folder: str) -> list[str]:
    """Differences found (empty = equal)."""
    df = fn(spark, folder)
    left_cols = df.columns
    left = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    right_cols = [d[0] for d in cur.description]
    right_kinds = {d[0]: str(d[1]) for d in cur.description}
    right = cur.fetchall()
    problems = []
    if sorted(left_cols) != sorted(right_cols):
        return [f"columns {sorted(left_cols)} vs {sorted(right_cols)}"]
    for name, kind in df.dtypes:
        want = KINDS.get(kind, kind.upper())
        if want != right_kinds[name] and not kind.startswith("array"):
            problems.append(f"type of {name}: {kind} vs {right_kinds[name]}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    a, b = _rows(left_cols, left), _rows(right_cols, right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} differing rows, first {bad[0]} over {sorted(left_cols)}")
    if not left:
        problems.append("EMPTY result")
    return problems


def main(patterns: list[str], folder: str) -> int:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry

    from tickloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("TICKLOOM_PATH"):  # single or chunked
        spark.conf.set("spark.tickloom.path", os.environ["TICKLOOM_PATH"])
        spark.conf.set("spark.tickloom.chunkTicks", os.environ.get("TICKLOOM_CHUNK", "64"))
    con = connect(folder)
    failed = 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, fn, oracles[name], folder)
                t = time.time() - t0
            else:
                n = fn(spark, folder).count()
                t = time.time() - t0
                problems = [] if n else ["EMPTY result"]
        except Exception as e:  # report and go on
            t = time.time() - t0
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if not problems else 'FAIL'} {kind} {name} {t:.1f}s {' | '.join(problems)}", flush=True)
        failed += bool(problems)
    print(f"failed {failed}")
    return failed


if __name__ == "__main__":
    folder = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        folder, args = args[0], args[1:]
    sys.exit(1 if main(args, folder) else 0)
