import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import whitening as wh
from tickloom.llm.queries import QUERIES


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


SPECTRA = [
    list(np.linspace(1, 5, 40)), [3.0] * 5 + [1.0] * 20, [1e9, 1e3, 1.0, 1e-3] + [1e-6] * 6, [2.0], [0.0, 0.0, 4.0],
    list(np.random.default_rng(3).exponential(1, 64)), [1.0 + 1e-9 * i for i in range(12)] + [0.5] * 3, [5.0, -1.0, 2.0, -3.0]]


@pytest.mark.parametrize("values", SPECTRA, ids=range(len(SPECTRA)))
def test_inertia_counts(values):
    m = symmetric(values)
    d, o = wh.tridiagonal(m)
    for t in (-4.0, -2.0, -0.5, 0.7, 1.5, 2.5, 3.5, 4.5, 1e4):
        assert wh.above(d, o, t) == sum(v > t for v in values)


@pytest.mark.parametrize("values", SPECTRA, ids=range(len(SPECTRA)))
def test_components_are_those_of_a_dense_solver(spark, values):
    m = symmetric(values)
    got, axes = wh.components(spark, m, 10)
    want = np.sort(np.array(values))[::-1][:10]
    size = np.abs(values).max()
    assert np.abs(got - want).max() < 1e-12 * size
    assert np.abs(m @ axes.T - axes.T * got).max() < 1e-11 * size
    assert np.abs(axes @ axes.T - np.eye(len(got))).max() < 1e-12


def test_intervals_hold_all_wanted_values():
    values = SPECTRA[5]
    d, o = wh.tridiagonal(symmetric(values))
    for nudge in (0.0, 0.1, -0.1):
        parts = wh.search_intervals(d, o, 20, nudge)
        assert sum(c for _, _, c in parts) >= 20 and all(c <= wh.EACH for _, _, c in parts)
        for (low, _, _), (_, high, _) in zip(parts, parts[1:]):
            assert low == high or not wh.above(d, o, high) - wh.above(d, o, low)


def brute(rows, count=32):
    """{(id, row)...} by whole numbers and a dense eigensolver."""
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in keep)
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in keep]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - s for a, s in zip(r, sums)] for r in x]
    centred = np.array([[a / n for a in r] for r in y])
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:count], q[:, ::-1][:, :count]
    return [i for i, _ in keep], n, [sum(a * a for a in r) for r in y], centred @ q / np.sqrt(e), e / np.trace(cov)


def test_query_against_a_dense_solver(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, n, deviation, whitened, explained = brute(rows)
    got = QUERIES["op12_whitening"](spark, folder).toPandas()
    assert len(got) == 32 * len(ids) and not got.duplicated(["vec_id", "component"]).any()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((table * whitened).sum(0))
    assert np.abs(table * sign - whitened).max() < 1e-8
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert got.groupby("component")["explained"].first().to_numpy() == pytest.approx(explained, rel=1e-9)
    assert got.groupby("vec_id")["deviation"].first().loc[ids].tolist() == deviation


def test_dropped_rows_ids_and_clashing_names(spark):
    big, rng = 2 ** 53, np.random.default_rng(5)
    rows = [(big + 1 + 2 * i, [float(c) for c in rng.normal(0, 3, 5)]) for i in range(20)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), rows[0], rows[0], (7, None), (8, [1.0, None, 1.0, 1.0, 1.0]),
             (9, [float("nan")] * 5), (10, [float("inf")] * 5), (11, [2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, whitened double, n int").coalesce(1)
    ids, n, deviation, _, explained = brute(rows)
    got = wh.whiten(df, count=3).collect()
    assert len(got) == 3 * len(ids)
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1 and r.vec_id is not None) == \
        sorted((i, d) for i, d in zip(ids, deviation) if i is not None)
    assert [r.explained for r in sorted(got[:3], key=lambda r: r.component)] == pytest.approx(list(explained[:3]), rel=1e-9)
    assert all(r.identity_error < 1e-9 and r.n == n for r in got)


def test_empty_equal_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    same = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    line = wh.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in wh.whiten(df).collect()}
    assert got == {1: None, 2: None, 3: 0}
    near = spark.createDataFrame([(1, [1e7]), (2, [-1.5e7]), (3, [0.5])], "vec_id long, embedding array<double>")
    x = [64 * 10 ** 7, -96 * 10 ** 7, 32]
    assert {r.vec_id: r.deviation for r in wh.whiten(near).collect()} == {i + 1: (3 * a - sum(x)) ** 2 for i, a in enumerate(x)}
    assert wh.whiten(df.select("vec_id", F.array(F.lit(1e300)).alias("embedding"))).count() == 0
