"""Nearest neighbours and whitening against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.llm import nearest as A
from quoin.llm import whitening as W

VECTORS = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")


def given(spark, rows, schema=VECTORS):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------------------- whitening
def whitened(df, **more):
    return sorted(W.whitened_components(df, **more).collect(), key=lambda r: (r.component, r.vec_id is None, r.vec_id))


def test_whitening_equals_eigenvectors_of_the_covariance(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 100_000
    n, s, y = len(x), x.sum(0), x - x.mean(0)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = W.whitened_components(e).toPandas().pivot(index="vec_id", columns="component")
    expected = y @ axes[:, :8] / np.sqrt(values[:8])
    mine = got["whitened"].to_numpy()
    assert mine * np.sign((mine * expected).sum(0)) == pytest.approx(expected, abs=1e-9)
    assert (got["deviation"].to_numpy() == ((n * x - s) ** 2).sum(1)[:, None]).all() and (got["n"].to_numpy() == n).all()
    assert got["explained"].to_numpy()[0] == pytest.approx(values[:8] / values.sum(), rel=1e-9)
    assert got["identity_error"].to_numpy().max() < 1e-9


def test_whitening_drops_what_has_no_covariance(spark):
    random = np.random.RandomState(1)
    good = [(i, [float(v) for v in random.normal(size=3)]) for i in range(20)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [NAN, 0.0, 0.0]), (53, [INF, 0.0, 0.0]), (54, [1.0]), (55, [])]
    assert [(r.vec_id, r.component, r.n) for r in whitened(given(spark, good + bad))] == [(i, c, 20) for c in (1, 2, 3) for i in range(20)]
    repeated = whitened(given(spark, good + good + [(None, good[0][1])]))
    assert len(repeated) == 41 * 3 and repeated[0].n == 41


def test_whitening_ends_with_the_rank(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    got = whitened(given(spark, flat))
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9
    assert whitened(given(spark, [(i, [1.0, 2.0]) for i in range(5)])) == [] and whitened(given(spark, [(1, [1.0, 2.0])])) == []
    assert whitened(given(spark, [])) == [] and whitened(given(spark, [(1, None)])) == []


def test_whitening_of_large_entries_and_other_columns(spark):
    rows = [(i, [float((-1) ** i * 10.0**15), float(i)], i, 0.5) for i in range(8)]
    got = whitened(given(spark, rows, "vec_id long, embedding array<double>, n int, whitened double"))
    x = [[math.floor(1024 * v) for v in r[1]] for r in rows]
    x = [[min(max(v, -(2**52)), 2**52) + 100_000 for v in r] for r in x]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((8 * v - t) ** 2 for v, t in zip(r, s)) for r in x]
    assert [r.deviation for r in got[:8]] == [v if v < 2**63 else None for v in exact]


def test_decomposition():
    random = np.random.RandomState(3)
    for d, rank in ((1, 1), (6, 6), (9, 4), (5, 0)):
        b = random.normal(size=(d, rank)) * 10.0 ** random.randint(-3, 4, rank)
        values, axes = W.components_of(b @ b.T)
        assert len(values) == rank and axes.T @ axes == pytest.approx(np.eye(rank), abs=1e-12)
        assert axes * values @ axes.T == pytest.approx(b @ b.T, rel=1e-9, abs=1e-9)
        assert (np.diff(values) <= 0).all()


# ------------------------------------------------------------------------------- nearest neighbours
def brute(rows, asked, k):
    """vec_ids and distances of the k nearest, by rows; null ids lose ties."""
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for j in asked:
        away = np.sqrt(((x - x[j]) ** 2).sum(1))
        order = sorted((i for i in range(len(rows)) if i != j), key=lambda i: (away[i], rows[i][0] is None, rows[i][0]))
        out[j] = [(rows[i][0], away[i]) for i in order[:k]]
    return out


def found(df, k=10, is_query=None):
    got = A.nearest_neighbours(df, F.col("vec_id") % 100 == 0 if is_query is None else is_query, k)
    return sorted(got.collect(), key=lambda r: (r.query_id, r["rank"]))


def test_nearest_recall_and_scores(spark, sf, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 40)
    monkeypatch.setattr(A, "QUERIES", 7)
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.orderBy("vec_id").collect()]
    asked = [i for i, r in enumerate(rows) if r[0] % 5 == 0]
    expected = brute(rows, asked, 10)
    got = found(e, 10, F.col("vec_id") % 5 == 0)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert len(by) == len(asked) and all([r["rank"] for r in v] == list(range(1, 11)) for v in by.values())
    hit = sum(len({r.vec_id for r in by[rows[j][0]]} & {v for v, _ in expected[j]}) for j in asked)
    assert hit >= 0.95 * 10 * len(asked)
    at = {r[0]: np.array(r[1], np.float64) for r in rows}
    assert all(r.score == pytest.approx(math.dist(at[r.query_id], at[r.vec_id]), rel=1e-12) for r in got)


def test_nearest_abandons_early_and_keeps_near_rows(spark):
    """A crowd of copies, a hot list, more dimensions than one block of columns."""
    random = np.random.RandomState(2)
    centre = random.normal(size=40)
    rows = [(i, [float(v) for v in centre + 0.01 * random.normal(size=40)]) for i in range(300)] + [(i, [float(v) for v in random.normal(size=40)]) for i in range(300, 400)] + [(i, [float(v) for v in centre]) for i in range(400, 420)]
    df = given(spark, rows, "vec_id long, embedding array<double>")
    expected = brute(rows, [0, 100, 200, 300, 400], 10)
    got = found(df)
    assert [(r.vec_id, pytest.approx(r.score)) for r in got if r.query_id == 400] == [(i, 0.0) for i in range(401, 411)]
    hit = sum(r.vec_id in {v for v, _ in expected[r.query_id]} for r in got)
    assert len(got) == 50 and hit >= 47


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [NAN, 1.0]), (5, [1.0, None]), (6, [INF, 1.0]), (7, [1.0]), (None, [0.0, 1.0]), (1, [0.0, 1.0]), (100, None)]
    got = found(given(spark, rows))
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, None)] and got[0].score == pytest.approx(2**0.5)
    assert found(given(spark, [])) == [] and found(given(spark, [(0, [1.0])])) == [] and found(given(spark, [(1, [1.0]), (2, [2.0])])) == []
    twice = found(given(spark, [(0, [1.0]), (0, [1.0]), (5, [3.0])]))
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in twice] == [(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 5, 2.0), (0, 2, 5, 2.0)]
    clash = given(spark, [(0, [1.0], 1, 9.0), (1, [2.0], 1, 9.0)], VECTORS + ", rank int, score double")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found(clash)] == [(0, 1, 1, 1.0)]
