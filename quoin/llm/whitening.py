"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import read, saved

#: Components that the query returns at most.
COMPONENTS = 8
#: Entries c become floor(SCALE * c) + SHIFT; beyond LARGEST they saturate.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**52
#: Pivots below this share of the largest variance are rounding noise: the rank ends there.
NOISE = 1e-12


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def commonest_length(vectors: DataFrame, column: str = "embedding") -> int:
    """The length that most vectors have (of equally common ones the largest); 0 without vectors."""
    top = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of length d as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def integers(column: pa.Array, d: int) -> np.ndarray:
    return np.clip(np.floor(SCALE * matrix(column, d)), -LARGEST, LARGEST).astype(np.int64) + SHIFT


# ---------------------------------------------------------------- the decomposition, of one d x d matrix
def pivoted_cholesky(a: np.ndarray, noise: float = NOISE) -> tuple[np.ndarray, np.ndarray]:
    """``(l, order)`` with ``a[order][:, order]`` = l l', l lower trapezoidal with one column a unit of rank.

    Each step takes the largest variance that is left, and ends when that is noise.
    """
    a, d = a.copy(), len(a)
    l, order, least = np.zeros((d, d)), np.arange(d), noise * max(0.0, float(np.max(np.diag(a), initial=0.0)))
    left = np.diag(a).copy()
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return l[:, :k], order
        order[[k, p]], left[[k, p]], l[[k, p]] = order[[p, k]], left[[p, k]], l[[p, k]]
        l[k, k] = np.sqrt(left[k])
        l[k + 1 :, k] = (a[order[k + 1 :], order[k]] - l[k + 1 :, :k] @ l[k, :k]) / l[k, k]
        left[k + 1 :] -= l[k + 1 :, k] ** 2
    return l, order


def jacobi_columns(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``l`` times a rotation that makes its columns orthogonal, longest first."""
    g, r = l.copy(), l.shape[1]
    for _ in range(sweeps):
        turned = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                x, y, z = g[:, i] @ g[:, i], g[:, j] @ g[:, j], g[:, i] @ g[:, j]
                if abs(z) <= 1e-15 * np.sqrt(x * y):
                    continue
                turned, t = True, (y - x) / (2 * z)
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                c = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = c * g[:, i] - c * t * g[:, j], c * t * g[:, i] + c * g[:, j]
        if not turned:
            break
    return g[:, np.argsort(-(g * g).sum(0), kind="stable")]


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and, as columns, unit eigenvectors of a covariance; those of its numerical rank only.

    With C = L L' after pivoting, rotating L's columns to be orthogonal gives U S, and C = U S S U':
    squared column norms are eigenvalues and normalised columns eigenvectors. C is never squared.
    """
    l, order = pivoted_cholesky(covariance)
    g = jacobi_columns(l)
    values = (g * g).sum(0)
    vectors = np.zeros_like(g)
    vectors[order] = g / np.sqrt(values)
    return values, vectors


# ---------------------------------------------------------------- passes over the table
@dataclass
class Whitening:
    """What a fit knows: counts and exact sums, the covariance's trace, its eigenvalues and eigenvectors (columns)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def sums_of(vectors: DataFrame, d: int, of) -> np.ndarray:
    """The sum over all vectors of a matrix of doubles, which ``of`` makes of each batch of them.

    Each task sends one row a matrix row, added up by row number in Python: d rows a task at most.
    """
    some = of(np.zeros((0, d), np.int64))
    rows, width = some.shape

    def run(batches):
        total = np.zeros((rows, width))
        for b in batches:
            total += of(integers(b.column("embedding"), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"i": table["i"][:1], "part": pa.array([matrix(table["part"].combine_chunks(), width).sum(0)], pa.list_(pa.float64()))})

    parts = vectors.select("embedding").mapInArrow(run, "i long, part array<double>")
    # pieces of 64 tasks first: no group grows with the table but by its tasks / 64
    parts = parts.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(64)).alias("piece")).applyInArrow(add, "i long, part array<double>")
    out = np.zeros((rows, width))
    for r in parts.groupBy("i").applyInArrow(add, "i long, part array<double>").toArrow().to_pylist():
        out[r["i"]] = r["part"]
    return out


def fit_whitening(vectors: DataFrame, d: int) -> Whitening | None:
    """Fits on all ``vectors(embedding)`` of length d; None without any. Two passes: exact sums, then the scatter around the mean."""

    def run(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = integers(b.column("embedding"), d)
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # 64-bit sums of either half are exact
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high.sum(0), low.sum(0))]
        yield pa.RecordBatch.from_pydict({"i": list(range(-1, d)), "s": [str(v) for v in (n, *total)]})

    rows = vectors.select("embedding").mapInArrow(run, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    got = {r.i: int(r.s) for r in rows}
    if not got.get(-1):
        return None
    n, sums = got[-1], [got[i] for i in range(d)]
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        y = x - mean
        return y.T @ y

    covariance = sums_of(vectors, d, scatter) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = components_of(covariance)
    return Whitening(n, sums, float(np.trace(covariance)), values, axes)


def whiten(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """``(row, deviation, whitened)``: each row as a struct, the exact sum of (n*x - S)^2 (null beyond a
    long), and its first components with variance 1. The model, d x ``components`` doubles, goes to the tasks."""
    n, sums, mean = model.n, model.sums, model.mean
    d = len(sums)
    scaled = model.vectors[:, :components] / np.sqrt(model.values[:components])

    def deviations(x: np.ndarray) -> list[int | None]:
        most = max(abs(int(v) * n - s) for f in (np.min, np.max) for v, s in zip(f(x, axis=0), sums))
        if most**2 * d < 2**63 and max(map(abs, sums)) < 2**62:
            off = x * np.int64(n) - np.array(sums, np.int64)
            return (off * off).sum(1).tolist()
        exact = (sum((int(v) * n - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist())
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = integers(b.column("embedding"), d)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(deviations(x), pa.int64()), pa.array(list((x - mean) @ scaled), pa.list_(pa.float64()))], ["row", "deviation", "whitened"])

    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), "embedding")
    return rows.mapInArrow(run, rows.select("row", F.lit(None).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")).schema)


def identity_error(whitened: DataFrame, r: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` (arrays of length r) minus the identity."""

    def run(batches):
        n, total, square = 0, np.zeros(r), np.zeros((r, r))
        for b in batches:
            w = matrix(b.column("whitened"), r)
            n, total, square = n + len(w), total + w.sum(0), square + w.T @ w
        yield pa.RecordBatch.from_pydict({"k": [*range(r * r + r + 1)], "v": [float(n), *total, *square.ravel()]})

    got = {x.k: x.v for x in whitened.select("whitened").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n = got[0]
    mean = np.array([got[1 + i] for i in range(r)]) / n
    square = np.array([got[1 + r + i] for i in range(r * r)]).reshape(r, r) / n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(r)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector of ``vectors(vec_id, embedding)`` and component, numbered from 1 by falling variance.

    Vectors that are null or hold nulls or non-finite entries are dropped, and so are those of another
    length than the commonest, which have no covariance with the others. Repeated rows and null ids count
    as rows like any other. Components end with the rank of the covariance: an eigenvalue of 0 has no
    whitened value, so equal vectors, a single one or none give no rows. Extra columns take no part.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite(F.col("embedding")))
    d = commonest_length(kept)
    kept = kept.where(F.size("embedding") == d)
    model = fit_whitening(kept, d) if d else None
    r = min(components, len(model.values)) if model else 0
    if not r:
        return spark.createDataFrame([], SCHEMA)
    wide = saved(whiten(kept, model, r).select(F.col("row.vec_id").alias("vec_id"), "deviation", "whitened"))
    error = identity_error(wide, r)
    explained = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values[:r]]), F.col("component"))
    out = wide.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).withColumn("component", (F.col("i") + 1).cast("int"))
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all ``embeddings``; see ``whitened_components``."""
    return whitened_components(read(spark, sf_dir, "embeddings"))
