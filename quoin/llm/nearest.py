"""Approximate nearest neighbours: lists around centroids, scanned dimension by dimension with early abandoning.

Vectors are turned by one random rotation, after which any first d of D coordinates hold about d/D of a
squared distance. A list is scanned in blocks of columns; after each, a candidate is abandoned once its
partial distance, scaled to D coordinates, exceeds the bound by more than chance allows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import read, saved
from quoin.llm.whitening import commonest_length, finite, matrix

#: The index is fitted on about SAMPLE vectors; it has the square root of the number of vectors as lists, LISTS at most.
SAMPLE, LISTS, ROUNDS = 16_384, 1_024, 8
#: Neighbours of sampled vectors that the probed lists hold at least, by which the number of probes is set.
TARGET, TRIALS = 0.97, 256
#: Vectors of a block of a list, and queries that meet it at a time, on average.
BLOCK, QUERIES = 512, 2_048
#: Coordinates of a block of columns; how many deviations a partial distance may be above the bound.
COLUMNS, DEVIATIONS = 16, 2.1
#: Pairs that a task holds at a time.
PAIRS = 1 << 16


@dataclass
class Model:
    """Centroids, the rotation, and how many of the nearest lists a query probes."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    @property
    def d(self) -> int:
        return len(self.rotation)


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, for choosing lists and for tests with a margin."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def fit(sample: np.ndarray, n: int, k: int) -> Model:
    """Centroids by Lloyd's rounds on the sample; probes so that TARGET of the k nearest within the sample are in probed lists."""
    random = np.random.RandomState(len(sample))
    lists = max(1, min(LISTS, len(sample), round(n**0.5)))
    centroids = sample[np.sort(random.choice(len(sample), lists, replace=False))]
    for _ in range(ROUNDS):
        own = squares(sample, centroids).argmin(1)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        centroids = centroids.copy()
        centroids[own[order][at]] = np.add.reduceat(sample[order], at) / np.diff(at, append=len(order))[:, None]
    own = squares(sample, centroids).argmin(1)
    asked = random.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    away = squares(sample[asked], sample)
    away[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(away, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(squares(sample[asked], centroids), axis=1, kind="stable"), axis=1, kind="stable")
    depth = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(TARGET * len(depth))))]) + 1 if len(depth) else 1
    return Model(centroids, rotation(sample.shape[1]), probes)


def assign(vectors: DataFrame, model: Model) -> DataFrame:
    """The index: each row with its list and, in columns c0, c1, .., blocks of its rotated coordinates."""
    d = model.d
    cuts = [(a, min(a + COLUMNS, d)) for a in range(0, d, COLUMNS)]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"), d)
            turned = x @ model.rotation
            own = np.concatenate([squares(x[i : i + 1024], model.centroids).argmin(1) for i in range(0, len(x), 1024)])
            slabs = [pa.FixedSizeListArray.from_arrays(np.ascontiguousarray(turned[:, a:z]).ravel(), z - a).cast(pa.list_(pa.float64())) for a, z in cuts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), *slabs], [*b.schema.names, "list", *(f"c{i}" for i in range(len(cuts)))])

    return vectors.mapInArrow(run, vectors.select("*", F.lit(0).alias("list"), *[F.array(F.lit(0.0)).alias(f"c{i}") for i in range(len(cuts))]).schema)


def probed(queries: DataFrame, model: Model, sizes: dict[int, int], least: int) -> DataFrame:
    """``(row, query_id, vector, list, nth)``: each query with the lists it probes, further ones as long as those hold fewer than ``least`` rows."""
    size = np.array([sizes.get(i, 0) for i in range(len(model.centroids))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            away = squares(matrix(b.column("vector"), model.d), model.centroids)
            order = np.argsort(np.where(size > 0, away, np.inf), axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1)
            takes = np.minimum(np.maximum((held < least).sum(1) + 1, model.probes), (size > 0).sum())
            who, nth = np.repeat(np.arange(b.num_rows), takes), np.concatenate([np.arange(t) for t in takes])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(who)).columns, pa.array(order[who, nth].astype(np.int32)), pa.array(nth.astype(np.int32))], [*b.schema.names, "list", "nth"])

    return queries.mapInArrow(run, queries.select("*", F.lit(0).alias("list"), F.lit(0).alias("nth")).schema)


FOUND = "row long, query_id long, found_row long, vec_id long, score double"


def scan(asked: DataFrame, index: DataFrame, model: Model, k: int) -> DataFrame:
    """FOUND: for each query of ``asked(list, block, chunk, row, query_id, vector, bound)`` the k nearest of
    ``index`` rows in that list, block and chunk, without those that the tests abandon. A null bound abandons none."""
    d, turn = model.d, model.rotation
    cuts = [(a, min(a + COLUMNS, d)) for a in range(0, d, COLUMNS)]

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return none
        column = lambda t, c: t[c].combine_chunks()
        query, own, other = matrix(column(q, "vector"), d), q["row"].to_numpy(), x["row"].to_numpy()
        turned, vector = query @ turn, matrix(column(x, "vector"), d)
        slabs = [matrix(column(x, f"c{i}"), z - a) for i, (a, z) in enumerate(cuts)]
        bound = np.nan_to_num(q["bound"].to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf) ** 2
        slack = 1e-9 * ((vector * vector).sum(1).max() + 1e-300)
        ids = x["vec_id"].to_pandas().astype("Int64")
        missing, ids = ids.isna().to_numpy(), ids.fillna(0).to_numpy(np.int64)
        out = []
        step = max(1, PAIRS // x.num_rows)
        for at in range(0, q.num_rows, step):
            j = slice(at, min(at + step, q.num_rows))
            part = squares(turned[j, : cuts[0][1]], slabs[0])
            i, c = np.nonzero((part <= (bound[j] * limit(0) + slack)[:, None]) & (own[j, None] != other[None, :]))
            part, i = part[i, c], i + at
            for n in range(1, len(cuts)):
                a, z = cuts[n]
                off = slabs[n][c] - turned[i, a:z]
                part = part + (off * off).sum(1)
                stay = part <= bound[i] * limit(n) + slack
                i, c, part = i[stay], c[stay], part[stay]
            off = vector[c] - query[i]
            away = np.sqrt((off * off).sum(1))
            order = np.lexsort((other[c], ids[c], missing[c], away, i))
            i, c, away = i[order], c[order], away[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            top = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < k
            out.append((i[top], c[top], away[top]))
        i, c, away = (np.concatenate(v) for v in zip(*out))
        return pa.table({"row": pa.array(own[i]), "query_id": q["query_id"].take(pa.array(i)), "found_row": pa.array(other[c]), "vec_id": x["vec_id"].take(pa.array(c)), "score": pa.array(away)})

    def limit(n: int) -> float:
        """The share of the squared bound that n + 1 blocks of columns may hold."""
        seen = cuts[n][1]
        return 1.0 if seen == d else seen / d * (1 + DEVIATIONS / seen**0.5) ** 2

    none = pa.table({c: pa.array([], t) for c, t in (("row", pa.int64()), ("query_id", pa.int64()), ("found_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
    key = ("list", "block", "chunk")
    return asked.groupBy(*key).cogroup(index.groupBy(*key)).applyInArrow(meet, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ranked from 1; ties to smaller ids, null ids last."""
    once = found.groupBy("row", "query_id", "found_row", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", F.asc_nulls_last("vec_id"), "found_row"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest of all other rows of ``vectors(vec_id, embedding)`` to
    each row for which the condition ``is_query`` holds, by Euclidean distance in double precision.

    Every row is indexed. Lists are dealt to blocks of about BLOCK rows, so a list that holds a third of
    all rows is many blocks. A query first scans one block of its nearest list in full; the k-th distance
    there bounds the scan of all blocks that it probes. Vectors that are null, zero, or hold nulls or
    non-finite entries take no part, nor do those of another length than the commonest. Rows that repeat
    an id are rows of their own (a query's own row alone is left out); null ids are no queries unless
    ``is_query`` says so, and lose ties. Extra columns take no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("asks"))
    kept = kept.where(finite(F.col("vector")) & F.exists("vector", lambda c: c != 0))
    kept = saved(kept.withColumn("row", F.monotonically_increasing_id()))
    d = commonest_length(kept, "vector")
    kept = kept.where(F.size("vector") == d)
    n = kept.count()
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = max(1, -(-n // SAMPLE))
    sample = kept.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("row", "vector").toArrow().sort_by("row")
    sample = matrix(sample["vector"].combine_chunks(), d)
    model = fit(sample if len(sample) else matrix(kept.orderBy("row").limit(1).select("vector").toArrow()["vector"].combine_chunks(), d), n, k)

    index = saved(assign(kept.select("row", "vec_id", "vector"), model))
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    asked = saved(probed(kept.where("asks").select("row", F.col("vec_id").alias("query_id"), "vector"), model, sizes, k + 1))
    asks = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    # one row a list: LISTS at most
    plan = F.broadcast(spark.createDataFrame([(i, -(-m // BLOCK), -(-asks.get(i, 0) // QUERIES)) for i, m in sizes.items()], "list int, blocks int, chunks int"))
    dealt = index.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    chunk = F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks")).cast("int").alias("chunk")

    seed = asked.where("nth = 0").join(plan, "list").select("row", "query_id", "vector", "list", F.pmod(F.xxhash64("row", F.lit(2)), F.col("blocks")).cast("int").alias("block"), chunk, F.lit(None).cast("double").alias("bound"))
    copies = dealt.where("chunks > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("blocks", "chunks")
    seeds = saved(best(scan(seed, copies, model, k), k))
    bounds = seeds.where(F.col("rank") == k).select("row", F.col("score").alias("bound"))
    whole = asked.join(bounds, "row", "left").join(plan, "list").select("row", "query_id", "vector", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk, "bound")
    found = scan(whole, copies, model, k).unionByName(seeds.drop("rank"))
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all ``embeddings`` to each whose vec_id is divisible by 100; see ``nearest_neighbours``."""
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
