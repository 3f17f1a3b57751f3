"""Every registered query against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from quoin.plans import registry


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return round(float(value), 6)


def rows(df_rows, columns):
    return sorted((tuple(normal(r[c]) for c in columns) for r in df_rows), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, r)) for r in result.fetchall()]
    assert rows([r.asDict() for r in df.collect()], columns) == rows(expected, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_approximate_search_recall(spark, sf):
    from quoin.operators.search import approx_vector_search, vector_search

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.chunk_id) for r in vector_search(q, e, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in approx_vector_search(q, e, 10, len(e.first().embedding)).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_bm25_without_matches(spark):
    from quoin.operators.search import bm25_search

    chunks = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "gamma"), (2, "beta"), (3, None)], "query_id long, text string")
    assert [(r.query_id, r.chunk_id) for r in bm25_search(queries, chunks, 5).collect()] == [(2, 1)]


def test_long_chains_and_cycles_end(spark):
    from quoin.operators.graph import chain_end

    chain = [(f"v{i + 1:04}", f"v{i:04}", "SUA_DOI") for i in range(300)]
    cycle = [("b", "a", "SUA_DOI"), ("a", "b", "SUA_DOI")]
    got = {r.id: (r.last, r.depth) for r in chain_end(spark.createDataFrame(chain + cycle, "src string, dst string, type string"), ["SUA_DOI"]).collect()}
    assert all(got[f"v{i:04}"] == ("v0300", 300 - i) for i in range(300))
    assert got["a"][1] > 300 and got["b"][1] > 300 and len(got) == 302


def test_approximate_search_asks_every_fiftieth(spark, sf):
    asked = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    assert len(asked) > 1 and {r.query_id for r in registry.QUERIES["R06"](spark, sf).select("query_id").distinct().collect()} == asked


def test_batch_wins_ties(spark):
    from quoin.operators.graph import upsert

    old = spark.createDataFrame([(1, "old", 5), (2, "old", 7), (3, "old", 1)], "id long, text string, version long")
    new = spark.createDataFrame([(1, "new", 5), (2, "new", 6), (4, "new", 1)], "id long, text string, version long")
    assert sorted((r.id, r.text) for r in upsert(old, new, ("id",), "version").collect()) == [(1, "new"), (2, "old"), (3, "old"), (4, "new")]


def test_batch_search_takes_words_of_any_script_and_answers_every_query(spark, tmp_path):
    texts = [(1, "Điều khoản"), (2, "điều"), (3, "закон i u"), (4, None), (5, "Größe"), (6, "gr e")]
    asked = [(1, "điều"), (2, "Закон"), (3, "größe"), (4, "nothing"), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["R19"](spark, str(tmp_path)).collect())
    assert got == [(1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 0, None), (5, 0, None)]
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(c.execute(registry.ORACLES["R19"]).fetchall()) == got
