"""Steps that were made more often than once, or grew faster than their input."""

import os
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quoin.functions import questions as Q
from quoin.functions import texts as T
from quoin.functions import vocabulary as V
from quoin.operators import extraction as X
from quoin.operators import search as S
from quoin.operators import structure as C
from quoin.plans import registry
from quoin.plans import more  # registry loads it


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_abbreviations_are_looked_up_once(spark, sf):
    texts = ["NĐ 15 của CP", "tt tt tt, nđ tt\ttt", "ttcp.tt", "(UBND)hđnd", "không có gì", "tt", "tt  tt", "qh15 xqh qhx", "TT\n", "tt-nđ-tt-tt", ""]
    got = {r.text: r.e for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", Q.expand_abbreviations(F.col("text")).alias("e")).collect()}
    for text in texts:
        t = text.lower()
        for short, full in V.ABBREVIATIONS:
            t = re.sub(rf"(^|[^a-zà-ỹđ]){short}($|[^a-zà-ỹđ])", rf"\g<1>{full}\g<2>", t)
        assert got[text] == t
    plan = optimized(registry.QUERIES["Q11"](spark, sf))
    assert plan.count("regexp_replace") <= len(V.ABBREVIATIONS)  # not once more to ask whether a text has variants


def test_article_chunks_are_cut_once(spark):
    colon = "Mở đầu có hơn năm mươi ký tự để làm một đoạn riêng, Chương I. Chung: x Điều 1. Một: a：b Điều 12. Hai： c Điều 3. Ba không có"
    rows = [(1, colon), (2, "Điều 1. Không có dấu " * 9), (3, None), (5, "Điều 7: bảy")]
    chunks = C.article_chunks(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.no, r.kind, r.article, r.chapter, r.text) for r in chunks.collect())
    first = colon[: colon.index("Điều 1.")].strip()
    assert got[:3] == [(1, 0, "other", None, "Chương I. Chung:", first), (1, 1, "article", "1", "Chương I. Chung:", "Điều 1. Một: a：b"), (1, 2, "article", "12", "Chương I. Chung:", "Điều 12. Hai： c Điều 3. Ba không có")]
    assert got[3:] == [(2, 0, "other", None, None, rows[1][1].strip()), (5, 0, "article", "7", None, "Điều 7: bảy")]
    assert optimized(chunks).count("regexp_extract_all") == 1


def test_pieces_are_joined_as_one_by_one(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("ab đ") for _ in range(n))
    for _ in range(40):
        base, pieces = [word(draw.choice((1, 9, 30, 90, 200))) for _ in range(30)], []
        for _ in range(60):  # whole ones, parts of them, and parts across the blank between two
            of = draw.choice((draw.choice(base), " ".join(pieces[-3:])))
            start = draw.randint(0, len(of))
            pieces.append(draw.choice((of, of[start : draw.randint(start, len(of))])))
        text = ""
        for piece in pieces:
            text = piece if text == "" else text if piece in text else f"{text} {piece}"
        assert T.joined_once(pieces) == text
    rows = [(1, 1, "n", "", "a"), (1, 2, "n", "xy", "bb"), (1, 3, "n", "x", "c"), (1, 4, "n", "z", "d"), (1, 5, "n", "y z", "e"), (2, 1, "n", None, "f"), (2, 2, "n", "q", "g")]
    merged = C.merge_pages(spark.createDataFrame(rows, "doc_id long, page long, node_id string, piece string, title string"))
    assert {(r.doc_id, r.text, r.title) for r in merged.collect()} == {(1, "xy z", "bb"), (2, None, "g")}


def test_joining_grows_with_the_text():
    pieces = [f"{i} " + "x" * 2000 for i in range(4000)]  # a search a piece would go through 16 GB
    start = time.process_time()
    assert T.joined_once(pieces) == " ".join(pieces)
    assert time.process_time() - start < 15


def test_replies_are_parsed_once(spark, sf):
    rows = [(1, '{"entities": [{"id": "a", "type": "T", "text": "x", "confidence": 0.5}], "relations": [{"source": "a", "target": "b", "type": "REF"}]}'), (2, "{'entities': [{'id': 'c', 'type': 'T'}],}"), (3, "nothing"), (4, None), (5, '{"relations": []}')]
    parsed = X.parse_replies(spark.createDataFrame(rows, "doc_id long, reply string"))
    assert {(r.doc_id, r.error) for r in parsed.collect()} == {(1, False), (2, False), (3, True), (4, True), (5, False)}
    got = {tuple(r) for r in X.extraction_parts(parsed).collect()}
    assert got == {(1, "entity", "1_a", "T", "x", 0.5), (1, "relation", "1_a", "REF", "1_b", None), (2, "entity", "2_c", "T", None, None)}
    entities, relations = X.explode_extractions(parsed)
    assert entities.count() == 2 and relations.count() == 1
    assert optimized(registry.QUERIES["N04"](spark, sf)).count("from_json") == 2 and optimized(registry.QUERIES["N03"](spark, sf)).count("from_json") == 2


def test_vectors_are_multiplied_in_blocks():
    draw = np.random.RandomState(5)
    q, rows = S._unit(draw.standard_normal((3000, 8)).round(1)), draw.standard_normal((3000, 8)).round(1)
    rows[7], rows[100:140] = np.nan, rows[0]  # ties, and one that is no vector
    vec = draw.permutation(3000)
    batch = pa.RecordBatch.from_arrays([pa.array(vec), pa.array(list(rows))], ["vec_id", "embedding"])
    tracemalloc.start()
    at, found, score = S._best(q, 10, [batch.slice(0, 2900), batch.slice(2900)])
    assert tracemalloc.get_traced_memory()[1] < 72e6  # all products at once would take that much
    tracemalloc.stop()
    scores = np.round(q @ S._unit(rows).T, 6)
    for i in range(0, 3000, 97):
        order = np.lexsort((vec, -scores[i]))[:10]
        assert found[at == i].tolist() == vec[order].tolist() and np.allclose(score[at == i], scores[i][order], atol=2e-6)
    few = [batch.slice(0, 4), batch.slice(5, 4)]  # fewer than k, with the one that is none as the last
    at, found, score = S._best(q[:2], 10, few)
    assert len(found) == 16 and np.isnan(score[at == 0][-1]) and found[7] == vec[7]


def test_files_stand_in_one_folder(spark):
    path = more._filed(spark.range(40).selectExpr("id AS key", "concat('v', id, chr(10), 'w') AS value"))
    assert {r.value for r in spark.read.text(path, wholetext=True).collect()} == {f"v{i}\nw\n" for i in range(40)}
    assert not [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("key=")]


def test_shared_fixture_steps_are_made_once(spark, sf):
    plan = optimized(registry.QUERIES["C01"](spark, sf))
    assert "dense_rank" not in plan and plan.count("Join") == 0  # articles and clauses are read, not made for each reader


def test_scores_are_summed_where_chunks_are(spark, sf):
    plan = registry.QUERIES["R02"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan)))
    assert not any("query_id" in keys and "chunk_id" in keys or "chunk_id" in keys and "term" in keys for keys in dealt)


def test_buckets_are_compared_without_rows_of_pairs(spark):
    draw = np.random.RandomState(8)
    rows = [(i, [float(x) for x in draw.standard_normal(6).round(2)]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = S.approx_vector_search(e.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), e, 5, 6, tables=2, bits=3)
    assert " join" not in optimized(found).lower()
    planes = np.random.RandomState(3).standard_normal((2, 3, 6)).round(4)
    m = np.array([v for _, v in rows], np.float32).astype(float)
    bucket = [[tuple(t @ v > 0) for t in planes] for v in m]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(20):
        near = [i for i in range(300) if any(a == b for a, b in zip(bucket[q], bucket[i]))]
        best = sorted(near, key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:5]
        assert [r.chunk_id for r in found.where(f"query_id = {q}").orderBy("rank").collect()] == best


def test_queries_stay_out_of_the_shuffle_of_words(spark):
    pairs = spark.createDataFrame([(1, "a b, c. B", "b c")], "id long, text string, query string")
    out = S.highlight(pairs)
    lines = re.sub(r"#\d+L?", "", optimized(out)).split("\n")
    last = max(i for i, line in enumerate(lines) if "windowspecdefinition(id, i" in line)
    assert "Project" in lines[last + 1] and not re.search(r"\bq\b", lines[last + 1])
    assert [tuple(r) for r in out.collect()] == [(1, 1, "a <mark>b</mark>, <mark>c</mark>. <mark>B</mark>", 2)]


def test_a_query_is_cut_once_a_text(spark):
    lines = optimized(S.highlight(spark.createDataFrame([(1, "a b", "b c")], "id long, text string, query string"))).split("\n")
    made = next(i for i, line in enumerate(lines) if "Generate " in line)
    assert [i > made for i, line in enumerate(lines) if "lower(query" in line] == [True]  # below the explode, not above it for each word
