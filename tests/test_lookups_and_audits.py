"""Substring joins, retrieval with settings as columns, audits, typed facts and long clauses at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import audits as A
from quoin.operators import lookups as Q
from quoin.operators import retrieval as R
from quoin.operators import structure as C
from quoin.operators import typed as T


def test_containing_equals_brute_force(spark):
    draw = random.Random(3)
    texts = [(i, "".join(draw.choice("abđ ") for _ in range(draw.randint(0, 12)))) for i in range(200)] + [(900, None)]
    phrases = {"".join(draw.choice("abđ ") for _ in range(draw.randint(1, 5))) for _ in range(60)} | {"", "zzz"}
    got = {tuple(r) for r in Q.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in [*phrases, None]], "phrase string")).collect()}
    assert got == {(i, p) for i, t in texts for p in phrases if t is not None and p and p in t}


def test_lookups_of_an_empty_graph(spark):
    nodes = spark.createDataFrame([], "id string, label string, name string, content string, num long")
    edges = spark.createDataFrame([], "src string, dst string, type string")
    specs = spark.createDataFrame([(i, intent, "t", "doc", None, 1) for i, intent in enumerate(("sanction_lookup", "prohibition_check", "definition_lookup", "article_lookup", None))], "question_id long, intent string, text string, document string, behaviour string, article_number long")
    assert Q.lookup(nodes, edges, specs).collect() == [] and Q.prohibited_acts(nodes, edges, specs).collect() == []


def test_one_plan_equals_a_run_a_query(spark):
    draw = random.Random(4)
    chunks = spark.createDataFrame([(f"c{i}", f"đoạn {i % 7} về điều {i % 5}", f"L{i % 2}", str(i % 5), None, None, f"T{i}") for i in range(60)], "chunk_id string, text string, law string, article string, clause string, point string, title string")
    results = spark.createDataFrame([(q, f"c{i}", s, float(draw.randint(0, 9))) for q in range(6) for s in ("vector", "bm25") for i in draw.sample(range(60), 40)], "query_id long, chunk_id string, source string, score double")
    ref = "struct<law:string,article:string,clause:string,point:string>"
    rows = [(0, "điều 3", ("L1", "3", None, None), True), (1, "điều 3", (None, "3", None, None), True), (2, "đoạn 2 điều", (None, None, None, None), False), (3, "", ("l0", "2", None, None), False), (4, None, (None, None, None, None), False), (5, "x", ("none", None, None, None), False)]
    asked = R.with_settings(spark.createDataFrame(rows, f"query_id long, text string, refs {ref}, exact boolean"), F.col("exact")).drop("exact")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = R.legal_retrieve(asked, results, chunks)
    assert key(whole) == sorted(x for q in range(6) for x in key(R.legal_retrieve(asked.where(F.col("query_id") == q), results.where(F.col("query_id") == q), chunks)))
    counts = {r.query_id: r["count"] for r in whole.groupBy("query_id").count().collect()}
    assert counts[0] == 3 and counts[2] == 5 and 5 not in counts
    articles = {r.article for r in whole.where("query_id = 1").join(chunks, "chunk_id").collect()}
    assert articles == {"3"}


def test_audits_take_nulls(spark):
    log = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "MATCH (a) RETURN a", None, "list", "general", "", [], None), (3, "match (a) return a.asset_set", None, "list", "general", "x", ["Luật 5/2020"], None)], "query_id long, generated string, params string, answer_type string, intent string, behaviour string, documents array<string>, time_reference string")
    got = {r.query_id: (r.passed, r.reasons) for r in A.audit_queries(log).collect()}
    assert got == {1: (False, ["syntax"]), 2: (True, []), 3: (False, ["constraints", "scope"])}


def test_mentions_cut_out_again(spark):
    docs = [(1, "Theo Khoản 2 Điều 5 và Điều  10, Khoản 3; khoản 9."), (2, ""), (3, None), (4, "không có"), (5, "Khoản 1")]
    rows = sorted(T.extract_mentions(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id, r.start))
    text = dict(docs)
    assert all(text[r.doc_id][r.start : r.end] == r.text for r in rows)
    assert [(r.doc_id, r.type, r.number, r.article) for r in rows] == [(1, "KHOAN", "2", "5"), (1, "DIEU", "5", None), (1, "DIEU", "10", None), (1, "KHOAN", "3", "10"), (5, "KHOAN", "1", None)]


def test_typed_properties_of_nothing(spark):
    one = spark.range(1)
    none = F.lit(None).cast("map<string,string>")
    row = one.select(T.map_entity_properties(F.lit("MON_HOC"), none).alias("a"), T.typed_node(F.lit("LUAT"), F.lit("Luật A"), F.lit(None).cast("string"), F.lit(0.5), none).alias("b"), T.typed_node(F.lit("?"), F.lit("x"), F.lit("y"), F.lit(None).cast("double"), none).alias("c")).first()
    assert row.a == {"so_tin_chi": "4"} and row.b.props["status"] == "Còn hiệu lực" and row.b.content == ""
    assert row.c.props == {"name": "x", "normalized_name": "y"}


@pytest.mark.parametrize("budget,parts", [(1000, 1), (9, 3), (1, 5)])
def test_long_clauses(spark, budget, parts):
    text = "Chương I. A\nĐiều 1. B\n1. một hai ba\na) bốn năm\nb) sáu bảy tám chín\nghi chú"
    lines = C.classify_lines(C.split_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")))
    got = sorted(C.split_long_clauses(C.carry_context(lines), budget).collect(), key=lambda r: r.part)
    assert [r.part for r in got] == list(range(1, len(got) + 1)) and len(got) <= parts
    assert " ".join(r.text for r in got) == text.split("\n", 2)[2].replace("\n", " ")


def test_counts_of_empty_tables(spark):
    nodes = spark.createDataFrame([], "id string, kind string, title string, text string")
    relations = spark.createDataFrame([], "src string, dst string, type string")
    tables, counts = A.post_process(nodes, relations, ((1, 1, None),))
    assert all(df.collect() == [] for df in tables.values()) and set(counts.read().values()) == {0}


@pytest.mark.parametrize("strict", [True, False])
def test_filter_by_whatever_is_named(spark, strict):
    """Also by a clause or a point alone, by a loose law without an article, and by an article with its word."""
    draw = random.Random(6)
    pick = lambda *values: draw.choice([None, "", *values])
    schema = "law string, article string, clause string, point string"
    chunks = [(i, pick("1/2019/QH14", "Luật 1/2019", "2/2019/qh14"), pick("1", "Điều 1", "2", "Điều Điều 1"), pick("1", "2"), pick("a", "b")) for i in range(150)]
    refs = [(i, pick("1/2019", "/qh14", "1/2019/QH14"), pick("1", "Điều 1", "Điều 2"), pick("1"), pick("A", "b")) for i in range(150)]

    def meets(r, c):
        law, article, clause, point = r[1:]
        of_law = not law or c[1] and (c[1] == law if strict else law.lower() in c[1].lower())
        of_article = not article or (c[2] == article if article.startswith("Điều") else c[2] in (article, f"Điều {article}"))
        return any(r[1:]) and of_law and of_article and (not clause or c[3] == clause) and (not point or c[4] == point.lower())

    found = R.legal_filter(spark.createDataFrame(chunks, f"chunk_id long, {schema}"), spark.createDataFrame(refs, f"query_id long, {schema}"), strict)
    assert sorted(map(tuple, found.collect())) == sorted((r[0], c[0]) for r in refs for c in chunks if meets(r, c))
    assert R.legal_filter(spark.createDataFrame(chunks, f"chunk_id long, {schema}"), spark.createDataFrame([(1, None, "", None, None)], f"query_id long, {schema}"), strict).collect() == []
