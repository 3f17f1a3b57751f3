"""Questions, types, replies, dumps and the hierarchy as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import legal as L
from quoin.functions import vocabulary as V
from quoin.operators import structure as C
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.questions import LOW, any_of, lit
from quoin.plans.registry import query
from quoin.plans.structure import L_, _lines
from quoin.sources.files import parse_crawled, read_extraction_json, read_plain_documents
from quoin.steps import shared_dir


def _first_cue(text: Column, cues, default: str) -> Column:
    return reduce(lambda a, c: a.when(F.contains(text, F.lit(c[0])), c[1]), cues, F.when(F.lit(False), "")).otherwise(default)


def question_spec(text: Column) -> Column:
    """Q14. Answer type and intent by the first cue, documents and articles named."""
    t = F.lower(text)
    named = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return F.struct(_first_cue(t, V.ANSWER_CUES, "article_ref").alias("answer_type"), _first_cue(t, V.INTENT_CUES, "general").alias("intent"), named(V.SCOPE_DOCUMENT).alias("documents"), named(V.SCOPE_ARTICLE).alias("articles"))


def mapped(value: Column, pairs, default: str) -> Column:
    """F23, F30. A value by a fixed map, unknown ones by the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), value), F.lit(default))


def parse_step_reply(reply: Column) -> Column:
    """N10. Step record from the JSON within a reply, else from its words."""
    schema = "reasoning_step string, information_gaps array<string>, next_search_query string, confidence double, can_answer_now boolean"
    body = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    j = F.from_json(body, schema)
    ok = j["reasoning_step"].isNotNull() | j["confidence"].isNotNull() | j["can_answer_now"].isNotNull()
    done = F.lower(reply).rlike("|".join(V.COMPLETION))
    return F.struct(
        F.when(ok, F.coalesce(j["reasoning_step"], F.lit(""))).otherwise(F.substring(reply, 1, 500)).alias("step"),
        F.when(ok, F.coalesce(j["confidence"], F.lit(0.5))).otherwise(F.when(done, 0.75).otherwise(0.5)).alias("confidence"),
        F.when(ok, F.coalesce(j["can_answer_now"], F.lit(False))).otherwise(done).alias("answerable"),
    )


def _cases(cues, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({LOW}, {lit(c)}) THEN {lit(v)}" for c, v in cues) + f" ELSE {lit(default)} END"


@query("Q14", duck("legal_queries") + f"SELECT query_id, {_cases(V.ANSWER_CUES, 'article_ref')} AS answer_type, {_cases(V.INTENT_CUES, 'general')} AS intent, array_to_string(regexp_extract_all(text, {lit(V.SCOPE_DOCUMENT)}, 1), '|') AS documents, array_to_string(regexp_extract_all(text, {lit(V.SCOPE_ARTICLE)}, 1), '|') AS articles FROM legal_queries")
def q14(spark, sf):
    out = fixture(spark, sf, "legal_queries").select("query_id", question_spec(F.col("text")).alias("s")).select("query_id", "s.*")
    return out.withColumns({c: F.array_join(c, "|") for c in ("documents", "articles")})


_REL = [p[0] for p in V.EDGE_TYPES] + ["KHAC"]


@query("F23", f"SELECT o_orderkey, coalesce(map_extract_value(MAP {{{', '.join(f'{lit(a)}: {lit(b)}' for a, b in V.EDGE_TYPES)}}}, [{', '.join(map(lit, _REL))}][o_orderkey % {len(_REL)} + 1]), 'LIEN_QUAN') AS edge_type FROM orders")
def f23(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _REL)), (F.col("o_orderkey") % len(_REL) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", mapped(raw, V.EDGE_TYPES, "LIEN_QUAN").alias("edge_type"))


@query("F30", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'THAY_THE' WHEN 2 THEN 'BO_SUNG' WHEN 3 THEN 'BAI_BO' ELSE 'SUA_DOI' END AS type FROM orders")
def f30(spark, sf):
    word = F.element_at(F.array(*map(F.lit, ("thay thế", "sửa đổi", "bổ sung", "bãi bỏ", "khác"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", mapped(word, V.AMENDMENT_TYPES, "SUA_DOI").alias("type"))


_DONE = f"regexp_matches(lower(reply), {lit('|'.join(V.COMPLETION))})"


@query("N10", duck("answers") + f"SELECT doc_id, CASE WHEN style < 2 THEN t ELSE substr(reply, 1, 500) END AS step, CASE WHEN style = 0 THEN ('0.' || doc_id % 10)::DOUBLE WHEN style = 1 THEN 0.5 WHEN {_DONE} THEN 0.75 ELSE 0.5 END AS confidence, CASE style WHEN 0 THEN doc_id % 3 = 0 WHEN 1 THEN false ELSE {_DONE} END AS answerable FROM (SELECT *, CASE style WHEN 2 THEN t || ' Tóm lại, xong.' ELSE brief END AS reply FROM answers WHERE t IS NOT NULL)")
def n10(spark, sf):
    k = F.col("style")
    step = F.concat(F.lit('{"reasoning_step": "'), "escaped", F.lit('"'))
    sure = F.concat(F.lit(', "confidence": 0.'), F.col("doc_id") % 10, F.lit(', "can_answer_now": '), (F.col("doc_id") % 3 == 0).cast("string"))
    reply = F.when(k == 0, F.concat(F.lit("so: "), step, sure, F.lit("} end"))).when(k == 1, F.concat(step, F.lit("}"))).when(k == 2, F.concat("t", F.lit(" Tóm lại, xong."))).otherwise(F.col("brief"))
    return fixture(spark, sf, "answers").where("t IS NOT NULL").select("doc_id", parse_step_reply(reply).alias("s")).select("doc_id", "s.*")


@query("S02", "SELECT url, 'T' || page_id AS title, length(html) AS length, html AS body FROM pages")
def s02(spark, sf):
    body = F.col("html")
    text = F.concat(F.lit("URL: "), "url", F.lit("\nTitle: T"), "page_id", F.lit("\nCrawled: 2024-05-01 10:00:00\nLength: "), F.length("html"), F.lit(" characters\n" + "=" * 100 + "\n"), body)
    return parse_crawled(table(spark, sf, "pages").select(text.alias("text"))).select("url", "title", "length", "body")


def chunk_records(context, law: Column):
    """C07. Id, prefix and tokens of a chunk an article."""
    rows = C.article_segments(context)
    heads = context.where("level = 'DIEU'").select("doc_id", "pos", "chapter_id")
    rows = rows.join(heads, ["doc_id", "pos"]).withColumns({"section_id": F.lit(None).cast("string"), "clause_no": F.lit(None).cast("string"), "point_no": F.lit(None).cast("string"), "law": law})
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("i", index).select("doc_id", L.chunk_id(F.col("law"), F.col("i")).alias("chunk_id"), L.embedding_prefix(F.col("law"), F.lit("LAW")).alias("prefix"), L.count_tokens(F.col("text")).alias("tokens"))


@query("C07", L_ + ", a AS (SELECT doc_id, article, chapter, string_agg(line, ' ' ORDER BY pos) AS text FROM n WHERE article > 0 GROUP BY ALL), p AS (SELECT *, 'CHUONG=' || CASE chapter WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' ELSE 'V' END AS ch FROM a) SELECT doc_id, 'LAW=L' || doc_id || ':' || ch || ':DIEU=' || article || ':' || substr(md5('LAW=L' || doc_id || ':' || ch || ':DIEU=' || article || ':' || article), 1, 8) AS chunk_id, 'DOC=L' || doc_id || ' | TYPE=LAW | ' || ch || ' | DIEU=' || article AS prefix, floor(len(string_split(text, ' ')) * 15 / 10)::INT AS tokens FROM p")
def c07(spark, sf):
    return chunk_records(C.carry_context(_lines(spark, sf)), F.concat(F.lit("L"), "doc_id"))


@query("C12", "SELECT doc_id, 'docx' AS source_type, lang AS article_no, NULL AS page FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'pdf', NULL, (doc_id % 9)::VARCHAR FROM documents WHERE doc_id % 2 = 1")
def c12(spark, sf):
    d = table(spark, sf, "documents")
    docx = d.where("doc_id % 2 = 0").select("doc_id", F.lit("docx").alias("source_type"), F.col("lang").alias("article_no"))
    pdf = d.where("doc_id % 2 = 1").select("doc_id", F.lit("pdf").alias("source_type"), (F.col("doc_id") % 9).cast("string").alias("page"))
    return docx.unionByName(pdf, allowMissingColumns=True)


@query("G01", L_ + ", h AS (SELECT doc_id, pos, level, CASE level WHEN 'CHUONG' THEN -1 WHEN 'DIEU' THEN max(CASE WHEN level = 'CHUONG' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) WHEN 'KHOAN' THEN max(CASE WHEN level = 'DIEU' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) ELSE max(CASE WHEN level = 'KHOAN' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) END AS parent FROM n WHERE level <> 'TEXT'), x AS (SELECT doc_id, pos, parent, lead(pos) OVER (PARTITION BY doc_id, parent ORDER BY pos) AS nx FROM h) SELECT doc_id || ':' || pos AS src, CASE WHEN parent < 0 THEN doc_id::VARCHAR ELSE doc_id || ':' || parent END AS dst, 'THUOC_VE' AS type FROM x UNION ALL SELECT doc_id || ':' || pos, doc_id || ':' || nx, 'KE_TIEP' FROM x WHERE nx IS NOT NULL")
def g01(spark, sf):
    tree = C.legal_tree(_lines(spark, sf))
    node = lambda c: F.concat_ws(":", F.col("doc_id").cast("string"), F.col(c).cast("string"))  # noqa: E731  a null parent: the document
    up = tree.select(node("pos").alias("src"), node("parent").alias("dst"), F.lit("THUOC_VE").alias("type"))
    return up.unionByName(tree.where("next IS NOT NULL").select(node("pos").alias("src"), node("next").alias("dst"), F.lit("KE_TIEP").alias("type")))


def _filed(rows: DataFrame, form: str = "text") -> str:
    """A folder with a file for each ``rows(key, value)``; without folders in it, which Spark would list one by one."""
    path = shared_dir(rows.sparkSession)
    rows.repartition("key").select("value").write.option("maxRecordsPerFile", 1).format(form).save(path)
    return path


_SUPPLIES = "SELECT l_suppkey, s_name, count(*) AS n, min(l_partkey) AS part FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_name"


@query("S01", f"SELECT 'Điều ' || l_suppkey || '. ' || s_name || chr(10) || '1. Mặt hàng ' || part || ', ' || n || chr(10) AS text, NULL AS error, 'txt' AS suffix FROM ({_SUPPLIES}) UNION ALL SELECT NULL, 'unsupported suffix', 'csv' FROM ({_SUPPLIES}) WHERE l_suppkey % 3 = 0")
def s01(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    made = joined.groupBy(F.col("l_suppkey").alias("key"), "s_name").agg(F.count("*").alias("n"), F.min("l_partkey").alias("part"))
    made = made.select("key", F.concat(F.lit("Điều "), "key", F.lit(". "), "s_name", F.lit("\n1. Mặt hàng "), "part", F.lit(", "), "n").alias("value"))
    rows = read_plain_documents(spark, _filed(made)).unionByName(read_plain_documents(spark, _filed(made.where("key % 3 = 0"), "csv")))
    return rows.select("text", "error", F.element_at(F.split("file_name", r"\."), -1).alias("suffix"))


@query("S03", """WITH k AS (SELECT l_suppkey AS s, l_returnflag AS f, l_linestatus AS st, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT s, f, 'Điều ' || f AS title, 'gồm ' || sum(n) AS body FROM k GROUP BY s, f)
    SELECT 'a' || s || f AS article_id, NULL AS clause_id, title, title || chr(10) || body AS text FROM a WHERE f = 'R'
    UNION ALL SELECT 'a' || s || f, 'k' || s || f || st, t, t || chr(10) || 'số ' || n FROM (SELECT k.*, CASE st WHEN 'F' THEN title ELSE title || chr(10) || 'Khoản ' || st END AS t FROM k JOIN a USING (s, f) WHERE f <> 'R')
    UNION ALL SELECT NULL, 'r' || s_suppkey, s_name, s_name || chr(10) || 'nước ' || s_nationkey FROM supplier WHERE s_suppkey IN (SELECT s FROM k)""")
def s03(spark, sf):
    title = F.concat(F.lit("Điều "), "f")
    counted = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st")).agg(F.count("*").alias("n"))
    clause = F.struct(F.concat(F.lit("k"), "key", "f", "st").alias("id"), F.when(F.col("st") == "F", title).otherwise(F.concat(F.lit("Khoản "), "st")).alias("title"), F.concat(F.lit("số "), "n").alias("full_text"))
    own = counted.groupBy("key", "f").agg(F.sort_array(F.collect_list(F.when(F.col("f") != "R", clause))).alias("clauses"), F.sum("n").alias("n"))
    article = F.struct(F.concat(F.lit("a"), "key", "f").alias("id"), title.alias("title"), F.concat(F.lit("gồm "), "n").alias("full_text"), "clauses")
    alone = F.struct(F.concat(F.lit("r"), "key").alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("nước "), "s_nationkey").alias("full_text"))
    docs = own.groupBy("key").agg(F.sort_array(F.collect_list(article)).alias("articles")).join(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "key"), "key")
    value = F.to_json(F.struct(F.struct("articles", F.array(alone).alias("clauses")).alias("stage1_structure")))
    return read_extraction_json(spark, _filed(docs.select("key", value.alias("value"))))
