"""Cleaning with counts, and audits of generated queries and answers, over planted breaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import vocabulary as V
from quoin.operators import audits as A
from quoin.plans.fixtures import table
from quoin.plans.questions import lit
from quoin.plans.registry import query

# generated queries about orders; one breach or another by key
_LOG = """SELECT o_orderkey AS query_id,
    CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'MATCH (d:`Điều`) WHERE d.name CONTAINS $doc_name' WHEN 2 THEN 'MATCH (h:`Hành vi được phép`) RETURN h.name' WHEN 3 THEN 'MATCH (d:`Điều` SET d.x = 1 RETURN d'
        WHEN 4 THEN 'MATCH (h:`Hành vi cấm`)-[:BI_XU_LY]->(c:`Chế tài`) RETURN c.min_amount, c.max_amount' WHEN 5 THEN 'MATCH (k:`Khái niệm`) RETURN k.definition' WHEN 6 THEN 'MATCH (d) WHERE d.status = 1 RETURN count(d) // luật ' || (o_orderkey % 50)
        WHEN 7 THEN 'match (a)-[:THAY_THE]->(b) return [a, b] // vượt đèn đỏ khi lái xe' ELSE 'MATCH (d) RETURN d.created ORDER BY d.name' END AS generated,
    CASE o_orderkey % 4 WHEN 0 THEN 'doc_name: ' || (o_orderkey % 50) || '/2020/QH14' WHEN 1 THEN 'behaviour: Vượt Đèn Đỏ' ELSE NULL END AS params,
    CASE o_orderkey % 5 WHEN 0 THEN 'amount_range' WHEN 1 THEN 'boolean' WHEN 2 THEN 'definition' WHEN 3 THEN 'temporal' ELSE 'list' END AS answer_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'sanction_lookup' WHEN 1 THEN 'validity_check' ELSE 'prohibition_check' END AS intent,
    CASE WHEN o_orderkey % 7 < 3 THEN 'vượt đèn đỏ khi lái xe' WHEN o_orderkey % 7 < 5 THEN '' END AS behaviour,
    CASE o_orderkey % 6 WHEN 0 THEN 'Luật ' || (o_orderkey % 50) WHEN 1 THEN (o_orderkey % 50) || '/2020/QH14' ELSE '' END AS document,
    CASE WHEN o_orderkey % 11 = 0 THEN 'hiện nay' END AS time_reference FROM {orders}"""


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


_PAIRS = " OR ".join(f"(contains(g, {lit(b)}) AND NOT contains(g, {lit(a)}))" for a, b in V.POLARITY)
_D05 = f"""WITH l AS ({_LOG.replace('{orders}', 'orders')}), x AS (SELECT *, coalesce(generated, '') AS g, lower(coalesce(generated, '') || ' ' || coalesce(params, '')) AS whole, lower(document) AS d, list_filter(string_split(lower(coalesce(behaviour, '')), ' '), lambda w: w <> '') AS b FROM l),
r AS (SELECT query_id, CASE WHEN answer_type = 'amount_range' AND NOT {_has('upper(g)', V.AMOUNT_FIELDS)} THEN 'fail' WHEN answer_type = 'boolean' AND NOT {_has('upper(g)', V.BOOLEAN_FIELDS)} THEN 'warn' WHEN answer_type = 'definition' AND NOT {_has('upper(g)', V.DEFINITION_FIELDS)} THEN 'warn' ELSE 'pass' END AS shape,
CASE WHEN len(list_filter(b, lambda w: contains(whole, w))) < len(b) * 0.3::DOUBLE OR (d <> '' AND NOT contains(whole, d) AND NOT contains(whole, string_split(d, ' ')[-1])) THEN 'fail' ELSE 'pass' END AS constraints,
CASE WHEN intent IN ('prohibition_check', 'sanction_lookup') AND ({_PAIRS}) THEN 'fail' ELSE 'pass' END AS polarity,
CASE WHEN (answer_type = 'temporal' OR time_reference IS NOT NULL OR intent = 'validity_check') AND NOT {_has('upper(g)', V.VALIDITY_FIELDS)} THEN 'warn' ELSE 'pass' END AS validity,
CASE WHEN NOT contains(upper(g), 'MATCH') OR NOT contains(upper(g), 'RETURN') OR length(replace(g, '(', '')) <> length(replace(g, ')', '')) OR length(replace(g, '[', '')) <> length(replace(g, ']', '')) THEN 'fail' ELSE 'pass' END AS syntax,
CASE WHEN regexp_matches(upper(g), {lit(V.WRITES)}) THEN 'fail' ELSE 'pass' END AS read_only,
CASE WHEN d <> '' AND len(list_filter(string_split(d, '/'), lambda f: contains(whole, f))) = 0 THEN 'fail' ELSE 'pass' END AS scope FROM x)
SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {n} = 'fail' THEN '{n}' END" for n in A.QUERY_RULES)}], lambda v: v IS NOT NULL), ',') AS reasons, NOT ({' OR '.join(f"{n} = 'fail'" for n in A.QUERY_RULES)}) AS passed FROM r"""


@query("D05", _D05)
def d05(spark, sf):
    log = spark.sql(_LOG, orders=table(spark, sf, "orders")).withColumn("documents", F.when(F.col("document") != "", F.array("document")))
    return A.audit_queries(log).select("query_id", *A.QUERY_RULES, F.array_join("reasons", ",").alias("reasons"), "passed")


# answers about orders, with line items as evidence
_ANSWERS = """SELECT o_orderkey AS question_id, CASE o_orderkey % 4 WHEN 0 THEN 'amount_range' WHEN 1 THEN 'boolean' ELSE 'list' END AS answer_type,
    CASE o_orderkey % 5 WHEN 0 THEN 'amount_range' WHEN 1 THEN 'boolean' ELSE 'list' END AS asked_type, o_orderkey % 3 AS has_amount, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS low,
    CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'VND' END AS currency, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Luật 9' ELSE 'Luật ' || (o_orderkey % 3) END AS cited,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Luật ' || (o_orderkey % 3) ELSE '' END AS document, CASE o_orderkey % 8 WHEN 0 THEN 'penalty_amount' WHEN 1 THEN 'currency' WHEN 2 THEN 'effective_date' WHEN 3 THEN 'article_ref' ELSE 'list_items' END AS required,
    CASE WHEN o_orderkey % 10 = 0 THEN 'Có hiệu lực từ ngày ' || o_orderkey ELSE repeat('trả lời ', CAST(o_orderkey % 20 AS INT)) END AS text, CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '99' ELSE '0' END AS evidence_id,
    CASE WHEN o_orderkey % 5 = 2 THEN 'hiện nay' END AS time_reference, o_orderkey % 4 = 3 AS has_items FROM {orders}"""
_EVIDENCE = "SELECT l_orderkey AS question_id, CASE WHEN l_partkey % 20 = 0 THEN 'Quy định này đã Bị bãi bỏ' ELSE 'còn dùng ' || l_partkey END AS text FROM {lineitem} WHERE l_linenumber < 4 AND l_orderkey % 17 <> 0"
_D06 = f"""WITH a AS ({_ANSWERS.replace('{orders}', 'orders')}), e AS (SELECT question_id, count(*) AS n, bool_or({_has('lower(text)', V.REVOKED)}) AS revoked FROM ({_EVIDENCE.replace('{lineitem}', 'lineitem')}) GROUP BY 1),
x AS (SELECT a.*, coalesce(n, 0) AS n, coalesce(revoked, false) AS revoked FROM a LEFT JOIN e USING (question_id)),
r AS (SELECT question_id, CASE WHEN answer_type <> asked_type THEN 'warn' ELSE 'pass' END AS kind,
CASE WHEN CASE required WHEN 'penalty_amount' THEN has_amount = 0 WHEN 'currency' THEN has_amount = 0 OR currency = '' WHEN 'effective_date' THEN NOT contains(lower(text), 'hiệu lực') WHEN 'article_ref' THEN cited = '' ELSE NOT has_items END THEN 'fail' ELSE 'pass' END AS required,
CASE WHEN document <> '' AND cited <> '' AND NOT contains(lower(cited), lower(document)) AND NOT contains(lower(document), lower(cited)) THEN 'warn' ELSE 'pass' END AS scope,
CASE WHEN time_reference IS NOT NULL AND revoked THEN 'fail' ELSE 'pass' END AS validity,
CASE WHEN n = 0 AND length(text) > 100 THEN 'fail' WHEN cited <> '' AND evidence_id = '' THEN 'warn' WHEN evidence_id = 'x' OR (evidence_id IN ('0', '99') AND evidence_id::BIGINT >= n) THEN 'warn' ELSE 'pass' END AS grounded,
CASE WHEN asked_type = 'amount_range' AND (has_amount = 0 OR low IS NULL) THEN 'fail' ELSE 'pass' END AS amount FROM x),
s AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {n} = 'fail' THEN '{n}' END" for n in A.ANSWER_RULES)}], lambda v: v IS NOT NULL) AS f, {' + '.join(f"({n} = 'pass')::INT" for n in A.ANSWER_RULES)} AS p FROM r)
SELECT question_id, {', '.join(A.ANSWER_RULES)}, array_to_string(f, ',') AS reasons, CASE WHEN len(f) = 0 THEN 'accepted' WHEN len(f) <= 2 AND len(list_filter(f, lambda v: v NOT IN ('required', 'validity'))) = 0 THEN 'regenerate' ELSE 'rejected' END AS verdict, round(p / 6::DOUBLE, 6) AS confidence FROM s"""


@query("D06", _D06)
def d06(spark, sf):
    rows = spark.sql(_ANSWERS, orders=table(spark, sf, "orders"))
    one = lambda c: F.when(F.col(c) != "", F.array(c))
    amount = F.when(F.col("has_amount") > 0, F.struct(F.col("low").alias("min"), F.lit(None).cast("double").alias("max"), "currency"))
    none = F.lit(None).cast("string")
    answers = rows.select("question_id", "answer_type", amount.alias("amount"), F.when(F.col("cited") != "", F.array(F.struct(F.col("cited").alias("document"), F.lit("1").alias("article")))).alias("article_refs"), F.lit(None).cast("boolean").alias("boolean_answer"), none.alias("definition_text"), F.when(F.col("has_items"), F.array(F.lit("a"))).alias("list_items"), F.lit(None).cast("array<string>").alias("citations"), "text", one("evidence_id").alias("evidence_ids"), F.lit(None).cast("array<string>").alias("assumptions"))
    specs = rows.select("question_id", F.col("asked_type").alias("answer_type"), one("document").alias("documents"), F.array("required").alias("required"), "time_reference", none.alias("effective_date"))
    out = A.audit_answers(answers, specs, spark.sql(_EVIDENCE, lineitem=table(spark, sf, "lineitem")))
    return out.select("question_id", *A.ANSWER_RULES, F.array_join("reasons", ",").alias("reasons"), "verdict", "confidence")


# an extraction: orders as articles of customers, some twice in another spelling, line items as clauses
_NODES = """SELECT CAST(o_custkey AS STRING) AS doc_id, 'dieu_' || o_orderkey AS id, 'article' AS kind, 'Điều ' || o_orderkey AS title, 'Nội dung ' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN ' theo quy định tại Khoản' WHEN 1 THEN ' gồm:' ELSE '.' END AS text FROM {orders}
    UNION ALL SELECT CAST(o_custkey AS STRING), 'DIEU_' || o_orderkey || ' ', 'article', '', 'Nội dung ' || o_orderkey FROM {orders} WHERE o_orderkey % 3 = 0
    UNION ALL SELECT CAST(c_custkey AS STRING), 'chuong_' || c_custkey, 'chapter', 'Chương ' || c_custkey, 'Chương ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' Điều 1. x' ELSE '' END FROM {customer}"""
_RELATIONS = """SELECT 'chuong_' || o_custkey AS src, 'dieu_' || o_orderkey AS dst, 'CONTAINS' AS type FROM {orders} UNION ALL SELECT 'DIEU_' || o_orderkey || ' ', 'dieu_' || (o_orderkey + 1), 'KE_TIEP' FROM {orders} WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'dieu_' || o_orderkey, 'dieu_' || o_orderkey, 'REF' FROM {orders} WHERE o_orderkey % 10 = 0"""
_SRC = {"nodes": _NODES, "relations": _RELATIONS}
_IN = ", ".join(f"{n} AS ({q.replace('{', '').replace('}', '')})" for n, q in _SRC.items())
_CUT = "(" + " OR ".join(f"regexp_matches(text, {lit(p)})" for p in V.TRUNCATED) + ")"


def _made(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("orders", "customer")}
    return spark.sql(_NODES, **tables), spark.sql(_RELATIONS, orders=tables["orders"])


def _counted(tables: dict, counts: A.Counts):
    """Both tables used up, in one job each, and the counts that were taken on the way."""
    for df in tables.values():
        df.write.format("noop").mode("overwrite").save()
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(sorted(counts.read().items()), "name string, n long")


@query("D03", f"WITH {_IN}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, lower(trim(id)) ORDER BY length(text) DESC, id DESC) AS r, first_value(id) OVER (PARTITION BY doc_id, kind, lower(trim(id)) ORDER BY length(text) DESC, id DESC) AS new FROM nodes), b AS (SELECT * FROM k WHERE r = 1), m AS (SELECT DISTINCT id, new FROM k), f AS (SELECT DISTINCT coalesce(s.new, src) AS src, coalesce(d.new, dst) AS dst, type FROM relations LEFT JOIN m s ON s.id = src LEFT JOIN m d ON d.id = dst), g AS (SELECT * FROM f WHERE src <> dst AND src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b)), ch AS (SELECT * FROM orders) SELECT 'nodes_in' AS name, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'nodes_out', (SELECT count(*) FROM b) UNION ALL SELECT 'relations_in', (SELECT count(*) FROM relations) UNION ALL SELECT 'relations_out', (SELECT count(*) FROM g) UNION ALL SELECT 'changes_in', (SELECT count(*) FROM ch) UNION ALL SELECT 'changes_out', (SELECT count(*) FROM ch WHERE o_custkey % 2 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 50 <> o_custkey % 50) UNION ALL SELECT 'issues', (SELECT count(*) FROM b WHERE kind = 'article' AND {_CUT})")
def d03(spark, sf):
    nodes, relations = _made(spark, sf)
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    changes = orders.select(F.col("o_custkey").cast("string").alias("doc_id"), F.when(k % 4 != 0, F.concat(F.lit("Điều "), k)).alias("target_article"), F.concat((k % 50).cast("string"), F.lit("/QĐ")).alias("target_document"))
    documents = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), (F.col("c_custkey") % 2 == 0).alias("amends"), F.concat((F.col("c_custkey") % 50).cast("string"), F.lit("/QĐ")).alias("signature"))
    return _counted(*A.clean_extraction(nodes, relations, changes, documents))


@query("D04", f"WITH {_IN}, c AS (SELECT *, regexp_extract(dst, '^dieu_([0-9]+)', 1)::INT AS num FROM relations WHERE src <> dst), f AS (SELECT *, CASE WHEN type = 'CONTAINS' THEN 'chuong_' || CASE WHEN num <= 100 THEN 1 WHEN num <= 2000 THEN 2 ELSE 3 END ELSE src END AS new FROM c) SELECT 'truncated' AS name, (SELECT count(*) FROM nodes WHERE {_CUT}) AS n UNION ALL SELECT 'chapters_cleaned', (SELECT count(*) FROM nodes WHERE kind = 'chapter' AND contains(text, 'Điều')) UNION ALL SELECT 'relations_in', (SELECT count(*) FROM relations) UNION ALL SELECT 'not_to_themselves', (SELECT count(*) FROM c) UNION ALL SELECT 'chapters_set', (SELECT count(*) FROM f WHERE new <> src) UNION ALL SELECT 'relations_out', (SELECT count(*) FROM (SELECT DISTINCT new, dst, type FROM f))")
def d04(spark, sf):
    nodes, relations = _made(spark, sf)
    return _counted(*A.post_process(nodes.drop("doc_id"), relations, ((1, 1, 100), (2, 101, 2000), (3, 2001, None))))
