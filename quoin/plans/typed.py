"""Typed facts, long clauses, retrieval in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import vocabulary as V
from quoin.operators import retrieval as R
from quoin.operators import structure as C
from quoin.operators import typed as T
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.questions import lit
from quoin.plans.ranking import _results
from quoin.plans.registry import query
from quoin.plans.structure import L_, P_, _lines, _statutes, ST_

_LABELS = [k for k, _, _ in V.LABEL_KEYS] + ["KHAC"]
_flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
# properties of parts under old and own keys
_PROPS = f"SELECT p_partkey, CASE p_partkey % {len(_LABELS)} " + " ".join(f"WHEN {i} THEN {lit(x)}" for i, x in enumerate(_LABELS)) + " END AS label, CASE p_partkey % 4 WHEN 0 THEN 'MON_HOC_' || p_partkey WHEN 1 THEN '' ELSE NULL END AS code, CASE WHEN p_partkey % 3 = 0 THEN 'ID ' || p_partkey END AS id, CASE WHEN p_partkey % 5 < 3 THEN p_type END AS name, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS title, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 6 AS VARCHAR(9)) END AS so_tin_chi, p_brand AS extra FROM {part}"
_KEY = lambda i, d: "CASE label " + " ".join(f"WHEN {lit(k[0])} THEN {lit(k[i])}" for k in V.LABEL_KEYS) + f" ELSE {lit(d)} END"


@query("F22", f"WITH p AS ({_PROPS.replace('{part}', 'part')}), i AS (SELECT *, coalesce(nullif(code, ''), id, name) AS raw FROM p), n AS (SELECT *, trim(replace(replace(CASE WHEN starts_with(raw, 'MON_HOC_') THEN substr(raw, 9) ELSE raw END, '(', ''), ')', ''), '_') AS own FROM i) SELECT p_partkey, array_to_string(list_sort(list_filter([{_KEY(1, 'id')} || '=' || own, {_KEY(2, 'name')} || '=' || coalesce(name, title, own), 'extra=' || extra, 'so_tin_chi=' || CASE WHEN label = 'MON_HOC' THEN coalesce(so_tin_chi, '4') ELSE so_tin_chi END], lambda x: x IS NOT NULL)), ';') AS props FROM n")
def f22(spark, sf):
    rows = spark.sql(_PROPS, part=table(spark, sf, "part"))
    keys = ("code", "id", "name", "title", "so_tin_chi", "extra")
    props = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull())
    return rows.select("p_partkey", _flat(T.map_entity_properties(F.col("label"), props)).alias("props"))


_KINDS = ("DIEU", "KHOAN", "KHAI_NIEM", "HANH_VI_CAM", "CHE_TAI", "QUYEN", "NGHIA_VU", "LUAT", "CHU_THE")
_ENT = "SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS kind, p_type AS text, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS normalized, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS content, CASE WHEN p_partkey % 4 = 0 THEN 'Hết hiệu lực' END AS status, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR(9)) END AS number FROM {part}"


@query("F29", f"WITH e AS ({_ENT.replace('{part}', 'part')}) SELECT p_partkey, CASE kind WHEN 'DIEU' THEN coalesce(content, '') WHEN 'KHOAN' THEN coalesce(content, text) WHEN 'KHAI_NIEM' THEN coalesce(content, '') WHEN 'LUAT' THEN '' WHEN 'CHU_THE' THEN '' ELSE text END AS content, array_to_string(list_sort(list_concat(['name=' || text, 'normalized_name=' || coalesce(normalized, text), 'confidence=0.5'], CASE kind WHEN 'DIEU' THEN ['article_number=' || coalesce(number, '0'), 'article_title=' || text, 'article_content=' || coalesce(content, '')] WHEN 'KHOAN' THEN ['clause_number=0', 'clause_content=' || coalesce(content, text)] WHEN 'KHAI_NIEM' THEN ['term=' || text, 'definition=' || coalesce(content, '')] WHEN 'HANH_VI_CAM' THEN ['prohibited_act=' || text] WHEN 'CHE_TAI' THEN ['sanction_type=', 'sanction_content=' || text] WHEN 'QUYEN' THEN ['right_content=' || text] WHEN 'NGHIA_VU' THEN ['obligation_content=' || text] WHEN 'LUAT' THEN ['document_number=', 'title=' || text, 'issuing_authority=', 'effective_date=', 'status=' || coalesce(status, '{V.IN_FORCE}')] ELSE [] END)), ';') AS props FROM e")
def f29(spark, sf):
    rows = spark.sql(_ENT, part=table(spark, sf, "part"))
    meta = F.map_filter(F.create_map(F.lit("content"), F.col("content"), F.lit("definition"), F.col("content"), F.lit("status"), F.col("status"), F.lit("article_number"), F.col("number")), lambda k, v: v.isNotNull())
    return rows.select("p_partkey", T.typed_node(F.col("kind"), F.col("text"), F.col("normalized"), F.lit(0.5), meta).alias("n")).select("p_partkey", "n.content", _flat(F.col("n.props")).alias("props"))


# statutes' own lines, and mentions by key
_SAID = "SELECT o_orderkey AS doc_id, 'Theo ' || CASE o_orderkey % 3 WHEN 0 THEN 'Khoản ' || (o_orderkey % 7) || ' Điều  ' || (o_orderkey % 50) WHEN 1 THEN 'Điều ' || (o_orderkey % 50) || ', Khoản ' || (o_orderkey % 9) ELSE 'luật' END || CASE WHEN o_orderkey % 5 = 0 THEN ' và Khoản 1 Điều 2' ELSE '' END || '.' AS text FROM {orders}"


@query("G06", f"WITH d AS ({_SAID.replace('{orders}', 'orders')}), m AS (SELECT doc_id, text AS whole, unnest(regexp_extract_all(text, '(?:Điều|Khoản)\\s+[0-9]+')) AS text, generate_subscripts(regexp_extract_all(text, '(?:Điều|Khoản)\\s+[0-9]+'), 1) AS i FROM d), g AS (SELECT doc_id, length(list_aggregate(regexp_split_to_array(whole, '(?:Điều|Khoản)\\s+[0-9]+')[1:i], 'string_agg', '')) + coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, whole, text, i, regexp_extract(text, '[0-9]+') AS number FROM m), w AS (SELECT *, lead(start) OVER w AS ns, lead(text) OVER w AS nt, lead(number) OVER w AS nn, last_value(CASE WHEN text LIKE 'Điều%' THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, start::INT AS start, (start + length(text))::INT AS \"end\", substr(whole, start::INT + 1, length(text)) AS text, CASE WHEN text LIKE 'Điều%' THEN 'DIEU' ELSE 'KHOAN' END AS type, number, CASE WHEN text LIKE 'Khoản%' THEN CASE WHEN nt LIKE 'Điều%' AND ns = start + length(text) + 1 THEN nn ELSE before END END AS article FROM w")
def g06(spark, sf):
    said = spark.sql(_SAID, orders=table(spark, sf, "orders"))
    return T.extract_mentions(said).drop("confidence")


@query("G02", L_ + "SELECT doc_id || '_' || replace(replace(replace(line, ':', '_'), '/', '_'), ' ', '_') AS id, level AS label, CASE WHEN level = 'KHOAN' THEN substr(repeat(line || ' ', 60), 1, 2000) ELSE substr(repeat(line || ' ', 60), 1, 1000) END AS content, CASE WHEN level IN ('DIEU', 'KHOAN') THEN TRY_CAST(regexp_extract(line, '([0-9]+)', 1) AS BIGINT) END AS num FROM n WHERE level IN ('CHUONG', 'DIEU', 'KHOAN')")
def g02(spark, sf):
    heads = _lines(spark, sf).where("level IN ('CHUONG', 'DIEU', 'KHOAN')")
    tree = heads.select(F.concat_ws(":", F.col("doc_id").cast("string"), "line").alias("path"), "level", "ident", "title", F.repeat(F.concat("line", F.lit(" ")), F.lit(60)).alias("text"))
    return T.tree_nodes(tree).select("id", "label", "content", "num")


_FACTS = "SELECT 'P' || (p_partkey % 300) AS id, CASE p_partkey % 2 WHEN 0 THEN 'KHAI_NIEM' ELSE 'QUYEN' END AS kind, 'F' || p_partkey AS name, repeat('x', CAST(p_partkey % 11 AS INT)) AS content, p_partkey FROM {part}"


@query("G03", f"WITH f AS ({_FACTS.replace('{part}', 'part')}) SELECT DISTINCT id AS src, 'O' || l_orderkey AS dst, 'QUY_DINH' AS type FROM f JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber = 1 AND ('O' || l_orderkey) IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0) UNION SELECT id, 'P' || ((p_partkey + 1) % 400), 'LIEN_QUAN' FROM f WHERE 'P' || ((p_partkey + 1) % 400) IN (SELECT id FROM f)")
def g03(spark, sf):
    facts = spark.sql(_FACTS, part=table(spark, sf, "part"))
    near = facts.select("p_partkey", F.struct(F.lit("LIEN_QUAN").alias("type"), F.concat(F.lit("P"), (F.col("p_partkey") + 1) % 400).alias("target")).alias("l"))
    far = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"), F.struct(F.lit("QUY_DINH").alias("type"), F.concat(F.lit("O"), "l_orderkey").alias("target")).alias("l"))
    links = near.unionByName(far).groupBy("p_partkey").agg(F.collect_list("l").alias("links"))
    nodes = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("O"), "o_orderkey").alias("id"))
    return T.semantic_nodes(facts.join(links, "p_partkey"), nodes)[1]


@query("G04", "WITH r AS (SELECT 'O' || l_orderkey AS src, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'O' || (l_orderkey + l_partkey % 3) END AS dst, CASE l_partkey % 4 WHEN 0 THEN 'DAN_CHIEU' WHEN 1 THEN 'VIEN_DAN' ELSE 'THAM_CHIEU' END AS type, 'theo ' || l_suppkey AS t FROM lineitem) SELECT src, dst, type, min(t) AS reference_text FROM r WHERE dst <> '' AND src IN (SELECT 'O' || o_orderkey FROM orders) AND dst IN (SELECT 'O' || o_orderkey FROM orders) GROUP BY ALL")
def g04(spark, sf):
    k = F.col("l_partkey")
    refs = table(spark, sf, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("source_id"), F.when(k % 9 != 0, F.concat(F.lit("O"), F.col("l_orderkey") + k % 3)).alias("target_id"), F.when(k % 4 == 0, "DAN_CHIEU").when(k % 4 == 1, "VIEN_DAN").alias("type"), F.concat(F.lit("theo "), "l_suppkey").alias("reference_text"))
    return T.reference_edges(refs, table(spark, sf, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id")))


@query("C18", duck("entities") + f"SELECT entity_id::VARCHAR AS src, CASE upper(type) {' '.join(f'WHEN {lit(a)} THEN {lit(b)}' for a, b in V.EDGE_TYPES)} ELSE 'LIEN_QUAN' END AS type, 'confidence=' || confidence || ';raw_type=' || type AS props, substr(repeat(text, 20), 1, 200) AS name FROM (SELECT entity_id, text, confidence, CASE entity_id % 5 WHEN 0 THEN 'sua_doi' WHEN 1 THEN 'THAY_THE' WHEN 2 THEN 'Dinh_Nghia' ELSE type END AS type FROM entities)")
def c18(spark, sf):
    k = F.col("entity_id")
    e = fixture(spark, sf, "entities").select(k.cast("string").alias("id"), F.repeat("text", F.lit(20)).alias("text"), "confidence", F.when(k % 5 == 0, "sua_doi").when(k % 5 == 1, "THAY_THE").when(k % 5 == 2, "Dinh_Nghia").otherwise(F.col("type")).alias("type"))
    nodes, edges = T.graph_rows(e, e.withColumns({"src": F.col("id"), "dst": F.col("id")}), V.EDGE_TYPES, "LIEN_QUAN")
    return edges.select("src", "type", _flat(F.col("props")).alias("props")).join(nodes.select(F.col("id").alias("src"), "name"), "src")


@query("A16", "WITH r AS (SELECT l_orderkey AS article_id, 'entities' AS kind, 'P' || l_partkey AS fact FROM lineitem UNION SELECT l_orderkey, 'relations', l_returnflag || l_linestatus FROM lineitem UNION SELECT l_orderkey, 'changes', 'S' || l_suppkey FROM lineitem WHERE l_linenumber = 1) SELECT kind, count(*) AS n, count(DISTINCT article_id) AS articles FROM r GROUP BY kind")
def a16(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.collect_list(F.concat(F.lit("P"), "l_partkey")).alias("entities"), F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("relations"), F.collect_list(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("S"), "l_suppkey"))).alias("changes"))
    return T.collect_semantics(rows)[1]


_SAYS = "SELECT o_orderkey AS question_id, CASE o_orderkey % 4 WHEN 0 THEN 'no record' ELSE 'so: {\"answer_type\": \"' || CASE o_orderkey % 3 WHEN 0 THEN 'AMOUNT_RANGE' WHEN 1 THEN 'boolean' ELSE 'poem' END || '\", \"min_amount\": ' || (o_orderkey % 100) || CASE WHEN o_orderkey % 2 = 0 THEN ', \"max_amount\": ' || (o_orderkey % 70) ELSE '' END || ', \"effective_date\": \"' || CASE o_orderkey % 5 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '05/03/2021' ELSE '2020-01-0' || (o_orderkey % 9 + 1) END || '\", \"article_refs\": [{\"document\": \"L\", \"article\": \"' || (o_orderkey % 40) || '\"}]} end' END AS reply FROM "


@query("N11", "SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 4 = 0 THEN 'article_ref' WHEN o_orderkey % 3 = 0 THEN 'amount_range' WHEN o_orderkey % 3 = 1 THEN 'boolean' ELSE 'article_ref' END AS answer_type, CASE WHEN o_orderkey % 4 > 0 THEN least(o_orderkey % 100, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 70 END)::DOUBLE END AS min, CASE WHEN o_orderkey % 4 > 0 THEN greatest(o_orderkey % 100, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 70 END)::DOUBLE END AS max, CASE WHEN o_orderkey % 4 > 0 THEN CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '2021-03-05' ELSE '2020-01-0' || (o_orderkey % 9 + 1) END END AS effective_date, CASE WHEN o_orderkey % 4 > 0 THEN 'L/' || (o_orderkey % 40) ELSE '' END AS refs FROM orders")
def n11(spark, sf):
    rows = spark.sql(_SAYS.replace("{", "{{").replace("}", "}}") + "{orders}", orders=table(spark, sf, "orders"))
    r = T.answer_reply(F.col("reply"), ("amount_range", "boolean", "list"), "article_ref")
    out = rows.select("question_id", r.alias("r"))
    return out.select("question_id", "r.answer_type", F.col("r.amount.min").alias("min"), F.col("r.amount.max").alias("max"), F.col("r.effective_date").cast("string").alias("effective_date"), F.array_join(F.transform("r.article_refs", lambda x: F.concat(x["document"], F.lit("/"), x["article"])), ",").alias("refs"))


@query("C05", L_ + ", c AS (SELECT doc_id, article, clause, line, level = 'DIEM' AS point, len(string_split(line, ' ')) AS w, row_number() OVER (PARTITION BY doc_id, article, clause ORDER BY pos) AS i FROM n WHERE clause > 0), f AS (SELECT doc_id, article, clause, i, line, CASE WHEN point AND floor(w * 1.5) > 12 THEN 0 ELSE w END AS words, CASE WHEN point AND floor(w * 1.5) > 12 THEN 2 ELSE 0 END AS part, CASE WHEN point AND floor(w * 1.5) > 12 THEN 1 ELSE 0 END AS own FROM c WHERE i = 1 UNION ALL SELECT c.doc_id, c.article, c.clause, c.i, c.line, CASE WHEN c.point AND floor(f.words * 1.5) + floor(c.w * 1.5) > 12 THEN 0 ELSE f.words + c.w END, CASE WHEN c.point AND floor(f.words * 1.5) + floor(c.w * 1.5) > 12 THEN f.part + 2 ELSE f.part END, CASE WHEN c.point AND floor(f.words * 1.5) + floor(c.w * 1.5) > 12 THEN f.part + 1 ELSE f.part END FROM f JOIN c ON c.doc_id = f.doc_id AND c.article = f.article AND c.clause = f.clause AND c.i = f.i + 1), g AS (SELECT doc_id, article, clause, own, string_agg(line, ' ' ORDER BY i) AS text FROM f GROUP BY ALL) SELECT doc_id, article::VARCHAR AS article_no, clause::VARCHAR AS clause_no, row_number() OVER (PARTITION BY doc_id, article, clause ORDER BY own)::INT AS part, text FROM g")
def c05(spark, sf):
    return C.split_long_clauses(C.carry_context(_lines(spark, sf)), 12).drop("seg")


@query("C10", ST_ + ", t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', ': ') ELSE text END AS text FROM statutes), h AS (SELECT doc_id, text, regexp_extract_all(text, 'Điều\\s+[0-9]+[^:：]*[:：]') AS heads, regexp_split_to_array(text, 'Điều\\s+[0-9]+[^:：]*[:：]') AS gaps FROM t), o AS (SELECT doc_id, 'other' AS kind, NULL AS article, trim(gaps[1]) AS text, gaps FROM h WHERE len(heads) > 0 AND length(trim(gaps[1])) > 50), a AS (SELECT doc_id, 'article' AS kind, unnest(heads) AS head, generate_subscripts(heads, 1) AS i, gaps FROM h) SELECT doc_id, kind, article, md5(text) AS h, nullif(trim(regexp_extract(gaps[1], '((?:Chương|CHƯƠNG)\\s+[IVXLCDM]+[^:：]*[:：])', 1)), '') AS chapter FROM (SELECT * FROM o UNION ALL SELECT doc_id, kind, regexp_extract(head, '[0-9]+'), trim(head || gaps[i + 1]), gaps FROM a)")
def c10(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(". "), F.lit(": "))).otherwise(F.col("text"))
    # documents without headings are packed as by C11, which has no twin
    return C.article_chunks(_statutes(spark, sf).withColumn("text", text)).where("kind = 'article' OR text NOT LIKE '%Điều 1.%'").select("doc_id", "kind", "article", F.md5("text").alias("h"), "chapter")


@query("C15", P_ + ", x AS (SELECT doc_id, page, 1 AS sub, node_id, piece FROM page_nodes UNION ALL SELECT doc_id % 50, (doc_id // 50) + 1, 0, 'n' || (doc_id % 5), 'pending ' || doc_id FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, node_id, count(*) AS pieces, arg_min(piece, (page, sub, piece)) AS first, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM x GROUP BY doc_id, node_id")
def c15(spark, sf):
    nodes, d = fixture(spark, sf, "page_nodes"), F.col("doc_id")
    contexts = table(spark, sf, "documents").select((d % 50).alias("doc_id"), (F.floor(d / 50) + 1).alias("page"), F.concat(F.lit("n"), d % 5).alias("pending_node_id"), F.when(d % 4 == 0, F.concat(F.lit("pending "), d)).otherwise(" ").alias("pending_text"))
    rows = C.attach_pending_text(nodes, contexts)
    first = rows.groupBy("doc_id", "node_id").agg(F.count("*").alias("pieces"), F.min_by("piece", F.struct("page", "sub", "piece")).alias("first"))
    return C.merge_pages(rows).join(first, ["doc_id", "node_id"]).select("doc_id", "node_id", "pieces", "first", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("F26", "SELECT p_partkey, '[' || (p_partkey % 9 + 1) || ']' || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_partkey || ')' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' - ' || p_brand END AS entry FROM part")
def f26(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", R.citation_entry((k % 9 + 1).cast("int"), F.when(k % 2 == 0, F.col("p_type")), F.when(k % 3 == 0, k), F.when(k % 5 == 0, " ").otherwise(F.col("p_brand"))).alias("entry"))


_R16Q = "q AS (SELECT DISTINCT query_id, CASE WHEN query_id % 3 = 0 THEN 'Điều ' || (query_id % 40 + 1) || ' quy định gì' ELSE 'Đoạn ' || query_id || ' nội dung ' || (query_id % 11) END AS text, query_id % 3 = 0 AS exact, CASE WHEN query_id % 3 = 0 THEN (query_id % 40 + 1)::VARCHAR END AS article FROM results)"


@query("R16", duck("results") + f", {_R16Q}, s AS (SELECT *, CASE WHEN exact THEN 3 ELSE 5 END AS k, CASE WHEN exact THEN 20 ELSE 30 END AS nv FROM q), c AS (SELECT 'c' || p_partkey AS chunk_id, (p_partkey % 40 + 1)::VARCHAR AS article, 'Đoạn ' || (p_partkey % 97) || ' nội dung ' || (p_partkey % 11) AS text, p_brand AS title FROM part), r AS (SELECT x.query_id, x.chunk_id, source, row_number() OVER (PARTITION BY x.query_id, source ORDER BY score DESC, x.chunk_id) AS rank FROM results x JOIN s USING (query_id) JOIN c USING (chunk_id) WHERE s.article IS NULL OR s.article = c.article), f AS (SELECT query_id, chunk_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM r JOIN s USING (query_id) WHERE rank <= CASE source WHEN 'vector' THEN nv ELSE 20 END GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM f), g AS (SELECT p.*, s.k, c.title, c.article, CASE WHEN exact THEN 0 ELSE round(len(list_intersect(list_distinct(string_split(lower(s.text), ' ')), list_distinct(string_split(lower(c.text), ' '))))::DOUBLE / len(list_distinct(string_split(lower(s.text), ' '))), 6) END AS again FROM p JOIN s USING (query_id) JOIN c USING (chunk_id) WHERE place <= CASE WHEN exact THEN 20 ELSE 10 END), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again DESC, place) AS rank FROM g) SELECT query_id, rank::INT AS rank, chunk_id, score, '[' || rank || '] ' || title || ' - Điều ' || article AS citation FROM z WHERE rank <= k")
def r16(spark, sf):
    results, q = _results(spark, sf), F.col("query_id")
    none = F.lit(None).cast("string")
    asked = results.select("query_id").distinct()
    exact, article = q % 3 == 0, (q % 40 + 1).cast("string")
    refs = F.struct(none.alias("law"), F.when(exact, article).alias("article"), none.alias("clause"), none.alias("point"))
    asked = R.with_settings(asked.select("query_id", F.when(exact, F.concat(F.lit("Điều "), article, F.lit(" quy định gì"))).otherwise(F.concat(F.lit("Đoạn "), q, F.lit(" nội dung "), q % 11)).alias("text"), refs.alias("refs")), exact)
    p = F.col("p_partkey")
    chunks = table(spark, sf, "part").select(F.concat(F.lit("c"), p).alias("chunk_id"), F.concat(F.lit("Đoạn "), p % 97, F.lit(" nội dung "), p % 11).alias("text"), none.alias("law"), (p % 40 + 1).cast("string").alias("article"), none.alias("clause"), none.alias("point"), F.col("p_brand").alias("title"))
    return R.legal_retrieve(asked, results.select("query_id", "chunk_id", "source", F.col("score").cast("double").alias("score")), chunks).drop("text")
