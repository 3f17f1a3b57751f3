"""F, C: statute text, its structure and its chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import legal as L
from quoin.functions import vocabulary as V
from quoin.operators import structure as C
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.questions import any_match, first, lit
from quoin.plans.registry import query

ST_ = duck("numbered_lines") + ", statutes AS (SELECT doc_id, 'so_' || doc_id || '.txt' AS file_name, string_agg(line, chr(10) ORDER BY pos) AS text FROM numbered_lines GROUP BY doc_id) "


def _statutes(spark, sf):
    lines = F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line")
    return fixture(spark, sf, "numbered_lines").groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text")).withColumn("file_name", F.concat(F.lit("so_"), "doc_id", F.lit(".txt")))


_F01 = "nfc_normalize(text)"
for _p in V.BOILERPLATE:
    _F01 = f"regexp_replace({_F01}, {lit('(?im)' + _p)}, '', 'g')"
_F01 = rf"regexp_replace(regexp_replace(regexp_replace({_F01}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("F01", ST_ + f"SELECT doc_id, md5({_F01}) AS h FROM statutes")
def f01(spark, sf):
    return _statutes(spark, sf).select("doc_id", F.md5(L.normalize_text(F.col("text"))).alias("h"))


_HEAD = "array_to_string(string_split(text, chr(10))[1:30], chr(10))"


@query("F02", ST_ + f"SELECT doc_id, coalesce(nullif(concat_ws('/', {', '.join(first(_HEAD, '(?i)' + V.LAW_ID, g) for g in (1, 2, 3))}), ''), 'UNKNOWN') AS law_id FROM statutes")
def f02(spark, sf):
    return _statutes(spark, sf).select("doc_id", L.law_id(F.col("file_name"), F.col("text")).alias("law_id"))


@query("F03", ST_ + "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10))[1:50], lambda x: CASE WHEN regexp_matches(lower(x), '^\\s*luật\\s+(.+)$') THEN 'Luật ' || trim(regexp_extract(x, '(?i)^\\s*luật\\s+(.+)$', 1)) END), lambda x: x IS NOT NULL)[1], 'Unknown Document') AS law_name FROM statutes")
def f03(spark, sf):
    return _statutes(spark, sf).select("doc_id", L.law_name(F.col("text")).alias("law_name"))


_KIND = "CASE WHEN contains(upper(law), 'QH') THEN 'LAW' WHEN regexp_matches(upper(law), 'NĐ-CP|ND-CP') THEN 'DECREE' WHEN contains(upper(law), 'TT-') THEN 'CIRCULAR' " + " ".join(f"WHEN regexp_matches(lower(substr(text, 1, 2000)), {lit(p)}) THEN {lit(k)}" for k, p in V.DOC_KINDS) + " ELSE 'LAW' END"


@query("F04", duck("legal_queries") + f", l AS (SELECT query_id, text, CASE query_id % 4 WHEN 0 THEN '1/2020/QH14' WHEN 1 THEN '2/2020/NĐ-CP' WHEN 2 THEN '3/2020/TT-BTC' ELSE 'x' END AS law FROM legal_queries) SELECT query_id, {_KIND} AS kind FROM l")
def f04(spark, sf):
    law = F.element_at(F.array(*map(F.lit, ("1/2020/QH14", "2/2020/NĐ-CP", "3/2020/TT-BTC", "x"))), (F.col("query_id") % 4 + 1).cast("int"))
    return fixture(spark, sf, "legal_queries").select("query_id", L.doc_kind(law, F.col("text")).alias("kind"))


_TOK = r"floor(len(list_filter(string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) * {f} / 10)::INT"


@query("F05", "SELECT doc_id, " + _TOK.format(t="text", f=15) + " AS tokens, " + _TOK.format(t="text", f=13) + " AS budget FROM documents")
def f05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.count_tokens(F.col("text")).alias("tokens"), L.count_tokens(F.col("text"), 13).alias("budget"))


_LEVELS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, 'L' || l_orderkey AS law, CASE WHEN l_partkey % 2 = 0 THEN 'I' END AS chapter_id, CAST(NULL AS VARCHAR) AS section_id, '' || l_partkey AS article_no, CASE WHEN l_partkey % 3 = 0 THEN '' || l_linenumber END AS clause_no, CASE WHEN l_partkey % 6 = 0 THEN 'a' END AS point_no FROM lineitem"
_PATH = "concat_ws('{s}', {first}, 'CHUONG=' || chapter_id, 'MUC=' || section_id, 'DIEU=' || article_no, 'KHOAN=' || clause_no, 'DIEM=' || point_no)"


def _levels(spark, sf):
    t = table(spark, sf, "lineitem")
    p = F.col("l_partkey")
    return t.select("l_orderkey", "l_linenumber", p, F.concat(F.lit("L"), "l_orderkey").alias("law"), F.when(p % 2 == 0, "I").alias("chapter_id"), F.lit(None).cast("string").alias("section_id"), p.cast("string").alias("article_no"), F.when(p % 3 == 0, F.col("l_linenumber").cast("string")).alias("clause_no"), F.when(p % 6 == 0, "a").alias("point_no"))


@query("F06", f"SELECT l_orderkey, l_linenumber, {_PATH.format(s=' | ', first="'DOC=' || law, 'TYPE=LAW'")} AS prefix FROM ({_LEVELS})")
def f06(spark, sf):
    return _levels(spark, sf).select("l_orderkey", "l_linenumber", L.embedding_prefix(F.col("law"), F.lit("LAW")).alias("prefix"))


@query("F07", f"SELECT l_orderkey, l_linenumber, p || ':' || substr(md5(p || ':' || l_linenumber), 1, 8) AS chunk_id FROM (SELECT *, {_PATH.format(s=':', first="'LAW=' || law")} AS p FROM ({_LEVELS}))")
def f07(spark, sf):
    return _levels(spark, sf).select("l_orderkey", "l_linenumber", L.chunk_id(F.col("law"), F.col("l_linenumber")).alias("chunk_id"))


@query("F08", "SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') || '_' || substr(md5(url), 1, 8) AS id FROM pages")
def f08(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.document_id(F.col("url")).alias("id"))


_FROM, _TO = "".join(x for _, x in V.FOLDED), "".join(a * len(x) for a, x in V.FOLDED)
_FOLD = "translate(lower({t}), " + f"'{_FROM}', '{_TO}')"
_STOP = "[" + ", ".join(_FOLD.format(t=lit(w)) for w in V.ANALYZER_STOP) + "]"
ANALYZED = f"list_filter(regexp_extract_all({_FOLD.format(t='text')}, '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))"


@query("F09", duck("legal_queries") + f"SELECT query_id, array_to_string({ANALYZED}, ' ') AS tokens FROM legal_queries")
def f09(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", F.array_join(L.vi_analyze(F.col("text")), " ").alias("tokens"))


@query("F10", duck("legal_queries") + f"SELECT query_id, {_FOLD.format(t='text')} AS keyword FROM legal_queries")
def f10(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", L.fold(F.col("text")).alias("keyword"))


@query("F11", "WITH s AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)), o AS (SELECT *, coalesce(sum(length(s) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM s) SELECT doc_id, start, (start + length(s))::INT AS \"end\", trim(s) AS text FROM o WHERE length(trim(s)) > 10")
def f11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(L.char_spans(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query("F13", f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[{V.VIETNAMESE}]') THEN 'vi' ELSE 'en' END AS lang FROM documents")
def f13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.detect_language(F.col("text")).alias("lang"))


@query("F14", "WITH r AS (SELECT c_custkey, c_custkey % 99 + 1 AS n, repeat('C', 0) || CASE (c_custkey % 99 + 1) // 10 WHEN 1 THEN 'X' WHEN 2 THEN 'XX' WHEN 3 THEN 'XXX' WHEN 4 THEN 'XL' WHEN 5 THEN 'L' WHEN 6 THEN 'LX' WHEN 7 THEN 'LXX' WHEN 8 THEN 'LXXX' WHEN 9 THEN 'XC' ELSE '' END || CASE (c_custkey % 99 + 1) % 10 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' ELSE '' END AS roman FROM customer) SELECT c_custkey, roman, n::INT AS value FROM r")
def f14(spark, sf):
    n = (F.col("c_custkey") % 99 + 1).cast("int")
    digit = lambda names, d: F.element_at(F.array(*map(F.lit, names)), d + 1)
    roman = F.concat(digit(("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), F.floor(n / 10).cast("int")), digit(("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), n % 10))
    return table(spark, sf, "customer").select("c_custkey", roman.alias("roman")).withColumn("value", L.roman_to_int(F.col("roman")))


@query("F15", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'dieu_' || p_partkey WHEN 1 THEN 'chuong_' || (p_partkey % 4 + 1) ELSE 'khoan_' || p_size || '_dieu_' || p_partkey END AS node FROM part")
def f15(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" DIEU_"), k, F.lit("_x"))).when(k % 3 == 1, F.concat(F.lit("CHUONG_"), F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV"))), (k % 4 + 1).cast("int")), F.lit("_to_chuc"))).otherwise(F.concat(F.lit("khoan_"), "p_size", F.lit("_dieu_"), k, F.lit("_y_z")))
    return table(spark, sf, "part").select("p_partkey", L.normalize_node_id(raw).alias("node"))


@query("F16", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN o_custkey ELSE o_orderkey END || '/QĐ-ĐHCNTT' AS signature FROM orders")
def f16(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    year = F.year("o_orderdate")  # numbers that are none of a decision
    spelt = [F.concat(F.lit("Quyết định số "), k, F.lit(" năm "), year), F.concat(k, F.lit("/QĐ-ĐHCNTT về việc "), c), F.concat(F.lit("Ban hành kèm "), k, F.lit("/qd-dhcntt ngày "), year), F.concat(F.lit("QUYẾT ĐỊNH "), k), F.concat(F.lit("Theo QĐ-"), k, F.lit(" và năm "), year), F.concat(F.lit("Thông báo "), year)]
    title = F.element_at(F.array(*spelt), (k % 6 + 1).cast("int"))
    files = F.when(k % 2 == 0, F.concat(c, F.lit("_QD_DHCNTT.docx"))).otherwise(F.concat(c, F.lit("-qd-dhcntt.pdf")))
    return table(spark, sf, "orders").select("o_orderkey", L.document_signature(title, files).alias("signature"))


@query("F17", duck("legal_queries") + f"SELECT query_id, regexp_matches(lower(text || ' ' || CASE WHEN query_id % 5 = 0 THEN 'Sửa đổi Điều 2' ELSE '' END), '{V.AMENDING}') AS amends FROM legal_queries")
def f17(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", L.is_amendment(F.col("text"), F.when(F.col("query_id") % 5 == 0, "Sửa đổi Điều 2")).alias("amends"))


@query("F18", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, {lit(p)}) THEN {lit(p)}" for p in V.TRUNCATED) + " END AS pattern FROM (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' theo quy định' WHEN 1 THEN ', ' WHEN 2 THEN ' và' WHEN 3 THEN '...' ELSE '.' END AS t FROM documents)")
def f18(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (" theo quy định", ", ", " và", "...", ".", "."))), (F.col("doc_id") % 6 + 1).cast("int"))
    t = F.concat("text", tail)
    return table(spark, sf, "documents").select("doc_id", L.truncation_pattern(t).alias("pattern"))


@query("F20", duck("entities") + r"SELECT entity_id, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[.,;:!?]+|[.,;:!?]+$', '', 'g')) AS normalized FROM entities")
def f20(spark, sf):
    return fixture(spark, sf, "entities").select("entity_id", L.normalize_entity(F.col("text")).alias("normalized"))


@query("F21", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'HOC_KY_' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_partkey AS id FROM part")
def f21(spark, sf):
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*map(F.lit, (*V.ID_PREFIXES, "HOC_KY_"))), (k % 6 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k)
    name = F.when(k % 6 == 5, name).when(k % 4 == 0, F.concat(F.lit("("), name, F.lit(")_"))).when(k % 4 == 1, F.concat(F.lit("__"), name)).otherwise(name)
    return table(spark, sf, "part").select("p_partkey", L.clean_entity_id(F.concat(prefix, name)).alias("id"))


@query("F24", "SELECT doc_id, greatest(1, floor(length(text) / 3000))::INT AS pages FROM documents")
def f24(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.estimate_pages(F.col("text")).alias("pages"))


@query("F25", f"SELECT l_orderkey, l_linenumber, concat_ws(' ', 'Điểm ' || point_no, 'Khoản ' || clause_no, 'Điều ' || article_no, 'Luật ' || law) AS citation FROM ({_LEVELS})")
def f25(spark, sf):
    c = F.col
    return _levels(spark, sf).select("l_orderkey", "l_linenumber", L.citation_short(c("point_no"), c("clause_no"), c("article_no"), c("law"), F.lit("-")).alias("citation"))


@query("F27", "SELECT doc_id, CASE WHEN p <> '' THEN '[Parent]' || chr(10) || p || chr(10) || chr(10) ELSE '' END || t || CASE WHEN n IS NOT NULL THEN chr(10) || chr(10) || '[Next]' || chr(10) || n ELSE '' END AS block FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS p, text AS t, CASE WHEN doc_id % 3 = 0 THEN lang END AS n FROM documents)")
def f27(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", L.context_block(F.when(d % 2 == 0, F.col("source")).otherwise(""), F.lit(None).cast("string"), F.col("text"), F.when(d % 3 == 0, F.col("lang"))).alias("block"))


# The fixture knows its own structure, so the oracles of C read it from there.
def _lines(spark, sf):
    return C.classify_lines(C.split_lines(_statutes(spark, sf)))


L_ = duck("statute_lines") + ", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, article, clause, sub) - 1 AS pos, CASE WHEN chapter = 0 THEN 'TEXT' WHEN article = 0 THEN 'CHUONG' WHEN clause = 0 THEN 'DIEU' WHEN sub = 0 THEN CASE WHEN clause < 100 THEN 'KHOAN' ELSE 'TEXT' END WHEN sub < 3 THEN 'DIEM' ELSE 'TEXT' END AS level FROM statute_lines) "


@query("C01", L_ + "SELECT doc_id, pos::INT AS pos, level, CASE level WHEN 'CHUONG' THEN split_part(split_part(line, ' ', 2), '.', 1) WHEN 'DIEU' THEN split_part(split_part(line, ' ', 2), '.', 1) WHEN 'KHOAN' THEN split_part(line, '.', 1) WHEN 'DIEM' THEN substr(line, 1, 1) END AS ident FROM n")
def c01(spark, sf):
    return _lines(spark, sf).select("doc_id", "pos", "level", "ident")


@query("C02", L_ + "SELECT doc_id, pos::INT AS pos, CASE chapter WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' ELSE 'V' END AS chapter_id, CASE WHEN article > 0 THEN article::VARCHAR END AS article_no, CASE WHEN clause > 0 THEN clause::VARCHAR END AS clause_no FROM n WHERE chapter > 0")
def c02(spark, sf):
    return C.carry_context(_lines(spark, sf)).select("doc_id", "pos", "chapter_id", "article_no", "clause_no")


@query("C03", L_ + "SELECT doc_id, article::VARCHAR AS article_no, md5(string_agg(line, ' ' ORDER BY pos)) AS h FROM n WHERE article > 0 GROUP BY doc_id, article")
def c03(spark, sf):
    return C.article_segments(C.carry_context(_lines(spark, sf))).select("doc_id", "article_no", F.md5("text").alias("h"))


@query("C04", L_ + ", t AS (SELECT *, sum(len(string_split(line, ' '))) OVER (PARTITION BY doc_id, article) AS total FROM n WHERE article > 0) SELECT doc_id, article::VARCHAR AS article_no, CASE WHEN floor(total * 1.5) > 60 THEN clause::VARCHAR END AS clause_key, md5(string_agg(line, ' ' ORDER BY pos)) AS h FROM t GROUP BY ALL")
def c04(spark, sf):
    return C.budget_chunks(C.carry_context(_lines(spark, sf)), 60).select("doc_id", "article_no", "clause_key", F.md5("text").alias("h"))


@query("C06", L_ + "SELECT doc_id, article::VARCHAR AS article_no, contains(line, 'Giải thích') OR coalesce(max(contains(line, 'Giải thích')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 0 FOLLOWING AND 4 FOLLOWING), false) AS is_definition FROM n QUALIFY level = 'DIEU'")
def c06(spark, sf):
    return C.definition_flag(_lines(spark, sf)).select("doc_id", F.col("ident").alias("article_no"), "is_definition")


@query("C08", L_ + ", h AS (SELECT doc_id, pos, level, CASE level WHEN 'CHUONG' THEN NULL WHEN 'DIEU' THEN max(CASE WHEN level = 'CHUONG' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) WHEN 'KHOAN' THEN max(CASE WHEN level = 'DIEU' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) ELSE max(CASE WHEN level = 'KHOAN' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) END AS parent FROM n WHERE level <> 'TEXT') SELECT doc_id, pos::INT AS pos, coalesce(parent, -1)::INT AS parent, coalesce(lag(pos) OVER w, -1)::INT AS prev, coalesce(lead(pos) OVER w, -1)::INT AS next FROM h WINDOW w AS (PARTITION BY doc_id, parent ORDER BY pos)")
def c08(spark, sf):
    return C.legal_tree(_lines(spark, sf)).select("doc_id", "pos", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("parent", "prev", "next")])


@query("W05", duck("clauses") + "SELECT doc_id, article, clause, coalesce(lag(clause) OVER w, -1)::BIGINT AS prev, coalesce(lead(clause) OVER w, -1)::BIGINT AS next FROM clauses WINDOW w AS (PARTITION BY doc_id, article ORDER BY clause)")
def w05(spark, sf):
    rows = fixture(spark, sf, "clauses").select("doc_id", "article", "clause")
    return C.sibling_links(rows, "doc_id", "article", order="clause").select("doc_id", F.col("article").cast("long").alias("article"), F.col("clause").cast("long").alias("clause"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("prev", "next")])


@query("C09", L_ + "SELECT doc_id, count(*) FILTER (level = 'CHUONG') AS chapters, 0::BIGINT AS sections, count(*) FILTER (level = 'DIEU') AS articles, count(*) FILTER (level = 'KHOAN') AS clauses, count(*) FILTER (level = 'DIEM') AS points, sum(" + _TOK.format(t="line", f=15) + ")::BIGINT AS tokens FROM n GROUP BY doc_id")
def c09(spark, sf):
    return C.structure_stats(_lines(spark, sf))


P_ = duck("page_nodes")


@query("C14", P_ + "SELECT doc_id, node_id, arg_max(title, (length(title), title)) AS title, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, count(*) AS n, md5(list_reduce(list(piece ORDER BY page, piece), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || ' ' || b END)) AS h FROM page_nodes GROUP BY doc_id, node_id")
def c14(spark, sf):
    nodes = fixture(spark, sf, "page_nodes")
    n = nodes.groupBy("doc_id", "node_id").count().withColumnRenamed("count", "n")
    return C.merge_pages(nodes).join(n, ["doc_id", "node_id"]).select("doc_id", "node_id", "title", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "n", F.md5("text").alias("h"))


@query("C16", P_ + "SELECT doc_id, count(*) AS nodes, count(*) FILTER (p > 1) AS multi_page FROM (SELECT doc_id, node_id, count(DISTINCT page) AS p FROM page_nodes GROUP BY ALL) GROUP BY doc_id")
def c16(spark, sf):
    return C.merge_summary(C.merge_pages(fixture(spark, sf, "page_nodes")))
