"""P, J, R, A, K, S, G, C, F: retrieval, lookups and the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import legal as L
from quoin.functions import questions as Q
from quoin.operators import extraction as X
from quoin.operators import graph as G
from quoin.operators import ranking as K
from quoin.operators import retrieval as R
from quoin.operators import search as S
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.graph import _asked, _docs, _edges, _nodes
from quoin.plans.questions import R_ as REFS
from quoin.plans.ranking import BEST, _results
from quoin.plans.registry import query

RES = duck("results")
B_ = duck("nodes", "edges")


@query("P01", REFS.rstrip() + ", c AS (SELECT doc_id || ':' || article AS chunk_id, 'x' AS law, article::VARCHAR AS article FROM (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS article FROM orders)) SELECT query_id, chunk_id FROM r JOIN c ON c.article = r.article WHERE r.law IS NULL AND r.clause IS NULL AND r.point IS NULL")
def p01(spark, sf):
    a = fixture(spark, sf, "articles")
    chunks = a.select(F.concat_ws(":", "doc_id", "article").alias("chunk_id"), F.lit("x").alias("law"), F.concat(F.lit("Điều "), "article").alias("article"), F.lit(None).cast("string").alias("clause"), F.lit(None).cast("string").alias("point"))
    refs = fixture(spark, sf, "legal_queries").select("query_id", Q.legal_reference(F.col("text")).alias("r")).select("query_id", "r.*")
    return R.legal_filter(chunks, refs)


_TOK = r"floor(len(list_filter(string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) * 13 / 10)::INT"
_CH = "SELECT doc_id AS chunk_id, text, CASE WHEN doc_id % 10 <> 0 THEN doc_id - doc_id % 10 END AS parent_id, CASE WHEN doc_id > 0 THEN doc_id - 1 END AS prev_id, doc_id + 1 AS next_id FROM documents"


def _neighbours(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    chunks = docs.select(d.alias("chunk_id"), "text", F.when(d % 10 != 0, d - d % 10).alias("parent_id"), F.when(d > 0, d - 1).alias("prev_id"), (d + 1).alias("next_id"))
    return docs.where("doc_id % 3 = 0").select((d % 7).alias("query_id"), d.alias("chunk_id")), chunks


@query("J02", f"WITH c AS ({_CH}), r AS (SELECT doc_id % 7 AS query_id, doc_id AS chunk_id FROM documents WHERE doc_id % 3 = 0), l AS (SELECT query_id, chunk_id, 0 AS o, 'parent' AS kind, parent_id AS neighbour FROM r JOIN c USING (chunk_id) UNION ALL SELECT query_id, chunk_id, 1, 'prev', prev_id FROM r JOIN c USING (chunk_id) UNION ALL SELECT query_id, chunk_id, 2, 'next', next_id FROM r JOIN c USING (chunk_id)), k AS (SELECT l.*, {_TOK.format(t='c.text')} AS n FROM l JOIN c ON c.chunk_id = l.neighbour WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = l.query_id AND r.chunk_id = l.neighbour)), u AS (SELECT *, least(n, 300) AS tokens, sum(least(n, 300)) OVER (PARTITION BY query_id, chunk_id ORDER BY o) AS used FROM k WHERE kind <> 'parent' OR n <= 300) SELECT query_id, chunk_id, kind, neighbour, tokens FROM u WHERE used <= 800")
def j02(spark, sf):
    return R.expand_neighbors(*_neighbours(spark, sf))


@query("R13", RES + ", q AS (SELECT DISTINCT query_id, 'Đoạn ' || query_id || ' nội dung ' || (query_id % 11) AS qt FROM results), s AS (SELECT r.*, round(len(list_distinct(list_intersect(string_split(lower(qt), ' '), string_split(lower(r.text), ' '))))::DOUBLE / len(list_distinct(string_split(lower(qt), ' '))), 6) AS rerank_score FROM results r JOIN q USING (query_id) WHERE source = 'vector') SELECT query_id, chunk_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5")
def r13(spark, sf):
    rows = _results(spark, sf).where("source = 'vector'")
    q = rows.select("query_id").distinct().select("query_id", F.concat(F.lit("Đoạn "), "query_id", F.lit(" nội dung "), F.col("query_id") % 11).alias("text"))
    return R.rerank(rows, q, 5).select("query_id", "chunk_id", "rerank_score", "rank")


@query("X02", RES + f""", c AS ({_CH}), q AS (SELECT DISTINCT query_id, 'Đoạn ' || query_id AS qt FROM results),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, score DESC, chunk_id) AS rank FROM (SELECT r.*, -abs(length(qt) - length(r.text))::DOUBLE AS v FROM results r JOIN q USING (query_id) WHERE source = 'vector')),
    l AS (SELECT c.chunk_id, k.kind, n.chunk_id AS neighbour, length(n.text) % 50 AS t, k.o FROM c, (VALUES (0, 'parent'), (1, 'prev'), (2, 'next')) AS k(o, kind) JOIN c n ON n.chunk_id = CASE k.kind WHEN 'parent' THEN c.parent_id WHEN 'prev' THEN c.prev_id ELSE c.next_id END WHERE c.chunk_id % 3 = 0 AND NOT (n.chunk_id % 3 = 0 AND n.chunk_id % 7 = c.chunk_id % 7)),
    u AS (SELECT *, sum(least(t, 40)) OVER (PARTITION BY chunk_id ORDER BY o) AS used FROM l WHERE kind <> 'parent' OR t <= 40)
    SELECT 'encoder' AS hook, doc_id::VARCHAR AS id, length(concat_ws(' ', source, text))::DOUBLE AS value FROM documents
    UNION ALL SELECT 'scorer', query_id || '/' || chunk_id, v FROM s WHERE rank <= 3
    UNION ALL SELECT 'tokens', chunk_id || '/' || kind, least(t, 40)::DOUBLE FROM u WHERE used <= 70""")
def x02(spark, sf):
    """An encoder, a scorer and an estimator of tokens of the caller's own."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("prefix"), "text")
    encoded = R.embed(docs, lambda text: text.map(lambda t: [float(len(t))]))
    rows = _results(spark, sf).where("source = 'vector'")
    asked = rows.select("query_id").distinct().select("query_id", F.concat(F.lit("Đoạn "), "query_id").alias("text"))
    near = R.rerank(rows, asked, 3, lambda q, t: -(q.str.len() - t.str.len()).abs().astype("float64"))
    around = R.expand_neighbors(*_neighbours(spark, sf), each=40, total=70, tokens=lambda text: F.length(text) % 50)
    out = encoded.select(F.lit("encoder").alias("hook"), F.col("doc_id").cast("string").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("value"))
    out = out.union(near.select(F.lit("scorer"), F.concat_ws("/", F.col("query_id").cast("string"), "chunk_id"), "rerank_score"))
    return out.union(around.select(F.lit("tokens"), F.concat_ws("/", F.col("chunk_id").cast("string"), "kind"), F.col("tokens").cast("double")))


@query("R14", RES + f", k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY {BEST}) AS r FROM results), f AS (SELECT query_id, chunk_id, round(sum(CASE source WHEN 'vector' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + r)), 9) AS score FROM k GROUP BY ALL) SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10")
def r14(spark, sf):
    rows = _results(spark, sf)
    return R.hybrid_search({s: rows.where(F.col("source") == s) for s in ("vector", "bm25")}, {"vector": 0.7, "bm25": 0.3}, 10).select("query_id", "chunk_id", "score", "rank")


@query("R15", RES + f", d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, trim(text) ORDER BY {BEST}) AS n FROM results WHERE source = 'vector') WHERE n = 1 AND doc_id IN (1, 2, 3, 5, 8, 13, 21) AND score >= 20) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank FROM d) WHERE rank <= 5")
def r15(spark, sf):
    return R.postprocess(_results(spark, sf).where("source = 'vector'"), 5, 20, doc_id=[1, 2, 3, 5, 8, 13, 21]).select("query_id", "chunk_id", "rank")


@query("R20", RES + f"SELECT query_id, chunk_id, '[' || rank || '] ' || chunk_id AS citation, score, CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id WHEN doc_id % 3 = 1 THEN 's' || doc_id ELSE substr(text, 1, 100) END AS piece FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank FROM results WHERE source = 'vector') WHERE rank <= 5")
def r20(spark, sf):
    rows, d = K.top_k(_results(spark, sf).where("source = 'vector'"), 5), F.col("doc_id")
    none = F.array().cast("array<string>")
    return R.source_list(rows, F.when(d % 3 == 0, F.array(F.concat(F.lit("m"), d))).otherwise(none), F.when(d % 3 == 1, F.array(F.concat(F.lit("s"), d))).otherwise(none))


@query("P08", "SELECT 'O' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN concat_ws(',', CASE WHEN o_custkey % 3 = 0 THEN 'number' END, CASE WHEN o_orderkey % 2 = 0 THEN 'title' END) WHEN 'O' THEN CASE WHEN o_custkey % 5 > 0 THEN 'id' ELSE '' END ELSE '' END AS missing FROM orders")
def p08(spark, sf):
    k, c, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    has = lambda name, when, value: F.when(when, F.create_map(F.lit(name), value.cast("string"))).otherwise(F.create_map())
    props = F.map_concat(has("title", k % 2 > 0, F.col("o_orderpriority")), has("number", c % 3 > 0, k), has("id", c % 5 == 0, c), has("y", k % 7 == 0, c))
    label = F.when(status == "F", "DIEU").when(status == "O", "LUAT").otherwise("OTHER")
    nodes = table(spark, sf, "orders").select(F.concat(F.lit("O"), k).alias("id"), label.alias("label"), props.alias("props"))
    return R.missing_properties(nodes, {"DIEU": ["title", "number"], "LUAT": ["id"]}).select("id", F.array_join("missing", ",").alias("missing"))


@query("A04", "SELECT doc_id % 37 AS key, arg_max(doc_id, (length(text), doc_id)) AS id, max(length(text)) AS length FROM documents GROUP BY 1")
def a04(spark, sf):
    nodes = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return R.deduplicate_nodes(nodes, F.col("id") % 37)[0].select("key", "id", F.length("text").alias("length"))


@query("A15", "SELECT event_type AS kind, count(*) FILTER (event_id % 4 IN (0, 1)) AS made, count(*) FILTER (event_id % 4 = 2) AS failed, count(*) FILTER (event_id % 4 = 3) AS merged, round(1 - count(*) FILTER (event_id % 4 = 2) / count(*), 6) AS success_rate FROM events GROUP BY event_type")
def a15(spark, sf):
    k = F.col("event_id") % 4
    return R.build_result(table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(k < 2, "made").when(k == 2, "failed").otherwise("merged").alias("outcome")))


@query("A09", B_ + "SELECT c.dst AS doc, count(DISTINCT c.src) AS n_chapters, count(d.src) AS n_articles FROM edges c LEFT JOIN edges d ON d.dst = c.src AND d.type = 'THUOC_VE' WHERE c.type = 'THUOC_VE' AND c.src LIKE 'C%' GROUP BY c.dst")
def a09(spark, sf):
    tree = R.document_tree(_nodes(spark, sf), _edges(spark, sf))
    n = F.aggregate("chapters", F.lit(0), lambda a, c: a + F.coalesce(F.nullif(F.size(c["articles"]), F.lit(-1)), F.lit(0)))
    return tree.select("doc", F.size("chapters").alias("n_chapters"), n.alias("n_articles"))


@query("K03", B_ + "SELECT dst AS id, count(*) AS n, array_to_string((list(name ORDER BY num))[1:5], '|') AS first FROM edges JOIN nodes n ON n.id = src WHERE type = 'THUOC_VE' AND label = 'CHUONG' GROUP BY dst")
def k03(spark, sf):
    return R.documents_overview(_nodes(spark, sf), _edges(spark, sf)).select("id", "n", F.array_join("first", "|").alias("first"))


@query("S12", B_ + "SELECT e.src, e.dst, e.type, a.label AS src_label, b.label AS dst_label, b.name AS dst_name FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst")
def s12(spark, sf):
    return R.export_graph(_nodes(spark, sf), _edges(spark, sf)).select("src", "dst", "type", "src_label", "dst_label", "dst_name")


@query("S04", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'vi') AS language, source AS chapter, source AS section FROM documents")
def s04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("vi")).alias("language"), F.col("source").alias("chapter"), F.col("source").alias("section"))


@query("U03", "SELECT DISTINCT l_suppkey AS src, l_partkey % 50 AS dst, l_returnflag AS type FROM lineitem WHERE l_suppkey <> l_partkey % 50")
def u03(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_returnflag").alias("type")).where("src != dst").dropDuplicates(["src", "dst", "type"])


@query("C13", "SELECT o_orderkey AS id, 'A' || o_orderkey || coalesce(string_agg(chr(10) || chr(10) || '--- K' || l_linenumber || ' ---' || chr(10) || p || chr(10), '' ORDER BY l_linenumber), '') AS text FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def c13(spark, sf):
    articles = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("A"), "o_orderkey").alias("text"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    child = F.concat_ws("_", "l_orderkey", "l_linenumber")
    children = lines.select(child.alias("id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("K"), "l_linenumber").alias("title"), F.col("p").cast("string").alias("text"))
    rel = lines.select(F.col("l_orderkey").cast("string").alias("src"), child.alias("dst"), F.lit("CONTAINS").alias("type"))
    return X.merge_children(articles, children, rel).select(F.col("id").cast("long").alias("id"), "text")


@query("C17")
def c17(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("prefix"), "text")
    return R.embed(docs, R.feature_vector()).select("doc_id", "embedding")


@query("F19", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN text WHEN length(intro) < 50 THEN 'Chương ' || source WHEN length(intro) > 500 THEN substr(intro, 1, 500) || '...' ELSE intro END AS intro FROM (SELECT *, trim(CASE doc_id % 3 WHEN 0 THEN text ELSE substr(text, 1, doc_id % 120) END) AS intro FROM documents)")
def f19(spark, sf):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat("text", F.lit(" Điều "), F.col("doc_id"), F.lit(". Phạm vi. Điều 2."))).when(k == 1, F.concat(F.substr("text", F.lit(1), F.col("doc_id") % 120), F.lit("Điều  12 x"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", L.chapter_intro(text, F.concat(F.lit("Chương "), "source")).alias("intro"))


# Lookups: concepts and their articles, documents and amendments.
@query("G18", B_ + "SELECT n.id, count(DISTINCT m.dst) AS concepts, count(DISTINCT a.src) AS changes FROM nodes n LEFT JOIN edges m ON m.src = n.id AND m.type = 'MENTIONS' LEFT JOIN edges a ON a.dst = n.id AND a.type NOT IN ('MENTIONS', 'THUOC_VE') WHERE n.label = 'DIEU' GROUP BY n.id")
def g18(spark, sf):
    e = _edges(spark, sf)
    concepts = e.where("type = 'MENTIONS'").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("concepts"))
    changes = e.where("type NOT IN ('MENTIONS', 'THUOC_VE')").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("changes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _nodes(spark, sf).where("label = 'DIEU'").select("id").join(concepts, "id", "left").join(changes, "id", "left").select("id", zero("concepts"), zero("changes"))


@query("G24", B_ + "SELECT k.id AS concept, m.src AS article, c.dst AS chapter, d.dst AS document FROM nodes k JOIN edges m ON m.dst = k.id AND m.type = 'MENTIONS' JOIN edges c ON c.src = m.src AND c.type = 'THUOC_VE' JOIN edges d ON d.src = c.dst AND d.type = 'THUOC_VE' WHERE k.label = 'KHAI_NIEM' AND contains(lower(k.name), 'steel')")
def g24(spark, sf):
    e = _edges(spark, sf)
    concepts = G.keyword_search_nodes(_nodes(spark, sf), "steel", {"KHAI_NIEM": ["name"]}).select(F.col("id").alias("concept"))
    return concepts.join(R.hop(e, "MENTIONS", "article", "concept"), "concept").join(R.hop(e, "THUOC_VE", "article", "chapter"), "article").join(R.hop(e, "THUOC_VE", "chapter", "document"), "chapter").select("concept", "article", "chapter", "document")


@query("G26", B_ + "SELECT d.dst AS document, a.num, count(*) AS articles, min(a.id) AS first FROM nodes a JOIN edges c ON c.src = a.id AND c.type = 'THUOC_VE' JOIN edges d ON d.src = c.dst AND d.type = 'THUOC_VE' WHERE a.label = 'DIEU' GROUP BY ALL")
def g26(spark, sf):
    e = _edges(spark, sf)
    articles = _nodes(spark, sf).where("label = 'DIEU'").select(F.col("id").alias("article"), "num")
    at = articles.join(R.hop(e, "THUOC_VE", "article", "chapter"), "article").join(R.hop(e, "THUOC_VE", "chapter", "document"), "chapter")
    return at.groupBy("document", "num").agg(F.count("*").alias("articles"), F.min("article").alias("first"))


@query("G22", B_ + ", inside AS (SELECT DISTINCT src FROM edges WHERE dst = 'N3' AND type = 'THUOC_VE') SELECT e.src, e.dst, e.type FROM edges e JOIN inside i ON i.src = e.src UNION ALL SELECT e.src, e.dst, e.type FROM edges e ANTI JOIN inside i ON i.src = e.src WHERE e.dst = 'N3'")
def g22(spark, sf):
    e = _edges(spark, sf)
    inside = e.where("dst = 'N3' AND type = 'THUOC_VE'").select("src").distinct()
    return e.join(inside, "src", "left_semi").unionByName(e.where("dst = 'N3'").join(inside.withColumnRenamed("src", "s"), F.col("src") == F.col("s"), "left_anti")).select("src", "dst", "type")


@query("G20", B_ + "SELECT e.src, e.dst, n.name, n.num FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type IN ('SUA_DOI', 'BO_SUNG')")
def g20(spark, sf):
    e = _edges(spark, sf).where("type IN ('SUA_DOI', 'BO_SUNG')")
    return e.join(_nodes(spark, sf).select(F.col("id").alias("dst"), "name", "num"), "dst").select("src", "dst", "name", "num")


@query("J09", "SELECT DISTINCT e.event_id AS article, je.key AS entity FROM events e, unnest(json_keys(e.props)) AS je(key)")
def j09(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("article"), F.explode(F.json_object_keys("props")).alias("entity")).distinct()


@query("J10", duck("entities") + "SELECT a.entity_id AS src, b.entity_id AS dst FROM entities a JOIN (SELECT type, text, min(entity_id) AS entity_id FROM entities GROUP BY ALL) b ON b.type = 'LUAT' AND b.text = a.text WHERE a.type = 'DIEU'")
def j10(spark, sf):
    e = fixture(spark, sf, "entities")
    key = lambda t: F.concat_ws(":", t, "text")
    targets = e.groupBy(key(F.col("type")).alias("key")).agg(F.min("entity_id").alias("dst"))
    return e.where("type = 'DIEU'").select(F.col("entity_id").alias("src"), key(F.lit("LUAT")).alias("key")).join(targets, "key").select("src", "dst")
