"""R, G, S, J, A, P: search, graphs and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import legal as L
from quoin.operators import graph as G
from quoin.operators import search as S
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.registry import query

N_, E_ = duck("nodes"), duck("edges")
B_ = duck("nodes", "edges")
BOTH = "s AS (SELECT src AS a, dst AS b, type FROM edges UNION ALL SELECT dst, src, type FROM edges)"


def _nodes(spark, sf):
    return fixture(spark, sf, "nodes")


def _edges(spark, sf):
    return fixture(spark, sf, "edges")


def _docs(spark, sf):
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id")


def _asked(spark, sf):
    return table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


T_ = "WITH t AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), p AS (SELECT chunk_id, term, count(*) AS tf, any_value(l) AS length FROM (SELECT chunk_id, len(t) AS l, unnest(t) AS term FROM t) GROUP BY chunk_id, term), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), tot AS (SELECT count(*) AS n, avg(len(t)) AS m FROM t) "


@query("R01", T_ + "SELECT p.term, df.df, sum(tf)::BIGINT AS tf, count(*) AS postings FROM p JOIN df USING (term) GROUP BY ALL")
def r01(spark, sf):
    postings, stats = S.bm25_index(_docs(spark, sf))
    return postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("postings")).join(stats.select("term", "df"), "term")


_BM = T_ + ", q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / m))), 6) AS score FROM p JOIN q USING (term) JOIN df USING (term), tot GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) "


@query("R02", _BM + "SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM k WHERE rank <= 10")
def r02(spark, sf):
    return S.bm25_search(_asked(spark, sf), _docs(spark, sf), 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query("R19", _BM.replace("[a-z0-9]+", S.MARKED) + "SELECT item_id AS query_id, count(k.query_id) AS n, min(rank) AS first FROM benchmark LEFT JOIN k ON k.query_id = item_id AND rank <= 20 GROUP BY item_id")
def r19(spark, sf):
    asked = _asked(spark, sf)
    found = S.bm25_search(asked, _docs(spark, sf), 20, cut=S.any_words).groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return asked.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "first")


@query("R04", "WITH q AS (SELECT item_id AS query_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS q FROM benchmark), d AS (SELECT doc_id AS chunk_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents) SELECT query_id, chunk_id FROM q JOIN d ON contains(t, q)")
def r04(spark, sf):
    return S.phrase_match(_asked(spark, sf), _docs(spark, sf))


@query("R05", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings) SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10")
def r05(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return S.vector_search(q, e, 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query("R06")
def r06(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    dimension = len(e.select("embedding").first()[0])
    return S.approx_vector_search(q, e, 10, dimension)


@query("G11", B_ + f", {BOTH} SELECT a AS id, b AS other, type FROM s WHERE a IN (SELECT id FROM nodes WHERE label = 'CHUONG')")
def g11(spark, sf):
    return G.neighbors(_edges(spark, sf), _nodes(spark, sf).where("label = 'CHUONG'"))


@query("G07", B_ + "SELECT s.id AS start, concat_ws('>', s.id, e.dst) AS path, 1 AS depth FROM nodes s JOIN edges e ON e.src = s.id WHERE s.label = 'CHUONG' AND e.type = 'THUOC_VE' UNION ALL SELECT s.id, concat_ws('>', s.id, e.dst, f.dst), 2 FROM nodes s JOIN edges e ON e.src = s.id AND e.type = 'THUOC_VE' JOIN edges f ON f.src = e.dst AND f.type = 'THUOC_VE' WHERE s.label = 'CHUONG'")
def g07(spark, sf):
    paths = G.traverse(_edges(spark, sf), _nodes(spark, sf).where("label = 'CHUONG'"), 2, "out", ["THUOC_VE"])
    return paths.select("start", F.array_join("path", ">").alias("path"), "depth")


@query("G08", B_ + f", {BOTH}, z AS (SELECT id FROM nodes WHERE label = 'DIEU' AND num = 7 AND content LIKE '1%'), one AS (SELECT z.id AS start, b AS id FROM z JOIN s ON a = z.id), two AS (SELECT start, b AS id FROM one JOIN s ON a = one.id WHERE b <> start) SELECT start, id, min(depth) AS depth FROM (SELECT DISTINCT start, id, 1 AS depth FROM one UNION ALL SELECT DISTINCT start, id, 2 FROM two) GROUP BY ALL")
def g08(spark, sf):
    return G.subgraph(_edges(spark, sf), _nodes(spark, sf).where("label = 'DIEU' AND num = 7 AND content LIKE '1%'"), 2)


PAIRS = "SELECT 'C' || c_custkey AS a, 'R' || (c_custkey % 5) AS b FROM customer"


@query("G09", duck("edges") + f", z AS ({PAIRS}), u AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'THUOC_VE') SELECT z.a, z.b, 2 AS depth FROM z WHERE EXISTS (SELECT 1 FROM u x JOIN u y ON x.b = y.a WHERE x.a = z.a AND y.b = z.b)")
def g09(spark, sf):
    c = table(spark, sf, "customer")
    pairs = c.select(F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("R"), F.col("c_custkey") % 5).alias("b"))
    return G.shortest_path(_edges(spark, sf), pairs, 3, "out", ["THUOC_VE"])


@query("G10", duck("edges") + f", z AS ({PAIRS}) SELECT z.a, z.b, concat_ws('>', x.src, x.dst, y.dst) AS path FROM z JOIN edges x ON x.src = z.a AND x.type = 'THUOC_VE' JOIN edges y ON y.src = x.dst AND y.dst = z.b AND y.type = 'THUOC_VE'")
def g10(spark, sf):
    c = table(spark, sf, "customer")
    pairs = c.select(F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("R"), F.col("c_custkey") % 5).alias("b"))
    return G.all_paths(_edges(spark, sf), pairs, 3, "out", ["THUOC_VE"]).select("a", "b", F.array_join("path", ">").alias("path"))


@query("G12", N_ + "SELECT id, name, content FROM nodes WHERE label = 'CHUONG' AND content = 'BUILDING'")
def g12(spark, sf):
    return G.nodes_by_type(_nodes(spark, sf), "CHUONG", content="BUILDING").select("id", "name", "content")


@query("G13", B_ + "SELECT n.id AS root, d.id FROM nodes n JOIN edges e ON e.dst = n.id AND e.type = 'THUOC_VE' JOIN edges f ON f.dst = e.src AND f.type = 'THUOC_VE' JOIN nodes d ON d.id = f.src WHERE n.label = 'LUAT' AND d.label = 'DIEU' AND d.num = 5")
def g13(spark, sf):
    n = _nodes(spark, sf)
    under = G.below(_edges(spark, sf), n.where("label = 'LUAT'"), 2)
    return under.join(n.where("label = 'DIEU' AND num = 5").select("id"), "id", "left_semi").select("root", "id")


@query("G14", B_ + "SELECT n.id, n.name, e.src AS article FROM nodes n LEFT JOIN edges e ON e.dst = n.id AND e.type = 'MENTIONS' WHERE n.label = 'KHAI_NIEM' AND contains(lower(n.name), 'brass')")
def g14(spark, sf):
    n = G.keyword_search_nodes(_nodes(spark, sf), "BRASS", {"KHAI_NIEM": ["name"]})
    at = _edges(spark, sf).where("type = 'MENTIONS'").select(F.col("dst").alias("id"), F.col("src").alias("article"))
    return n.join(at, "id", "left").select("id", "name", "article")


AM = "('THAY_THE', 'SUA_DOI', 'BO_SUNG', 'BAI_BO')"


@query("G05", duck("amendments") + "SELECT dst, arg_max(type, (effective, src)) AS last_type, count(*) AS changes FROM amendments GROUP BY dst")
def g05(spark, sf):
    a = fixture(spark, sf, "amendments")
    return a.groupBy("dst").agg(F.max_by("type", F.struct("effective", "src")).alias("last_type"), F.count("*").alias("changes"))


@query("G17", B_ + f"SELECT e.dst, e.src, e.type, n.name, n.content FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type IN {AM}")
def g17(spark, sf):
    e = _edges(spark, sf).where(f"type IN {AM}")
    return e.join(_nodes(spark, sf).select(F.col("id").alias("src"), "name", "content"), "src").select("dst", "src", "type", "name", "content")


@query("G21", duck("edges") + f", c AS (SELECT dst AS id, src AS last, 1 AS depth FROM edges WHERE type IN {AM} UNION ALL SELECT c.id, e.src, c.depth + 1 FROM c JOIN edges e ON e.dst = c.last AND e.type IN {AM}) SELECT id, arg_max(last, depth) AS last, max(depth) AS depth FROM c GROUP BY id")
def g21(spark, sf):
    return G.chain_end(_edges(spark, sf), ["THAY_THE", "SUA_DOI", "BO_SUNG", "BAI_BO"])


@query("W10", duck("amendments") + ", v AS (SELECT o_orderkey % 50 AS article, 'O' || o_orderkey AS id, o_orderkey AS arrival, ('O' || o_orderkey) IN (SELECT dst FROM amendments) AS amended FROM orders) SELECT article, id FROM (SELECT *, row_number() OVER (PARTITION BY article ORDER BY amended DESC, arrival) AS n FROM v) WHERE n = 1")
def w10(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("article"), F.concat(F.lit("O"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("arrival"))
    changed = fixture(spark, sf, "amendments").select(F.col("dst").alias("id"), F.lit(True).alias("amended")).distinct()
    rows = o.join(changed, "id", "left").withColumn("amended", F.coalesce("amended", F.lit(False)))
    n = F.row_number().over(Window.partitionBy("article").orderBy(F.col("amended").desc(), "arrival"))
    return rows.withColumn("n", n).where("n = 1").select("article", "id")


@query("G19", duck("edges") + "SELECT DISTINCT x.src AS a, y.src AS b FROM edges x JOIN edges y ON x.dst = y.dst AND x.src < y.src WHERE x.type = 'MENTIONS' AND y.type = 'MENTIONS'")
def g19(spark, sf):
    return G.related_articles(_edges(spark, sf))


@query("G28", B_ + f", {BOTH} SELECT a AS id, count(*) AS relations, min(b) AS first_other FROM s WHERE a IN (SELECT id FROM nodes WHERE label = 'LUAT') GROUP BY a")
def g28(spark, sf):
    return G.neighbors(_edges(spark, sf), _nodes(spark, sf).where("label = 'LUAT'")).groupBy("id").agg(F.count("*").alias("relations"), F.min("other").alias("first_other"))


@query("G29", N_ + "SELECT id, label, coalesce(nullif(name, ''), nullif(content, ''), id) AS display FROM nodes")
def g29(spark, sf):
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return _nodes(spark, sf).select("id", "label", F.coalesce(some("name"), some("content"), "id").alias("display"))


@query("A06", B_ + "SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges")
def a06(spark, sf):
    return G.graph_stats(_nodes(spark, sf), _edges(spark, sf))


@query("A07", B_ + "SELECT dst AS id, count(*) AS mentions, any_value(n.name) AS name FROM edges JOIN nodes n ON n.id = dst WHERE type = 'MENTIONS' GROUP BY dst ORDER BY mentions DESC, dst LIMIT 5")
def a07(spark, sf):
    return G.entity_stats(_nodes(spark, sf), _edges(spark, sf).where("type = 'MENTIONS'"))


@query("A08", B_ + "SELECT n.id, count(DISTINCT c.src) AS chapters, count(DISTINCT d.src) AS articles FROM nodes n LEFT JOIN edges c ON c.dst = n.id AND c.type = 'THUOC_VE' LEFT JOIN edges d ON d.dst = c.src AND d.type = 'THUOC_VE' WHERE n.label = 'LUAT' GROUP BY n.id")
def a08(spark, sf):
    up = _edges(spark, sf).where("type = 'THUOC_VE'")
    per = up.alias("c").join(up.alias("d"), F.col("d.dst") == F.col("c.src"), "left").groupBy(F.col("c.dst").alias("id")).agg(F.count_distinct("c.src").alias("chapters"), F.count_distinct("d.src").alias("articles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _nodes(spark, sf).where("label = 'LUAT'").select("id").join(per, "id", "left").select("id", zero("chapters"), zero("articles"))


@query("P10", N_ + "SELECT id, label FROM nodes WHERE (label = 'LUAT' AND contains(lower(name), 'an')) OR (label = 'CHUONG' AND contains(lower(content), 'an'))")
def p10(spark, sf):
    return G.keyword_search_nodes(_nodes(spark, sf), "AN", {"LUAT": ["name"], "CHUONG": ["content"]}).select("id", "label")


@query("P11", N_ + "SELECT id, 3 * (contains(lower(name), 'brass')::INT + contains(lower(name), 'tin')::INT) + contains(lower(content), 'brass')::INT + contains(lower(content), 'tin')::INT AS score FROM nodes WHERE contains(lower(name), 'brass') OR contains(lower(name), 'tin') OR contains(lower(content), 'tin') OR contains(lower(content), 'brass') ORDER BY score DESC, id LIMIT 50")
def p11(spark, sf):
    return G.scored_search(_nodes(spark, sf), ["brass", "tin"], 50).select("id", "score")


@query("J08", duck("edges") + "SELECT dst AS id, count(DISTINCT src) AS articles FROM edges WHERE type = 'MENTIONS' GROUP BY dst HAVING count(DISTINCT src) > 1")
def j08(spark, sf):
    return G.shared_entities(_edges(spark, sf).where("type = 'MENTIONS'"))


@query("S09", N_ + "SELECT label, id, name, CASE WHEN label = 'CHUONG' AND num % 3 = 0 THEN 'new' ELSE content END AS content FROM nodes UNION ALL SELECT 'CHUONG', 'X1', 'x', 'new'")
def s09(spark, sf):
    n = _nodes(spark, sf).select("label", "id", "name", "content")
    batch = _nodes(spark, sf).where("label = 'CHUONG' AND num % 3 = 0").select("label", "id", F.lit(None).cast("string").alias("name"), F.lit("new").alias("content"))
    extra = spark.createDataFrame([("CHUONG", "X1", "x", "new")], "label string, id string, name string, content string")
    return G.upsert_nodes(n, batch.unionByName(extra))


@query("S10", duck("edges") + "SELECT src, dst, type, CASE WHEN type = 'MENTIONS' THEN 2.0::DOUBLE ELSE weight::DOUBLE END AS weight FROM edges")
def s10(spark, sf):
    e = _edges(spark, sf)
    batch = e.where("type = 'MENTIONS'").withColumn("weight", F.lit(2.0)).unionByName(e.limit(1).select(F.lit("nowhere").alias("src"), "dst", "type", F.lit(1.0).alias("weight")))
    return G.upsert_edges(e, batch, _nodes(spark, sf))


@query("S11", B_ + "SELECT id FROM nodes WHERE NOT (label = 'KHAI_NIEM' AND num % 4 = 0 AND id NOT IN (SELECT dst FROM edges))")
def s11(spark, sf):
    n = _nodes(spark, sf)
    return G.delete_nodes(n, _edges(spark, sf), n.where("label = 'KHAI_NIEM' AND num % 4 = 0"), False)[0].select("id")


@query("S08", B_ + "SELECT src, dst, type FROM edges WHERE NOT starts_with(src, 'C1') AND NOT starts_with(dst, 'C1')")
def s08(spark, sf):
    n = _nodes(spark, sf)
    return G.delete_nodes(n, _edges(spark, sf), n.where(F.startswith("id", F.lit("C1"))), True)[1].select("src", "dst", "type")


@query("S05", "SELECT event_id % 500 AS id, arg_max(event_type, event_id) AS event_type, max(event_id) AS version FROM events GROUP BY 1")
def s05(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 500).alias("id"), "event_type", F.col("event_id").alias("version"))
    return G.upsert(e.where("version % 2 = 0"), e.where("version % 2 = 1"), ("id",), "version")


@query("S06", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def s06(spark, sf):
    gone = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, sf, "documents").join(gone, "doc_id", "left_anti").select("doc_id")


@query("S07", "SELECT conv_id, turn FROM conversations WHERE NOT (role = 'user' AND turn = 0)")
def s07(spark, sf):
    c = table(spark, sf, "conversations")
    gone = c.where("role = 'user' AND turn = 0").select("conv_id", "turn")
    return c.join(gone, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("S13", "SELECT source, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def s13(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"))


@query("J05", duck("edges", "nodes") + ", m AS (SELECT CASE WHEN src LIKE 'O%5' THEN 'O' || (substr(src, 2)::BIGINT - 1) ELSE src END AS src, dst, type FROM edges WHERE type = 'THUOC_VE') SELECT DISTINCT src, dst, type FROM m WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def j05(spark, sf):
    e = _edges(spark, sf).where("type = 'THUOC_VE'")
    renamed = _nodes(spark, sf).where("label = 'DIEU' AND id LIKE '%5'").select(F.col("id").alias("old"), F.concat(F.lit("O"), F.substring("id", 2, 20).cast("long") - 1).alias("new"))
    return G.fix_relations(e, renamed, _nodes(spark, sf))


EN_ = duck("entities") + r", e AS (SELECT *, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[.,;:!?]+|[.,;:!?]+$', '', 'g')) AS normalized FROM entities) "


@query("A01", EN_ + "SELECT arg_max(entity_id, (confidence, -entity_id)) AS entity_id, arg_max(text, (confidence, -entity_id)) AS text, min(start_pos) AS start_pos, max(end_pos) AS end_pos, max(confidence) AS confidence, count(*) AS merged FROM e GROUP BY type, normalized")
def a01(spark, sf):
    e = fixture(spark, sf, "entities").withColumn("normalized", L.normalize_entity(F.col("text")))
    return G.merge_entities(e, [F.col("type"), F.col("normalized")]).select("entity_id", "text", "start_pos", "end_pos", "confidence", "merged")


@query("P07", duck("entities") + "SELECT entity_id, CASE WHEN confidence < 0.7 THEN 'confidence' WHEN trim(text) = '' THEN 'empty' WHEN type NOT IN ('LUAT', 'DIEU', 'KHAI_NIEM') THEN 'type' END AS reason FROM entities")
def p07(spark, sf):
    return G.valid_entities(fixture(spark, sf, "entities"), ["LUAT", "DIEU", "KHAI_NIEM"]).select("entity_id", "reason")
