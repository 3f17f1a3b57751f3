"""N, C, J, D, A, R, T: extracted structure, audits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import vocabulary as V
from quoin.operators import extraction as X
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.questions import any_of, lit
from quoin.plans.registry import query

def _replies(spark, sf):
    return fixture(spark, sf, "replies").select("doc_id", "reply")


@query("N01", duck("replies") + "SELECT doc_id, CASE style WHEN 2 THEN left(object, -1) || ', }' WHEN 3 THEN replace(object, chr(34), chr(39)) WHEN 5 THEN reply ELSE object END AS json FROM replies")
def n01(spark, sf):
    return _replies(spark, sf).select("doc_id", X.clean_json_text(F.col("reply")).alias("json"))


@query("N02", duck("replies") + "SELECT doc_id, object AS json FROM replies")
def n02(spark, sf):
    # a comma and a line end before each bracket; every other object in single quotes
    loose = F.replace("object", F.lit("]"), F.lit(",\n ]"))
    loose = F.when(F.col("style") % 2 == 0, F.replace(loose, F.lit('"'), F.lit("'"))).otherwise(loose)
    return fixture(spark, sf, "replies").select("doc_id", X.fix_json(loose).alias("json"))


@query("N03", duck("replies") + "SELECT doc_id, style = 5 AS error, CASE WHEN style = 5 THEN 0 ELSE n END AS n FROM replies")
def n03(spark, sf):
    return X.parse_replies(_replies(spark, sf)).select("doc_id", "error", F.coalesce(F.nullif(F.size("parsed.entities"), F.lit(-1)), F.lit(0)).alias("n"))


@query("N04", duck("reply_items") + "SELECT doc_id, 'entity' AS part, doc_id || '_' || id AS id, type, text, confidence::DOUBLE AS confidence FROM reply_items WHERE style < 5 UNION ALL SELECT doc_id, 'relation', doc_id || '_' || id, 'REF', doc_id || '_' || target, NULL FROM reply_items WHERE style < 5 AND related")
def n04(spark, sf):
    return X.extraction_parts(X.parse_replies(_replies(spark, sf)))


@query("N05", "SELECT doc_id, lang, source FROM documents")
def n05(spark, sf):
    packed = table(spark, sf, "documents").select("doc_id", X.pack_metadata("lang", "source").alias("m"))
    out = packed.withColumn("u", X.unpack_metadata(F.col("m")))
    return out.select("doc_id", F.col("u")["lang"].alias("lang"), F.col("u")["source"].alias("source"))


SECOND = " UNION ALL SELECT DISTINCT doc_id, 1, {} FROM reply_items WHERE style % 2 = 0"


def _tabled(spark, sf):
    return fixture(spark, sf, "piped").select("doc_id", "text")


@query("N06", duck("reply_items") + "SELECT doc_id, 0 AS no, CASE WHEN style < 3 THEN 'Mã|Tên|Giá' ELSE 'Mã|Tên' END AS columns, count(*) AS n_rows FROM reply_items GROUP BY doc_id, style" + SECOND.format("'Ghi chú', 1"))
def n06(spark, sf):
    return X.extract_tables(_tabled(spark, sf)).select("doc_id", "no", F.array_join("columns", "|").alias("columns"), F.size("rows").alias("n_rows"))


@query("N07", duck("reply_items") + """SELECT doc_id, 0 AS no, i AS row, c AS "column", CASE c WHEN 'Mã' THEN id WHEN 'Tên' THEN CASE WHEN short THEN '' ELSE text END ELSE CASE WHEN short THEN '' ELSE price::VARCHAR END END AS cell
        FROM (SELECT *, unnest(CASE WHEN style < 3 THEN ['Mã', 'Tên', 'Giá'] ELSE ['Mã', 'Tên'] END) AS c FROM reply_items)""" + SECOND.format("0, 'Ghi chú', 'n' || doc_id"))
def n07(spark, sf):
    return X.tables_as_records(X.extract_tables(_tabled(spark, sf)))


@query("N08", duck("reply_items") + """SELECT doc_id, 0 AS no, CASE WHEN style < 3 THEN '| Mã | Tên | Giá |' || chr(10) || '|---|---|---|' ELSE '| Mã | Tên |' || chr(10) || '|---|---|' END || chr(10)
        || string_agg(CASE WHEN short THEN '| ' || id || ' |' WHEN style < 3 THEN '| ' || id || ' | ' || text || ' | ' || price || ' |' ELSE '| ' || id || ' | ' || text || ' |' END, chr(10) ORDER BY i) AS markdown FROM reply_items GROUP BY doc_id, style""" + SECOND.format("'| Ghi chú |' || chr(10) || '|---|' || chr(10) || '| n' || doc_id || ' |'"))
def n08(spark, sf):
    return X.table_to_markdown(X.extract_tables(_tabled(spark, sf)))


LEAD = "'Dựa trên thông tin có sẵn: ' || "


@query("N09", duck("answers") + f"SELECT doc_id, CASE WHEN style < 2 THEN t WHEN style = 3 THEN {LEAD}brief WHEN length(bare) < 50 THEN {LEAD}bare ELSE bare END AS answer FROM (SELECT *, regexp_replace(t || chr(10), '\\n\\s*$', '') AS bare FROM answers)")
def n09(spark, sf):
    fenced = lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```"))
    k, body = F.col("style"), F.concat(F.lit('"answer": "'), "escaped", F.lit('"}'))
    raw = F.when(k == 0, F.concat(F.lit("```json\n{"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit('Vâng: {"n": 1, '), body, F.lit(" hết"))).when(k == 2, fenced(F.col("t"))).otherwise(fenced(F.col("brief")))
    return fixture(spark, sf, "answers").select("doc_id", X.json_answer(raw).alias("answer"))


@query("N12", "SELECT DISTINCT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst, upper(CASE WHEN l_linenumber % 2 = 0 THEN 'ref' ELSE 'has' END) AS type FROM lineitem")
def n12(spark, sf):
    t = table(spark, sf, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("subject"), F.when(F.col("l_linenumber") % 2 == 0, "ref").otherwise("has").alias("relation"), F.concat(F.lit("P"), "l_partkey").alias("object"))
    return X.triplets_to_tables(t)[1]


@query("C11")
def c11(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(X.pack_greedily(F.split("text", "\n"), 800, 100)).alias("no", "chunk"))


@query("J03", "SELECT p_partkey, string_agg(DISTINCT l_returnflag || l_linestatus, ' | ' ORDER BY l_returnflag || l_linestatus) AS evidence FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def j03(spark, sf):
    chunks = table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"))
    rel = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.concat("l_returnflag", "l_linestatus").alias("evidence"))
    return X.attach_evidence(chunks, rel).select(F.col("chunk_id").alias("p_partkey"), "evidence")


@query("J07", "SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'chuong_' || CASE WHEN n <= 9 THEN 1 WHEN n <= 19 THEN 2 WHEN n <= 27 THEN 3 WHEN n <= 30 THEN 4 WHEN n <= 34 THEN 5 ELSE 6 END END AS src, 'dieu_' || n AS dst, 'CONTAINS' AS type FROM (SELECT *, o_orderkey % 50 + 1 AS n FROM orders)")
def j07(spark, sf):
    k = F.col("o_orderkey")
    rel = table(spark, sf, "orders").select(F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit("chuong_"), k % 6)).alias("src"), F.concat(F.lit("dieu_"), k % 50 + 1).alias("dst"), F.lit("CONTAINS").alias("type"))
    return X.assign_chapter(rel)


J06 = "WITH a AS (SELECT o_custkey AS doc_id, 'a' || o_orderkey AS id, o_orderkey AS pos, CASE WHEN o_orderkey % 6 = 0 THEN 'được sửa đổi như sau' ELSE 'x' END AS text FROM orders), "


@query("J06", J06 + "m AS (SELECT doc_id, arg_min(id, (CASE WHEN text <> 'x' THEN 0 ELSE 1 END, pos)) AS src FROM a GROUP BY doc_id) SELECT DISTINCT o_custkey AS doc_id, src, 'c' || l_orderkey || '_' || l_linenumber AS dst, 'CONTAINS' AS type FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN m ON m.doc_id = o_custkey WHERE l_linenumber % 2 = 0")
def j06(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    articles = o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("a"), k).alias("id"), k.alias("pos"), F.when(k % 6 == 0, "được sửa đổi như sau").otherwise("x").alias("text"))
    clauses = li.join(o, F.col("l_orderkey") == k).select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("c"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id"), "l_linenumber").distinct()
    has = clauses.where("l_linenumber % 2 = 1").select("doc_id", F.lit("y").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
    return X.link_orphans(clauses, has, articles)


@query("D01", duck("amendments") + "SELECT src, dst FROM amendments WHERE substr(src, 2)::BIGINT % 3 <> 0 AND substr(dst, 2)::BIGINT % 4 <> 0")
def d01(spark, sf):
    a = fixture(spark, sf, "amendments")
    n, t = F.substring("src", 2, 20).cast("long"), F.substring("dst", 2, 20).cast("long")
    changes = a.select(F.col("src").alias("doc_id"), F.col("dst").alias("target_article"), F.when(t % 4 == 0, F.concat(F.substring("src", 2, 20), F.lit("/QĐ"))).otherwise(F.concat(F.lit("9"), F.substring("dst", 2, 20), F.lit("/QĐ"))).alias("target_document"))
    documents = a.select(F.col("src").alias("doc_id"), (n % 3 != 0).alias("amends"), F.concat(F.substring("src", 2, 20), F.lit("/QĐ-X")).alias("signature")).distinct()
    return X.remove_invalid_changes(changes, documents).select(F.col("doc_id").alias("src"), F.col("target_article").alias("dst"))


_WORDS = [w for _, words in V.TOPICS for w in words]
_TITLES = [t for t, _ in V.TOPICS] + ["Khác"]


def _hits(words) -> str:
    return "(" + " + ".join(f"contains(head, {lit(w)})::INT" for w in words) + ")"


_EXPECTED = "CASE " + " ".join(f"WHEN {any_of('title', words)} THEN {lit(t)}" for t, words in V.TOPICS) + " END"
_OWN = "CASE expected " + " ".join(f"WHEN {lit(t)} THEN {_hits(words)}" for t, words in V.TOPICS) + " END"
_OTHER = "CASE " + " ".join(f"WHEN expected <> {lit(t)} AND {_hits(words)} >= 2 AND {_hits(words)} > own THEN {lit(t)}" for t, words in V.TOPICS) + " END"
#: A clause's line: another article's heading, an article named within it, a chapter's heading, or words of two topics.
_LINE = f"CASE WHEN l_partkey % 31 = 0 THEN 'Chương II. Của ' || doc_id WHEN l_partkey % 6 = 0 THEN '  Điều ' || l_partkey % 20 || '. Khác' WHEN l_partkey % 6 = 1 THEN 'theo Điều ' || l_partkey % 20 || '. Như trên' ELSE {{}} END"


@query("D02", duck("clauses") + f"""SELECT DISTINCT id, 'article' AS kind, (l_partkey % 20)::VARCHAR AS detected FROM (SELECT *, 'dieu_' || article || '_' || doc_id AS id FROM clauses) WHERE l_partkey % 31 > 0 AND l_partkey % 6 = 0 AND l_partkey % 20 <> article
        UNION ALL SELECT DISTINCT 'dieu_' || article || '_' || doc_id, 'chapter', '' FROM clauses WHERE l_partkey % 31 = 0
        UNION ALL SELECT id, 'topic', other FROM (SELECT id, {_OTHER} AS other FROM (SELECT *, {_OWN} AS own FROM (SELECT *, {_EXPECTED} AS expected FROM
            (SELECT 'dieu_' || article || '_' || doc_id AS id, lower([{', '.join(map(lit, _TITLES))}][(doc_id + article) % {len(_TITLES)} + 1]) AS title, lower(substr(string_agg({_LINE.format(f"[{', '.join(map(lit, _WORDS))}][l_partkey % {len(_WORDS)} + 1] || ', ' || [{', '.join(map(lit, _WORDS))}][l_partkey * 7 % {len(_WORDS)} + 1]")}, chr(10) ORDER BY clause), 1, 500)) AS head FROM clauses GROUP BY doc_id, article)))) WHERE other IS NOT NULL""")
def d02(spark, sf):
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    k = F.col("l_partkey")
    rows = fixture(spark, sf, "clauses").withColumn("words", F.concat(pick(_WORDS, k), F.lit(", "), pick(_WORDS, k * 7))).withColumn("line", F.expr(_LINE.format("words")))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("clause", "line"))).getField("line"), "\n")
    articles = rows.groupBy("doc_id", "article").agg(text.alias("text"))
    return X.content_bleeding(articles.select(F.concat(F.lit("dieu_"), "article", F.lit("_"), "doc_id").alias("id"), pick(_TITLES, F.col("doc_id") + F.col("article")).alias("title"), "text"))


_ANS = "SELECT doc_id, text AS answer, doc_id % 6 AS n, (doc_id % 10) / 10.0::DOUBLE AS s FROM documents"


@query("A11", f"SELECT doc_id, round(least(0.95, greatest(0.1, 0.5::DOUBLE + CASE WHEN n > 0 THEN least(0.2, n * 0.05::DOUBLE) + s * 0.3::DOUBLE ELSE 0 END + CASE WHEN length(answer) > 100 THEN 0.1 ELSE 0 END + CASE WHEN {any_of('lower(answer)', V.LEGAL_TERMS)} THEN 0.1 ELSE 0 END)), 6) AS confidence, CASE WHEN n = 0 THEN 'insufficient_data' WHEN length(answer) < 100 THEN 'partial' WHEN {any_of('lower(answer)', V.ASPECTS)} THEN 'complete' WHEN length(answer) < 300 THEN 'partial' ELSE 'complete' END AS completeness FROM ({_ANS})")
def a11(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", X.answer_confidence(d % 6, (d % 10) / 10.0, F.col("text")).alias("confidence"), X.completeness(d % 6, F.col("text")).alias("completeness"))


_STEPS = "SELECT user_id AS session, event_id AS step, event_id % 3 = 0 AS answerable, (event_id % 100) / 100.0::DOUBLE AS confidence, event_id % 7 AS gaps FROM events"


@query("R21", f"SELECT session, coalesce(min(CASE WHEN step >= 2 AND ((answerable AND confidence >= 0.7) OR gaps = 0 OR confidence >= 0.8) THEN step END), max(step)) AS stop FROM ({_STEPS}) GROUP BY session")
def r21(spark, sf):
    e = F.col("event_id")
    steps = table(spark, sf, "events").select(F.col("user_id").alias("session"), e.alias("step"), (e % 3 == 0).alias("answerable"), ((e % 100) / 100.0).alias("confidence"), (e % 7).alias("gaps"))
    return X.early_stop(steps)


_NUM = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations"


@query("R22", f"SELECT conv_id, string_agg(i || '. ' || role, chr(10) ORDER BY i) AS text FROM ({_NUM}) GROUP BY conv_id")
def r22(spark, sf):
    return X.numbered_text(table(spark, sf, "conversations"), "conv_id", "turn", "role", single_bare=False)


@query("R23", f"SELECT conv_id, string_agg(CASE WHEN c = 1 THEN '' ELSE i || '. ' END || role, chr(10) ORDER BY i) AS text FROM ({_NUM}) GROUP BY conv_id")
def r23(spark, sf):
    return X.numbered_text(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("A18", "SELECT user_id, count(*) AS requests, sum(1 + CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END + event_id % 3)::BIGINT AS calls FROM events GROUP BY user_id")
def a18(spark, sf):
    calls = F.lit(1) + F.when(F.col("event_type") != "error", 1).otherwise(0) + F.col("event_id") % 3
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("requests"), F.sum(calls).alias("calls"))
