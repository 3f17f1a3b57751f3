"""W, K, U, P, A and R: ranked lists, sessions and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.operators import ranking as K
from quoin.operators import sessions as M
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.registry import query

R_ = duck("results")
BEST = "score DESC, chunk_id"


def _results(spark, sf):
    return fixture(spark, sf, "results")


@query("W01", R_ + f"SELECT query_id, chunk_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}, source) AS rank FROM results WHERE source = 'vector'")
def w01(spark, sf):
    return K.rank_results(_results(spark, sf).where("source = 'vector'")).select("query_id", "chunk_id", "source", "score", "rank")


@query("K01", R_ + f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank FROM results WHERE source = 'bm25') WHERE rank <= 10")
def k01(spark, sf):
    return K.top_k(_results(spark, sf).where("source = 'bm25'"), 10).select("query_id", "chunk_id", "score", "rank")


@query("K02", "SELECT event_id, k, mode, CASE mode WHEN 'vector' THEN greatest(4 * k, 16) WHEN 'keyword' THEN greatest(2 * k, 12) WHEN 'hybrid' THEN greatest(4 * k, 20) ELSE 2 * k END AS n FROM (SELECT event_id, event_id % 20 + 1 AS k, CASE event_id % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'keyword' WHEN 2 THEN 'hybrid' ELSE 'rerank' END AS mode FROM events)")
def k02(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 20 + 1).alias("k"), F.element_at(F.array(*map(F.lit, ("vector", "keyword", "hybrid", "rerank"))), (F.col("event_id") % 4 + 1).cast("int")).alias("mode"))
    return e.withColumn("n", K.candidate_count(F.col("k"), F.col("mode")))


@query("W06", R_ + f"SELECT query_id, chunk_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, trim(text) ORDER BY {BEST}) AS n FROM results WHERE source = 'vector') WHERE n = 1")
def w06(spark, sf):
    return K.dedup_results(_results(spark, sf).where("source = 'vector'")).select("query_id", "chunk_id", "source", "score")


@query("W07", R_ + "SELECT query_id, chunk_id, text FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY query_id, chunk_id) AS n FROM results WHERE source = 'bm25') WHERE n = 1")
def w07(spark, sf):
    rows = _results(spark, sf).where("source = 'bm25'").withColumn("arrival", F.struct("query_id", "chunk_id"))
    return K.dedup_first_seen(rows, "arrival").select("query_id", "chunk_id", "text")


@query("U01", R_ + "SELECT DISTINCT substr(text, 1, 200) AS text, first_value(chunk_id) OVER (PARTITION BY substr(text, 1, 200) ORDER BY query_id, chunk_id) AS chunk_id FROM results WHERE source = 'vector'")
def u01(spark, sf):
    rows = _results(spark, sf).where("source = 'vector'").withColumn("arrival", F.struct("query_id", "chunk_id"))
    return K.dedup_first_seen(rows, "arrival", 200).select("text", "chunk_id")


@query("W08", R_ + f"SELECT query_id, chunk_id, score AS original_score, doc_id AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS original_rank, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC, chunk_id) AS rerank_rank FROM results WHERE source = 'vector'")
def w08(spark, sf):
    return K.rerank_delta(_results(spark, sf).where("source = 'vector'"), "doc_id")


@query("W09", R_ + f", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank, length(text) AS tokens FROM results WHERE source = 'bm25'), u AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM k) SELECT query_id, chunk_id, rank, used FROM u WHERE used + tokens <= 800")
def w09(spark, sf):
    rows = K.rank_results(_results(spark, sf).where("source = 'bm25'")).withColumn("tokens", F.length("text"))
    return K.budget_prefix(rows, 800).select("query_id", "chunk_id", "rank", "used")


RANKED = R_ + f", k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY {BEST}) AS rank FROM results) "


def _fused(df):
    return df.select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("R07", RANKED + "SELECT query_id, chunk_id, round(sum(CASE source WHEN 'vector' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (60 + rank)), 9) AS score FROM k GROUP BY ALL")
def r07(spark, sf):
    return _fused(K.rrf(_results(spark, sf), {"vector": 3.0, "bm25": 2.0}))


@query("R08", RANKED + "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM k GROUP BY ALL")
def r08(spark, sf):
    return _fused(K.rrf(_results(spark, sf)))


@query("R12", R_ + ", v AS (SELECT *, 'v' || (doc_id % 3) AS variant FROM results WHERE source = 'vector'), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, chunk_id) AS rank FROM v) SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM k GROUP BY ALL")
def r12(spark, sf):
    rows = _results(spark, sf).where("source = 'vector'").withColumn("variant", F.concat(F.lit("v"), F.col("doc_id") % 3))
    return _fused(K.rrf(rows, by="variant"))


@query("R09", R_ + "SELECT query_id, chunk_id, round(sum(CASE source WHEN 'vector' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * score / CASE WHEN m = 0 THEN 1 ELSE m END), 9) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id, source) AS m FROM results) GROUP BY ALL")
def r09(spark, sf):
    return _fused(K.weighted_score_fusion(_results(spark, sf), {"vector": 0.7, "bm25": 0.3}))


@query("R10", RANKED + ", t AS (SELECT query_id, chunk_id, min(rank * 3 + CASE source WHEN 'vector' THEN 0 ELSE 1 END) AS turn FROM k GROUP BY ALL) SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, chunk_id) AS rank FROM t) WHERE rank <= 20")
def r10(spark, sf):
    return K.interleave(_results(spark, sf), ("vector", "bm25"), 20)


@query("R11", R_ + "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, max(score) AS score FROM results GROUP BY ALL)")
def r11(spark, sf):
    return K.score_merge(_results(spark, sf))


@query("A05", "SELECT field, term, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, term) AS r FROM (SELECT 'lang' AS field, lang AS term, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source)) WHERE r <= CASE field WHEN 'lang' THEN 3 ELSE 10 END")
def a05(spark, sf):
    return K.facets(table(spark, sf, "documents"), {"lang": 3, "source": 10})


@query("P02", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source = 'src3'")
def p02(spark, sf):
    return K.dict_filter(table(spark, sf, "documents"), {"language": ["en", "de"], "source": "src3", "year": None}, {"language": "lang"}).select("doc_id")


@query("P03", R_ + "SELECT query_id, chunk_id FROM results WHERE chunk_id IN (SELECT 'c' || p_partkey FROM part WHERE p_size < 5)")
def p03(spark, sf):
    ids = table(spark, sf, "part").where("p_size < 5").select(F.concat(F.lit("c"), "p_partkey").alias("chunk_id"))
    return K.id_filter(_results(spark, sf), ids).select("query_id", "chunk_id")


@query("J01", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def j01(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id")
    return K.id_filter(docs, table(spark, sf, "benchmark").withColumnRenamed("item_id", "chunk_id")).select(F.col("chunk_id").alias("doc_id"), "source")


@query("P04", "SELECT doc_id FROM documents WHERE lang IN ('fr') AND source IN ('src1', 'src2')")
def p04(spark, sf):
    return K.facet_filter(table(spark, sf, "documents"), lang=["fr"], source=["src1", "src2"], year=[]).select("doc_id")


@query("P05", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality IN (1)")
def p05(spark, sf):
    return K.post_filter(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left"), quality=[1]).select("doc_id")


@query("X01", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars > 1000")
def x01(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return K.post_filter(docs, strict=True, predicate=F.col("n_chars") > 1000, quality=[1]).select("doc_id")


@query("P06", R_ + "SELECT query_id, chunk_id, source, score FROM results WHERE score >= 40")
def p06(spark, sf):
    return K.min_score(_results(spark, sf), 40).select("query_id", "chunk_id", "source", "score")


@query("P09", R_ + f"SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank FROM results WHERE source = 'bm25') WHERE rank <= 5 AND length(text) > 10")
def p09(spark, sf):
    return K.usable_documents(_results(spark, sf).where("source = 'bm25'")).select("query_id", "chunk_id", "rank")


@query("U02", R_ + ", e AS (SELECT chunk_id, text FROM results WHERE query_id = 1 AND source = 'vector'), n AS (SELECT chunk_id, text FROM results WHERE query_id = 2 AND source = 'vector') SELECT * FROM e UNION ALL SELECT * FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM e) AND substr(text, 1, 500) NOT IN (SELECT substr(text, 1, 500) FROM e)")
def u02(spark, sf):
    rows = _results(spark, sf).where("source = 'vector'")
    return K.merge_documents(rows.where("query_id = 1").select("chunk_id", "text"), rows.where("query_id = 2").select("chunk_id", "text"))


@query("U04", R_ + ", s AS (SELECT query_id % 5 AS session, query_id AS step, chunk_id, text, score FROM results WHERE source = 'bm25'), a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY step, score DESC, chunk_id) AS arrival FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY session, substr(text, 1, 200) ORDER BY arrival) AS n FROM a) SELECT session, step, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY arrival) AS place FROM f WHERE n = 1) WHERE place <= 15")
def u04(spark, sf):
    steps = _results(spark, sf).where("source = 'bm25'").select((F.col("query_id") % 5).alias("session"), F.col("query_id").alias("step"), "chunk_id", "text", "score")
    return K.accumulate_context(steps).select("session", "step", "chunk_id", "place")


@query("R18", R_ + f"SELECT query_id, string_agg('[' || rank || '] ' || chunk_id || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank FROM results WHERE source = 'vector') WHERE rank <= 8 GROUP BY query_id")
def r18(spark, sf):
    return K.pack_context(K.top_k(_results(spark, sf).where("source = 'vector'"), 8))


@query("R17", R_ + f", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank FROM results WHERE source = 'vector'), f AS (SELECT query_id, text AS citation, min(rank) AS rank FROM k GROUP BY ALL) SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY rank, citation) AS place FROM f")
def r17(spark, sf):
    return K.unique_citations(K.rank_results(_results(spark, sf).where("source = 'vector'")), "text")


@query("A10", R_ + f"SELECT query_id, round(least(1.0, 0.6::DOUBLE * avg(score / 100) + 0.4::DOUBLE * least(sum(length(text)) / 1000, 1.0)), 6) AS quality, sum(length(text)) > 100 AS enough FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank FROM results WHERE source = 'vector') WHERE rank <= 6 GROUP BY query_id")
def a10(spark, sf):
    rows = K.top_k(_results(spark, sf).where("source = 'vector'"), 6).withColumn("score", F.col("score") / 100)
    return K.context_quality(rows)


@query("J04", R_ + f", k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {BEST}) AS rank, doc_id FROM results WHERE source = 'vector'), x AS (SELECT query_id, rank, 0 AS pos, chunk_id AS id FROM k WHERE rank <= 10 UNION ALL SELECT query_id, rank, 1, 'c' || doc_id FROM k WHERE rank <= 10 UNION ALL SELECT query_id, rank, 2, 'c' || (doc_id + 1) FROM k WHERE rank <= 10) SELECT query_id, id AS chunk_id, rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, pos) AS n FROM x) WHERE n = 1")
def j04(spark, sf):
    rows = K.top_k(_results(spark, sf).where("source = 'vector'"), 10)
    return K.flatten_expanded(rows.withColumn("neighbours", F.array(F.concat(F.lit("c"), "doc_id"), F.concat(F.lit("c"), F.col("doc_id") + 1))))


@query("W02", "SELECT conv_id, turn, role FROM (SELECT *, count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS s, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS n FROM conversations) WHERE role = 'system' OR n <= 3 - s")
def w02(spark, sf):
    return M.prune_history(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


@query("W03", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS n FROM conversations) WHERE role = 'system' OR n <= 2")
def w03(spark, sf):
    return M.history(table(spark, sf, "conversations"), 2).select("conv_id", "turn", "role")


@query("W04", "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id")
def w04(spark, sf):
    return M.history_text(table(spark, sf, "conversations"))


@query("A17", "SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def a17(spark, sf):
    return M.conversation_list(table(spark, sf, "conversations"))


@query("S15", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def s15(spark, sf):
    c = table(spark, sf, "conversations")
    return M.delete_sessions(c, c.where("role = 'system'")).select("conv_id", "turn")


J_ = duck("job_events")


@query("A12", J_ + "SELECT job_id, coalesce(arg_max(chunks, CASE WHEN chunks <> 0 THEN seq END), 0) AS chunks, coalesce(arg_max(pages, CASE WHEN pages <> 0 THEN seq END), 0) AS pages FROM job_events GROUP BY job_id")
def a12(spark, sf):
    return M.merge_job_metrics(fixture(spark, sf, "job_events"), ["chunks", "pages"])


@query("A13", J_ + "SELECT job_id, arg_max(status, (ts, seq)) AS status, arg_max(percentage, (ts, seq)) AS percentage, max(percentage) AS highest, count(*) AS n_events FROM job_events GROUP BY job_id")
def a13(spark, sf):
    return M.job_latest(fixture(spark, sf, "job_events"))


@query("W11", J_ + "SELECT job_id, min(seq) AS created FROM job_events GROUP BY job_id ORDER BY created DESC, job_id LIMIT 20")
def w11(spark, sf):
    return M.retain_latest_jobs(fixture(spark, sf, "job_events").groupBy("job_id").agg(F.min("seq").alias("created")), 20)


@query("A14", "SELECT md5(trim(regexp_replace(lower('Q  ' || user_id || ' ' || event_type), '\\s+', ' ', 'g'))) AS query_hash, count(*) AS executions, round(avg(event_id % 100), 4) AS mean_ms, count(*) FILTER (event_id % 3 = 0) AS hits, count(*) FILTER (event_id % 3 <> 0) AS misses, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS hit_rate FROM events GROUP BY ALL")
def a14(spark, sf):
    log = table(spark, sf, "events").select(F.concat(F.lit("Q  "), "user_id", F.lit(" "), "event_type").alias("key"), (F.col("event_id") % 100).alias("ms"), "event_id")
    return M.query_statistics(log, F.col("event_id") % 3 == 0)


@query("S14", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place, (SELECT count(*) FROM events WHERE event_type = 'click') AS total FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 10 OFFSET 20")
def s14(spark, sf):
    return M.page_of(table(spark, sf, "events").where("event_type = 'click'"), 3, 10, [F.col("ts").desc(), F.col("event_id")]).select("event_id", "place", "total")


@query("F28", "SELECT event_id, date_diff('second', ts, TIMESTAMP '2030-01-01') // 3600 AS age FROM events")
def f28(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", M.age_hours(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.to_timestamp(F.lit("2030-01-01"))).alias("age"))
