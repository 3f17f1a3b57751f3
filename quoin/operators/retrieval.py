"""Retrieval as a whole: filters, hybrid search, reranking, neighbours, sources; and quality of graphs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.legal import count_tokens
from quoin.operators import ranking as K
from quoin.operators.joins import gathered_join
from quoin.operators.lookups import containing
from quoin.steps import kept


#: The word before an article's number.
ARTICLE_WORD = "Điều"
#: What a question may name of a place.
PLACE = ("law", "article", "clause", "point")


def legal_filter(chunks: DataFrame, refs: DataFrame, strict: bool = True) -> DataFrame:
    """P01. ``(query_id, chunk_id)``: chunks whose law, article, clause and point are those that a query names, whichever these
    are. A bare article matches bare or with its word, one with its word only so; loose compares the law as contained text.

    Queries that name the same fields meet chunks by all of these at once; of a loose one's law, by each law that contains it.
    A query that names nothing has no filter: it is paired with no chunk, and its search takes all.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    chunks = chunks.select("chunk_id", *[some(c).alias(c) for c in PLACE])
    refs = refs.select("query_id", *[(F.lower(some(c)) if c == "point" else some(c)).alias(c) for c in PLACE])
    if not strict:
        chunks = chunks.withColumn("law", F.lower("law"))
        laws = chunks.select(F.col("law").alias("id"), F.col("law").alias("text")).distinct()
        named = refs.where("law IS NOT NULL").withColumn("phrase", F.lower("law")).drop("law")
        within = containing(laws, named.select("phrase")).select("phrase", F.col("id").alias("law"))
        refs = refs.where("law IS NULL").unionByName(named.join(within, "phrase").drop("phrase"))
    worded = F.startswith("article", F.lit(ARTICLE_WORD))
    form = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.when(worded, ARTICLE_WORD).otherwise(c) if c == "article" else F.lit(c)) for c in PLACE])
    refs = kept(refs.select("query_id", form.alias("form"), *[F.coalesce(c, F.lit("")).alias(c) for c in PLACE]).where("form != ''"))
    forms = [r.form for r in refs.select("form").distinct().collect()]  # 23 at most
    if not forms:
        return refs.join(chunks, F.lit(False)).select("query_id", "chunk_id")

    def as_named(form: str) -> Column:
        names = form.split(",")
        own = {c: F.col(c) if c in names else F.lit("") for c in PLACE}
        own["article"] = F.when(worded, F.col("article")) if ARTICLE_WORD in names else F.regexp_replace("article", f"^{ARTICLE_WORD} ", "") if "article" in names else F.lit("")
        return F.struct(F.lit(form).alias("form"), *[own[c].alias(c) for c in PLACE])

    places = chunks.select("chunk_id", F.inline(F.array(*map(as_named, forms))))
    return gathered_join(places, refs, "form", *PLACE).select("query_id", "chunk_id")


def expand_neighbors(results: DataFrame, chunks: DataFrame, each: int = 300, total: int = 800, tokens: Callable[[Column], Column] = lambda text: count_tokens(text, 13)) -> DataFrame:
    """J02, X02. ``(query_id, chunk_id, kind, neighbour, tokens)``: parent, previous and next of each result by id, unless it is a
    result itself; a parent over ``each`` tokens is left out, siblings are cut; as long as the budget of a result lasts.
    ``tokens`` estimates the tokens of a text."""
    kinds = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(k).alias("kind"), F.col(f"{k}_id").alias("neighbour")) for i, k in enumerate(("parent", "prev", "next"))])
    links = results.join(chunks.select("chunk_id", "parent_id", "prev_id", "next_id"), "chunk_id").select("query_id", "chunk_id", F.explode(kinds).alias("k")).select("query_id", "chunk_id", "k.*").where("neighbour IS NOT NULL")
    known = results.select("query_id", F.col("chunk_id").alias("neighbour")).distinct()
    links = links.join(known, ["query_id", "neighbour"], "left_anti")
    texts = chunks.select(F.col("chunk_id").alias("neighbour"), tokens(F.col("text")).alias("n"))
    rows = links.join(texts, "neighbour").where((F.col("kind") != "parent") | (F.col("n") <= each)).withColumn("tokens", F.least("n", F.lit(each)))
    w = Window.partitionBy("query_id", "chunk_id").orderBy("order")
    used = F.sum("tokens").over(w)
    return rows.withColumn("used", used).where(F.col("used") <= total).select("query_id", "chunk_id", "kind", "neighbour", "tokens")


def rerank(results: DataFrame, queries: DataFrame, top_n: int, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """R13, X02. New scores for (query, text) by ``overlap``, or by any vectorised scorer; the first n, old order among equals."""
    new = F.pandas_udf(scorer, "double") if scorer else lambda q, t: overlap(F.col(q), F.col(t))
    scored = results.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").withColumn("rerank_score", F.round(new("query_text", "text"), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("score").desc(), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n).drop("query_text")


def hybrid_search(branches: dict[str, DataFrame], weights: dict[str, float] | None, k: int) -> DataFrame:
    """R14. One fused list of the branches' results, or the one branch, the first k of each query."""
    parts = [df.select("query_id", "chunk_id", F.lit(name).alias("source"), F.col("score").cast("double").alias("score")) for name, df in branches.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = K.rrf(rows, weights) if len(parts) > 1 else rows.drop("source")
    return K.top_k(fused.withColumn("score", F.round("score", 9)), k)


def postprocess(results: DataFrame, k: int, least: float, **lists) -> DataFrame:
    """R15. Duplicates, filter, threshold, top k, in this order."""
    return results.transform(K.dedup_results).transform(lambda d: K.post_filter(d, **lists)).transform(lambda d: K.min_score(d, least)).transform(lambda d: K.top_k(d, k))


def source_list(results: DataFrame, marked: Column, spans: Column) -> DataFrame:
    """R20, F26. Numbered sources with the first highlighted piece, else the first span."""
    piece = F.coalesce(F.get(marked, 0), F.get(spans, 0), F.substring("text", 1, 100))
    return results.select("query_id", "chunk_id", F.format_string("[%d] %s", "rank", "chunk_id").alias("citation"), "score", piece.alias("piece"))


def feature_vector(dimension: int = 64) -> Callable[[pd.Series], pd.Series]:
    """C17, X02. The default encoder: words hashed into signed features, of length 1."""

    def encode(text: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in text:
            v = np.zeros(dimension, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h & 0x80000000 else -1
            out.append((v / max(float(np.linalg.norm(v)), 1e-9)).tolist())
        return pd.Series(out)

    return encode


def embed(chunks: DataFrame, encoder: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Adds ``embedding`` of prefix and text by any vectorised encoder."""
    return chunks.withColumn("embedding", F.pandas_udf(encoder, "array<float>")(F.concat_ws(" ", "prefix", "text")))


def missing_properties(nodes: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """P08. Required keys of a node's label that its ``props`` map has not."""
    want = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return nodes.withColumn("missing", F.array_sort(F.array_except(F.coalesce(F.try_element_at(want, F.col("label")), F.array().cast("array<string>")), F.map_keys("props"))))


def deduplicate_nodes(nodes: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """A04. Of nodes with one key the one with the longest text; and the map from old to new ids."""
    best = nodes.groupBy(key.alias("key")).agg(F.max_by(F.struct("id", "text"), F.struct(F.length("text"), "id")).alias("b"))
    return best.select("key", "b.*"), nodes.withColumn("key", key).join(best, "key").select(F.col("id").alias("old"), F.col("b.id").alias("new"))


def build_result(log: DataFrame) -> DataFrame:
    """A15. What a build made, failed and merged, and its success rate."""
    n = lambda s: F.count_if(F.col("outcome") == s)
    return log.groupBy("kind").agg(n("made").alias("made"), n("failed").alias("failed"), n("merged").alias("merged"), F.round(1 - n("failed") / F.count("*"), 6).alias("success_rate"))


def document_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A09. Articles of each chapter as an ordered array, and chapters of each document, bottom up."""
    up = edges.where("type = 'THUOC_VE'").select("src", "dst")
    articles = nodes.where("label = 'DIEU'").join(up, F.col("id") == F.col("src")).groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("num", "id"))).alias("articles"))
    chapters = nodes.where("label = 'CHUONG'").join(up, F.col("id") == F.col("src")).select("id", "num", F.col("dst").alias("doc")).join(articles.withColumnRenamed("dst", "id"), "id", "left")
    return chapters.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("num", "id", "articles"))).alias("chapters"))


def documents_overview(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """K03. The first n chapters by number of each document, and how many there are."""
    up = edges.where("type = 'THUOC_VE'").select("src", "dst")
    chapters = nodes.where("label = 'CHUONG'").join(up, F.col("id") == F.col("src"))
    return chapters.groupBy(F.col("dst").alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct("num", "name"))), 1, n).getField("name").alias("first"), F.count("*").alias("n"))


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S12. Edges with names and labels of both ends, as they are written out."""
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"), F.col("name").alias(f"{c}_name"))
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def hop(edges: DataFrame, type: str, start: str, end: str) -> DataFrame:
    """Steps of one type with named ends, to chain lookups."""
    return edges.where(F.col("type") == type).select(F.col("src").alias(start), F.col("dst").alias(end))


# ---------------------------------------------------------------- retrieval with settings as columns
#: Settings of a question about an exact place, and of any other.
EXACT = {"k": 3, "vector_n": 20, "bm25_n": 20, "vector_weight": 0.5, "bm25_weight": 0.5, "strict": True, "rerank": False, "rerank_n": 10}
SEMANTIC = {"k": 5, "vector_n": 30, "bm25_n": 20, "vector_weight": 0.5, "bm25_weight": 0.5, "strict": False, "rerank": True, "rerank_n": 10}


def with_settings(queries: DataFrame, exact: Column) -> DataFrame:
    """The settings of each query as columns, by its intent."""
    return queries.withColumns({c: F.when(exact, F.lit(EXACT[c])).otherwise(F.lit(SEMANTIC[c])) for c in EXACT})


def citation_entry(rank: Column, title: Column, page: Column, section: Column) -> Column:
    """F26. ``[n] title (page) - section``; what is missing or blank is left out."""
    some = lambda before, c, after="": F.concat(F.lit(before), F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(after))
    return F.concat_ws(" ", F.format_string("[%d]", rank), some("", title), some("(", page, ")"), some("- ", section))


def overlap(query: Column, text: Column) -> Column:
    """The share of a query's words that a text has; 0 without words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.coalesce(F.size(F.array_intersect(words(query), words(text))) / F.nullif(F.size(words(query)), F.lit(0)), F.lit(0.0))


def legal_retrieve(queries: DataFrame, results: DataFrame, chunks: DataFrame, rrf_k: int = 60) -> DataFrame:
    """R16. ``(query_id, rank, chunk_id, score, citation)``: the whole retrieval for a table of queries in one plan.

    ``queries(query_id, text, refs struct<law,article,clause,point>, settings..)`` brings its settings as columns, so queries of
    any intent go through together; ``results(query_id, chunk_id, source, score)`` are vector and bm25 lists,
    ``chunks(chunk_id, text, law, article, clause, point, title)``. In order: queries that name a place keep what stands there (P01,
    strict or loose by query); the first ``vector_n`` and ``bm25_n`` of either list are fused by reciprocal
    rank with the query's weights; the best of those are reranked by overlap with the question if it
    asks for that; the first k stay, each with its citation. Ties by chunk_id.
    """
    refs = queries.select("query_id", "strict", "refs.*")
    names = F.coalesce("law", "article", "clause", "point").isNotNull()
    placed = refs.where(names)
    allowed = legal_filter(chunks, placed.where("strict").drop("strict"), True).unionByName(legal_filter(chunks, placed.where("NOT strict").drop("strict"), False)).distinct()
    free = results.join(placed.select("query_id"), "query_id", "left_anti")
    lists = free.unionByName(results.join(allowed, ["query_id", "chunk_id"], "left_semi").select(*free.columns))
    ranked = K.rank_results(lists.select("query_id", "chunk_id", "source", "score"), "source").join(queries.drop("refs", "text"), "query_id")
    vector = F.col("source") == "vector"
    ranked = ranked.where(F.col("rank") <= F.when(vector, F.col("vector_n")).otherwise(F.col("bm25_n")))
    weight = F.when(vector, F.col("vector_weight")).otherwise(F.col("bm25_weight"))
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (rrf_k + F.col("rank"))), 9).alias("score"))
    of = Window.partitionBy("query_id")
    fused = fused.withColumn("place", F.row_number().over(of.orderBy(F.desc("score"), "chunk_id"))).join(queries.select("query_id", F.col("text").alias("question"), "k", "rerank", "rerank_n", "vector_n", "bm25_n"), "query_id")
    best = fused.where(F.col("place") <= F.when(F.col("rerank"), F.col("rerank_n")).otherwise(F.greatest("vector_n", "bm25_n"))).join(chunks.select("chunk_id", "text", "title", "article"), "chunk_id")
    again = F.when(F.col("rerank"), F.round(overlap(F.col("question"), F.col("text")), 6)).otherwise(0.0)
    out = best.withColumn("again", again).withColumn("rank", F.row_number().over(of.orderBy(F.desc("again"), "place"))).where("rank <= k")
    return out.select("query_id", "rank", "chunk_id", "score", citation_entry(F.col("rank"), F.col("title"), F.lit(None).cast("string"), F.concat(F.lit("Điều "), "article")).alias("citation"), "text")
