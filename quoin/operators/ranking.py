"""Ranked lists ``results(query_id, chunk_id, source, score, ..)``: ranks, fusion, deduplication, top k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_first(*by: str) -> "Window":
    """A window over the rows of a query, best score first, ties by chunk_id."""
    return Window.partitionBy("query_id", *by).orderBy(F.col("score").desc(), F.col("chunk_id"))


def rank_results(results: DataFrame, *by: str) -> DataFrame:
    """W01. Adds ``rank`` from 1 within a query (and ``by``)."""
    return results.withColumn("rank", F.row_number().over(best_first(*by)))


def top_k(results: DataFrame, k: int) -> DataFrame:
    """K01. The first k of each query; Spark limits the groups before the shuffle."""
    return rank_results(results).where(F.col("rank") <= k)


def candidate_count(k: Column, mode: Column) -> Column:
    """K02. How many candidates a branch fetches to return k."""
    return F.when(mode == "vector", F.greatest(4 * k, F.lit(16))).when(mode == "keyword", F.greatest(2 * k, F.lit(12))).when(mode == "hybrid", F.greatest(4 * k, F.lit(20))).otherwise(2 * k)


def signature(method: str) -> Column:
    """What makes two results equal: the text, its first 100 characters in lower case, or the id."""
    return {"text": F.md5(F.trim(F.col("text"))), "prefix": F.md5(F.lower(F.substring(F.trim(F.col("text")), 1, 100))), "id": F.col("chunk_id")}[method]


def dedup_results(results: DataFrame, method: str = "text") -> DataFrame:
    """W06. Of results with equal signatures in a query, the best."""
    row = F.row_number().over(Window.partitionBy("query_id", "sig").orderBy(F.col("score").desc(), F.col("chunk_id")))
    return results.withColumn("sig", signature(method)).withColumn("n", row).where("n = 1").drop("n", "sig")


def dedup_first_seen(results: DataFrame, arrival: str, n: int = 100, *by: str) -> DataFrame:
    """W07. Of results whose texts begin alike, the first to arrive; empty texts go."""
    row = F.row_number().over(Window.partitionBy(*by, F.substring("text", 1, n)).orderBy(arrival))
    return results.where(F.length(F.trim("text")) > 0).withColumn("n", row).where("n = 1").drop("n")


def rerank_delta(results: DataFrame, new_score: str) -> DataFrame:
    """W08. Old and new rank and score next to each other."""
    old = F.row_number().over(best_first())
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(new_score).desc(), F.col("chunk_id")))
    return results.select("query_id", "chunk_id", F.col("score").alias("original_score"), F.col(new_score).alias("rerank_score"), old.alias("original_rank"), new.alias("rerank_rank"))


def budget_prefix(items: DataFrame, budget: int, tokens: str = "tokens", group: str = "query_id", order: str = "rank") -> DataFrame:
    """W09. Items whose group has not used up the budget before them."""
    before = F.sum(tokens).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumn("used", F.coalesce(before, F.lit(0))).where(F.col("used") + F.col(tokens) <= budget)


def rrf(results: DataFrame, weights: dict[str, float] | None = None, k: int = 60, normalise: bool = True, by: str = "source") -> DataFrame:
    """R07, R08, R12. Reciprocal rank fusion over the lists of a query: the sum of weight / (k + rank).

    Without weights each list has weight 1; given weights add up to 1 unless ``normalise`` is off.
    """
    ranked = rank_results(results, by)
    if weights:
        total = sum(weights.values()) if normalise else 1.0
        weight = reduce(lambda a, w: a.when(F.col(by) == w[0], w[1] / total), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    else:
        weight = F.lit(1.0)
    return ranked.groupBy("query_id", "chunk_id").agg(F.sum(weight / (k + F.col("rank"))).alias("score"))


def weighted_score_fusion(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """R09. Scores by the best of their list, weighted and summed; a list whose best is 0 counts as it is."""
    best = F.max("score").over(Window.partitionBy("query_id", "source"))
    weight = reduce(lambda a, w: a.when(F.col("source") == w[0], w[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    scaled = results.withColumn("part", weight * F.col("score") / F.when(best == 0, 1.0).otherwise(best))
    return scaled.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def interleave(results: DataFrame, order: tuple[str, ...], n: int) -> DataFrame:
    """R10. The lists in turn, each chunk where it first stands, n a query."""
    place = reduce(lambda a, x: a.when(F.col("source") == x[1], x[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order))
    turn = rank_results(results, "source").groupBy("query_id", "chunk_id").agg(F.min(F.col("rank") * (len(order) + 1) + place).alias("turn"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "chunk_id"))
    return turn.withColumn("rank", rank).where(F.col("rank") <= n).drop("turn")


def score_merge(results: DataFrame) -> DataFrame:
    """R11. Every chunk with its best raw score, ranked."""
    return rank_results(results.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")))


def facets(results: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """A05. ``(field, term, n)``: the most frequent terms of each field; nulls do not count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("term")) for f in sizes]))
    counts = results.select(pairs.alias("p")).where("p.term IS NOT NULL").groupBy("p.field", "p.term").agg(F.count("*").alias("n"))
    limit = reduce(lambda a, x: a.when(F.col("field") == x[0], x[1]), sizes.items(), F.when(F.lit(False), 0))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("term")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def dict_filter(df: DataFrame, wanted: dict, names: dict[str, str] | None = None) -> DataFrame:
    """P02. All given fields equal; a list means one of; None is ignored; ``names`` renames fields."""
    for field, value in wanted.items():
        c = F.col((names or {}).get(field, field))
        if value is not None:
            df = df.where(c.isin(*value) if isinstance(value, (list, tuple, set)) else c == value)
    return df


def facet_filter(df: DataFrame, **lists) -> DataFrame:
    """P04. Before scoring: each field is one of a list; empty lists do not filter."""
    return dict_filter(df, {k: list(v) for k, v in lists.items() if v})


def post_filter(results: DataFrame, strict: bool = False, predicate: Column | None = None, **lists) -> DataFrame:
    """P05, X01. After scoring: as P04, but a missing value passes unless ``strict``; and any other condition."""
    for field, values in lists.items():
        if values:
            ok = F.col(field).isin(*values)
            results = results.where(ok if strict else ok | F.col(field).isNull())
    return results if predicate is None else results.where(predicate)


def min_score(results: DataFrame, least: float) -> DataFrame:
    """P06."""
    return results.where(F.col("score") >= least)


def id_filter(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """P03, J01. Chunks whose chunk_id is listed."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def merge_documents(existing: DataFrame, new: DataFrame, n: int = 500) -> DataFrame:
    """U02. Existing rows and those new ones whose id and first n characters are unknown."""
    begin = F.substring("text", 1, n)
    fresh = new.join(existing.select("chunk_id").distinct(), "chunk_id", "left_anti")
    known = existing.select(begin.alias("begin")).distinct()
    return existing.unionByName(fresh.withColumn("begin", begin).join(known, "begin", "left_anti").drop("begin"))


def accumulate_context(steps: DataFrame, cap: int = 15, n: int = 200) -> DataFrame:
    """U04. ``(session, step, chunk_id, text, score)`` in order of arrival, each beginning once, cut at the cap."""
    arrival = Window.partitionBy("session").orderBy("step", F.col("score").desc(), "chunk_id")
    once = dedup_first_seen(steps.withColumn("arrival", F.row_number().over(arrival)), "arrival", n, "session")
    place = F.row_number().over(Window.partitionBy("session").orderBy("arrival"))
    return once.withColumn("place", place).where(F.col("place") <= cap).drop("arrival")


def pack_context(results: DataFrame, rule: str = "\n---\n") -> DataFrame:
    """R18. One text a query: numbered heading and text of each result in rank order."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("chunk_id"), F.lit("\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("query_id").agg(ordered.alias("b")).select("query_id", F.array_join(F.col("b.block"), rule).alias("context"))


def unique_citations(results: DataFrame, citation: str) -> DataFrame:
    """R17. Each citation of a query once, where it first stands."""
    first = results.groupBy("query_id", F.col(citation).alias("citation")).agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "citation"))).drop("rank")


def context_quality(results: DataFrame) -> DataFrame:
    """A10. 0.6 of the mean score and 0.4 of the length in thousands (1 at most), 1 at most; whether over 100 characters."""
    size = F.sum(F.length("text"))
    quality = F.least(F.lit(1.0), F.lit(0.6) * F.avg("score") + F.lit(0.4) * F.least(size / 1000, F.lit(1.0)))
    return results.groupBy("query_id").agg(F.round(quality, 6).alias("quality"), (size > 100).alias("enough"))


def usable_documents(results: DataFrame, n: int = 5) -> DataFrame:
    """P09. Of the first n results of a query those with more than 10 characters."""
    return top_k(results, n).where(F.length("text") > 10)


def flatten_expanded(results: DataFrame, neighbours: str = "neighbours") -> DataFrame:
    """J04. Each main chunk and then its neighbours, every chunk of a query where it first stands."""
    all_ids = F.concat(F.array("chunk_id"), F.coalesce(neighbours, F.array().cast("array<string>")))
    rows = results.select("query_id", "rank", F.posexplode(all_ids).alias("pos", "id"))
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank", "pos"))
    return rows.withColumn("n", first).where("n = 1").select("query_id", F.col("id").alias("chunk_id"), "rank", "pos")
