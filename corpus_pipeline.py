"""A corpus from raw documents to a mix: quality, lines, near duplicates, benchmarks, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import read, saved
from quoin.llm.decontaminate import benchmark_hits, contaminated, n_hit
from quoin.llm.line_dedup import MIN_CHARS, _trimmed, dedup_lines
from quoin.llm.mixing import mix_documents
from quoin.llm.ngram_join import similar_documents
from quoin.llm.quality import quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.5 or more."""
    scored = quality_scores(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))
    return scored.where("score >= 0.5").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere. One goes if no line of MIN_CHARS is left and each
    shorter one that is not blank occurs in an earlier document too; short lines themselves always stay."""
    out = dedup_lines(docs.select(*COLUMNS)).withColumn("doc", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))))
    each = lambda df, doc: df.select(doc.alias("doc"), F.explode(F.split("text", "\n")).alias("line")).select("doc", _trimmed(F.col("line")).alias("line"))
    asked = saved(each(out.where("emptied"), F.col("doc")).where("line != ''").distinct())
    every = each(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    first = every.where(F.length("line") < MIN_CHARS).join(asked.select("line").distinct(), "line", "left_semi").groupBy("line").agg(F.min("doc").alias("first"))
    own = saved(asked.join(first, "line").where("doc = first").select(F.col("doc").alias("owner")).distinct())
    out = out.join(own, F.col("doc") == F.col("owner"), "left").where(~F.col("emptied") | F.col("owner").isNotNull())
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select("row.doc_id", "text", "row.lang", "row.source", n_chars.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id (those without an id last, then by hash of
    id and text). Different texts under one id are documents of their own; rows equal in both count once,
    the least by their other columns."""
    own = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))).alias("own")
    rows = docs.select(*COLUMNS, own)
    groups = similar_documents(rows.select(F.col("own").alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id").distinct()
    named = rows.select("own", "doc_id").join(groups, "own")
    stays = saved(named.groupBy("component_id").agg(F.min_by("own", F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("own")).select("own"))
    once = rows.join(stays, "own", "left_semi")
    twice = saved(rows.groupBy("own").count().where("count > 1").select("own"))
    if twice.isEmpty():
        return once.select(*COLUMNS)
    least = once.join(twice, "own", "left_semi").groupBy("own").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.join(twice, "own", "left_anti").select(*COLUMNS).unionByName(least.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    hits = benchmark_hits(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")).withColumn("hit", n_hit())
    return hits.where(~contaminated(F.col("hit"), F.col("n_words"))).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's rate and its draw say, with ``copy`` from 1; those taken 0 times are absent."""
    return mix_documents(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed)]

#: The trained model and MinHash have no SQL twin; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents: the columns of documents, and ``copy``.

    Null texts, empty tables and repeated rows are as each stage's operator states; columns beyond those
    of documents do not take part.
    """
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
