"""Files in, tables out; what cannot be read becomes a row with an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("txt", "md")


def read_plain_documents(spark: SparkSession, path: str) -> DataFrame:
    """S01. ``(file_name, text, error)``: one row a file; other suffixes have an error and no text."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("text"))
    ok = F.lower(F.element_at(F.split("file_name", r"\."), -1)).isin(*SUFFIXES)
    return files.select("file_name", F.when(ok, F.col("text")).alias("text"), F.when(~ok, F.lit("unsupported suffix")).alias("error"))


def parse_crawled(raw: DataFrame) -> DataFrame:
    """S02. ``(url, title, crawled_at, length, body)`` of ``raw(text)``: four header lines, a rule, the body."""
    head = lambda name: F.regexp_extract("text", rf"(?m)^{name}: (.*)$", 1)
    return raw.select(
        head("URL").alias("url"), head("Title").alias("title"), F.try_to_timestamp(head("Crawled")).alias("crawled_at"),
        F.regexp_extract("text", r"(?m)^Length: ([0-9]+)", 1).cast("int").alias("length"),
        F.regexp_extract("text", r"(?s)^.*?\n={20,}\n(.*)$", 1).alias("body"),
    )


def read_crawled_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_crawled(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def read_extraction_json(spark: SparkSession, path: str) -> DataFrame:
    """S03. ``(article_id, clause_id, title, text)``: a row for each clause of an article, else one for the article,
    and one for each clause that stands alone."""
    clause = "struct<id:string,title:string,full_text:string>"
    schema = f"stage1_structure struct<articles:array<struct<id:string,title:string,full_text:string,clauses:array<{clause}>>>,clauses:array<{clause}>>"
    s = spark.read.json(path, schema=schema, multiLine=True).select("stage1_structure.*")
    a = s.select(F.explode("articles").alias("a")).select("a.*").select("id", "title", "full_text", F.explode_outer("clauses").alias("c"))
    head = F.when(F.col("c.title") != F.col("title"), F.concat_ws("\n", "title", "c.title")).otherwise(F.col("title"))
    own = a.select(F.col("id").alias("article_id"), F.col("c.id").alias("clause_id"), head.alias("title"), F.concat_ws("\n", head, F.coalesce("c.full_text", "full_text")).alias("text"))
    alone = s.select(F.explode("clauses").alias("c")).select(F.lit(None).cast("string").alias("article_id"), F.col("c.id").alias("clause_id"), F.col("c.title").alias("title"), F.concat_ws("\n", "c.title", "c.full_text").alias("text"))
    return own.unionByName(alone)
