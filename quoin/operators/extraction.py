"""Model replies and extracted structure: parsing, tables, repair, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import vocabulary as V
from quoin.functions.questions import has_any

REPLY = "struct<entities:array<struct<id:string,type:string,text:string,confidence:double>>,relations:array<struct<source:string,target:string,type:string>>>"


def clean_json_text(reply: Column) -> Column:
    """N01. The fenced block, else the outermost object or array, else the text; {} if empty."""
    t = F.regexp_replace(F.trim(reply), "^﻿", "")
    some = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit(""))
    fenced = some(r"(?is)```json\s*(.*?)\s*```")
    block = some(r"(?s)```\s*([{\[].*?)\s*```")
    outer = F.coalesce(some(r"(?s)(\{.*\})"), some(r"(?s)(\[.*\])"))
    return F.coalesce(fenced, block, outer, F.nullif(t, F.lit("")), F.lit("{}"))


def fix_json(text: Column) -> Column:
    """N02. Without trailing commas; single quotes become double ones if there are no double ones."""
    t = F.regexp_replace(text, r",\s*([}\]])", "$1")
    return F.when(~F.contains(t, F.lit('"')), F.translate(t, "'", '"')).otherwise(t)


def parse_replies(responses: DataFrame, schema: str = REPLY) -> DataFrame:
    """N03. Adds ``parsed`` (direct, cleaned, then fixed; null if all fail) and ``error``.

    Each step is a column of its own, so that a reply is cleaned once and parsed again only if it must be.
    """
    ok = lambda c: F.col(c)["entities"].isNotNull() | F.col(c)["relations"].isNotNull()
    read = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE"})
    rows = responses.withColumn("_clean", clean_json_text(F.col("reply"))).withColumn("_first", read(F.col("_clean")))
    rows = rows.withColumn("_first", F.when(ok("_first"), F.col("_first"))).withColumn("_fixed", F.when(F.col("_first").isNull(), fix_json(F.col("_clean"))))
    rows = rows.withColumn("_second", read(F.col("_fixed")))
    parsed = F.coalesce(F.col("_first"), F.when(ok("_second"), F.col("_second")))
    return rows.withColumn("parsed", parsed).withColumn("error", F.col("parsed").isNull()).drop("_clean", "_first", "_fixed", "_second")


def _own(c: str | Column) -> Column:
    return F.concat_ws("_", F.col("doc_id").cast("string"), c)


def explode_extractions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N04. Entities and relations, ids prefixed by document."""
    e = parsed.select("doc_id", F.explode("parsed.entities").alias("e")).select("doc_id", _own("e.id").alias("id"), "e.type", "e.text", "e.confidence")
    r = parsed.select("doc_id", F.explode("parsed.relations").alias("r")).select("doc_id", _own("r.source").alias("src"), _own("r.target").alias("dst"), "r.type")
    return e, r


def extraction_parts(parsed: DataFrame) -> DataFrame:
    """N04. Both tables in one pass, so that no reply is parsed twice: ``(doc_id, part, id, type, text, confidence)``,
    a relation's target as its text."""
    item = lambda part, c, text, sure: F.struct(F.lit(part).alias("part"), c["id" if part == "entity" else "source"].alias("id"), c["type"].alias("type"), text.alias("text"), sure.alias("confidence"))
    e = F.transform("parsed.entities", lambda c: item("entity", c, c["text"], c["confidence"]))
    r = F.transform("parsed.relations", lambda c: item("relation", c, _own(c["target"]), F.lit(None).cast("double")))
    none = F.array().cast("array<struct<part:string,id:string,type:string,text:string,confidence:double>>")
    rows = parsed.select("doc_id", F.concat(F.coalesce(e, none), F.coalesce(r, none)).alias("items"))
    # outer: for the inner form Spark would parse once more, to ask whether there are any
    each = rows.select("doc_id", F.posexplode_outer("items").alias("i", "x")).where("i IS NOT NULL")
    return each.select("doc_id", "x.part", _own("x.id").alias("id"), "x.type", "x.text", "x.confidence")


def pack_metadata(*columns: str) -> Column:
    """N05. Extra columns as one JSON string."""
    return F.to_json(F.struct(*columns))


def unpack_metadata(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


TABLE = r"(\|[^\n]+\|\n\|[-:| ]+\|\n(?:\|[^\n]+\|\n)*)"


def extract_tables(docs: DataFrame) -> DataFrame:
    """N06. A row for each pipe table: number, columns, rows of cells."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TABLE), F.lit(1))).alias("no", "markdown"))
    lines = F.filter(F.split("markdown", "\n"), lambda x: x != "")
    cells = lambda line: F.transform(F.split(F.regexp_extract(line, r"^\|(.*)\|$", 1), r"\|"), lambda c: F.trim(c))
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    return found.select("doc_id", "no", cells(F.get(lines, 0)).alias("columns"), F.transform(body, cells).alias("rows"))


def tables_as_records(tables: DataFrame) -> DataFrame:
    """N07. A row for each cell, named by its column; short rows padded with empty text."""
    rows = tables.select("doc_id", "no", "columns", F.posexplode("rows").alias("row", "cells"))
    rows = rows.select("doc_id", "no", "row", "cells", F.posexplode("columns").alias("i", "column"))
    return rows.select("doc_id", "no", "row", "column", F.coalesce(F.get("cells", F.col("i")), F.lit("")).alias("cell"))


def table_to_markdown(tables: DataFrame) -> DataFrame:
    """N08. Tables written as pipe rows, a rule behind the first."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("columns")))
    return tables.select("doc_id", "no", F.array_join(F.concat(F.array(line(F.col("columns")), rule), F.transform("rows", line)), "\n").alias("markdown"))


def json_answer(text: Column, least: int = 50) -> Column:
    """N09. The answer field of an object in the text, else the text without fences, short ones with a lead-in."""
    obj = F.nullif(F.regexp_extract(text, r"(?s)(\{.*?\})", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*\n", ""), r"\n\s*```\s*$", "")
    return F.coalesce(F.get_json_object(obj, "$.answer"), F.when(F.length(bare) < least, F.concat(F.lit("Dựa trên thông tin có sẵn: "), bare)).otherwise(bare))


def triplets_to_tables(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N12. Entities (each id once) and typed relations of subject-relation-object rows."""
    ends = triplets.select(F.col("subject").alias("id")).union(triplets.select(F.col("object").alias("id")))
    return ends.distinct(), triplets.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.upper("relation").alias("type")).distinct()


def pack_greedily(parts: Column, size: int, overlap: int) -> Column:
    """C11. Paragraphs packed to a size; the next chunk begins with the end of the last."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc, p):
        full = F.length(acc["now"]) + F.length(p) > size
        out = F.when(full & (F.trim(acc["now"]) != ""), F.concat(acc["out"], F.array(F.trim(acc["now"])))).otherwise(acc["out"])
        tail = F.when(F.length(acc["now"]) > overlap, F.right(acc["now"], F.lit(overlap))).otherwise(acc["now"])
        now = F.when(full, F.concat(tail, p)).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return F.struct(now.alias("now"), out.alias("out"))

    return F.aggregate(parts, start, step, lambda a: F.when(F.trim(a["now"]) != "", F.concat(a["out"], F.array(F.trim(a["now"])))).otherwise(a["out"]))


def attach_evidence(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """J03. Chunks with all evidence of their relations, in order, joined by a bar."""
    notes = relations.groupBy(F.col("src").alias("chunk_id")).agg(F.array_join(F.array_sort(F.collect_set("evidence")), " | ").alias("evidence"))
    return chunks.join(notes, "chunk_id", "left")


def assign_chapter(relations: DataFrame, ranges=V.CHAPTER_RANGES) -> DataFrame:
    """J07. The chapter of each article by its number; wrong CONTAINS sources replaced, repeats dropped."""
    number = F.try_element_at(F.regexp_extract_all("dst", F.lit(r"^dieu_([0-9]+)"), F.lit(1)), F.lit(1)).cast("int")
    chapter = reduce(lambda a, r: a.when(number <= (r[2] or 2**31 - 1), f"chuong_{r[0]}"), ranges, F.when(F.lit(False), ""))
    wrong = (F.col("type") == "CONTAINS") & F.startswith("src", F.lit("chuong_")) & number.isNotNull()
    return relations.withColumn("src", F.when(wrong, chapter).otherwise(F.col("src"))).distinct()


def link_orphans(clauses: DataFrame, relations: DataFrame, articles: DataFrame) -> DataFrame:
    """J06. CONTAINS from the first article that speaks of amending (else the first) to clauses without a parent."""
    has = relations.where("type = 'CONTAINS'").select("doc_id", F.col("dst").alias("id"))
    orphans = clauses.select("doc_id", "id").join(has, ["doc_id", "id"], "left_anti")
    main = articles.groupBy("doc_id").agg(F.min_by("id", F.struct(F.when(has_any(F.lower("text"), V.AMENDING_ARTICLE), 0).otherwise(1), "pos")).alias("src"))
    return orphans.join(main, "doc_id").select("doc_id", "src", F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))


def merge_children(articles: DataFrame, children: DataFrame, relations: DataFrame) -> DataFrame:
    """C13. Articles with the texts of the clauses they contain behind their own, each under its title."""
    of = relations.where("type = 'CONTAINS'").groupBy(F.col("dst").alias("child")).agg(F.max("src").alias("id"))
    block = F.concat(F.lit("\n\n--- "), F.col("title"), F.lit(" ---\n"), F.col("text"), F.lit("\n"))
    own = children.select(F.col("id").alias("child"), "pos", block.alias("block")).join(of, "child")
    tails = own.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "child", "block"))).getField("block"), "").alias("tail"))
    return articles.join(tails, "id", "left").withColumn("text", F.concat("text", F.coalesce("tail", F.lit("")))).drop("tail")


def remove_invalid_changes(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """D01. Changes of amending documents with a target that is not the document itself."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    ok = F.col("amends") & F.col("target_article").isNotNull() & (F.coalesce(number("target_document"), F.lit("")) != F.coalesce(number("signature"), F.lit("-")))
    return changes.join(documents.select("doc_id", "amends", "signature"), "doc_id").where(ok).select(*changes.columns)


def content_bleeding(articles: DataFrame, topics=V.TOPICS) -> DataFrame:
    """D02. ``(id, kind, detected)``: headings of other articles or chapters in a text, and texts on another topic."""
    others = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*Điều\s+([0-9]+)[.\s:：]"), F.lit(1)))
    foreign = F.filter(others, lambda n: n != F.regexp_extract("id", "dieu_([0-9]+)", 1))
    rows = [F.transform(foreign, lambda n: F.struct(F.lit("article").alias("kind"), n.alias("detected")))]
    rows.append(F.when(F.upper("text").rlike(r"CHƯƠNG\s+[IVXLCDM1-9]+[.\s:：]"), F.array(F.struct(F.lit("chapter").alias("kind"), F.lit("").alias("detected")))).otherwise(F.array().cast("array<struct<kind:string,detected:string>>")))
    head, title = F.lower(F.substring("text", 1, 500)), F.lower("title")
    hits = {t: sum(F.when(F.contains(head, F.lit(w)), 1).otherwise(0) for w in words) for t, words in topics}
    expected = reduce(lambda a, t: a.when(has_any(title, t[1]), t[0]), topics, F.when(F.lit(False), ""))
    own = reduce(lambda a, t: a.when(expected == t, hits[t]), hits, F.when(F.lit(False), 0)).otherwise(99)
    other = reduce(lambda a, t: a.when((expected != t) & (hits[t] >= 2) & (hits[t] > own), t), hits, F.when(F.lit(False), ""))
    rows.append(F.when(other.isNotNull(), F.array(F.struct(F.lit("topic").alias("kind"), other.alias("detected")))).otherwise(F.array().cast("array<struct<kind:string,detected:string>>")))
    return articles.select("id", F.explode(F.concat(*rows)).alias("issue")).select("id", "issue.*")


def answer_confidence(n_docs: Column, mean_score: Column, answer: Column) -> Column:
    """A11. From the number and scores of documents and the answer's length and terms; 0.1 to 0.95."""
    docs = F.when(n_docs > 0, F.least(F.lit(0.2), n_docs * 0.05) + mean_score * 0.3).otherwise(0.0)
    more = F.when(F.length(answer) > 100, 0.1).otherwise(0.0) + F.when(has_any(F.lower(answer), V.LEGAL_TERMS), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.1), 0.5 + docs + more)), 6)


def completeness(n_docs: Column, answer: Column, least: int = 50) -> Column:
    short = F.length(answer) < 2 * least
    return F.when(n_docs == 0, "insufficient_data").when(short, "partial").when(has_any(F.lower(answer), V.ASPECTS), "complete").when(F.length(answer) < 6 * least, "partial").otherwise("complete")


def early_stop(steps: DataFrame, least_steps: int = 2, confident: float = 0.7, sure: float = 0.8) -> DataFrame:
    """R21. The first step of a session at which a stop rule holds, else its last."""
    rule = (F.col("step") >= least_steps) & ((F.col("answerable") & (F.col("confidence") >= confident)) | (F.col("gaps") == 0) | (F.col("confidence") >= sure))
    return steps.groupBy("session").agg(F.coalesce(F.min(F.when(rule, F.col("step"))), F.max("step")).alias("stop"))


def numbered_text(rows: DataFrame, group: str, order: str, text: str, single_bare: bool = True) -> DataFrame:
    """R22, R23. Numbered lines in order; a single line as it is."""
    lines = F.array_sort(F.collect_list(F.struct(order, text))).getField(text)
    out = rows.groupBy(group).agg(lines.alias("lines"))
    numbered = F.array_join(F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return out.select(group, (F.when(F.size("lines") == 1, F.get("lines", 0)).otherwise(numbered) if single_bare else numbered).alias("text"))
