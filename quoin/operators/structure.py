"""Statutes as lines, segments, chunks and a tree; a window never spans two documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import legal as L
from quoin.functions import vocabulary as V
from quoin.functions.texts import pieces_joined
from quoin.operators.extraction import pack_greedily

DEPTH = {"CHUONG": 1, "MUC": 2, "DIEU": 3, "KHOAN": 4, "DIEM": 5}


def in_order():
    """A window over a document's lines."""
    return Window.partitionBy("doc_id").orderBy("pos")


def split_lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, pos, line)`` of the trimmed lines that are not blank."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.trim("line")).where("line != ''")


def classify_lines(lines: DataFrame) -> DataFrame:
    """C01. Adds ``level, ident, title``: clauses only in an article, points only in a clause, else TEXT."""
    raw = F.lit("TEXT")
    for level, pattern in reversed(V.HEADINGS):
        raw = F.when(F.col("low").rlike(pattern), level).otherwise(raw)
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    last = lambda cond: F.coalesce(F.max(F.when(cond, F.col("pos"))).over(before), F.lit(-1))
    rows = lines.withColumn("low", F.lower("line")).withColumn("raw", raw)
    rows = rows.withColumns({"a": last(F.col("raw") == "DIEU"), "h": last(F.col("raw").isin("CHUONG", "MUC"))})
    rows = rows.withColumn("in_article", F.col("a") > F.col("h"))
    rows = rows.withColumn("level", F.when((F.col("raw") == "KHOAN") & ~F.col("in_article"), "TEXT").otherwise(F.col("raw")))
    rows = rows.withColumn("k", last(F.col("level") == "KHOAN"))
    rows = rows.withColumn("level", F.when((F.col("level") == "DIEM") & ~(F.col("in_article") & (F.col("k") > F.col("a"))), "TEXT").otherwise(F.col("level")))
    part = lambda g: F.coalesce(*[F.when(F.col("level") == level, F.regexp_extract("line", f"(?iu){p}", g)) for level, p in V.HEADINGS])
    return rows.select(*lines.columns, "level", part(1).alias("ident"), F.trim(part(2)).alias("title"))


def carry_context(lines: DataFrame) -> DataFrame:
    """C02. The chapter, section, article, clause and point that hold at each line; a higher heading ends
    lower ones. Text before the first article of a heading is dropped."""
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    at = {level: F.max(F.when(F.col("level") == level, F.col("pos"))).over(upto) for level in DEPTH}
    rows = lines.withColumns({f"at_{level}": c for level, c in at.items()})
    names = {"CHUONG": "chapter_id", "MUC": "section_id", "DIEU": "article_no", "KHOAN": "clause_no", "DIEM": "point_no"}
    ident = {level: F.last(F.when(F.col("level") == level, F.col("ident")), ignorenulls=True).over(upto) for level in DEPTH}
    out = {}
    for level, depth in DEPTH.items():
        above = [F.coalesce(F.col(f"at_{x}"), F.lit(-1)) for x, d in DEPTH.items() if d < depth]
        holds = F.col(f"at_{level}").isNotNull()
        for a in above:
            holds = holds & (F.col(f"at_{level}") > a)
        out[names[level]] = F.when(holds, ident[level])
    rows = rows.withColumns(out)
    return rows.where(F.col("article_no").isNotNull() | (F.col("level") != "TEXT")).drop(*[f"at_{x}" for x in DEPTH])


def article_segments(context: DataFrame) -> DataFrame:
    """C03. ``(doc_id, seg, article_no, text, is_definition)``: each article's lines, joined by spaces."""
    rows = context.where("article_no IS NOT NULL").withColumn("seg", F.sum(F.when(F.col("level") == "DIEU", 1).otherwise(0)).over(in_order()))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line"), " ")
    return rows.groupBy("doc_id", "seg").agg(F.first("article_no").alias("article_no"), F.min("pos").alias("pos"), text.alias("text"))


def definition_flag(lines: DataFrame) -> DataFrame:
    """C06. Articles whose own or next four lines have a definition phrase."""
    near = F.concat_ws("\n", F.collect_list("line").over(in_order().rowsBetween(0, 4)))
    return lines.withColumn("is_definition", (F.col("level") == "DIEU") & F.lower(near).rlike(V.DEFINITION)).where("level = 'DIEU'")


def budget_chunks(context: DataFrame, max_tokens: int = 800) -> DataFrame:
    """C04. Articles within the budget are one chunk; others are their head and a chunk a clause."""
    rows = context.where("article_no IS NOT NULL").withColumn("seg", F.sum(F.when(F.col("level") == "DIEU", 1).otherwise(0)).over(in_order()))
    total = F.sum(L.count_tokens(F.col("line"), 10)).over(Window.partitionBy("doc_id", "seg"))
    clause = F.when(F.floor(total * 1.5) > max_tokens, F.coalesce("clause_no", F.lit("0")))
    rows = rows.withColumn("clause_key", clause)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line"), " ")
    return rows.groupBy("doc_id", "seg", "article_no", "clause_key").agg(F.min("pos").alias("pos"), text.alias("text")).withColumn("tokens", L.count_tokens(F.col("text")))


def legal_tree(lines: DataFrame) -> DataFrame:
    """C08. ``(doc_id, pos, level, ident, parent, prev, next)``: the nearest open higher heading and the siblings."""
    heads = lines.where("level != 'TEXT'")
    depth = F.create_map(*[F.lit(x) for kv in DEPTH.items() for x in kv])[F.col("level")]
    heads = heads.withColumn("depth", depth)
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    above = F.lit(-1)
    for level, d in DEPTH.items():
        above = F.greatest(above, F.when(F.col("depth") > d, F.coalesce(F.max(F.when(F.col("level") == level, F.col("pos"))).over(before), F.lit(-1))).otherwise(F.lit(-1)))
    heads = heads.withColumn("parent", F.nullif(above, F.lit(-1)))
    return sibling_links(heads, "doc_id", "parent").select("doc_id", "pos", "level", "ident", "parent", "prev", "next")


def sibling_links(nodes: DataFrame, *of: str, order: str = "pos") -> DataFrame:
    """W05. The node before and the node behind under one parent."""
    w = Window.partitionBy(*of).orderBy(order)
    return nodes.withColumns({"prev": F.lag(order).over(w), "next": F.lead(order).over(w)})


def structure_stats(lines: DataFrame) -> DataFrame:
    """C09. Headings of each level and tokens of a document, in one aggregation."""
    return lines.groupBy("doc_id").agg(*[F.count_if(F.col("level") == level).alias(name) for level, name in (("CHUONG", "chapters"), ("MUC", "sections"), ("DIEU", "articles"), ("KHOAN", "clauses"), ("DIEM", "points"))], F.sum(L.count_tokens(F.col("line"))).alias("tokens"))


def merge_pages(page_nodes: DataFrame) -> DataFrame:
    """C14. One node an id over all pages: texts in page order, a piece that is in the text already is skipped;
    the longest title; the pages. A column ``sub`` (C15) orders pieces within a page."""
    order = ["page", "sub", "piece"] if "sub" in page_nodes.columns else ["page", "piece"]
    pieces = F.array_sort(F.collect_list(F.struct(*order))).getField("piece")
    out = page_nodes.groupBy("doc_id", "node_id").agg(pieces.alias("p"), F.max_by("title", F.struct(F.length("title"), "title")).alias("title"), F.array_sort(F.collect_set("page")).alias("pages"))
    return out.select("doc_id", "node_id", pieces_joined(F.col("p")).alias("text"), "title", "pages")


def merge_summary(nodes: DataFrame) -> DataFrame:
    """C16. Nodes and those on several pages, by document."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.size("pages") > 1).alias("multi_page"))


def attach_pending_text(page_nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """C15. ``page_nodes`` and, before each page's own pieces, the text that ``contexts(doc_id, page, pending_node_id, pending_text)``
    leaves for a node still open. Blank texts and those without a node add nothing."""
    open_ = contexts.where("pending_node_id IS NOT NULL AND trim(coalesce(pending_text, '')) != ''")
    left = open_.select("doc_id", "page", F.col("pending_node_id").alias("node_id"), F.col("pending_text").alias("piece"), F.lit("").alias("title"), F.lit(0).alias("sub"))
    return page_nodes.select("doc_id", "page", "node_id", "piece", "title", F.lit(1).alias("sub")).unionByName(left)


def split_long_clauses(context: DataFrame, max_tokens: int = 800) -> DataFrame:
    """C05. ``(doc_id, seg, article_no, clause_no, part, text)``: clauses of C02's lines, cut where a point would overflow.

    A point with which a clause would exceed the budget ends what was gathered and is a part of its own;
    later lines start afresh. Parts are numbered from 1, so that no two chunks share an id. The fold runs
    over one clause's lines and only numbers them.
    """
    rows = context.where("clause_no IS NOT NULL").withColumn("seg", F.sum(F.when(F.col("level") == "DIEU", 1).otherwise(0)).over(in_order()))
    key = ["doc_id", "seg", "article_no", "clause_no"]
    lines = F.array_sort(F.collect_list(F.struct("pos", L.count_tokens(F.col("line"), 10).alias("words"), (F.col("level") == "DIEM").alias("point"), "line")))
    tokens = lambda words: F.floor(words * 15 / 10)
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        over = x["point"] & (tokens(acc["words"]) + tokens(x["words"]) > max_tokens)
        part = F.when(over, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(F.when(over, 0).otherwise(acc["words"] + x["words"]).alias("words"), F.when(over, part + 1).otherwise(part).alias("part"), F.concat(acc["out"], F.array(part)).alias("out"))

    parts = rows.groupBy(*key).agg(lines.alias("l")).withColumn("p", F.aggregate("l", start, step, lambda a: a["out"]))
    each = parts.select(*key, F.posexplode_outer(F.arrays_zip("l", "p")).alias("i", "x")).where("i IS NOT NULL")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("x.l.pos", "x.l.line"))).getField("line"), " ")
    chunks = each.groupBy(*key, F.col("x.p").alias("p")).agg(text.alias("text"))
    return chunks.withColumn("part", F.row_number().over(Window.partitionBy(*key).orderBy("p"))).select(*key, "part", "text")


ARTICLE_HEAD, CHAPTER_HEAD = r"Điều\s+[0-9]++[^:：]*+[:：]", r"((?:Chương|CHƯƠNG)\s+[IVXLCDM]++[^:：]*+[:：])"


def article_chunks(documents: DataFrame, size: int = 2000, overlap: int = 200, least: int = 50) -> DataFrame:
    """C10. ``(doc_id, no, kind, article, chapter, text)``: texts cut at article headings that end in a colon.

    What stands before the first heading is a chunk if it is longer than ``least``, and gives the chapter
    of all. A text that yields none is packed by paragraphs (C11). Headings are sought before the last
    colon alone: behind it each would be followed to the end of the text in vain.
    """
    rows = documents.where("text IS NOT NULL").withColumn("tail", F.substring_index(F.substring_index("text", ":", -1), "：", -1))
    rows = rows.withColumn("body", F.left("text", F.length("text") - F.length("tail")))
    rows = rows.withColumns({"gaps": F.split("body", ARTICLE_HEAD, -1), "heads": F.regexp_extract_all("body", F.lit(ARTICLE_HEAD), F.lit(0))})
    gap = lambda i: F.concat(F.get("gaps", i), F.when(F.size("heads") == i, F.col("tail")).otherwise(""))
    first = gap(F.lit(0))
    chapter = F.nullif(F.trim(F.regexp_extract(F.get("gaps", F.lit(0)), CHAPTER_HEAD, 1)), F.lit(""))
    articles = F.transform("heads", lambda h, i: F.struct(F.lit("article").alias("kind"), F.regexp_extract(h, r"Điều\s+([0-9]+)", 1).alias("article"), F.trim(F.concat(h, gap(i + 1))).alias("text")))
    none = F.array().cast("array<struct<kind:string,article:string,text:string>>")
    other = lambda t: F.struct(F.lit("other").alias("kind"), F.lit(None).cast("string").alias("article"), t.alias("text"))
    found = F.concat(F.when(F.length(F.trim(first)) > least, F.array(other(F.trim(first)))).otherwise(none), articles)
    packed = F.transform(pack_greedily(F.split("text", r"\n\s*\n"), size, overlap), other)
    out = rows.select("doc_id", chapter.alias("chapter"), F.when(F.size(found) > 0, found).otherwise(packed).alias("c"))
    # outer: for the inner form Spark would make all chunks once more, to ask whether there are any
    each = out.select("doc_id", "chapter", F.posexplode_outer("c").alias("no", "x")).where("no IS NOT NULL")
    return each.select("doc_id", "no", "x.kind", "x.article", "chapter", "x.text")
