"""Extracted facts as typed nodes, edges and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import legal as L
from quoin.functions import vocabulary as V

NO_PROPS = "map<string,string>"


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _pick(props: Column, *keys) -> Column:
    """The first of some keys that has a value; a key may depend on the row."""
    return F.coalesce(*[_filled(F.try_element_at(props, k if isinstance(k, Column) else F.lit(k))) for k in keys])


def _by_label(label: Column, values: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), label), F.lit(default))


def _present(entries: list[tuple[Column | str, Column]]) -> Column:
    """A map of those entries that have a value; of equal keys the first one stands."""
    pairs = F.filter(F.array(*[F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.cast("string").alias("v")) for k, v in entries]), lambda e: e["v"].isNotNull())
    once = F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda x: x["k"]), e["k"]) == (i + 1))
    return F.map_from_entries(once)


def map_entity_properties(label: Column, props: Column) -> Column:
    """F22. A node's properties under the keys of its label.

    The id is the first filled of the label's own key, ``code``, ``id`` and ``name``, without known prefixes (F21); the
    name the first of the label's own key, ``name`` and ``title``, else the id. Courses without credits
    have 4. Every other key passes through; those four old names do not. Null maps count as empty.
    """
    props = F.coalesce(props, F.create_map().cast(NO_PROPS))
    id_key, name_key = _by_label(label, {k: a for k, a, _ in V.LABEL_KEYS}, "id"), _by_label(label, {k: b for k, _, b in V.LABEL_KEYS}, "name")
    own_id = L.clean_entity_id(_pick(props, id_key, "code", "id", "name"))
    name = F.coalesce(_pick(props, name_key, "name", "title"), own_id)
    rest = F.map_filter(props, lambda k, v: ~k.isin("code", "id", "name", "title") & (k != id_key) & (k != name_key))
    credits = (label == V.COURSE) & _filled(F.try_element_at(rest, F.lit(V.CREDITS))).isNull()
    rest = F.when(credits, F.map_filter(rest, lambda k, v: k != V.CREDITS)).otherwise(rest)
    return F.map_concat(_present([(id_key, own_id), (name_key, name)]), rest, F.when(credits, F.create_map(F.lit(V.CREDITS), F.lit("4"))).otherwise(F.create_map().cast(NO_PROPS)))


def typed_node(kind: Column, text: Column, normalized: Column, confidence: Column, metadata: Column) -> Column:
    """F29. ``(name, content, props)`` of an extracted entity: what its type asks for, from its metadata or its text.

    Articles and clauses have numbers (0 if unknown) and content, concepts a term and definition,
    sanctions a type, acts, rights and duties their text, documents number, title, authority, date and
    status (in force by default). Other types have name, normalised name and confidence alone.
    """
    meta = F.coalesce(metadata, F.create_map().cast(NO_PROPS))
    has = lambda key, default: F.coalesce(F.try_element_at(meta, F.lit(key)), default if isinstance(default, Column) else F.lit(default))
    own = {
        "DIEU": (has("content", ""), [("article_number", has("article_number", "0")), ("article_title", has("article_title", text)), ("article_content", has("content", ""))]),
        "KHOAN": (has("content", text), [("clause_number", has("clause_number", "0")), ("clause_content", has("content", text))]),
        "KHAI_NIEM": (has("definition", ""), [("term", has("term", text)), ("definition", has("definition", ""))]),
        "HANH_VI_CAM": (text, [("prohibited_act", text)]),
        "CHE_TAI": (text, [("sanction_type", has("sanction_type", "")), ("sanction_content", text)]),
        "QUYEN": (text, [("right_content", text)]),
        "NGHIA_VU": (text, [("obligation_content", text)]),
    }
    document = [("document_number", has("document_number", "")), ("title", text), ("issuing_authority", has("issuing_authority", "")), ("effective_date", has("effective_date", "")), ("status", has("status", V.IN_FORCE))]
    own |= {k: (F.lit(""), document) for k in ("LUAT", "NGHI_DINH", "THONG_TU")}
    base = [("name", text), ("normalized_name", F.coalesce(normalized, text)), ("confidence", confidence.cast("string"))]
    content = reduce(lambda a, k: a.when(kind == k, own[k][0]), own, F.when(F.lit(False), "")).otherwise("")
    more = reduce(lambda a, k: a.when(kind == k, _present(own[k][1])), own, F.when(F.lit(False), F.create_map().cast(NO_PROPS))).otherwise(F.create_map().cast(NO_PROPS))
    return F.struct(text.alias("name"), content.alias("content"), F.map_concat(_present(base), more).alias("props"))


MENTION = r"(Điều|Khoản)\s+([0-9]+)"


def extract_mentions(documents: DataFrame) -> DataFrame:
    """G06. ``(doc_id, start, end, text, type, number, article, confidence)``: articles and clauses named in ``documents(doc_id, text)``.

    ``substr(text, start + 1, end - start)`` cuts the mention out again. ``article`` is the article of a
    clause: the one that its mention goes on to name ("Khoản 2 Điều 5"), else the last one named before it.
    """
    gaps, found = F.split("text", MENTION, -1), F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text"))
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("m"))
    spans = documents.where("text IS NOT NULL").select("doc_id", "text", F.posexplode(F.aggregate(pairs, first, step, lambda a: a["out"])).alias("i", "s")).select("doc_id", F.col("text").alias("whole"), "i", "s.*")
    rows = spans.select("doc_id", "i", "start", "end", "text", F.when(F.startswith("text", F.lit("Điều")), "DIEU").otherwise("KHOAN").alias("type"), F.regexp_extract("text", "([0-9]+)$", 1).alias("number"), F.substr("whole", F.col("end") + 1, F.lit(2)).alias("behind"))
    w = Window.partitionBy("doc_id").orderBy("i")
    named = F.when(F.col("type") == "DIEU", F.col("number"))
    follows = (F.lead("start").over(w) == F.col("end") + 1) & (F.lead("type").over(w) == "DIEU") & F.startswith("behind", F.lit(" "))
    article = F.coalesce(F.when(follows, F.lead("number").over(w)), F.last(named, ignorenulls=True).over(w))
    return rows.select("doc_id", "start", "end", "text", "type", "number", F.when(F.col("type") == "KHOAN", article).alias("article"), F.lit(0.9).alias("confidence"))


def tree_nodes(tree: DataFrame) -> DataFrame:
    """G02. Graph nodes of a parsed tree ``(path, level, ident, title, text)``: ids from the path, texts cut."""
    cut = F.when(F.col("level").isin("KHOAN", "DIEM"), 2000).otherwise(1000)
    return tree.select(F.translate("path", ":/ ", "___").alias("id"), F.col("level").alias("label"), F.coalesce(_filled(F.col("title")), F.col("ident")).alias("name"), F.substr(F.coalesce("text", F.lit("")), F.lit(1), cut).alias("content"), F.regexp_extract("ident", "^([0-9]+)", 1).try_cast("long").alias("num"))


def semantic_nodes(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G03. Nodes and edges of ``facts(id, kind, name, content, links array<struct<type,target>>)``: each fact once (the longest
    content; ties the largest name), its links only to nodes that exist or are facts themselves."""
    once = facts.groupBy("id").agg(F.max_by(F.struct("kind", "name", "content"), F.struct(F.length(F.coalesce("content", F.lit(""))), "name")).alias("f")).select("id", F.col("f.kind").alias("label"), "f.name", F.coalesce("f.content", F.lit("")).alias("content"))
    links = facts.select(F.col("id").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.target").alias("dst"), F.col("l.type").alias("type")).distinct()
    known = nodes.select(F.col("id").alias("dst")).unionByName(once.select(F.col("id").alias("dst"))).distinct()
    return once, links.join(known, "dst", "left_semi").select("src", "dst", "type")


def reference_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """G04. Edges of ``refs(source_id, target_id, type, reference_text)``: both ends filled and existing, type by default an inner
    reference; made once, with the text of the first in order."""
    rows = refs.where("coalesce(source_id, '') != '' AND coalesce(target_id, '') != ''").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.coalesce("type", F.lit("THAM_CHIEU")).alias("type"), "reference_text")
    ids = nodes.select("id").distinct()
    ok = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ok.groupBy("src", "dst", "type").agg(F.min("reference_text").alias("reference_text"))


def graph_rows(entities: DataFrame, relations: DataFrame, types, default: str) -> tuple[DataFrame, DataFrame]:
    """C18. Nodes and edges of extracted entities and relations: names cut at 200, raw type and confidence kept as properties."""
    props = lambda: F.map_filter(F.create_map(F.lit("raw_type"), F.col("type"), F.lit("confidence"), F.col("confidence").cast("string")), lambda k, v: v.isNotNull())
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in types for x in kv]), F.upper("type")), F.lit(default))
    nodes = entities.select("id", F.upper("type").alias("label"), F.substr("text", F.lit(1), F.lit(200)).alias("name"), F.col("text").alias("content"), props().alias("props"))
    return nodes, relations.select("src", "dst", kind.alias("type"), props().alias("props"))


def collect_semantics(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A16. Of ``results(article_id, entities, relations, changes)``, arrays of strings, a row a fact with its article and kind; and totals of each kind."""
    facts = None
    for kind in ("entities", "relations", "changes"):
        rows = results.select("article_id", F.lit(kind).alias("kind"), F.explode(kind).alias("fact")).distinct()
        facts = rows if facts is None else facts.unionByName(rows)
    return facts, facts.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("articles"))


ANSWER = "answer_type string, min_amount double, max_amount double, currency string, effective_date string, article_refs array<struct<document:string,article:string>>"


def answer_reply(reply: Column, kinds: tuple[str, ...], default: str) -> Column:
    """N11. A typed record from the JSON in a reply: an unknown kind is the default, dates by day or in ISO form, null if neither."""
    j = F.from_json(_filled(F.regexp_extract(reply, r"(?s)(\{.*\})", 1)), ANSWER)
    kind = F.lower(j["answer_type"])
    date = F.coalesce(F.try_to_date(j["effective_date"], "yyyy-MM-dd"), F.try_to_date(j["effective_date"], "dd/MM/yyyy"))
    amount = F.when(j["min_amount"].isNotNull() | j["max_amount"].isNotNull(), F.struct(F.least(j["min_amount"], j["max_amount"]).alias("min"), F.greatest(j["min_amount"], j["max_amount"]).alias("max"), F.coalesce(j["currency"], F.lit("VND")).alias("currency")))
    refs = F.coalesce(j["article_refs"], F.array().cast("array<struct<document:string,article:string>>"))
    return F.struct(F.when(kind.isin(*kinds), kind).otherwise(default).alias("answer_type"), amount.alias("amount"), date.alias("effective_date"), refs.alias("article_refs"))
