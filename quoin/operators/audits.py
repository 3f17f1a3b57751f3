"""Extraction cleaned with counts taken on the way; generated queries and answers held against rules."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quoin.functions import legal as L
from quoin.functions import vocabulary as V
from quoin.functions.questions import has_any
from quoin.operators import extraction as X
from quoin.operators.graph import fix_relations
from quoin.operators.retrieval import deduplicate_nodes

PASS, WARN, FAIL = "pass", "warn", "fail"


# ---------------------------------------------------------------- rules
def judged(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds a column a rule (pass, warn or fail; a null condition passes), ``passed``, ``reasons`` and ``warnings`` (rules by name, in order)."""
    rows = rows.withColumns({name: F.coalesce(rule, F.lit(PASS)) for name, rule in rules.items()})
    those = lambda s: F.array_compact(F.array(*[F.when(F.col(n) == s, n) for n in rules]))
    return rows.withColumns({"reasons": those(FAIL), "warnings": those(WARN)}).withColumn("passed", F.size("reasons") == 0)


def _any_of(text: Column, words) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


QUERY_RULES = ("shape", "constraints", "polarity", "validity", "syntax", "read_only", "scope")


def audit_queries(log: DataFrame) -> DataFrame:
    """D05. ``log(query_id, generated, params, answer_type, intent, behaviour, documents, time_reference)`` with seven rules.

    shape: fields that the expected kind of answer needs (amounts fail, truth values and definitions warn).
    constraints: three tenths of the behaviour's words, and one of the documents, by whole name or last word.
    polarity: no label in place of its opposite, for questions about prohibitions and sanctions.
    validity: a filter on what is in force where a time is asked (warns). syntax: reads, returns, closes
    its brackets. read_only: no word that writes. scope: of each document some part of its number.
    Nulls count as empty.
    """
    text = F.coalesce("generated", F.lit(""))
    up, both = F.upper(text), F.lower(F.concat(text, F.lit(" "), F.coalesce("params", F.lit(""))))
    behaviour = F.filter(F.split(F.lower(F.trim(F.coalesce("behaviour", F.lit("")))), r"\s+"), lambda w: w != "")
    found = F.size(F.filter(behaviour, lambda w: F.contains(both, w)))
    documents = F.transform(F.coalesce("documents", F.array().cast("array<string>")), lambda d: F.lower(d))
    named = F.exists(documents, lambda d: F.contains(both, d) | F.contains(both, F.element_at(F.split(F.trim(d), r"\s+"), -1)))
    kind, asks = F.col("answer_type"), F.col("intent")
    opposite = reduce(lambda a, p: a | (F.contains(text, F.lit(p[1])) & ~F.contains(text, F.lit(p[0]))), V.POLARITY, F.lit(False))
    n = lambda c: F.length(text) - F.length(F.translate(text, c, ""))
    unread = F.exists(documents, lambda d: ~F.exists(F.split(d, "/"), lambda f: F.contains(both, f)))
    rules = {
        "shape": F.when((kind == "amount_range") & ~_any_of(up, V.AMOUNT_FIELDS), FAIL).when((kind == "boolean") & ~_any_of(up, V.BOOLEAN_FIELDS), WARN).when((kind == "definition") & ~_any_of(up, V.DEFINITION_FIELDS), WARN),
        "constraints": F.when((found < F.size(behaviour) * 0.3) | ((F.size(documents) > 0) & ~named), FAIL),
        "polarity": F.when(asks.isin("prohibition_check", "sanction_lookup") & opposite, FAIL),
        "validity": F.when(((kind == "temporal") | F.col("time_reference").isNotNull() | (asks == "validity_check")) & ~_any_of(up, V.VALIDITY_FIELDS), WARN),
        "syntax": F.when(~F.contains(up, F.lit("MATCH")) | ~F.contains(up, F.lit("RETURN")) | (n("(") != n(")")) | (n("[") != n("]")), FAIL),
        "read_only": F.when(up.rlike(V.WRITES), FAIL),
        "scope": F.when(unread, FAIL),
    }
    return judged(log, rules)


ANSWER_RULES = ("kind", "required", "scope", "validity", "grounded", "amount")


def audit_answers(answers: DataFrame, specs: DataFrame, evidence: DataFrame) -> DataFrame:
    """D06. Answers held against what was asked and found: ``verdict`` (accepted, regenerate, rejected) and ``confidence``.

    ``answers(question_id, answer_type, amount struct<min,max,currency>, article_refs array<struct<document,article>>,
    boolean_answer, definition_text, list_items, citations, text, evidence_ids, assumptions)``,
    ``specs(question_id, answer_type, documents, required, time_reference, effective_date)``,
    ``evidence(question_id, text)``: any number of records a question, counted before the join.
    required: every field asked for is there. validity: no record says that the rule is out of force.
    grounded: no long answer without records; references have evidence, by numbers of records. One or two
    failures of required and validity alone ask for another answer. Nulls count as empty. One spec a question.
    """
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    found = evidence.groupBy("question_id").agg(F.count("*").alias("n_evidence"), F.bool_or(has_any(F.lower("text"), V.REVOKED)).alias("revoked"))
    asked = specs.select("question_id", F.col("answer_type").alias("asked_type"), "documents", "required", "time_reference", "effective_date")
    rows = answers.join(asked, "question_id").join(found, "question_id", "left").fillna({"n_evidence": 0})
    a = F.col("amount")
    dated = F.exists(F.coalesce("citations", F.array().cast("array<string>")), lambda c: F.lower(c).rlike("hiệu lực|ngày")) | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("hiệu lực"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacks = {"penalty_amount": a.isNull(), "currency": a.isNull() | (F.coalesce(a["currency"], F.lit("")) == ""), "article_ref": empty("article_refs"), "boolean_answer": F.col("boolean_answer").isNull(), "definition_text": blank("definition_text"), "list_items": empty("list_items"), "effective_date": ~dated}
    missing = F.array_compact(F.array(*[F.when(F.array_contains(F.coalesce("required", F.array().cast("array<string>")), f) & no, f) for f, no in lacks.items()]))
    rows = rows.withColumn("missing", missing)
    low = F.transform(F.coalesce("documents", F.array().cast("array<string>")), lambda d: F.lower(d))
    outside = F.exists(F.coalesce("article_refs", F.array().cast(rows.schema["article_refs"].dataType)), lambda r: (F.coalesce(r["document"], F.lit("")) != "") & ~F.exists(low, lambda d: F.contains(F.lower(r["document"]), d) | F.contains(d, F.lower(r["document"]))))
    wrong = F.exists(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda e: ~e.rlike("^[0-9]+$") | (F.expr("0") + F.coalesce(e.try_cast("long"), F.lit(2**62)) >= F.col("n_evidence")))
    rules = {
        "kind": F.when(~F.col("answer_type").eqNullSafe(F.col("asked_type")), WARN),
        "required": F.when(F.size("missing") > 0, FAIL),
        "scope": F.when((F.size(low) > 0) & outside, WARN),
        "validity": F.when((F.col("time_reference").isNotNull() | F.col("effective_date").isNotNull()) & F.col("revoked"), FAIL),
        "grounded": F.when((F.col("n_evidence") == 0) & (F.length("text") > 100) & empty("assumptions"), FAIL).when(~empty("article_refs") & empty("evidence_ids"), WARN).when(wrong, WARN),
        "amount": F.when((F.col("asked_type") == "amount_range") & (a.isNull() | (a["min"].isNull() & a["max"].isNull())), FAIL),
    }
    out = judged(rows, rules)
    soft = (F.size("reasons") <= 2) & (F.size(F.array_except("reasons", F.array(F.lit("required"), F.lit("validity")))) == 0)
    verdict = F.when(F.col("passed"), "accepted").when(soft, "regenerate").otherwise("rejected")
    sure = F.round((len(rules) - F.size("reasons") - F.size("warnings")) / len(rules), 6)
    return out.withColumns({"verdict": verdict, "confidence": sure})


# ---------------------------------------------------------------- cleaning with counts
class Counts:
    """Counts taken while rows pass, one name a step, without a job of their own.

    Spark fills an observation when an action runs the whole step; reading a count before that would
    wait, so ``read`` gives what the actions so far have seen, as a dictionary.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def of(self, rows: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        self.seen[name] = Observation(name)
        return rows.observe(self.seen[name], (F.count("*") if condition is None else F.count_if(condition)).alias("n"))

    def read(self) -> dict[str, int]:
        return {name: self._count(o) for name, o in self.seen.items()}

    @staticmethod
    def _count(observation: Observation) -> int:
        try:
            return observation.get["n"]
        except Py4JJavaError:  # of a table known to be empty Spark plans no rows and no observation
            return 0


def clean_extraction(nodes: DataFrame, relations: DataFrame, changes: DataFrame, documents: DataFrame) -> tuple[dict[str, DataFrame], Counts]:
    """D03. Tables ``nodes, relations, changes, issues`` and the counts of what went in and came out.

    ``nodes(doc_id, id, kind, title, text)``: of those of a document with one kind and id but for case and
    outer blanks the longest stays (A04); relations ``(src, dst, type)`` follow to it and go if an end is
    missing (J05); changes of what no amending document says go (D01); articles with foreign content or
    a cut end are reported (D02, F18). Counts are read once the tables have been written or shown.
    """
    counts = Counts()
    changes_in = counts.of(changes, "changes_in")
    kept_changes = counts.of(X.remove_invalid_changes(changes_in, documents), "changes_out")
    nodes_in = counts.of(nodes, "nodes_in")
    best, renamed = deduplicate_nodes(nodes_in.select("id", "text", "kind", "doc_id"), F.struct("doc_id", "kind", F.lower(F.trim("id")).alias("low")))
    rows = best.select(F.col("key.doc_id").alias("doc_id"), F.col("key.kind").alias("kind"), "id", "text")
    rows = rows.join(nodes.groupBy("doc_id", "kind", "id").agg(F.max("title").alias("title")), ["doc_id", "kind", "id"])
    kept_nodes = counts.of(rows, "nodes_out")
    relations_in = counts.of(relations, "relations_in")
    kept_relations = counts.of(fix_relations(relations_in, renamed.select("old", "new").distinct().where("old != new"), best), "relations_out")
    articles = rows.where("kind = 'article'")
    cut = articles.withColumn("detected", L.truncation_pattern(F.col("text"))).where("detected IS NOT NULL").select("id", F.lit("truncated").alias("kind"), F.lit("").alias("detected"))
    issues = counts.of(X.content_bleeding(articles).unionByName(cut), "issues")
    return {"nodes": kept_nodes, "relations": kept_relations, "changes": kept_changes, "issues": issues}, counts


def post_process(nodes: DataFrame, relations: DataFrame, ranges) -> tuple[dict[str, DataFrame], Counts]:
    """D04. ``nodes(id, kind, title, text)`` and ``relations(src, dst, type)``: cut texts marked (F18), relations of a
    node to itself dropped, chapters of articles set by number (J07), chapters' texts without their articles
    (F19), repeated relations dropped. Tables ``nodes, relations`` and counts of each step, read once both are used.
    """
    counts = Counts()
    marked = nodes.withColumn("truncated", L.truncation_pattern(F.col("text")).isNotNull())
    chapter = F.col("kind") == "chapter"
    intro = L.chapter_intro(F.col("text"), F.col("title"))
    marked = marked.withColumns({"cleaned": chapter & ~intro.eqNullSafe(F.col("text")), "text": F.when(chapter, intro).otherwise(F.col("text"))})
    marked = counts.of(counts.of(marked, "truncated", F.col("truncated")), "chapters_cleaned", F.col("cleaned"))
    others = counts.of(counts.of(relations, "relations_in").where("src != dst"), "not_to_themselves")
    before = Window.partitionBy("src", "dst", "type")
    numbered = others.select("src", "dst", "type", F.col("src").alias("was"), F.row_number().over(before.orderBy("src")).alias("k"))
    fixed = counts.of(X.assign_chapter(numbered, ranges), "chapters_set", ~F.col("src").eqNullSafe(F.col("was")))
    once = counts.of(fixed.select("src", "dst", "type").distinct(), "relations_out")
    return {"nodes": marked.drop("cleaned"), "relations": once}, counts
