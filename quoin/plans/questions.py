"""Q: questions about statutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import questions as Q
from quoin.functions import vocabulary as V
from quoin.plans.fixtures import duck, fixture, table
from quoin.plans.registry import query



def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(p)})" for p in phrases) + ")"


def any_match(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {lit(p)})" for p in patterns) + ")"


def first(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {lit(pattern)}, {group}), '')"


Q_ = duck("legal_queries")
LOW = "lower(text)"
LAW_PARTS = [first(LOW, V.LAW_NUMBER, g) for g in (1, 2, 3)]
REF = f"nullif(concat_ws('/', {LAW_PARTS[0]}, {LAW_PARTS[1]}, upper({LAW_PARTS[2]})), '') AS law, {first(LOW, V.ARTICLE)} AS article, coalesce({first(LOW, V.CLAUSE)}, {first(LOW, V.CLAUSE_SHORT)}) AS clause, {first(LOW, V.POINT)} AS point"
R_ = Q_ + f", r AS (SELECT query_id, text, {REF} FROM legal_queries) "
INTENT = f"""CASE WHEN {any_match(LOW, V.COMPARISON_CUES)} THEN 'comparison' WHEN point IS NOT NULL OR (clause IS NOT NULL AND article IS NOT NULL) THEN 'lookup_exact'
  WHEN article IS NOT NULL AND clause IS NULL THEN 'lookup_article' WHEN coalesce(law, article, clause, point) IS NULL AND {any_match(LOW, V.DEFINITION_CUES)} THEN 'definition'
  WHEN {any_match(LOW, V.QUESTION_CUES)} OR coalesce(law, article, clause, point) IS NULL THEN 'semantic_question' ELSE 'lookup_article' END"""


def _ref(spark, sf):
    return fixture(spark, sf, "legal_queries").withColumn("r", Q.legal_reference(F.col("text")))


@query("Q01", R_ + "SELECT query_id, law, article, clause, point FROM r")
def q01(spark, sf):
    return _ref(spark, sf).select("query_id", "r.*")


_NORM = "text"
for _p, _f in ((r"[Đđ]iều\s+(?:số\s+)?([0-9]+)", r"Điều \1"), (r"[Kk]hoản\s+([0-9]+)", r"Khoản \1"), (r"[Đđ]iểm\s+([a-zđ])", r"Điểm \1"), (r"\s+", " ")):
    _NORM = f"regexp_replace({_NORM}, {lit(_p)}, {lit(_f)}, 'g')"


@query("Q02", Q_ + f"SELECT query_id, trim({_NORM}) AS normalized FROM legal_queries")
def q02(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", Q.normalized_query(F.col("text")).alias("normalized"))


_KEY = LOW
for _p in (V.LAW_NUMBER, V.ARTICLE, V.CLAUSE, V.POINT):
    _KEY = f"regexp_replace({_KEY}, {lit(_p)}, '', 'g')"
_KEY = rf"list_filter(string_split(trim(regexp_replace({_KEY}, '\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ({', '.join(map(lit, V.FILLER))}) AND NOT regexp_matches(w, '^[0-9]+$'))"


@query("Q03", Q_ + f"SELECT query_id, array_to_string({_KEY}, '|') AS keywords FROM legal_queries")
def q03(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", F.array_join(Q.legal_keywords(F.col("text")), "|").alias("keywords"))


@query("Q04", R_ + f"SELECT query_id, {INTENT} AS intent FROM r")
def q04(spark, sf):
    return _ref(spark, sf).select("query_id", Q.legal_intent(F.col("text"), F.col("r")).alias("intent"))


_SUM = "50 + CASE WHEN law IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN article IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN clause IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN point IS NOT NULL THEN 10 ELSE 0 END"


@query("Q05", R_ + f"SELECT query_id, least({_SUM} + CASE WHEN {INTENT} = 'lookup_exact' THEN 10 ELSE 0 END, 100) / 100 AS confidence FROM r")
def q05(spark, sf):
    return _ref(spark, sf).select("query_id", Q.parse_confidence(F.col("r"), Q.legal_intent(F.col("text"), F.col("r"))).alias("confidence"))


@query("Q06", R_ + "SELECT query_id, concat_ws('; ', CASE WHEN point IS NOT NULL AND clause IS NULL THEN 'point without clause' END, CASE WHEN clause IS NOT NULL AND article IS NULL THEN 'clause without article' END) AS warnings FROM r")
def q06(spark, sf):
    return _ref(spark, sf).select("query_id", F.array_join(Q.reference_warnings(F.col("r")), "; ").alias("warnings"))


_SIMPLE = f"CASE WHEN {any_of(LOW, V.IDENTITY)} THEN 'identity' WHEN " + " OR ".join(f"trim({LOW}) = {lit(p)} OR starts_with(trim({LOW}), {lit(p + ' ')})" for p in V.SOCIAL) + " THEN 'social' END"
_INTENT = f"CASE WHEN {any_of(LOW, V.GREETING)} THEN 'social_greeting' WHEN {any_of(LOW, V.COMPARATIVE)} THEN 'comparative' WHEN {any_of(LOW, V.PROCEDURAL)} THEN 'procedural' ELSE 'informational' END"


@query("Q07", Q_ + f"SELECT query_id, {_SIMPLE} AS simple, {_INTENT} AS intent FROM legal_queries")
def q07(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", Q.simple_query(F.col("text")).alias("simple"), Q.intent(F.col("text")).alias("intent"))


_SCORE = f"""CASE WHEN {any_of(LOW, V.TRIVIAL)} THEN 1.0::DOUBLE ELSE greatest(0.0, least(10.0, 5.0::DOUBLE + CASE WHEN length(text) < 20 THEN -2.0 WHEN length(text) < 40 THEN -1.0 ELSE 0 END
  + CASE WHEN {any_of(LOW, V.COMPLEX)} THEN 2.5 ELSE 0 END + CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN 1.0 ELSE 0 END + CASE WHEN length(text) > 100 THEN 1.5 WHEN length(text) > 60 THEN 0.5 ELSE 0 END)) END"""
S_ = Q_ + f", s AS (SELECT *, {_SCORE} AS score, {_SIMPLE} AS simple FROM legal_queries), l AS (SELECT *, CASE WHEN score <= 3.5 THEN 'simple' WHEN score >= 6.5 THEN 'complex' ELSE 'medium' END AS label FROM s) "


@query("Q08", S_ + "SELECT query_id, score, label FROM l")
def q08(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", Q.complexity_score(F.col("text")).alias("score")).withColumn("label", Q.complexity(F.col("score")))


_NEEDS = f"({any_of(LOW, V.RELATIONSHIP + V.REGULATION + V.REGULATION_QUESTION)} OR regexp_matches({LOW}, 'điều\\s+[0-9]+'))"


@query("Q09", Q_ + f"SELECT query_id, {_NEEDS} AS needs_graph FROM legal_queries")
def q09(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", Q.needs_graph(F.col("text")).alias("needs_graph"))


@query("Q10", Q_ + f"SELECT query_id, CASE WHEN {any_match(LOW, V.MULTI_HOP)} THEN 'multi_hop' WHEN {any_match(LOW, V.RELATION_SCAN)} THEN 'local' WHEN {any_match(LOW, V.GLOBAL)} THEN 'global' ELSE 'local' END AS graph_type FROM legal_queries")
def q10(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", Q.graph_query_type(F.col("text")).alias("graph_type"))


_EXP = LOW
for _s, _f in V.ABBREVIATIONS:
    _EXP = f"regexp_replace({_EXP}, '(^|[^a-zà-ỹđ]){_s}($|[^a-zà-ỹđ])', '\\1{_f}\\2', 'g')"


@query("Q11", Q_ + f", e AS (SELECT query_id, text, {_EXP} AS t FROM legal_queries) SELECT query_id, 0 AS variant_no, text AS variant FROM e UNION ALL SELECT query_id, 1, t FROM e WHERE t <> lower(text) AND t <> text")
def q11(spark, sf):
    variants = fixture(spark, sf, "legal_queries").select("query_id", Q.query_variants(F.col("text")).alias("v"))
    # outer: for the inner form Spark would make them once more, to ask whether there are any
    return variants.select("query_id", F.posexplode_outer("v").alias("variant_no", "variant")).where("variant_no IS NOT NULL")


_WORDS = rf"list_filter(list_transform(string_split(trim(regexp_replace(translate({LOW}, ',.', '  '), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[?!.,;:]+|[?!.,;:]+$', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(lit, V.KEYWORD_STOP))}))[1:10]"


@query("Q12", Q_ + f"SELECT query_id, array_to_string({_WORDS}, '|') AS keywords FROM legal_queries")
def q12(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", F.array_join(Q.keywords(F.col("text")), "|").alias("keywords"))


def _named(table) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {any_of(LOW, p)} THEN {lit(n)} END" for n, p in table) + ")"


def _all(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({LOW}, {lit(pattern)}, {group})"


_YEARS = f"list_concat(list_concat({_all(r'năm\s*([0-9]{4})')}, {_all(r'số\s*[0-9]+/([0-9]{4})')}), list_concat({_all(r'([0-9]{4})\s*[-–]\s*[0-9]{4}')}, {_all(r'\b(20[0-9]{2})\b')}))"
_REFS = f"list_concat(list_concat({_all(r'điều\s*[0-9]+', 0)}, {_all(r'khoản\s*[0-9]+', 0)}), {_all(r'nghị định\s*(?:số\s*)?[0-9]+', 0)})"


@query("Q13", Q_ + f"SELECT query_id, {_named(V.DOMAINS)} AS domains, {_named(V.DOC_TYPES)} AS doc_types, array_to_string(list_sort(list_distinct(list_filter({_YEARS}, lambda y: y::INT BETWEEN 1945 AND 2100))), '|') AS years, array_to_string(list_sort(list_distinct({_REFS})), '|') AS refs FROM legal_queries")
def q13(spark, sf):
    out = fixture(spark, sf, "legal_queries").select("query_id", Q.filters(F.col("text")).alias("f"))
    joined = lambda c, s: F.array_join(F.array_sort(F.col(f"f.{c}").cast("array<string>")) if s else F.col(f"f.{c}"), "|").alias(c)
    return out.select("query_id", joined("domains", False), joined("doc_types", False), joined("years", True), joined("refs", True))


@query("Q15", Q_ + f"SELECT query_id, CASE WHEN {any_of(LOW, V.ANSWER_PROCEDURAL)} THEN 'procedural' WHEN {any_of(LOW, V.ANSWER_COMPARATIVE)} THEN 'comparative' ELSE 'informative' END AS answer_type FROM legal_queries")
def q15(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", Q.answer_type(F.col("text")).alias("answer_type"))


@query("Q16", S_ + f"""SELECT query_id, CASE WHEN label = 'simple' THEN 0 WHEN label = 'complex' AND score > 7 THEN 10 WHEN label = 'complex' THEN 8 ELSE 5 END AS k, label = 'complex' AS hybrid,
  label = 'complex' AND score > 7 AS rerank, CASE label WHEN 'simple' THEN 'direct_response' WHEN 'complex' THEN 'advanced_rag' ELSE 'standard_rag' END AS strategy,
  label <> 'simple' AND (label = 'complex' OR {_NEEDS} OR {_INTENT} = 'comparative') AS use_graph FROM l""")
def q16(spark, sf):
    return fixture(spark, sf, "legal_queries").select("query_id", Q.retrieval_plan(F.col("text")).alias("p")).select("query_id", "p.*")


@query("Q17", S_ + "SELECT query_id, label = 'complex' OR score >= 6.5 AS iterate, CASE WHEN label = 'complex' AND score >= 7 THEN 3 WHEN label = 'complex' THEN 2 ELSE 1 END AS rounds FROM l")
def q17(spark, sf):
    out = fixture(spark, sf, "legal_queries").withColumn("score", Q.complexity_score(F.col("text")))
    return out.select("query_id", Q.iteration_plan(Q.complexity(F.col("score")), F.col("score")).alias("p")).select("query_id", "p.*")


_ROUTES = ("graph_traversal", "vector_search", "hybrid_search", "legal_trace")


@query("Q18", "SELECT event_id, route, route IN ('graph_traversal', 'legal_trace', 'hybrid_search') AS graph, route IN ('vector_search', 'hybrid_search') AS vector FROM (SELECT event_id, ['graph_traversal', 'vector_search', 'hybrid_search', 'legal_trace'][event_id % 4 + 1] AS route FROM events)")
def q18(spark, sf):
    route = F.element_at(F.array(*map(F.lit, _ROUTES)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", route.alias("route")).withColumn("s", Q.store_route(F.col("route"))).select("event_id", "route", "s.*")
