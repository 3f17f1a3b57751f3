"""Understanding questions: columns over a table of queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions import vocabulary as V


def has_any(text: Column, phrases) -> Column:
    """Whether a text contains one of some phrases."""
    return text.rlike("|".join(re.escape(p) for p in phrases))


def matches_any(text: Column, patterns) -> Column:
    return reduce(lambda a, p: a | text.rlike(p), patterns, F.lit(False))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def low(text: Column) -> Column:
    return F.lower(text)


def law_reference(text: Column) -> Column:
    t = low(text)
    number, year, issuer = (_found(t, V.LAW_NUMBER, g) for g in (1, 2, 3))
    return F.concat_ws("/", number, year, F.upper(issuer))


def legal_reference(text: Column) -> Column:
    """First law number, article, clause and point named in a question; each null if absent."""
    t = low(text)
    return F.struct(
        F.nullif(law_reference(text), F.lit("")).alias("law"),
        _found(t, V.ARTICLE).alias("article"),
        F.coalesce(_found(t, V.CLAUSE), _found(t, V.CLAUSE_SHORT)).alias("clause"),
        _found(t, V.POINT).alias("point"),
    )


def normalized_query(text: Column) -> Column:
    for pattern, form in ((r"[Đđ]iều\s+(?:số\s+)?([0-9]+)", "Điều $1"), (r"[Kk]hoản\s+([0-9]+)", "Khoản $1"), (r"[Đđ]iểm\s+([a-zđ])", "Điểm $1")):
        text = F.regexp_replace(text, pattern, form)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def legal_keywords(text: Column) -> Column:
    t = low(text)
    for pattern in (V.LAW_NUMBER, V.ARTICLE, V.CLAUSE, V.POINT):
        t = F.regexp_replace(t, pattern, "")
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*V.FILLER) & ~w.rlike("^[0-9]+$"))


def legal_intent(text: Column, ref: Column) -> Column:
    t = low(text)
    law, article, clause, point = (ref[c].isNotNull() for c in ("law", "article", "clause", "point"))
    none = ~(law | article | clause | point)
    return (
        F.when(matches_any(t, V.COMPARISON_CUES), "comparison")
        .when(point | (clause & article), "lookup_exact")
        .when(article & ~clause, "lookup_article")
        .when(none & matches_any(t, V.DEFINITION_CUES), "definition")
        .when(matches_any(t, V.QUESTION_CUES) | none, "semantic_question")
        .otherwise("lookup_article")
    )


def parse_confidence(ref: Column, intent: Column) -> Column:
    some = lambda c, w: F.when(ref[c].isNotNull(), w).otherwise(0)  # noqa: E731  in hundredths
    total = F.lit(50) + some("law", 15) + some("article", 15) + some("clause", 10) + some("point", 10) + F.when(intent == "lookup_exact", 10).otherwise(0)
    return F.least(total, F.lit(100)) / 100


def reference_warnings(ref: Column) -> Column:
    return F.array_compact(F.array(
        F.when(ref["point"].isNotNull() & ref["clause"].isNull(), "point without clause"),
        F.when(ref["clause"].isNotNull() & ref["article"].isNull(), "clause without article"),
    ))


def simple_query(text: Column) -> Column:
    """identity, social or null for questions that need no retrieval."""
    t = F.trim(low(text))
    social = reduce(lambda a, p: a | (t == p) | t.startswith(p + " "), V.SOCIAL, F.lit(False))
    return F.when(has_any(t, V.IDENTITY), "identity").when(social, "social")


def intent(text: Column) -> Column:
    t = low(text)
    return F.when(has_any(t, V.GREETING), "social_greeting").when(has_any(t, V.COMPARATIVE), "comparative").when(has_any(t, V.PROCEDURAL), "procedural").otherwise("informational")


def complexity_score(text: Column) -> Column:
    t, n = low(text), F.length(text)
    score = F.lit(5.0) + F.when(n < 20, -2.0).when(n < 40, -1.0).otherwise(0.0) + F.when(has_any(t, V.COMPLEX), 2.5).otherwise(0.0)
    score = score + F.when(F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))) > 1, 1.0).otherwise(0.0) + F.when(n > 100, 1.5).when(n > 60, 0.5).otherwise(0.0)
    return F.when(has_any(t, V.TRIVIAL), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


def complexity(score: Column) -> Column:
    return F.when(score <= 3.5, "simple").when(score >= 6.5, "complex").otherwise("medium")


def needs_graph(text: Column) -> Column:
    t = low(text)
    return has_any(t, V.RELATIONSHIP + V.REGULATION + V.REGULATION_QUESTION) | t.rlike(r"điều\s+[0-9]+")


def graph_query_type(text: Column) -> Column:
    t = low(text)
    return F.when(matches_any(t, V.MULTI_HOP), "multi_hop").when(matches_any(t, V.RELATION_SCAN), "local").when(matches_any(t, V.GLOBAL), "global").otherwise("local")


_LETTER = "a-zà-ỹđ"
_SHORT = "|".join(s for s, _ in sorted(V.ABBREVIATIONS, key=lambda a: -len(a[0])))
#: An abbreviation as a whole word, and two equal ones with one character between.
_ABBREVIATED, _TWICE = rf"(?<![{_LETTER}])(?:{_SHORT})(?![{_LETTER}])", rf"(?<![{_LETTER}])({_SHORT})[^{_LETTER}]\1(?![{_LETTER}])"


def expand_abbreviations(text: Column) -> Column:
    """The text in lower case with abbreviations, as whole words, written out. Of equal ones with one character between
    every other stays: a word takes the characters around it.

    Words that stand alone are looked up, in one pass; texts without any are left, and those with such neighbours
    are gone through abbreviation by abbreviation.
    """
    t = each = low(text)
    for short, full in V.ABBREVIATIONS:
        each = F.regexp_replace(each, rf"(^|[^{_LETTER}]){short}($|[^{_LETTER}])", f"$1{full}$2")
    written = F.create_map(*[F.lit(x) for pair in V.ABBREVIATIONS for x in pair])
    pieces = F.regexp_extract_all(t, F.lit(rf"[{_LETTER}]+|[^{_LETTER}]+"), F.lit(0))
    once = F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(written, w), w)), "")
    return F.when(~t.rlike(_ABBREVIATED), t).when(t.rlike(_TWICE), each).otherwise(once)


def query_variants(text: Column, most: int = 3) -> Column:
    expanded = expand_abbreviations(text)
    both = F.get(F.transform(F.array(expanded), lambda t: F.array(text, F.when(t != low(text), t))), 0)
    return F.slice(F.array_distinct(F.array_compact(both)), 1, most)


def keywords(text: Column, most: int = 10) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.translate(low(text), ",.", "  "), r"\s+", " ")), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[?!.,;:]+|[?!.,;:]+$", ""))
    return F.slice(F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(*V.KEYWORD_STOP)), 1, most)


def filters(text: Column) -> Column:
    """Domains, document types, years and references that a question names."""
    t = low(text)
    named = lambda table: F.array_compact(F.array(*[F.when(has_any(t, phrases), name) for name, phrases in table]))
    years = F.concat(F.regexp_extract_all(t, F.lit(r"năm\s*([0-9]{4})"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"số\s*[0-9]+/([0-9]{4})"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"([0-9]{4})\s*[-–]\s*[0-9]{4}"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)))
    years = F.array_distinct(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y.between(1945, 2100)))
    refs = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (r"điều\s*[0-9]+", r"khoản\s*[0-9]+", r"nghị định\s*(?:số\s*)?[0-9]+")])
    return F.struct(named(V.DOMAINS).alias("domains"), named(V.DOC_TYPES).alias("doc_types"), years.alias("years"), F.array_distinct(F.transform(refs, lambda r: F.trim(r))).alias("refs"))


def answer_type(text: Column) -> Column:
    t = low(text)
    return F.when(has_any(t, V.ANSWER_PROCEDURAL), "procedural").when(has_any(t, V.ANSWER_COMPARATIVE), "comparative").otherwise("informative")


def retrieval_plan(text: Column) -> Column:
    """k, flags and strategy of a question from its complexity; simple questions are answered directly."""
    score = complexity_score(text)
    label = complexity(score)
    hard = label == "complex"
    return F.struct(
        F.when(label == "simple", 0).when(hard & (score > 7), 10).when(hard, 8).otherwise(5).alias("k"),
        hard.alias("hybrid"),
        (hard & (score > 7)).alias("rerank"),
        F.when(label == "simple", "direct_response").when(hard, "advanced_rag").otherwise("standard_rag").alias("strategy"),
        ((label != "simple") & (hard | needs_graph(text) | (intent(text) == "comparative"))).alias("use_graph"),
    )


def iteration_plan(label: Column, score: Column, threshold: float = 6.5) -> Column:
    """Whether retrieval and reasoning alternate, and in how many rounds at most."""
    rounds = F.when((label == "complex") & (score >= 7), 3).when(label == "complex", 2).otherwise(1)
    return F.struct(((label == "complex") | (score >= threshold)).alias("iterate"), rounds.alias("rounds"))


def store_route(route: Column) -> Column:
    return F.struct(route.isin("graph_traversal", "legal_trace", "hybrid_search").alias("graph"), route.isin("vector_search", "hybrid_search").alias("vector"))
