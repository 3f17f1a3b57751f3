"""Normalising statute text and the identifiers in it."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions import vocabulary as V


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no function of its own for it."""

    def normalized(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return F.pandas_udf(normalized, "string")(text)


def normalize_text(text: Column) -> Column:
    """F01. NFC, without boilerplate lines, blank lines and spaces squeezed."""
    t = reduce(lambda a, p: F.regexp_replace(a, f"(?imu){p}", ""), V.BOILERPLATE, nfc(text))
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), " +", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def law_id(file_name: Column, text: Column) -> Column:
    """F02. number/year[/issuer] from the file name, else from the first 30 lines, else UNKNOWN."""
    part = lambda t, g: F.nullif(F.regexp_extract(t, f"(?iu){V.LAW_ID}", g), F.lit(""))
    joined = lambda t: F.nullif(F.concat_ws("/", *[part(t, g) for g in (1, 2, 3)]), F.lit(""))
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 30), "\n")
    return F.coalesce(joined(file_name), joined(head), F.lit("UNKNOWN"))


def law_name(text: Column) -> Column:
    """F03. The first of 50 lines that begins with a document word, in its canonical form."""
    named = lambda line: reduce(lambda a, n: a.when(F.lower(line).rlike(n[0]), F.concat(F.lit(n[1] + " "), F.trim(F.regexp_extract(line, f"(?iu){n[0]}", 1)))), V.LAW_NAMES, F.when(F.lit(False), ""))
    found = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 50), lambda x: named(F.trim(x))), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit("Unknown Document"))


def doc_kind(law: Column, text: Column) -> Column:
    """F04. From the law id, else from the first 2000 characters, else LAW."""
    up, head = F.upper(law), F.lower(F.substring(text, 1, 2000))
    kind = F.when(up.contains("QH"), "LAW").when(up.rlike("NĐ-CP|ND-CP"), "DECREE").when(up.contains("TT-"), "CIRCULAR")
    return reduce(lambda a, k: a.when(head.rlike(k[1]), k[0]), V.DOC_KINDS, kind).otherwise("LAW")


def count_tokens(text: Column, tenths: int = 15) -> Column:
    """F05. Words times a factor, rounded down."""
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != ""))
    return F.floor(words * tenths / 10).cast("int")


LEVELS = (("CHUONG", "chapter_id"), ("MUC", "section_id"), ("DIEU", "article_no"), ("KHOAN", "clause_no"), ("DIEM", "point_no"))


def _path(first: list[Column], sep: str) -> Column:
    return F.concat_ws(sep, *first, *[F.concat(F.lit(f"{level}="), F.col(c)) for level, c in LEVELS])


def embedding_prefix(law: Column, kind: Column) -> Column:
    """F06. Present levels, joined by a bar."""
    return _path([F.concat(F.lit("DOC="), law), F.concat(F.lit("TYPE="), kind)], " | ")


def chunk_id(law: Column, index: Column) -> Column:
    """F07. Colon path of the present levels and eight digits of a hash of path and position."""
    path = _path([F.concat(F.lit("LAW="), law)], ":")
    return F.concat_ws(":", path, F.substring(F.md5(F.concat_ws(":", path, index.cast("string"))), 1, 8))


def document_id(path: Column) -> Column:
    """F08. Stem and eight digits of the path's MD5."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.md5(path), 1, 8))


def fold(text: Column) -> Column:
    """Lower case without Vietnamese marks."""
    return F.translate(F.lower(text), "".join(x for _, x in V.FOLDED), "".join(a * len(x) for a, x in V.FOLDED))


def vi_analyze(text: Column) -> Column:
    """F09. Folded word tokens without stop words."""
    stop = F.array(*[fold(F.lit(w)) for w in V.ANALYZER_STOP])
    return F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def char_spans(text: Column) -> Column:
    """F11. Start, end and text of each sentence longer than 10 characters; one pass with a running offset."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc, s):
        span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(s)).alias("end"), F.trim(s).alias("text"))
        out = F.when(F.length(F.trim(s)) > 10, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(s) + 2).alias("at"), out.alias("out"))

    return F.aggregate(F.split(text, r"\. "), start, step, lambda a: a["out"])


def detect_language(text: Column) -> Column:
    """F13. vi if any Vietnamese letter, else en."""
    return F.when(F.lower(text).rlike(f"[{V.VIETNAMESE}]"), "vi").otherwise("en")


def roman_to_int(text: Column) -> Column:
    """F14. Subtractive numerals up to C; other letters add nothing."""
    value = lambda c: reduce(lambda a, r: a.when(c == r[0], r[1]), (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100)), F.when(F.lit(False), 0)).otherwise(0)
    values = F.transform(F.split(F.upper(text), ""), value)
    return F.aggregate(F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)


def parse_number(text: Column) -> Column:
    return F.coalesce(F.try_to_number(F.when(text.rlike("^[0-9]{1,9}$"), text), F.lit("999999999")).cast("int"), F.lit(0))


def normalize_node_id(node: Column) -> Column:
    """F15. Lower case, without the title behind the number, Roman chapter numbers as digits."""
    t = F.trim(F.lower(node))
    t = F.regexp_replace(t, r"^(chuong)_([ivxlcdm]+|[0-9]+)_.*$", "$1_$2")
    t = F.regexp_replace(t, r"^(dieu)_([0-9]+)_.*$", "$1_$2")
    t = F.regexp_replace(t, r"^(khoan)_([0-9]+)_(dieu)_([0-9]+)_.*$", "$1_$2_$3_$4")
    digits = F.create_map(*[F.lit(str(x)) for r in V.ROMAN for x in r])
    return F.coalesce(F.concat(F.lit("chuong_"), F.try_element_at(digits, F.regexp_extract(t, "^chuong_([ivxlcdm]+)$", 1))), t)


def document_signature(title: Column, file_name: Column) -> Column:
    """F16. The decision's number from its title in several spellings, else from the file name."""
    t = F.lower(title)
    numbers = [F.regexp_extract(t, p, 1) for p in (r"([0-9]+)/qđ-đhcntt", r"([0-9]+)/qd-dhcntt", r"quyết định (?:số )?([0-9]+)", r"qđ[- ]?([0-9]+)")]
    numbers.append(F.regexp_extract(F.lower(file_name), r"([0-9]+)[_-]?qd[_-]?dhcntt", 1))
    return F.concat(F.coalesce(*[F.nullif(n, F.lit("")) for n in numbers]), F.lit("/QĐ-ĐHCNTT"))


def is_amendment(*texts: Column, pattern: str = V.AMENDING) -> Column:
    """F17."""
    return F.lower(F.concat_ws(" ", *texts)).rlike(pattern)


def truncation_pattern(text: Column) -> Column:
    """F18. The first pattern of texts cut within a sentence that holds; null if none."""
    return reduce(lambda a, p: a.when(text.rlike(p), p), V.TRUNCATED, F.when(F.lit(False), ""))


def chapter_intro(full_text: Column, title: Column) -> Column:
    """F19. What stands before the first article; the title if that is short; 500 characters at most."""
    at = F.regexp_instr(full_text, F.lit(r"Điều\s+[0-9]+"))
    intro = F.trim(F.substr(full_text, F.lit(1), at - 1))
    intro = F.when(F.length(intro) < 50, title).otherwise(intro)
    return F.when(at == 0, full_text).otherwise(F.when(F.length(intro) > 500, F.concat(F.substring(intro, 1, 500), F.lit("..."))).otherwise(intro))


def normalize_entity(text: Column) -> Column:
    """F20."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[.,;:!?]+|[.,;:!?]+$", ""))


def clean_entity_id(value: Column) -> Column:
    """F21. Without a known prefix, brackets and outer underscores."""
    bare = reduce(lambda a, p: a.when(value.startswith(p), F.substr(value, F.lit(len(p) + 1))), V.ID_PREFIXES, F.when(F.lit(False), "")).otherwise(value)
    return F.regexp_replace(F.translate(bare, "()", ""), "^_+|_+$", "")


def estimate_pages(text: Column) -> Column:
    """F24."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3000)).cast("int")


def citation_short(point: Column, clause: Column, article: Column, law: Column, chunk: Column) -> Column:
    """F25. Point, clause, article and law as far as known, else the chunk's id."""
    some = lambda word, c: F.concat(F.lit(word + " "), F.nullif(c, F.lit("")))
    article = F.when(article.startswith("Điều"), article).otherwise(some("Điều", article))
    return F.coalesce(F.nullif(F.concat_ws(" ", some("Điểm", point), some("Khoản", clause), article, some("Luật", law)), F.lit("")), chunk)


def context_block(parent: Column, previous: Column, text: Column, following: Column) -> Column:
    """F27. Labelled neighbours and text, blank lines between."""
    some = lambda label, c: F.concat(F.lit(f"[{label}]\n"), F.nullif(c, F.lit("")))
    return F.concat_ws("\n\n", some("Parent", parent), some("Previous", previous), text, some("Next", following))
