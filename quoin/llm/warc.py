"""WARC derivatives: metadata and plain-text conversion records from response records."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import read

FETCHED = "2024-01-01T00:00:00Z"
#: Elements whose content is not text, and elements that begin a new line.
SILENT = ("script", "style", "noscript", "template")
LINES = "p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|article|section|header|footer|nav|main|aside|title|blockquote|pre|hr|form|body|head|html"
#: Code points of the named character references of HTML 4, and ``apos``; a no-break space is a space.
NAMED = name2codepoint | {"apos": ord("'"), "nbsp": ord(" ")}
#: What may stand between & and ; of a reference, and the destination of a link in the three ways to write it.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`]+)"""


def urn(*parts: Column) -> Column:
    """A record id that the same parts give again."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records ``(page_id, record_id, target_uri, warc_date, payload_digest, block)`` of fetched pages.

    Null html is an empty body, a null url a null target.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", urn(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(FETCHED).alias("warc_date"), digest(body).alias("payload_digest"), F.concat(head, body).alias("block"))


def decoded(text: Column) -> Column:
    """Decodes ``&name;``, ``&#n;`` and ``&#xh;`` once, from left to right; unknown names and invalid code points stay."""
    points = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])
    number = lambda n: F.when(n.rlike("^#[xX]"), F.conv(F.substr(n, F.lit(3)), 16, 10).cast("int")).when(n.startswith("#"), F.substr(n, F.lit(2)).cast("int")).when(n != "", F.try_element_at(points, n))
    valid = lambda n: F.coalesce(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.lit(False))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    parts = F.split(text, "&")
    named = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, REFERENCE, 1).alias("name")))
    known = F.transform(named, lambda s: F.struct(s["p"].alias("p"), s["name"].alias("name"), number(s["name"]).alias("n")))
    pieces = F.transform(known, lambda s: F.when(valid(s["n"]), F.concat(char(s["n"]), F.substr(s["p"], F.length(s["name"]) + 2))).otherwise(F.concat(F.lit("&"), s["p"])))
    return F.when(F.instr(text, "&") > 0, F.concat(F.get(parts, 0), F.array_join(pieces, ""))).otherwise(text)


def _untagged(html: Column) -> Column:
    """No comments, scripts or tags; a newline where a block begins or ends."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?is)<({'|'.join(SILENT)})\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"[\t\r\n\f]+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{LINES})\b[^>]*>", "\n")
    return F.regexp_replace(t, r"<[a-zA-Z/!?][^>]*>", "")


def _tidy(text: Column) -> Column:
    """One space or newline at a time, none at the ends."""
    text = F.regexp_replace(text, r" [ \t\r\f]+|[\t\r\f][ \t\r\f]*", " ")
    text = F.regexp_replace(text, r" \n[ \n]*|\n[ \n]+", "\n")
    return F.trim(text, F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """The text of an HTML document: no comments, scripts or styles, one line a block, references decoded."""
    return _tidy(decoded(_untagged(html)))


#: Columns of a derivative; of the source record, these and its block do not stay under their names.
MADE = ("warc_type", "record_id", "refers_to", "source_digest", "source_headers", "content_type", "content_length", "block_digest", "block")


def derivatives(records: DataFrame) -> DataFrame:
    """Two linked records of each response record ``(record_id, target_uri, warc_date, payload_digest, block, ..)``.

    ``metadata`` (application/warc-fields: title, status, type, outlinks) and ``conversion`` (text/plain), each
    with ``refers_to`` the response's id, its target, date, HTTP headers and payload digest, and digest
    and length of its own block. Other columns stay; one that has a name of MADE comes with ``_`` after it, as often
    as makes it new. A null block is an empty message; a block without an empty line is all headers.
    """
    rest, taken = [], {c.lower() for c in (*MADE, *records.columns)} - {"payload_digest"}
    for c in records.columns:
        if c in ("record_id", "block", "payload_digest"):
            continue
        name = c
        while c.lower() in MADE and name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        rest.append((c, name))
    block = F.coalesce(F.col("block"), F.lit(""))
    cut = F.instr(block, "\r\n\r\n")
    head = F.when(cut > 0, F.substr(block, F.lit(1), cut - 1)).otherwise(block)
    body = F.when(cut > 0, F.substr(block, cut + 4)).otherwise("")
    row = F.struct(F.lit(0), *[F.col(f"`{c}`").alias(name) for c, name in rest])
    r = records.select(row.alias("row"), "record_id", F.col("payload_digest").alias("source_digest"), head.alias("source_headers"), body.alias("body"))
    raw = F.transform(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    r = r.withColumn("title", F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title", 1)).withColumn("links", raw)  # each searched for once
    r = r.withColumn("untagged", _untagged(F.col("body"))).withColumn("decoded", decoded(F.col("untagged"))).withColumn("text", _tidy(F.col("decoded")))
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    title = clean(decoded(F.col("title")))
    status = F.regexp_extract("source_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    kind = clean(F.regexp_extract("source_headers", r"(?i)\ncontent-type: *([^\r\n]*)", 1))
    links = F.transform("links", lambda x: clean(decoded(x)))
    lines = F.concat(F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("http-status: "), status), F.concat(F.lit("source-content-type: "), kind)), F.transform(links, lambda x: F.concat(F.lit("outlink: "), x)))
    fields = F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n"))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    r = r.withColumn("made", F.explode(made))
    return r.select(
        *[F.col(f"row.`{name}`") for _, name in rest],
        F.col("made.warc_type").alias("warc_type"),
        urn(F.col("made.warc_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "source_digest",
        "source_headers",
        F.col("made.content_type").alias("content_type"),
        F.octet_length("made.block").cast("long").alias("content_length"),
        digest(F.col("made.block")).alias("block_digest"),
        F.col("made.block").alias("block"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """Adds ``warc``: the whole record as it stands in a WARC/1.1 file. HTTP headers go in as X-Source-Header lines."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))  # noqa: E731  null: no line
    headers = F.concat_ws("\r\n", F.lit("WARC/1.1"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")), line("X-Source-Payload-Digest", F.col("source_digest")), F.array_join(F.transform(F.split("source_headers", "\r\n"), lambda x: F.concat(F.lit("X-Source-Header: "), x)), "\r\n"), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length")))
    return records.withColumn("warc", F.concat(headers, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")))


def parsed(warc: Column) -> Column:
    """The fields of a serialised record as a struct."""
    get = lambda name: F.nullif(F.regexp_extract(F.substring_index(warc, "\r\n\r\n", 1), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "block_digest": "WARC-Block-Digest", "source_digest": "X-Source-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
    block = F.substr(warc, F.instr(warc, "\r\n\r\n") + 4)
    return F.struct(*[get(n).alias(c) for c, n in names.items()], F.regexp_replace(block, r"\r\n\r\n$", "").alias("block"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(read(spark, sf_dir, "pages").select("page_id", "url", "html"))).drop("block")


def _sql_text(t: str) -> str:
    t = rf"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    for tag in SILENT:
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    t = rf"regexp_replace({t}, '[ \t\r\n\f]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{LINES})\b[^>]*>', chr(10), 'g')"
    t = rf"regexp_replace({t}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    return t


def _sql_rest(t: str) -> str:
    t = rf"regexp_replace({t}, '[ \t\r\f]+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"


def _sql_decoded(t: str) -> str:
    name = f"regexp_extract(p, '{REFERENCE}', 1)"
    points = ", ".join(f"'{k}': {v}" for k, v in sorted(NAMED.items()))
    n = f"CASE WHEN {name} ILIKE '#x%' THEN ('0x' || {name}[3:])::INT WHEN {name} LIKE '#%' THEN {name}[2:]::INT WHEN {name} <> '' THEN map_extract_value(MAP {{{points}}}, {name}) END"
    return f"string_split({t}, '&')[1] || array_to_string(list_transform(string_split({t}, '&')[2:], lambda p: CASE WHEN coalesce(({n}) BETWEEN 1 AND 55295 OR ({n}) BETWEEN 57344 AND 1114111, false) THEN chr({n}) || p[length({name}) + 2:] ELSE '&' || p END), '')"


_URN = "'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
OP2_SQL = rf"""
WITH r AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS body, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS h FROM pages),
i AS (SELECT *, {_URN.format(h="h")} AS refers_to, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) AS source_headers FROM r),
t AS (SELECT *, {_sql_text("body")} AS t FROM i),
c AS (SELECT *, {_sql_decoded("t")} AS u FROM t),
m AS (SELECT page_id, target_uri, refers_to, source_headers, 'sha256:' || sha256(body) AS source_digest, 'conversion' AS warc_type, 'text/plain; charset=utf-8' AS content_type, {_sql_rest("u")} AS block FROM c
  UNION ALL SELECT page_id, target_uri, refers_to, source_headers, 'sha256:' || sha256(body), 'metadata', 'application/warc-fields',
    array_to_string(list_concat(['title: ' || trim(regexp_replace({_sql_decoded("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1)")}, '\s+', ' ', 'g')), 'http-status: 200', 'source-content-type: text/html; charset=utf-8'],
      list_transform(regexp_extract_all(body, '{LINK.replace("'", "''")}', 1), lambda x: 'outlink: ' || trim(regexp_replace({_sql_decoded("regexp_replace(x, '^[" + chr(34) + "'']|[" + chr(34) + "'']$', '', 'g')")}, '\s+', ' ', 'g')))), chr(13) || chr(10)) || chr(13) || chr(10) FROM i),
k AS (SELECT *, md5(warc_type || '|' || refers_to) AS h FROM m)
SELECT page_id, target_uri, '{FETCHED}' AS warc_date, warc_type, {_URN.format(h="h")} AS record_id, refers_to, source_digest, source_headers, content_type,
  strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM k
"""
