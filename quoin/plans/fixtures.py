"""Derived input tables, in SQL that Spark and DuckDB both read; tables stand in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quoin.steps import kept


def _joined(item: str) -> str:
    """The items of a group, by number, with commas between."""
    return "substr(" + " || ".join(f"coalesce(max(CASE WHEN i = {i} THEN ',' || {item} END), '')" for i in range(4)) + ", 2)"


def _escaped(text: str) -> str:
    """A text as it stands in a JSON string."""
    for code, mark in ((92, "chr(92)"), (34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
        text = f"replace({text}, chr({code}), chr(92) || {mark})"
    return text


FIXTURES = {
    # questions about statutes, one an order, in ten spellings
    "legal_queries": """SELECT o_orderkey AS query_id, CASE o_orderkey % 10
        WHEN 0 THEN 'Điểm a Khoản ' || (o_orderkey % 5 + 1) || ' Điều ' || (o_orderkey % 40 + 1) || ' Luật ' || (o_orderkey % 90 + 1) || '/20' || (o_orderkey % 10 + 10) || '/QH15 quy định gì'
        WHEN 1 THEN 'điều số ' || (o_orderkey % 40 + 1) || 'a nói gì về hợp đồng lao động?'
        WHEN 2 THEN 'So sánh Điều ' || (o_orderkey % 40 + 1) || ' và Điều ' || (o_orderkey % 30 + 2)
        WHEN 3 THEN 'Hợp đồng lao động là gì?'
        WHEN 4 THEN 'khoản ' || (o_orderkey % 7 + 1) || '   điều ' || (o_orderkey % 30 + 1) || ' nghị định 15/2020/NĐ-CP'
        WHEN 5 THEN CASE o_orderkey % 3 WHEN 0 THEN 'xin chào' WHEN 1 THEN 'bạn là ai?' ELSE 'cảm ơn nhiều' END
        WHEN 6 THEN 'Quy trình xử phạt vi phạm giao thông năm 20' || (o_orderkey % 20 + 10)
        WHEN 7 THEN 'UBND và HĐND có trách nhiệm như thế nào nếu hành vi vi phạm? Khi nào áp dụng?'
        WHEN 8 THEN 'Liệt kê tất cả điều kiện kinh doanh bất động sản, phân tích các bước và so sánh thông tư ' || (o_orderkey % 60 + 1) || '/2015/TT-BTC với quyết định số ' || (o_orderkey % 9 + 1) || '/2019, điểm b khoản ' || (o_orderkey % 6 + 1)
        ELSE 'cách nộp thuế thu nhập doanh nghiệp theo TT 78/2014, điểm đ' END AS text FROM {orders}""",
    # ranked lists of two sources with ties
    "results": """SELECT l_suppkey % 25 AS query_id, 'c' || l_partkey AS chunk_id, CASE WHEN l_linenumber % 2 = 0 THEN 'vector' ELSE 'bm25' END AS source,
        max(l_quantity) AS score, max(l_partkey % 60) AS doc_id, 'Đoạn ' || max(l_partkey % 97) || ' nội dung ' || max(l_partkey % 11) AS text
        FROM {lineitem} GROUP BY l_suppkey % 25, l_partkey, l_linenumber % 2""",
    "entities": """SELECT p_partkey AS entity_id, p_partkey % 40 AS chunk_no, CASE p_partkey % 4 WHEN 0 THEN 'LUAT' WHEN 1 THEN 'DIEU' WHEN 2 THEN 'KHAI_NIEM' ELSE 'XX' END AS type,
        CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN '  ' || p_type || ' .' ELSE p_type END AS text,
        (p_partkey % 11) / 10.0E0 AS confidence, p_partkey % 100 AS start_pos, p_partkey % 100 + 10 AS end_pos FROM {part}""",
    "job_events": """SELECT user_id AS job_id, event_id AS seq, ts, event_type AS status, CAST(floor(abs(value)) AS BIGINT) % 101 AS percentage,
        CAST(floor(abs(value)) AS BIGINT) % 7 AS chunks, event_id % 5 AS pages FROM {events}""",
    "statute_lines": """SELECT o_custkey AS doc_id, 0 AS chapter, 0 AS article, 0 AS clause, 0 AS sub, 'Cộng hòa xã hội chủ nghĩa Việt Nam' AS line FROM {orders} GROUP BY o_custkey
        UNION ALL SELECT o_custkey, 0, 0, 0, 1, 'LUẬT MẪU ' || o_custkey FROM {orders} GROUP BY o_custkey
        UNION ALL SELECT o_custkey, 0, 0, 0, 2, 'Số: ' || o_custkey || '/' || (2000 + o_custkey % 24) || '/QH15' FROM {orders} GROUP BY o_custkey
        UNION ALL SELECT doc_id, chapter, 0, 0, 0, 'Chương ' || CASE chapter WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' ELSE 'V' END || '. Ưu tiên ' || chapter FROM articles GROUP BY doc_id, chapter
        UNION ALL SELECT doc_id, chapter, article, 0, 0, 'Điều ' || article || CASE WHEN o_orderkey % 7 = 0 THEN '. Giải thích từ ngữ' ELSE '. Đơn hàng ' || o_orderkey END FROM articles
        UNION ALL SELECT doc_id, chapter, article, clause, 0, clause || '. Mặt hàng ' || l_partkey || ' số lượng ' || CAST(l_quantity AS BIGINT) FROM clauses
        UNION ALL SELECT doc_id, chapter, article, clause, 1, 'a) Trạng thái ' || l_returnflag FROM clauses WHERE l_partkey % 3 = 0
        UNION ALL SELECT doc_id, chapter, article, clause, 2, 'b) Dòng ' || l_linestatus FROM clauses WHERE l_partkey % 3 = 0
        UNION ALL SELECT doc_id, chapter, article, clause, 3, 'Ghi chú thêm cho khoản này.' FROM clauses WHERE l_partkey % 5 = 0""",
    "articles": """SELECT o_custkey AS doc_id, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS chapter,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS article FROM {orders}""",
    "clauses": """SELECT doc_id, chapter, article, row_number() OVER (PARTITION BY doc_id, article ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS clause, l_partkey, l_quantity, l_returnflag, l_linestatus
        FROM articles JOIN {lineitem} ON l_orderkey = o_orderkey""",
    "numbered_lines": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, article, clause, sub) AS pos, line FROM statute_lines",
    "nodes": """SELECT 'R' || r_regionkey AS id, 'VUNG' AS label, r_name AS name, '' AS content, CAST(r_regionkey AS BIGINT) AS num FROM {region}
        UNION ALL SELECT 'N' || n_nationkey, 'LUAT', n_name, 'Luật ' || n_name, CAST(n_nationkey AS BIGINT) FROM {nation}
        UNION ALL SELECT 'C' || c_custkey, 'CHUONG', c_name, c_mktsegment, CAST(c_custkey AS BIGINT) FROM {customer}
        UNION ALL SELECT 'O' || o_orderkey, 'DIEU', 'Điều ' || (o_orderkey % 50), o_orderpriority, o_orderkey % 50 FROM {orders}
        UNION ALL SELECT 'P' || p_partkey, 'KHAI_NIEM', p_type, p_brand, p_partkey FROM {part}""",
    "edges": """SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'THUOC_VE' AS type, 1.0E0 AS weight FROM {nation}
        UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'THUOC_VE', 1.0E0 FROM {customer}
        UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'THUOC_VE', 1.0E0 FROM {orders}
        UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, 'MENTIONS', 1.0E0 FROM {lineitem} WHERE l_linenumber = 1
        UNION ALL SELECT src, dst, type, 1.0E0 FROM amendments""",
    "amendments": """SELECT 'O' || o_orderkey AS src, 'O' || prev AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'THAY_THE' WHEN 1 THEN 'SUA_DOI' WHEN 2 THEN 'BO_SUNG' ELSE 'BAI_BO' END AS type, o_orderdate AS effective
        FROM (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}) o WHERE prev IS NOT NULL""",
    # what a model extracted from each four lines of an order
    "reply_items": """SELECT l_orderkey * 100 + CAST(floor(k / 4) AS BIGINT) AS doc_id, l_orderkey % 6 AS style, k % 4 AS i, 'e' || l_partkey || '_' || k AS id,
        CASE l_returnflag WHEN 'A' THEN 'LUAT' WHEN 'R' THEN 'DIEU' ELSE 'KHAI_NIEM' END AS type, 'Mặt ' || chr(123) || 'hàng ' || l_partkey || chr(125) || ', số ' || CAST(l_quantity AS BIGINT) AS text,
        '0.' || l_partkey % 10 AS confidence, 'p' || l_suppkey AS target, l_partkey % 3 = 0 AS related, l_partkey % 5 = 0 AS short, CAST(l_quantity AS BIGINT) AS price
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS k FROM {lineitem}) x""",
    "reply_objects": f"""SELECT doc_id, style, count(*) AS n, chr(123) || '"entities": [' || {_joined("""chr(123) || '"id": "' || id || '", "type": "' || type || '", "text": "' || text || '", "confidence": ' || confidence || chr(125)""")}
        || '], "relations": [' || coalesce({_joined("""CASE WHEN related THEN chr(123) || '"source": "' || id || '", "target": "' || target || '", "type": "REF"' || chr(125) END""")}, '') || ']' AS body FROM reply_items GROUP BY doc_id, style""",
    # replies around these objects: fenced, bare, with a comma too many, with single quotes, without an object
    "replies": """SELECT doc_id, style, n, body || chr(125) AS object, CASE style WHEN 0 THEN 'Kết quả: ```json' || chr(10) || body || chr(125) || chr(10) || '``` xong ' || doc_id WHEN 1 THEN '  ' || body || chr(125) || ' '
        WHEN 2 THEN 'Đây là ' || body || ', ' || chr(125) || ' hết' WHEN 3 THEN replace(body || chr(125), chr(34), chr(39)) WHEN 4 THEN '```' || chr(10) || body || chr(125) || chr(10) || '```'
        ELSE 'không có dữ liệu cho đơn ' || doc_id END AS reply FROM reply_objects""",
    # a pipe table of the same lines, for half of them with a column less, for half a second table
    "piped": f"""SELECT doc_id, style, 'Đoạn ' || doc_id || chr(10) || CASE WHEN style < 3 THEN '| Mã | Tên|Giá |' || chr(10) || '|---|:---|---:|' ELSE '|Mã | Tên |' || chr(10) || '| --- | --- |' END || chr(10)
        || replace({_joined("""'| ' || id || CASE WHEN short THEN ' |' ELSE ' |' || text || CASE WHEN style < 3 THEN ' |  ' || price || ' |' ELSE '|' END END || chr(10)""")}, chr(10) || ',', chr(10))
        || 'hết | không phải bảng' || chr(10) || CASE WHEN style % 2 = 0 THEN '| Ghi chú |' || chr(10) || '|---|' || chr(10) || '| n' || doc_id || ' |' || chr(10) || 'z' ELSE '' END AS text FROM reply_items GROUP BY doc_id, style""",
    "answers": f"""SELECT doc_id, doc_id % 4 AS style, t, {_escaped("t")} AS escaped, coalesce(source, '?') || ' ' || doc_id AS brief
        FROM (SELECT doc_id, source, replace(text, chr(125), ')') AS t FROM {{documents}}) x""",
    "page_nodes": """SELECT doc_id % 50 AS doc_id, CAST(floor(doc_id / 50) AS BIGINT) AS page, 'n' || (doc_id % 7) AS node_id, text AS piece, 'T' || (doc_id % 13) AS title FROM {documents}""",
}
NEEDS = {"reply_objects": ["reply_items"], "replies": ["reply_objects"], "piped": ["reply_items"], "clauses": ["articles"], "statute_lines": ["articles", "clauses"], "numbered_lines": ["articles", "clauses", "statute_lines"], "edges": ["amendments"]}


def _with(*names: str) -> list[str]:
    order: list[str] = []
    for n in names:
        for x in [*_with(*NEEDS.get(n, [])), n]:
            if x not in order:
                order.append(x)
    return order


def duck(*names: str) -> str:
    """The WITH clause that defines fixtures for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', FIXTURES[n])})" for n in _with(*names)) + " "


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame. A step that is read more than once on the way to it is written once: Spark would
    make it again for each reader."""
    steps, made = _with(name), {}
    of = lambda n: rf"\b{n}\b"

    def made_of(last: str) -> DataFrame:
        body = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in _with(last) if n not in made)
        for n in made:
            body = re.sub(of(n), f"{{{n}}}", body)
        tables = set(re.findall(r"\{(\w+)\}", body))
        return spark.sql(f"WITH {body} SELECT * FROM {last}", **{t: made[t] if t in made else table(spark, sf_dir, t) for t in tables})

    for n in steps[:-1]:
        if sum(len(re.findall(of(n), FIXTURES[s])) for s in steps) > 1:
            made[n] = kept(made_of(n))
    return made_of(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
