"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

A line of at least ``MIN_CHARS`` characters is a copy of another if their sets of ``SHINGLE``-character
shingles (trimmed, lower case) have a Jaccard similarity of ``ALIKE`` or more. Of each component of
copies one line stays: the first by doc_id and position. Shorter lines always stay.

Equal lines are gathered first, by 64-bit hash: an aggregation by line that also takes the MinHash
signature, the minimum of each seeded hash over all shingles. Bands of signatures deal the lines into
buckets; all lines of a bucket are candidates. Of the lines that it may
meet first (the first of each of its buckets), each line is compared with the one most alike by signature,
and components are formed; in buckets that stay crowded the lines outside the largest component meet some
of its lines in a few more rounds. At last, in each bucket that still has several components, every line
outside the largest one is compared with all candidates of other components, so no candidate pair is lost:
by a sketch that never refuses a copy, for which a large bucket is dealt into blocks of bounded size. What the
sketch lets through is told apart by exact Jaccard, as all links are; texts are shuffled for such pairs alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import components, discard, read, saved, sieved

MIN_CHARS, SHINGLE, ALIKE = 25, 12, 0.75
#: Bands of two hashes each: 0.993 of the pairs at a similarity of 0.75, 0.9999 at 0.9, share one.
BANDS = 6
#: Lines of a block, and the comparisons above which a bucket has up to ROUNDS more rounds with about HEADS lines to meet.
BLOCK, CROWDED, ROUNDS, HEADS = 512, 4096, 2, 8
#: Of the hashes, those that a line must share to be met before the blocks.
LIKELY = 7
#: 64-bit words of a line's parity sketch.
SKETCH = 16
#: Shingles hashed in one row of the signatures' aggregation.
STRIDE = 4

_SEEDS = [int(x) for x in np.random.RandomState(7).randint(-(2**63), 2**63 - 1, 2 * BANDS, dtype=np.int64)]
_HASHES = [f"m{i}" for i in range(2 * BANDS)]
_PARITIES = [f"p{i}" for i in range(SKETCH)]


_BLANKS = " \t\r\f\u00a0"


def _trimmed(line: Column) -> Column:
    # trim looks at every character, so only lines with a blank at an end are given to it
    ends = [at(line, F.lit(c)) for c in _BLANKS for at in (F.startswith, F.endswith)]
    return F.when(reduce(Column.__or__, ends), F.trim(line, F.lit(_BLANKS))).otherwise(line)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc, pos, line, line_id)`` of the lines that may be copies; a null doc_id counts as the least."""
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.length(_trimmed(F.col("line"))) >= min_chars).withColumn("line", F.lower(_trimmed(F.col("line")))).withColumn("line_id", F.xxhash64("line"))


def _hash(wide: Column, at: Column, shingle: int) -> Column:
    """Hash of the shingle that begins at character ``at`` of a text in UTF-32, four bytes a character."""
    return F.xxhash64(F.substr(wide, at * 4 + 1, F.lit(4 * shingle)))


def _last(wide: Column, shingle: int) -> Column:
    return F.greatest((F.octet_length(wide) / 4).cast("int") - shingle, F.lit(0))


def signatures(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(line_id, first_doc, n, m0, ..)``: each distinct line with its number of occurrences and, for each
    seed, the least of the seeded hashes of its shingles. Lines are aggregated where they are read."""
    wide = lines.select("doc", "line_id", F.encode("line", "UTF-32").alias("wide")).withColumn("last", _last(F.col("wide"), shingle))
    rows = wide.select("doc", "line_id", "wide", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(STRIDE))).alias("at"))
    hashed = rows.select("doc", "line_id", "at", *[_hash(F.col("wide"), F.least(F.col("at") + j, F.col("last")), shingle).alias(f"h{j}") for j in range(STRIDE)])
    least = lambda seed: F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(seed)) for j in range(STRIDE)]))
    first = [F.min("doc").alias("first_doc"), F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("n")]
    return hashed.groupBy("line_id").agg(*first, *[F.shiftright(least(s), 32).cast("int").alias(m) for m, s in zip(_HASHES, _SEEDS)])


def _band(b: int) -> Column:
    return F.xxhash64(F.lit(b), f"m{2 * b}", f"m{2 * b + 1}")


def _bands() -> Column:
    return F.array(*[_band(b) for b in range(BANDS)])


def _first_shared() -> Column:
    """The first of the buckets that two lines share: they are compared there alone."""
    both = lambda b: reduce(Column.__and__, [F.col(f"m{k}") == F.col(f"om{k}") for k in (2 * b, 2 * b + 1)])
    return F.coalesce(*[F.when(both(b), _band(b)) for b in range(BANDS)])


def _shingles(line: Column, shingle: int) -> Column:
    """The distinct hashes of a line's shingles."""
    every = lambda wide: F.transform(F.sequence(F.lit(0), _last(wide, shingle)), lambda i: _hash(wide, i, shingle))
    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "UTF-32")), every), 0))  # the line is encoded once


def _alike(both: Column, a: Column, b: Column, alike: float) -> Column:
    """Whether sets of ``a`` and ``b`` elements that share ``both`` reach the similarity."""
    return both * (1 + alike) >= alike * (a + b)


def _unsettled(rows: DataFrame) -> DataFrame:
    """``(band, line_id, component)`` of the buckets with several components, with their size ``n``, the
    largest component ``main`` and the number of lines outside it, ``others``."""
    by = rows.groupBy("band", "component").agg(F.count("*").alias("n"))
    by = by.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).where("top.n < n")
    return saved(rows.join(by.select("band", F.col("top.component").alias("main"), "n", (F.col("n") - F.col("top.n")).alias("others")), "band"))


def sketches(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(line_id, size, p0, ..)``: the number of distinct shingles of each line, and for each bit whether
    the number of shingles that fall on it is odd."""
    each = lines.select("line_id", F.explode(_shingles(F.col("line"), shingle)).alias("h"))
    each = each.select("line_id", F.pmod(F.shiftright("h", 6), F.lit(SKETCH)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int")).alias("one"))
    return each.groupBy("line_id").agg(F.count("*").alias("size"), *[F.bit_xor(F.when(F.col("word") == k, F.col("one")).otherwise(0)).alias(p) for k, p in enumerate(_PARITIES)])


def _able(alike: float) -> Column:
    """Whether the sets may reach the similarity: a shingle that only one line has changes one bit, so
    sketches differ in no more bits than the sets differ in shingles."""
    bits = sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"o{p}"))) for p in _PARITIES)
    return (F.least("size", "osize") >= alike * F.greatest("size", "osize")) & (bits * (1 + alike) <= (1 - alike) * (F.col("size") + F.col("osize")))


def _same() -> Column:
    return sum(F.when(F.col(m) == F.col(f"o{m}"), 1).otherwise(0) for m in _HASHES)


def similar_lines(docs: DataFrame, distinct: DataFrame, min_chars: int = MIN_CHARS, shingle: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """``(node, component)`` of the lines with copies, by id; a component is named by its smallest line.

    ``distinct`` has the signatures of the lines of ``docs``.
    """
    rows = distinct.select("line_id", F.explode(_bands()).alias("band"))
    firsts = saved(rows.groupBy("band").agg(F.min("line_id").alias("head"), F.max("line_id").alias("last")).where("head < last").select("band", "head"), release=True)
    buckets = saved(sieved(rows, "band", firsts).join(firsts, "band"))
    ids = saved(buckets.select("line_id").distinct())
    # texts and signatures of the lines that share a bucket; the others are alone
    texts = sieved(_lines(docs, min_chars).select("line_id", "line"), "line_id", ids).groupBy("line_id").agg(F.first("line").alias("line"))
    texts = saved(texts.join(ids, "line_id", "left_semi"), release=True)
    signed = saved(sieved(distinct, "line_id", ids).join(ids, "line_id", "left_semi").select("line_id", *_HASHES))
    discard(firsts)
    other = signed.select(F.col("line_id").alias("head"), *[F.col(m).alias(f"o{m}") for m in _HASHES])

    # few bytes, much to compute: by a fixed number of partitions, which are not coalesced by size
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The ``(a, b)`` of ``pairs(line_id, head)`` that are copies. The texts of these pairs alone are shuffled, each
        row's set is made once, where it is compared, and rows are sorted before they hold sets."""
        asked = saved(pairs)
        own = asked.join(sieved(texts, "line_id", asked), "line_id")
        heads = sieved(texts.select(F.col("line_id").alias("head"), "line"), "head", asked)
        placed = lambda rows, name: rows.repartition(tasks, "head").sortWithinPartitions("head").withColumn(name, _shingles(F.col("line"), shingle)).drop("line")
        copies = _alike(F.size(F.array_intersect("hashes", "ohashes")), F.size("hashes"), F.size("ohashes"), alike)
        return placed(own, "hashes").join(placed(heads, "ohashes"), "head").where(copies).select(F.col("line_id").alias("a"), F.col("head").alias("b"))

    def best(pairs: DataFrame) -> DataFrame:
        both = pairs.join(signed, "line_id").join(other, "head").where(_same() >= LIKELY)
        return saved(confirmed(both.select("line_id", "head", _same().alias("same")).groupBy("line_id").agg(F.max_by("head", F.struct("same", "head")).alias("head"))))

    def by_component(rows: DataFrame) -> DataFrame:
        at = rows.select("band", "line_id").join(joined, F.col("line_id") == F.col("node"), "left")
        return _unsettled(at.select("band", "line_id", F.coalesce("component", "line_id").alias("component")))

    def extended(links: DataFrame) -> DataFrame:
        known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return saved(components(known.union(links)))

    joined = saved(components(best(buckets.where("line_id != head").select("line_id", "head"))))
    every = by_component(buckets)
    busy = F.col("n") * F.col("others") > CROWDED
    # the other buckets keep the components of now: lines joined later are compared once more, none less
    calm, crowded = every.where(~busy), every.where(busy)
    for k in range(ROUNDS):
        drawn = F.pmod(F.xxhash64(F.lit(k), "line_id"), F.ceil((F.col("n") - F.col("others")) / HEADS)) == 0
        heads = crowded.where(busy & (F.col("component") == F.col("main")) & drawn).select("band", F.col("line_id").alias("head"))
        links = best(crowded.where(busy & (F.col("component") != F.col("main"))).select("band", "line_id").join(heads, "band").select("line_id", "head"))
        if links.isEmpty():
            break
        joined = extended(links)
        crowded = by_component(crowded)
    # of the lines of one bucket, those of different components have not all met
    rest = calm.union(crowded)
    drawn = saved(sketches(texts.join(rest.select("line_id").distinct(), "line_id", "left_semi"), shingle).join(signed, "line_id"), release=True)
    across, down = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("others") / BLOCK)
    dealt = lambda blocks: F.pmod(F.xxhash64("line_id"), blocks)
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    keys = ["band", "i", "j"]
    placed = rest.join(drawn, "line_id").withColumns({"i": dealt(across), "j": each(down)}).drop("n", "others").repartition(tasks, *keys)
    outside = rest.where("component != main").select("band", "line_id", "component", dealt(down).alias("j"), each(across).alias("i"))
    outside = outside.join(drawn, "line_id").repartition(tasks, *keys)
    outside = outside.select(*keys, *[F.col(c).alias("head" if c == "line_id" else f"o{c}") for c in outside.columns if c not in keys])
    differ = (F.col("component") != F.col("ocomponent")) & ((F.col("component") == F.col("main")) | (F.col("line_id") < F.col("head")))
    pairs = placed.join(outside, keys).where(differ & (F.col("band") == _first_shared()) & _able(alike)).select("line_id", "head")
    return extended(confirmed(pairs))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shingle: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """``(doc, dropped)``: the positions, from 0, of the lines of a document that are copies of lines kept elsewhere."""
    if min_chars < shingle:
        raise ValueError("lines must have a shingle: min_chars >= shingle")
    distinct = saved(signatures(_lines(docs, min_chars), shingle), release=True)
    joined = similar_lines(docs, distinct, min_chars, shingle, alike)
    # the lines with copies, and the document that keeps the first
    known = distinct.select("line_id", "first_doc", "n").join(joined, F.col("line_id") == F.col("node"), "left").where("n > 1 OR node IS NOT NULL")
    known = saved(known.select("line_id", "first_doc", F.coalesce("component", "line_id").alias("component")))
    keepers = known.groupBy("component").agg(F.min("first_doc").alias("keeper"))
    known = saved(known.join(keepers, "component").select("line_id", "component", "keeper"))
    at = sieved(_lines(docs, min_chars).select("doc", "pos", "line_id"), "line_id", known).join(known, "line_id")
    own = at.groupBy("doc", "component").agg(F.min("keeper").alias("keeper"), F.collect_set("pos").alias("pos"))
    gone = F.when(F.col("doc") == F.col("keeper"), F.array_except("pos", F.array(F.array_min("pos")))).otherwise(F.col("pos"))
    return own.select("doc", gone.alias("gone")).where(F.size("gone") > 0).groupBy("doc").agg(F.flatten(F.collect_list("gone")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shingle: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """``(row, text, n_lines, n_dropped, emptied)`` for each row of ``docs`` (as a struct): its text without
    the copies, its number of lines, how many went, and whether no line of ``min_chars`` is left of some.

    Null texts stay null, with 0 lines; a text without newline is one line. Rows that share a doc_id
    are taken as one document: a line in the same place of both counts once. Null doc_ids count as one
    id, before all others. No rows give no rows.
    """
    dropped = saved(dropped_lines(docs, min_chars, shingle, alike), release=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(dropped, F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))) == F.col("doc"), "left")
    lines = F.split("row.text", "\n")
    # rows that share a doc_id may differ in length
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")))
    rows = rows.select("row", "dropped", F.when(F.col("dropped").isNotNull(), lines).alias("lines"), F.coalesce(F.size(lines), F.lit(0)).alias("n"))
    rows = rows.withColumn("kept", F.when(F.col("lines").isNotNull(), F.transform(kept, lambda i: F.get("lines", i))))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n")).cast("long")
    return rows.select(
        "row",
        F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        n.alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce((F.size("kept") < F.size("lines")) & ~F.exists("kept", lambda x: F.length(_trimmed(x)) >= min_chars), F.lit(False)).alias("emptied"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
