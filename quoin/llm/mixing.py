"""Mixing sources to target weights: repetition rates by source, then whole and Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import read, saved, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows; ``share`` is (numerator, denominator).

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets are proportional to the
    weights and add up to ``share`` of all sizes, but none is above ``most`` times its source's size:
    ordered by capacity per weight, the first sources are full, and the others divide what is left.
    Sources are pre-aggregated, so the windows see one row a source. A source of size 0 gets 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight)
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    by = by.withColumns({
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "open": F.sum("weight").over(after),
        "all": F.sum("source_size").over(every),
        "place": F.row_number().over(order),
    })
    # what a unit of weight gets if this source and all after it are below their caps
    by = by.withColumn("unit", (share[0] * F.col("all") - share[1] * most * F.col("full")) / (share[1] * F.col("open")))
    fits = F.col("unit") * F.col("weight") <= most * F.col("source_size")
    first = F.min(F.when(fits, F.col("place"))).over(every)
    unit = F.max(F.when(F.col("place") == first, F.col("unit"))).over(every)
    target = F.when(first.isNull() | (F.col("place") < first), (most * F.col("source_size")).cast("double")).otherwise(unit * F.col("weight"))
    return by.select("source", "source_size", target.alias("target"))


def document_key(doc_id: Column, text: Column) -> Column:
    """What a document draws by: its id and its text, so that rows without an id or with a repeated one draw apart."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a document's key; the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _copies(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """``rows(source, mix_key, ..)`` with ``mix_source_size``, ``mix_target`` and ``mix_copies``, by the sources of ``sizes``.

    Each document is taken floor(rate) times, and once more with probability rate - floor(rate),
    where rate = target / source_size.
    """
    targets = saved(source_targets(sizes, weights, share, most)).select(*[F.col(c).alias(f"mix_{c}") for c in ("source", "source_size", "target")])
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.col("mix_target") / F.col("mix_source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("mix_key"), seed) < rate - F.floor(rate), 1).otherwise(0)
    # one row a source against all documents: below the broadcast threshold the planner broadcasts it, above it splits skewed sources
    return rows.join(targets, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("mix_copies", copies.cast("long"))


def mixing_plan(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)``: how often the mix takes each document.

    Null text has size 0; rows that repeat both id and text share a draw, and no others do, with an id or
    without; extra columns take no part; an empty table gives an empty plan.
    """
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text")).alias("mix_key")))
    return _copies(sizes, sizes, **how).select("doc_id", "source", "size", *[F.col(f"mix_{c}").alias(c) for c in ("source_size", "target", "copies")])


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as planned, with ``copy`` from 1 (documents not taken are absent).
    All columns stay; where one is named ``copy`` already, the number is ``copy_``."""
    number = "copy"
    while number in docs.columns:
        number += "_"
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), "source", document_key(F.col("doc_id"), F.col("text")).alias("mix_key"))
    taken = _copies(rows, sizes, **how).where("mix_copies > 0")
    return taken.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias(number)).select("mix_row.*", number)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of mixing all ``documents``; see ``mixing_plan``."""
    plan = mixing_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER r AS place, sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open,
        coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before, (sum(source_size) OVER ())::BIGINT AS total
      FROM w WINDOW r AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
u AS (SELECT *, (3 * total - 4 * full_before)::DOUBLE / (2 * open)::DOUBLE AS unit FROM o),
f AS (SELECT min(place) AS first FROM u WHERE unit * weight <= 2 * source_size),
t AS (SELECT source, source_size, CASE WHEN (SELECT first FROM f) IS NULL OR place < (SELECT first FROM f) THEN (2 * source_size)::DOUBLE
        ELSE (SELECT unit FROM u WHERE place = (SELECT first FROM f)) * weight END AS target FROM u),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0.0 END AS rate,
        ('0x' || substr(md5('17:' || d.key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
