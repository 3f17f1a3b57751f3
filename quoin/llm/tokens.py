"""Separator scan: documents in flat, unindexed token files, found by their end-of-document identifier."""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import read, saved, scratch_dir

#: The byte-level vocabulary of 50,256 ranks; its next identifier ends a document.
VOCABULARY, SEPARATOR = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: How that vocabulary splits text before merging. A fixed value that belongs to it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Tokens of a block, and blocks that one task of the prefix scan takes.
BLOCK_TOKENS, SCAN_BLOCKS = 1 << 21, 4096


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Flat files of little-endian 16-bit tokens in ``path``, one for each partition of ``docs(doc_id, text)``,
    each document followed by the separator. Returns ``(file, place, doc_id)``: which document stands where.

    Each attempt of a task writes a file of its own name and returns it in its rows, so the rows that
    Spark keeps name the file that belongs to them, and files of attempts that were lost are in no row:
    ``count_tokens`` takes the files to read. Null text is a document without tokens. ``vocabulary`` is a path that every machine has.
    """

    def run(batches):
        import tiktoken
        from pyspark import TaskContext

        if not os.path.exists(vocabulary):
            raise FileNotFoundError(f"no vocabulary {vocabulary} on this machine: pass a path that every executor has")
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.tok"
        draft, place = f"{folder}/.{name}", 0
        with store.open_output_stream(draft) as out:
            for b in batches:
                for text in b.column("text").to_pylist():
                    out.write(np.array([*encoding.encode_ordinary(text or ""), separator], "<u2").tobytes())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n)), b.column("doc_id")], ["file", "place", "doc_id"])
                place += n
        store.move(draft, f"{folder}/{name}")

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, place long, doc_id long")


def token_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, uri, block, first, n)``: ranges of tokens that cover the .tok files of a folder. Only names and lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", (F.col("length") / 2).cast("long").alias("tokens"))
    blocks = files.where("tokens > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("tokens") - 1) / block_tokens).cast("long"))))
    first = F.col("block") * block_tokens
    return blocks.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("path").alias("uri"), "block", first.alias("first"), F.least(F.lit(block_tokens), F.col("tokens") - first).alias("n"))


def separator_positions(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """``(file, block, first, n, at)``: in each block, the positions in the file of all separators, by one vector compare."""

    def run(batches):
        for b in batches:
            found = []
            for uri, first, n in zip(*(b.column(c).to_pylist() for c in ("uri", "first", "n"))):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    f.seek(2 * first)
                    tokens = np.frombuffer(f.read(2 * n), "<u2")
                found.append(np.flatnonzero(tokens == separator) + first)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), b.column("first"), b.column("n"), pa.array(found, pa.list_(pa.int64()))], ["file", "block", "first", "n", "at"])

    spread = blocks.repartition("uri", "block")
    return spread.mapInArrow(run, "file string, block long, first long, n long, at array<long>")


def stitched(scanned: DataFrame, scan_blocks: int = SCAN_BLOCKS) -> DataFrame:
    """``(file, place, start, n_tokens)`` of every document from what each block found on its own.

    An exclusive prefix scan over a file's blocks carries two things on: how many separators came
    before (the place of a block's first document) and where the last one was (where it starts). The
    scan has two levels, groups of ``scan_blocks`` blocks and the blocks in a group, so no task takes a
    whole file. Tokens after a file's last separator are a document if there are any; adjacent
    separators enclose an empty one.
    """
    table = scanned.withColumns({"seps": F.size("at"), "last": F.array_max("at"), "group": F.floor(F.col("block") / scan_blocks)})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = table.groupBy("file", "group").agg(F.sum("seps").alias("g_seps"), F.max("last").alias("g_last"))
    order = before(Window.partitionBy("file").orderBy("group"))
    groups = groups.select("file", "group", F.coalesce(F.sum("g_seps").over(order), F.lit(0)).alias("g_before"), F.max("g_last").over(order).alias("g_last_before"), F.lead("group").over(Window.partitionBy("file").orderBy("group")).alias("next_group"))
    order = before(Window.partitionBy("file", "group").orderBy("block"))
    table = table.withColumns({"b_before": F.coalesce(F.sum("seps").over(order), F.lit(0)), "b_last": F.max("last").over(order), "next_block": F.lead("block").over(Window.partitionBy("file", "group").orderBy("block"))})
    table = table.join(groups, ["file", "group"])
    carried = F.coalesce(F.col("b_last"), F.col("g_last_before"), F.lit(-1))  # the last separator before this block
    ends_file = F.col("next_block").isNull() & F.col("next_group").isNull()
    end = F.col("first") + F.col("n")
    open_end = ends_file & (F.coalesce(F.col("last"), carried) < end - 1)
    ends = F.when(open_end, F.concat("at", F.array(end))).otherwise(F.col("at"))
    docs = table.select("file", (F.col("g_before") + F.col("b_before")).alias("places"), carried.alias("carried"), ends.alias("ends")).select("file", "places", "carried", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carried")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    return docs.select("file", (F.col("places") + F.col("i")).alias("place"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, files: DataFrame | None = None) -> DataFrame:
    """``(file, place, start, n_tokens)`` of every document in the flat token files of a folder, or in ``files(file)`` of it."""
    blocks = token_blocks(spark, path, block_tokens)
    if files is not None:
        blocks = blocks.join(files.select("file").distinct(), "file", "left_semi")
    return stitched(saved(separator_positions(blocks, separator)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    written = saved(write_token_files(read(spark, sf_dir, "documents"), path))
    return written.join(count_tokens(spark, path, files=written), ["file", "place"]).select("doc_id", "file", "place", "start", "n_tokens")
