"""What several operators share: tables between steps, hashed words, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------- tables between steps
def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session
    gets a temporary folder of its own; on a cluster, whose machines would not share it, this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, release: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Later steps start from files that outlive any executor, and the planner knows their size. After a
    large step, ``release`` lets Spark drop its shuffle files: it does so once the driver has collected
    the plans that own them, which without this may be much later.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    del df
    if release:
        for _ in range(2):  # the gateway lets go of collected plans in a thread of its own
            gc.collect()
            time.sleep(0.4)
            spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` wrote, once no later step reads them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits of a sieve.
SIEVE_WORDS = 1 << 19


def sieved(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column``, a 64-bit hash, may be in the same column of ``keys``, and few others.

    A filter before a join's shuffle: the keys set bits in a bitmap whose broadcast has SIEVE_WORDS rows
    at most, however many keys there are. With very many keys it lets more rows through, never fewer.
    """
    word = F.pmod(F.shiftright(column, 6), F.lit(SIEVE_WORDS)).alias("sieve_word")
    bit = F.pmod(F.col(column), F.lit(64)).cast("int")
    bits = keys.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("sieve_word").agg(F.bit_or("one").alias("sieve_bits"))
    found = df.withColumn("sieve_word", word).join(F.broadcast(bits), "sieve_word")
    return found.where(F.bit_get("sieve_bits", bit) == 1).drop("sieve_word", "sieve_bits")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


# ---------------------------------------------------------------- words as 64-bit hashes
def _byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte; A-Z have those of a-z."""
    v = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(np.uint64)
    v[65:91] = v[97:123]
    return v


def _table(*outside: tuple[int, int]) -> np.ndarray:
    t = np.ones(256, bool)
    for a, b in outside:
        t[a : b + 1] = False
    return t


#: Bytes of ``[^\x20\x09-\x0D]+``: bytes over 0x7F only occur in characters that belong to words.
SPACED = _table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
ALNUM = _table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def hash_words(texts: pa.Array, inside: np.ndarray, shapes: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words (A-Z lower-cased) of a column of texts, and where each row's words begin.
    With ``shapes`` also each word's length in bytes and its number of A-Z.

    A word is a longest run of bytes for which ``inside`` holds; no word spans two rows. Nulls have
    no words. Bytes are taken a megabyte at a time, cut between words.
    """
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)
    offsets = offsets[texts.offset : texts.offset + rows + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if rows and buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    value = np.where(inside, _byte_values(), np.uint64(0))
    most = max(1, min(_CHUNK, len(data)))
    power, inverse = _powers(_POWER, most), _powers(_INVERSE, most)
    found, starts, sizes, capitals, at = [], [], [], [], 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        while end < len(data) and inside[data[end]] and inside[data[end - 1]]:  # not within a word
            gap = np.flatnonzero(~inside[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(end + _CHUNK, len(data))
        d = data[at:end]
        if len(d) > len(power):
            power, inverse = _powers(_POWER, len(d)), _powers(_INVERSE, len(d))
        w = inside[d]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        edge = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        first[edge] = w[edge]
        inner = edge[edge > 0]
        last[inner - 1] = w[inner - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(value[d] * power[: len(d)], out=total[1:])
        found.append(mixed((total[b] - total[a]) * inverse[a]))
        starts.append(a + at)
        if shapes:
            upper = np.zeros(len(d) + 1, np.int64)
            np.cumsum((d >= 65) & (d <= 90), out=upper[1:])
            sizes.append(b - a)
            capitals.append(upper[b] - upper[a])
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    begins = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    rest = tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, capitals)) if shapes else ()
    return hashes, np.searchsorted(begins, offsets), *rest


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mixed(h)


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; a component is named by its smallest node.

    Alternates the large-star and the small-star step until nothing changes: each step only takes
    minima by node and joins them back, so a node with very many edges is pre-aggregated and never
    gathered. Null ends and self loops are ignored.
    """
    now = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        now = saved(small)
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if mark == seen:
            break
        seen = mark
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
