"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with document shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import ALNUM, discard, hash_words, read, saved, shingle_hashes

#: Words of a window, and words of the shingles by which windows are found.
WINDOW, SHINGLE = 13, 3
#: Benchmark words in one index; a larger benchmark is taken in several such pieces, one pass after another.
INDEX_WORDS = 2_000_000
#: Words by which a long item moves on from one segment to the next, and bits of the sieve of its shingles.
SEGMENT, SIEVE_BITS = 4096, 26


def _segments(benchmark: DataFrame, window: int) -> DataFrame:
    """``(item, segment, n, words)``: an item's words, of long items in segments that share all but one word of a window."""

    def run(batches):
        for b in batches:
            words, begin = hash_words(b.column("text"), ALNUM)
            ids = b.column("item").to_pylist()
            for i in range(b.num_rows):
                own = words[begin[i] : begin[i + 1]].view(np.int64)
                starts = range(0, max(1, len(own) - window + 1), SEGMENT) if len(own) else []
                rows = [own[at : at + SEGMENT + window - 1] for at in starts]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([len(r) for r in rows], pa.int32()), pa.array(rows, pa.list_(pa.int64()))], ["item", "segment", "n", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).where("item IS NOT NULL AND text IS NOT NULL")
    return items.mapInArrow(run, "item string, segment int, n int, words array<long>")


def _windows(items: list, window: int, shingle: int) -> dict:
    """Distinct windows of some items: their words, their shingles by position, and the items that have them."""
    at: dict[bytes, int] = {}
    words, owners = [], []
    for item, seq in items:
        seq = np.asarray(seq, np.int64).view(np.uint64)
        w = min(window, len(seq))
        for i in range(len(seq) - w + 1):
            own = seq[i : i + w]
            k = at.setdefault(own.tobytes(), len(words))
            if k == len(words):
                words.append(own)
                owners.append(set())
            owners[k].add(item)
    size = np.array([min(shingle, len(w)) for w in words], np.int64)
    return {"words": words, "owners": [sorted(o) for o in owners], "size": size, "tokens": [shingle_hashes(w, k) for w, k in zip(words, size)]}


def _lookup(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted array of hashes, and a table of the low bits that they have: plain arrays, for broadcasts."""
    keys = np.unique(keys)
    low = np.zeros(1 << 18, bool)
    low[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    return keys, low


def _find(look: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the hashes that are keys, and which keys they are: by low bits first, then by binary search."""
    keys, low = look
    at = np.flatnonzero(low[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
    key = np.searchsorted(keys, hashes[at])
    hit = keys[np.minimum(key, len(keys) - 1)] == hashes[at] if len(keys) else np.zeros(len(at), bool)
    return at[hit], key[hit]


def _tokens(segments: DataFrame, window: int, shingle: int) -> DataFrame:
    """``(piece, k, token)``: the different shingles of each piece's windows, and how many words they have."""

    def run(batches):
        for b in batches:
            for piece, seq in zip(b.column("piece").to_pylist(), b.column("words")):
                own = np.asarray(seq.values, np.int64).view(np.uint64)
                k = min(window, shingle, len(own))
                token = np.unique(shingle_hashes(own, k)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), piece, np.int64)), pa.array(np.full(len(token), k, np.int32)), pa.array(token)], ["piece", "k", "token"])

    return segments.select("piece", "words").mapInArrow(run, "piece long, k int, token long").distinct()


def _rarity(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(piece, k, token, n)``: how often each of the benchmark's shingles occurs in all documents, in one scan.

    Shingles go through a bitmap of SIEVE_BITS bits first, whatever the benchmark's size; those that
    pass are counted in each batch, and then by key.
    """
    place = F.col("token").bitwiseAND((1 << SIEVE_BITS) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    bits = tokens.groupBy("k", F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    sieves = {}
    for k in sorted(set(bits["k"].to_pylist())):
        own = bits["k"].to_numpy() == k
        sieves[k] = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
        sieves[k][bits["word"].to_numpy()[own]] = bits["bits"].to_numpy()[own].view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def run(batches):
        for b in batches:
            words, _ = hash_words(b.column("text"), ALNUM)
            for k, sieve in shared.value.items():
                h = shingle_hashes(words, k)
                at = h & np.uint64((1 << SIEVE_BITS) - 1)
                passed = (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                keys, n = np.unique(h[passed.astype(bool)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["k", "token", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n"))
    return tokens.join(counts, ["k", "token"]).select("piece", "k", "token", "n")


def _index(found: dict, rarity: dict[int, dict[int, int]]) -> dict:
    """Windows by their rarest shingle. Containment needs every shingle, so one prefix token a window
    suffices; a window with a shingle that no document has cannot occur."""
    rows: dict[int, list] = {}
    for i, (words, tokens, k) in enumerate(zip(found["words"], found["tokens"], found["size"])):
        seen = [rarity[k].get(int(t), 0) for t in tokens]
        offset = min(range(len(seen)), key=lambda j: (seen[j], int(tokens[j])))
        if seen[offset]:
            rows.setdefault(int(k), []).append((int(tokens[offset]), i, offset, len(words)))
    out = {"by": {}, "owners": found["owners"], "words": found["words"]}
    for k, own in rows.items():
        own.sort()
        token = np.array([r[0] for r in own], np.uint64)
        look = _lookup(token)
        out["by"][k] = (look, np.searchsorted(token, look[0]), np.searchsorted(token, look[0], "right"), *[np.array([r[j] for r in own], np.int64) for j in (1, 2, 3)])
    return out


def _occurrences(words: np.ndarray, begin: np.ndarray, index: dict):
    """``(row, start, length, window)`` of all windows that occur, ``start`` among all words of the batch."""
    for k, (look, first, last, window, offset, length) in index["by"].items():
        at, key = _find(look, shingle_hashes(words, k))
        many = last[key] - first[key]
        entry = np.repeat(first[key] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
        start = np.repeat(at, many) - offset[entry]
        row = np.searchsorted(begin, np.repeat(at, many), "right") - 1
        fits = (start >= begin[row]) & (start + length[entry] <= begin[row + 1])  # positional and length bounds
        for r, s, n, w in zip(row[fits].tolist(), start[fits].tolist(), length[entry][fits].tolist(), window[entry][fits].tolist()):
            if np.array_equal(words[s : s + n], index["words"][w]):
                yield r, s, n, w


def _merged(runs: list[int]) -> list[int]:
    """Sorted disjoint runs [start, end, ..] from any runs."""
    out: list[int] = []
    for a, b in sorted(zip(runs[::2], runs[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _search(rows: DataFrame, index) -> DataFrame:
    """Adds what one piece of the benchmark finds to ``(row, text, n_words, runs, items)``."""

    def run(batches):
        for b in batches:
            words, begin = hash_words(b.column("text"), ALNUM)
            runs, items = {}, {}
            for r, s, n, w in _occurrences(words, begin, index.value):
                runs.setdefault(r, []).extend((s - int(begin[r]), s - int(begin[r]) + n))
                items.setdefault(r, set()).update(index.value["owners"][w])
            old_runs, old_items = b.column("runs"), b.column("items")
            out_runs, out_items = [], []
            for r in range(b.num_rows):
                before, known = old_runs[r].as_py() or [], old_items[r].as_py() or []
                out_runs.append(_merged(before + runs[r]) if r in runs else before)
                out_items.append(sorted(items[r] | set(known)) if r in items else known)
            n_words = pa.array(np.diff(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), n_words, pa.array(out_runs, pa.list_(pa.int32())), pa.array(out_items, pa.list_(pa.string()))], ["row", "text", "n_words", "runs", "items"])

    return rows.mapInArrow(run, rows.schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, index_words: int = INDEX_WORDS) -> DataFrame:
    """``(row, n_words, runs, items)``: each row of ``docs`` as a struct, with its hit words and items.

    ``runs`` are disjoint [start, end) word positions, flat and sorted; ``items`` the ids, as strings,
    of items with an occurring window. Null texts have no words; null item ids and items without
    words are ignored; repeated items count once. The benchmark is cut into pieces of ``index_words`` words
    (by hash of item and segment, so about as many). Each piece is a pass of its own over what the pass before
    it wrote, so a task holds one index at a time, however large the benchmark is.
    """
    spark = docs.sparkSession
    segments = saved(_segments(benchmark, window))
    pieces = max(1, -(-(segments.agg(F.sum("n")).first()[0] or 0) // index_words))
    segments = segments.withColumn("piece", F.pmod(F.xxhash64("item", "segment"), F.lit(pieces)))
    rarity = saved(_rarity(docs, saved(_tokens(segments, window, shingle))))
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))
    before = None
    for p in range(pieces):
        own = segments.where(F.col("piece") == p).select("item", "words").toArrow()
        found = _windows(list(zip(own["item"].to_pylist(), own["words"].to_pylist())), window, shingle)
        seen: dict[int, dict[int, int]] = {int(k): {} for k in set(found["size"].tolist())}
        for k, token, n in rarity.where(F.col("piece") == p).select("k", "token", "n").toArrow().to_pandas().itertuples(index=False):
            seen[k][int(np.int64(token).view(np.uint64))] = n
        index = spark.sparkContext.broadcast(_index(found, seen))
        rows = _search(rows, index)
        if p < pieces - 1:
            rows = saved(rows)
            index.unpersist()
            if before is not None:
                discard(before)
            before = rows
    return rows.select("row", "n_words", "runs", "items")


def n_hit(runs="runs"):
    """Words within runs."""
    at = F.sequence(F.lit(0), F.size(runs) - 1)
    sign = lambda i: F.when(i % 2 == 1, F.lit(1)).otherwise(F.lit(-1)) * F.get(F.col(runs), i)
    return F.when(F.size(runs) == 0, F.lit(0)).otherwise(F.aggregate(at, F.lit(0), lambda a, i: a + sign(i))).cast("long")


def contaminated(hit, words):
    """The rule: some word is hit, and at least one word in twenty."""
    return (hit > 0) & (20 * hit >= words)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = benchmark_hits(docs, read(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    sha = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return hits.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS g FROM bw WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item FROM dg JOIN win USING (g, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
