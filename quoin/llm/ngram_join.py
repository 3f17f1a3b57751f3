"""N-gram Jaccard join: documents whose word-shingle sets reach a similarity, by T-occurrence search.

The join is exact (up to 64-bit shingle hashes). Steps, each a Spark job over all documents:

1. every text becomes its set of shingle hashes; equal sets form one class;
2. classes that cannot have a partner leave early: with the hashes in increasing order, two similar
   sets share several of the smallest hashes of both (the extended prefix filter);
3. for the classes left, shingles found in one class only are set aside; a class with fewer than the
   required share of common shingles leaves, the others order their shingles by rarity;
4. classes that share a shingle of their rare-first prefixes fall into one block;
5. in each block DivideSkip finds the links: short inverted lists are heap-merged with skips, long
   ones are probed by binary search. Blocks that are too large for a task are cut into a grid;
6. components of the links, then of the documents.

Within a block, two sets that are already connected are not compared again, so a group of thousands
of near copies costs about one list merge a member, never all pairs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import SPACED, components, hash_words, read, saved, shingle_hashes

WORDS = 5
#: Similarity as a fraction.
ALIKE = (75, 100)
#: The share of its size by which a set's prefix is extended in step 2.
EXTRA = 0.12
#: How readily DivideSkip sets lists aside, and the postings up to which it merges by heap.
MU, HEAP_POSTINGS = 0.05, 4096
#: Classes whose ids are broadcast to the scan that reads their texts again; above, the texts are shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles of a bucket of steps 2 and 3.
BUCKET_SHINGLES = 2_000_000
#: Shingles in one side of a task of step 5.
TASK_SHINGLES = 4_000_000


def required(n: int, alike: tuple[int, int] = ALIKE) -> int:
    """The least overlap of a set of n with any similar set."""
    return -(-alike[0] * n // alike[1])


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    words, begin = hash_words(batch.column("text"), SPACED)
    for i in range(batch.num_rows):
        own = words[begin[i] : begin[i + 1]]
        yield i, np.unique(shingle_hashes(own, min(k, len(own)) or 1))


def _key(own: np.ndarray) -> int:
    """A set's key: 64 bits of its hashes, never 0."""
    return (xxhash.xxh3_64_intdigest(own.tobytes()) or 1) - (1 << 63) or 1


def row_key() -> Column:
    """By which a document's text is found again: its id, or without one a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))).alias("row_key")


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``(doc_id, row_key, n_shingles, set_key)``; equal sets have equal set keys, an empty set has none."""

    def run(batches):
        for b in batches:
            n, keys = [], []
            for _, own in _sets(b, k):
                n.append(len(own))
                keys.append(_key(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "row_key", "n_shingles", "set_key"])

    return docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_key long, n_shingles long, set_key long")


def _packed(tokens: np.ndarray, keys: np.ndarray, buckets: int, width: int) -> list[tuple]:
    """Rows ``(bucket, tokens, keys, runs)`` of (token, key) pairs: the low ``width`` bytes of each token, and the
    keys run by run. A shuffle then carries few long rows instead of many short ones."""
    place = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, tokens, keys = place[order], tokens[order], keys[order]
    out = []
    for a, b in zip(cuts := np.flatnonzero(np.diff(place, prepend=-1)), [*cuts[1:], len(place)]):
        own = keys[a:b]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        raw = np.ascontiguousarray(tokens[a:b]).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        out.append((int(place[a]), raw, own[begins].tobytes(), np.diff(np.append(begins, b - a)).astype(np.uint32).tobytes()))
    return out


def _unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (token, key) pairs of packed rows, in increasing order."""
    raw = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    token = wide.view(np.uint64).ravel()
    key = np.repeat(np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64), np.frombuffer(b"".join(table["runs"].to_pylist()), np.uint32))
    return _distinct(token, key)


def _distinct(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    return token[new], key[new]


def _times(token: np.ndarray) -> np.ndarray:
    """How often each of the sorted tokens occurs."""
    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(token)))
    return np.repeat(sizes, sizes)


_PACKED = "bucket int, tokens binary, keys binary, runs binary, known binary, counts binary"


def _prefix_rows(docs: DataFrame, k: int, alike: tuple[int, int], buckets: int) -> DataFrame:
    """Packed (token, set_key) pairs of the extended prefixes.

    Tokens that several sets of a batch share are counted there (``known``, ``counts``), and only a
    marker with key 0 goes on, so a frequent token comes about once a batch.
    """

    def run(batches):
        for b in batches:
            tokens, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, own in _sets(b, k):
                if n := len(own):
                    cut = min(n, n - required(n, alike) + _extra(n))
                    tokens.append(own[:cut] & np.uint64((1 << 48) - 1))
                    keys.append(np.full(cut, _key(own), np.int64))
            token, key = _distinct(np.concatenate(tokens), np.concatenate(keys))
            shared = _times(token) > 1
            known, counts = np.unique(key[shared], return_counts=True)
            marks = np.unique(token[shared])
            token, key = np.concatenate([token[~shared], marks]), np.concatenate([key[~shared], np.zeros(len(marks), np.int64)])
            by_key = np.argsort(key, kind="stable")
            rows = _packed(token[by_key], key[by_key], buckets, 6)
            extra = [(known.tobytes(), counts.astype(np.int64).tobytes())] + [(b"", b"")] * (len(rows) - 1)
            columns = list(zip(*[(*r, *x) for r, x in zip(rows, extra)])) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["bucket", "tokens", "keys", "runs", "known", "counts"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, _PACKED)


def _extra(n: int) -> int:
    return max(1, int(EXTRA * n))


def _may_match(docs: DataFrame, classes: DataFrame, k: int, alike: tuple[int, int], buckets: int) -> DataFrame:
    """Classes ``(set_key, row_key, n)`` that share enough of their extended prefix with other classes."""

    def run(table: pa.Table) -> pa.Table:
        token, key = _unpacked(table, 6)
        found = key[(_times(token) > 1) & (key != 0)]
        keys, counts = np.unique(found, return_counts=True)
        known = np.frombuffer(b"".join(table["known"].to_pylist()), np.int64)
        more = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64)
        keys, counts = np.concatenate([keys, known]), np.concatenate([counts, more])
        to = keys % buckets
        order = np.argsort(to, kind="stable")
        rows = [(int(to[own[0]]), keys[own].tobytes(), counts[own].astype(np.int64).tobytes()) for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(own)]
        columns = list(zip(*rows)) or [()] * 3
        return pa.table({"to": pa.array(columns[0], pa.int32()), "keys": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        keys, at = np.unique(np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64), return_inverse=True)
        counts = np.bincount(at, np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64), len(keys))
        return pa.table({"set_key": keys, "shared": counts.astype(np.int64)})

    shared = _prefix_rows(docs, k, alike, buckets).groupBy("bucket").applyInArrow(run, "to int, keys binary, counts binary").groupBy("to").applyInArrow(total, "set_key long, shared long")
    smallest_partner = F.ceil(F.col("n") * alike[0] / alike[1])
    need = F.greatest(F.lit(1), F.floor(F.lit(EXTRA) * smallest_partner))
    return classes.join(shared, "set_key").where(F.col("shared") >= need).select("set_key", "row_key", "n")


def _common_shingles(docs: DataFrame, may: DataFrame, k: int, alike: tuple[int, int], buckets: int) -> DataFrame:
    """``(set_key, n, tokens)``: shingles that other classes have too, rarest first, where there are enough of them.

    A token is its classes' number (127 at most) and 56 bits of its hash, so it sorts by rarity.
    """

    def deal(batches):
        for b in batches:
            tokens, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            own_keys = b.column("set_key").to_pylist()
            for i, own in _sets(b, k):
                if len(own) and _key(own) == own_keys[i]:
                    tokens.append(own & np.uint64((1 << 56) - 1))
                    keys.append(np.full(len(own), own_keys[i], np.int64))
            rows = list(zip(*_packed(np.concatenate(tokens), np.concatenate(keys), buckets, 7))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], ["bucket", "tokens", "keys", "runs"])

    def rare(table: pa.Table) -> pa.Table:
        token, key = _unpacked(table, 7)
        df = _times(token)
        token = (np.minimum(df, 127).astype(np.uint64) << np.uint64(56) | token)[df > 1].view(np.int64)
        key = key[df > 1]
        order = np.argsort(key, kind="stable")
        token, key = token[order], key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        to, runs = key[begins] % buckets, np.diff(np.append(begins, len(key)))
        rows = []
        for t in np.unique(to):
            own = np.repeat(to == t, runs)
            rows.append((int(t), token[own].tobytes(), key[begins][to == t].tobytes(), runs[to == t].astype(np.uint32).tobytes()))
        columns = list(zip(*rows)) or [()] * 4
        return pa.table({"to": pa.array(columns[0], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("tokens", "keys", "runs"), columns[1:])}})

    def gather(table: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.int64)
        key = np.repeat(np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64), np.frombuffer(b"".join(table["runs"].to_pylist()), np.uint32))
        order = np.lexsort((token, key))
        token, key = token[order], key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)).astype(np.int32)), pa.array(token)) if len(key) else pa.array([], pa.list_(pa.int64()))
        return pa.table({"set_key": pa.array(key[begins]), "tokens": lists})

    ids = may.select("row_key", "set_key")
    ids = F.broadcast(ids) if may.count() <= BROADCAST_ROWS else ids
    # of the rows that share a row key, those with another set drop out in ``deal``
    texts = docs.select(row_key(), F.col("text").cast("string").alias("text")).join(ids, "row_key").select("set_key", "text")
    parts = texts.mapInArrow(deal, "bucket int, tokens binary, keys binary, runs binary").groupBy("bucket").applyInArrow(rare, "to int, tokens binary, keys binary, runs binary")
    own = parts.groupBy("to").applyInArrow(gather, "set_key long, tokens array<long>").join(may.select("set_key", "n"), "set_key")
    return own.where(F.size("tokens") >= F.ceil(F.col("n") * alike[0] / alike[1])).select("set_key", F.col("n").cast("int").alias("n"), "tokens")


def _blocks(sets: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """``(set_key, block)`` of the classes that share a token of their rare-first prefixes."""
    # tokens that only one class has come first in the order and take up part of the prefix
    length = (F.col("n") - F.ceil(F.col("n") * alike[0] / alike[1]) + 1 - (F.col("n") - F.size("tokens"))).cast("int")
    prefix = sets.select("set_key", F.explode(F.slice("tokens", F.lit(1), length)).alias("token"))
    first = prefix.groupBy("token").agg(F.min("set_key").alias("b"))
    edges = prefix.join(first, "token").where("set_key != b").select(F.col("set_key").alias("a"), "b")
    return components(edges).select(F.col("node").alias("set_key"), F.col("component").alias("block"))


class Found:
    """Disjoint sets of a task's rows."""

    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)
        self.members = {c: [int(i) for i in np.flatnonzero(self.of == c)] for c in range(self.of.max() + 1)} if len(labels) < 2000 else _members(self.of)

    def join(self, i: int, j: int) -> None:
        a, b = int(self.of[i]), int(self.of[j])
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            self.of[self.members[b]] = a
            self.members[a] += self.members.pop(b)


def _members(of: np.ndarray) -> dict[int, list[int]]:
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return {int(of[g[0]]): g.tolist() for g in np.split(order, cuts)}


def merge_skip(lists: list[np.ndarray], least: int) -> dict[int, int]:
    """Ids in at least ``least`` of the sorted lists, and in how many: a heap of list heads that skips.

    When the smallest head is in too few lists, the ``least - 1`` smallest heads are popped and their
    lists jump, by binary search, to the smallest head left: no id before it can still qualify.
    """
    lists = [x.tolist() for x in lists if len(x)]
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    out: dict[int, int] = {}
    while len(heap) >= least:
        low, popped = heap[0][0], []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out[low] = len(popped)
            target = low + 1
        else:
            while len(popped) < least - 1 and heap:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], target, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return out


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in at least ``least`` of the sorted ``lists``, and in how many of them.

    The longest lists are set aside; an id needs ``least`` minus their number among the short ones,
    which are merged, and is then probed in the long ones by binary search. Few postings are merged
    by the skipping heap, many (a query into a group of thousands) by counting ids in one vector pass.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    aside = min(least - 1, int(least / (MU * np.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    if sum(map(len, short)) <= HEAP_POSTINGS:
        found = merge_skip(short, least - aside)
        ids = np.array(sorted(found), np.int64)
        counts = np.array([found[i] for i in ids.tolist()], np.int64)
    else:
        counts = np.bincount(np.concatenate(short))
        ids = np.flatnonzero(counts >= least - aside)
        counts = counts[ids]
    for k, x in enumerate(long):
        at = np.searchsorted(x, ids)
        counts = counts + (x[np.minimum(at, len(x) - 1)] == ids)
        able = counts + len(long) - k - 1 >= least
        ids, counts = ids[able], counts[able]
    return ids, counts


def block_links(n: np.ndarray, tokens: list[np.ndarray], indexed: np.ndarray, asking: np.ndarray, group: np.ndarray, alike: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between rows of a block that connect all that is similar; pairs connected already are skipped.

    ``indexed`` rows stand in the inverted lists, ``asking`` rows are looked up, ``group`` has what is
    known to be connected.
    """
    flat = np.concatenate([tokens[i] for i in indexed]) if len(indexed) else np.zeros(0, np.int64)
    owner = np.repeat(indexed, [len(tokens[i]) for i in indexed])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]  # within a token, owners are in increasing order
    found, links = Found(group), []
    a, b = alike
    anchor = int(asking[0]) if len(asking) else -1
    everywhere = set(indexed.tolist())
    for q in asking.tolist():
        # both in the first row's group: linked; otherwise the other row asks, if all rows may ask
        if q != anchor and found.of[q] == found.of[anchor] and len(everywhere) <= len(asking) and q in everywhere:
            continue
        if (found.of[indexed] == found.of[q]).all():
            continue
        left, right = np.searchsorted(flat, tokens[q]), np.searchsorted(flat, tokens[q], "right")
        lists = []
        for x, y in zip(left.tolist(), right.tolist()):
            if y > x:
                at = owner[x:y]
                at = at[found.of[at] != found.of[q]]
                if len(at):
                    lists.append(at)
        # a partner may be as small as the required share of q
        for d, both in zip(*map(np.ndarray.tolist, divide_skip(lists, required(int(n[q]), alike)))):
            if b * both >= a * (int(n[q]) + int(n[d]) - both) and found.of[q] != found.of[d]:
                found.join(q, d)
                links.append((q, d))
    return links


def _search(rows: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """Links ``(a, b)`` from ``(block, cell, set_key, n, tokens, part, role)``; role 1 is indexed, 2 asks, 3 both."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, role = table["set_key"].to_numpy(), table["role"].to_numpy()
        tokens = table["tokens"].combine_chunks()
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.chunk(0)
        values, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        order = np.argsort(keys, kind="stable")
        lists = [np.sort(values[at[i] : at[i + 1]]) for i in order]
        role, keys = role[order], keys[order]
        links = block_links(table["n"].to_numpy()[order], lists, np.flatnonzero(role & 1), np.flatnonzero(role & 2), table["part"].to_numpy()[order], alike)
        return pa.table({"a": pa.array([keys[i] for i, _ in links], pa.int64()), "b": pa.array([keys[j] for _, j in links], pa.int64())})

    return rows.groupBy("block", "cell").applyInArrow(run, "a long, b long")


def set_links(sets: DataFrame, blocks: DataFrame, alike: tuple[int, int] = ALIKE, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Links that connect exactly what the similarity connects.

    A block is dealt to as many pieces as its shingles need. First all rows look into piece 0 (which
    is the whole of a small block); then, in large blocks, the rows outside the largest component look
    into the other pieces.
    """
    rows = sets.join(blocks, "set_key")
    sizes = rows.groupBy("block").agg(F.ceil(F.sum(F.size("tokens")) / task_shingles).cast("int").alias("pieces"))
    rows = saved(rows.join(sizes, "block").withColumn("piece", F.pmod(F.xxhash64("set_key"), F.col("pieces")).cast("int")))
    columns = ["block", "set_key", "n", "tokens"]
    own = F.col("set_key").alias("part")
    small = rows.where("pieces = 1").select(*columns, own, F.lit(0).alias("cell"), F.lit(3).alias("role"))
    large = rows.where("pieces > 1")
    asking = large.select(*columns, own, F.col("piece").alias("cell"), F.when(F.col("piece") == 0, 3).otherwise(2).alias("role"))
    index = large.where("piece = 0").select(*columns, own, F.explode(F.sequence(F.lit(1), F.col("pieces") - 1)).alias("cell"), F.lit(1).alias("role"))
    first = saved(_search(small.unionByName(asking).unionByName(index), alike))
    if large.isEmpty():
        return first
    part = components(first).withColumnRenamed("node", "set_key").withColumnRenamed("component", "part")
    large = saved(large.join(part, "set_key", "left").withColumn("part", F.coalesce("part", "set_key")))
    most = large.groupBy("block", "part").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("part", F.struct("c", "part")).alias("most"))
    large = large.join(most, "block")
    cell = lambda i, q: (i * F.col("pieces") + q).cast("int").alias("cell")
    asking = large.where("part != most").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("pieces") - 1))).select(*columns, "part", cell(F.col("i"), F.col("piece")), F.lit(2).alias("role"))
    index = large.where("piece > 0").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(*columns, "part", cell(F.col("piece"), F.col("q")), F.lit(1).alias("role"))
    return first.union(saved(_search(asking.unionByName(index), alike)))


def similar_documents(docs: DataFrame, k: int = WORDS, alike: tuple[int, int] = ALIKE, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs(doc_id, text, ..)``.

    Null and blank texts have empty sets and are components of their own. Repeated rows and equal
    texts fall into one class. A null doc_id is kept; its component is the smallest other id of its
    component, else null. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sets = saved(shingle_sets(docs, k))
    classes = saved(sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.max("n_shingles").alias("n")))
    # enough buckets for a task to hold its shingles, and one for each of the shuffle's partitions at least
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))
    may = saved(_may_match(docs, classes, k, alike, buckets), release=True)
    common = saved(_common_shingles(docs, may, k, alike, buckets), release=True)
    links = set_links(common, saved(_blocks(common, alike)), alike, task_shingles)
    joined = saved(components(links))
    named = classes.join(joined, classes.set_key == joined.node, "left").select("set_key", "doc_id", F.coalesce("component", "set_key").alias("part"))
    names = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    named = saved(named.join(names, "part").select("set_key", "component_id"))
    out = sets.join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT g.* FROM g JOIN common USING (g)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS nb FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * nb >= 75 * (x.n + y.n - nb)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
