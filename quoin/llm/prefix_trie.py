"""The prefix trie of conversations by the Euler-tour technique.

A node is a sequence of first turns that some conversation begins with; a parallel prefix hash names it.
An enter and an exit arc for each node form one list, the tour, which is ranked distributedly: runs that
lie next to each other in sorted order become one link each, links between random splitters are joined
by pointer jumping, and the splitters are ranked in the same way. Sums over a subtree are then
differences of suffix sums at its two arcs, however deep or wide the trie is.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import read, saved

#: Turns of a conversation of one chunk of a prefix scan.
CHUNK = 4_096
#: One in STRIDE links is a splitter; FINISH links or fewer are ranked in one task.
STRIDE, FINISH = 16, 1 << 16
#: Parents with more than a HOT-th of all nodes as children, fewer than HOT in number, are joined by broadcast.
HOT = 1_000
#: Ids of one piece of text under a digest.
IDS = 512
#: Rebuilt conversations: conv_id % FAMILY names the base, crc32 % (HEAD + 1) the turns taken from it.
FAMILY, HEAD = 5, 8


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before; the first row does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


# ---------------------------------------------------------------- turns
def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, k, c1, c2, bytes)``: turns numbered from 1, with 120 bits of a digest of role and text.

    A range sort deals even one conversation over several partitions; each numbers its own rows, and the
    at most one conversation that a partition continues from earlier ones is moved on by their counts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    piece = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    turns = turns.select("conv_id", "turn", piece(1).alias("c1"), piece(16).alias("c2"), "bytes")
    order = ["conv_id", "turn", "c1", "c2"]

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy()
            at = np.flatnonzero(starts(conv))
            k = np.arange(len(conv)) - np.repeat(at, np.diff(at, append=len(conv))) + 1
            if conv[0] == last:
                k[: at[1] if len(at) > 1 else len(k)] += n
            last, n = conv[-1], int(k[-1])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(k), part)), pa.array(k), *(b.column(c) for c in ("c1", "c2", "bytes"))], ["conv_id", "part", "k", "c1", "c2", "bytes"])

    rows = saved(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, part long, k long, c1 long, c2 long, bytes long"))
    counts = rows.groupBy("conv_id", "part").agg(F.max("k").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    continued = counts.withColumn("before", before).where("before IS NOT NULL").drop("n")  # one row a partition at most
    return rows.join(F.broadcast(continued), ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "c1", "c2", "bytes")


def conversation_sizes(turns: DataFrame) -> DataFrame:
    """``(conv_id, n, h, base, kept, total)``: turns of its own, turns asked of its base, those there are, and turns once rebuilt."""
    own = turns.groupBy("conv_id").agg(F.max("k").alias("n"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    kept = F.least("h", F.coalesce("base_n", F.lit(0)))
    return own.join(base, "base", "left").select("conv_id", "n", "h", "base", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))


def rebuilt_turns(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(conv_id, d, total, bytes, x1, x2)``: turns of the rebuilt conversations, with two hashes of turn and position.
    Long conversations meet their sizes in chunks; a base's first turns go to FAMILY conversations (twice as many around 0)."""
    far = F.floor(F.col("n") / CHUNK)
    dealt = sizes.select("conv_id", "h", "kept", "total", F.explode(F.sequence(F.lit(0).cast("long"), far)).alias("chunk"))
    own = turns.withColumn("chunk", F.floor(F.col("k") / CHUNK)).join(dealt, ["conv_id", "chunk"]).where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("kept")).alias("d"), "total", "c1", "c2", "bytes")
    first = turns.where(F.col("k") <= HEAD).withColumnRenamed("conv_id", "base")
    taken = first.join(sizes.select("conv_id", "base", "h", "total"), "base").where("k <= h").select("conv_id", F.col("k").alias("d"), "total", "c1", "c2", "bytes")
    return own.unionByName(taken).select("conv_id", "d", "total", "bytes", F.xxhash64("d", "c1", "c2").alias("x1"), F.xxhash64("c2", "d", "c1").alias("x2"))


def prefixes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(conv_id, d, total, bytes, h1, h2, p1, p2)``: the hashes of each prefix and of the one a turn shorter.

    A prefix is the exclusive or of its turns' hashes, each of which knows its position; so it is a scan,
    done within chunks and then over the chunks of conversations that have several.
    """
    if (sizes.agg(F.max("total")).first()[0] or 0) >= CHUNK:
        rows = saved(rows)
        chunk = F.floor(F.col("d") / CHUNK).alias("chunk")
        sums = rows.where(F.col("total") >= CHUNK).groupBy("conv_id", chunk).agg(F.bit_xor("x1").alias("o1"), F.bit_xor("x2").alias("o2"))
        earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("conv_id", "chunk", *[F.bit_xor(c).over(earlier).alias(c) for c in ("o1", "o2")])
        rows = rows.withColumn("chunk", chunk).join(sums, ["conv_id", "chunk"], "left")
    else:
        rows = rows.withColumns({"chunk": F.lit(0).cast("long"), "o1": F.lit(0).cast("long"), "o2": F.lit(0).cast("long")})
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    h = [F.bit_xor(f"x{i}").over(so_far).bitwiseXOR(F.coalesce(f"o{i}", F.lit(0).cast("long"))).alias(f"h{i}") for i in (1, 2)]
    rows = rows.select("conv_id", "d", "total", "bytes", "x1", "x2", *h)
    return rows.select("conv_id", "d", "total", "bytes", "h1", "h2", *[F.col(f"h{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)])


# ---------------------------------------------------------------- nodes
def trie_nodes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(conv, d, h1, h2, p1, p2, n_convs, bytes, n_children, first_child)``, the root included."""
    nodes = rows.groupBy("d", "h1", "h2").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs")).select(zero.alias("d"), zero.alias("h1"), zero.alias("h2"), "conv", "n_convs", zero.alias("bytes"), none.alias("p1"), none.alias("p2")).where("n_convs > 0")
    nodes = saved(nodes.unionByName(root))
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"), F.min("conv").alias("first_child"))
    return nodes.join(kids, ["d", "h1", "h2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def with_parents(nodes: DataFrame, n: int) -> DataFrame:
    """``(conv, d, parent)`` of all nodes but the root. Parents of very many children, fewer than HOT, are broadcast."""
    key = ["d", "p1", "p2"]
    parents = nodes.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("parent"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > n // HOT).drop("n_children"))
    children = nodes.where("d > 0").select("conv", *key).join(hot, key, "left")
    rest = children.where("parent IS NULL").drop("parent").join(parents.where(F.col("n_children") <= n // HOT).drop("n_children"), key)
    return children.where("parent IS NOT NULL").unionByName(rest).select("conv", "d", "parent")


def with_siblings(children: DataFrame) -> DataFrame:
    """``(conv, d, parent, next)``: with the next child of the same parent by conv, if any.

    Children are sorted over all partitions; what follows a partition's last row is in the next one, of
    which the driver learns the first rows: two rows a partition.
    """
    order = ["parent", "d", "conv"]

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True
        schema = ["parent", "d", "conv", "next", "edge", "part"]

        def out(p, d, c, following, edge):
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(d), pa.array(c), following, pa.array(edge), pa.array(np.full(len(p), part))], schema)

        for b in batches:
            if not b.num_rows:
                continue
            p, d, c = (np.concatenate([[h], b.column(x).to_numpy()]).astype(np.int64) if held is not None else b.column(x).to_numpy() for x, h in zip(order, held or (0, 0, 0)))
            held = (p[-1], d[-1], c[-1])
            edge = np.zeros(len(p) - 1, np.int64)
            if first and len(edge):
                edge[0], first = 1, False
            same = (p[1:] == p[:-1]) & (d[1:] == d[:-1])
            yield out(p[:-1], d[:-1], c[:-1], pa.array(c[1:], mask=~same), edge)
        if held is not None:  # bit 1: first row of the partition, bit 2: its last
            p, d, c = (np.array([v], np.int64) for v in held)
            yield out(p, d, c, pa.array([None], pa.int64()), np.array([3 if first else 2], np.int64))

    rows = saved(children.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "parent long, d long, conv long, next long, edge long, part long"))
    edges = sorted(rows.where("edge > 0").collect(), key=lambda r: (r.part, r.edge == 2))
    follows = [(a.part, b.conv) for a, b in pairwise(edges) if a.part != b.part and (a.parent, a.d) == (b.parent, b.d)]
    patch = F.broadcast(rows.sparkSession.createDataFrame(follows, "part long, other long").withColumn("last", F.lit(True)))
    return rows.withColumn("last", F.col("edge") >= 2).join(patch, ["part", "last"], "left").select("conv", "d", "parent", F.coalesce("next", "other").alias("next"))


# ---------------------------------------------------------------- the tour
SUMS = ["arcs", "leaves", "saved"]


def _arc(conv: Column, leaves: int, depth: Column) -> Column:
    """An arc's name: (conv, 0, d) enters a node and (conv, 1, -d) leaves it, so that runs of a tour lie in sorted order."""
    return F.struct(conv.alias("c"), F.lit(leaves).cast("long").alias("k"), (-depth if leaves else depth).alias("p"))


def tour(nodes: DataFrame, siblings: DataFrame) -> DataFrame:
    """``(id, next, arcs, leaves, saved)``: the arcs of the Euler tour as a linked list, with what each adds."""
    d, conv, one, zero = F.col("d"), F.col("conv"), F.lit(1).cast("long"), F.lit(0).cast("long")
    enter = nodes.select(_arc(conv, 0, d).alias("id"), F.when(F.col("n_children") > 0, _arc(F.col("first_child"), 0, d + 1)).otherwise(_arc(conv, 1, d)).alias("next"), one.alias("arcs"), F.when(F.col("n_children") > 0, zero).otherwise(one).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    leave = siblings.select(_arc(conv, 1, d).alias("id"), F.when(F.col("next").isNotNull(), _arc(F.col("next"), 0, d)).otherwise(_arc(F.col("parent"), 1, d - 1)).alias("next"))
    end = nodes.where("d = 0").select(_arc(conv, 1, d).alias("id"), F.lit(None).cast("struct<c:long,k:long,p:long>").alias("next"))
    return enter.unionByName(leave.unionByName(end).select("*", one.alias("arcs"), zero.alias("leaves"), zero.alias("saved")))


def runs_of(arcs: DataFrame) -> DataFrame:
    """``(id, head, next, before_*, total_*)``: arcs in runs whose next arc is the next row in sorted order.

    ``head`` is a run's first arc and ``before_*`` what its earlier arcs add. A run's last arc alone has
    ``next`` and ``total_*``, what the run adds. Runs end with their partition.
    """
    names = ["c", "k", "p", "nc", "nk", "np", *SUMS]
    flat = arcs.select("id.*", *[F.col(f"next.{x}").alias(f"n{x}") for x in ("c", "k", "p")], *SUMS)
    arc = pa.struct([(x, pa.int64()) for x in ("c", "k", "p")])

    def named(parts, mask=None):
        return pa.StructArray.from_arrays([pa.array(x) for x in parts], fields=list(arc), mask=None if mask is None else pa.array(mask))

    def run(batches):
        held = None  # the last row, whose run may go on: its columns, the run's head, what came before it

        def emit(x, ended, head, before, tail):
            total = [pa.array(b + w, mask=~tail) for b, w in zip(before, x[6:])]
            return pa.RecordBatch.from_arrays([named(x[:3]), named(head), named(x[3:6], ~tail | ended), *map(pa.array, before), *total], ["id", "head", "next", *(f"before_{s}" for s in SUMS), *(f"total_{s}" for s in SUMS)])

        for b in batches:
            if not b.num_rows:
                continue
            ended = b.column("nc").is_null().to_numpy(zero_copy_only=False)
            x = [b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                x, ended = [np.concatenate([h, v]) for h, v in zip(held[0], x)], np.concatenate([held[1], ended])
            new = np.ones(len(ended), bool)
            new[1:] = ended[:-1] | (x[3][:-1] != x[0][1:]) | (x[4][:-1] != x[1][1:]) | (x[5][:-1] != x[2][1:])
            at = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            head, before = [v[at][run_of] for v in x[:3]], []
            for v in x[6:]:
                earlier = np.cumsum(v) - v
                before.append(earlier - earlier[at][run_of])
            if held is not None:
                begun = run_of == 0
                for v, h in zip(head, held[2]):
                    v[begun] = h
                for v, h in zip(before, held[3]):
                    v[begun] += h
            held = [v[-1:] for v in x], ended[-1:], [v[-1] for v in head], [v[-1] for v in before]
            if len(ended) > 1:
                yield emit([v[:-1] for v in x], ended[:-1], [v[:-1] for v in head], [v[:-1] for v in before], new[1:])
        if held is not None:
            yield emit(held[0], held[1], [np.array([v]) for v in held[2]], [np.array([v]) for v in held[3]], np.ones(1, bool))

    kind = "struct<c:long,k:long,p:long>"
    schema = f"id {kind}, head {kind}, next {kind}, " + ", ".join(f"{w}_{s} long" for w in ("before", "total") for s in SUMS)
    order = ["c", "k", "p"]
    return flat.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def rank_list(links: DataFrame, sums: list[str], finish: int | None = None, level: int = 0) -> DataFrame:
    """``(id, *sums)``: for each link of lists ``(id, next, *sums)`` the sums from it to its list's end.

    One link in STRIDE is a splitter, by a hash. All links jump along until the next splitter, in about
    log2(STRIDE ln n) rounds, of which each is written out; then the splitters alone are a list of a
    STRIDE-th the length. ``finish`` links or fewer, a fixed number, are ranked in one task.
    """
    finish = finish or FINISH
    kind = links.schema["id"].dataType.simpleString()
    columns = ["id", "next", *sums]
    if links.count() <= finish:

        def walk(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            key = lambda v: tuple(v.values()) if isinstance(v, dict) else v
            came = {key(r["next"]): r for r in rows if r["next"] is not None}
            out = []
            for r in (r for r in rows if r["next"] is None):
                far = [0] * len(sums)
                while r:
                    far = [f + r[s] for f, s in zip(far, sums)]
                    out.append({"id": r["id"], **dict(zip(sums, far))})
                    r = came.get(key(r["id"]))
            return pa.Table.from_pylist(out, table.select(["id", *sums]).schema)

        return links.select(*columns).groupBy(F.lit(True)).applyInArrow(walk, f"id {kind}, " + ", ".join(f"{s} long" for s in sums))

    splits = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(STRIDE)) == 0
    now = links.select(*columns)
    while True:
        goes_on = F.col("next").isNotNull() & ~splits("next")
        if now.where(goes_on).isEmpty():
            break
        far = now.where(~splits("id")).select(F.col("id").alias("next"), F.col("next").alias("after"), *[F.col(s).alias(f"far_{s}") for s in sums])
        jumped = now.where(goes_on).join(far, "next").select("id", F.col("after").alias("next"), *[(F.col(s) + F.col(f"far_{s}")).alias(s) for s in sums])
        now = saved(now.where(~goes_on).unionByName(jumped))
    chosen = saved(rank_list(saved(now.where(splits("id"))), sums, finish, level + 1))
    ranked = chosen.select(F.col("id").alias("next"), *[F.col(s).alias(f"far_{s}") for s in sums])
    others = now.where(~splits("id")).join(ranked, "next", "left").select("id", *[(F.col(s) + F.coalesce(f"far_{s}", F.lit(0))).alias(s) for s in sums])
    return chosen.unionByName(others)


def subtree_sums(nodes: DataFrame, siblings: DataFrame) -> DataFrame:
    """``(conv, d, enter_at, exit_at, n_leaves, saved_tokens)``: places on the tour from 0, and sums over each subtree, its top included."""
    arcs = saved(runs_of(tour(nodes, siblings)))
    links = saved(arcs.where("total_arcs IS NOT NULL").select(F.col("head").alias("id"), "next", *[F.col(f"total_{s}").alias(s) for s in SUMS]))
    ranks = saved(rank_list(links, SUMS))
    far = arcs.join(ranks.withColumnRenamed("id", "head"), "head").select(F.col("id.c").alias("conv"), F.abs("id.p").alias("d"), F.col("id.k").alias("k"), *[(F.col(s) - F.col(f"before_{s}")).alias(s) for s in SUMS])
    at = lambda s, k: F.max(F.when(F.col("k") == k, F.col(s)))
    both = far.groupBy("conv", "d").agg(*[at(s, k).alias(f"{s}{k}") for s in SUMS for k in (0, 1)])
    total = 2 * nodes.count()
    return both.select("conv", "d", (F.lit(total) - F.col("arcs0")).alias("enter_at"), (F.lit(total) - F.col("arcs1")).alias("exit_at"), (F.col("leaves0") - F.col("leaves1")).alias("n_leaves"), (F.col("saved0") - F.col("saved1")).alias("saved_tokens"))


# ---------------------------------------------------------------- who ends where
def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``(d, h1, h2, ends_sha256)`` of ``ends(d, h1, h2, conv_id)``: SHA-256 of each node's ids, ascending, comma-joined.

    SHA-256 reads its input in order, so one task reads a node's text; but sorting and writing the
    numbers, in pieces of IDS, is done by all, and the task holds one batch of pieces at a time.
    """
    order = ["d", "h1", "h2", "conv_id"]

    def write(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d, h1, h2, c = (b.column(x).to_numpy() for x in order)
            at = np.flatnonzero(starts(d, h1, h2))
            cut = np.concatenate([np.arange(a, z, IDS) for a, z in zip(at, np.append(at[1:], len(c)))])
            ids = [",".join(map(str, c[a:z].tolist())) for a, z in zip(cut, np.append(cut[1:], len(c)))]
            yield pa.RecordBatch.from_arrays([*(pa.array(v[cut]) for v in (d, h1, h2, c)), pa.array(ids)], [*order, "ids"])

    def digest(batches):
        key, h = None, None
        for b in batches:
            done = []
            for k, ids in zip(zip(*(b.column(x).to_pylist() for x in order[:3])), b.column("ids").to_pylist()):
                if k == key:
                    h.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            yield table(done)
        if key:
            yield table([(*key, h.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_pylist([dict(zip(("d", "h1", "h2", "ends_sha256"), r)) for r in rows], pa.schema([("d", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())]))

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "d long, h1 long, h2 long, conv_id long, ids string")
    return pieces.repartition("d", "h1", "h2").sortWithinPartitions(*order).mapInArrow(digest, "d long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt ``conversations(conv_id, turn, role, text)``.

    Columns: those of ``op11_prefix_trie``, and ``enter_at`` and ``exit_at``, the node's places on the tour.
    Rows without a conv_id belong to no conversation and are left out; null roles and texts are empty;
    turns of one number are ordered by a digest of role and text, so repeated rows are turns of their own.
    A table without conversations has no nodes, not even the root. Extra columns take no part.
    """
    turns = saved(numbered_turns(conversations))
    sizes = saved(conversation_sizes(turns))
    rows = saved(prefixes(rebuilt_turns(turns, sizes), sizes))
    nodes = saved(trie_nodes(rows, sizes))
    siblings = saved(with_siblings(with_parents(nodes, nodes.count())))
    sums = subtree_sums(nodes, siblings)
    zero = F.lit(0).cast("long")
    ends = rows.where("d = total").select("d", "h1", "h2", "conv_id").unionByName(sizes.where("total = 0").select(zero.alias("d"), zero.alias("h1"), zero.alias("h2"), "conv_id"))
    out = nodes.join(siblings.select("conv", "d", "parent"), ["conv", "d"], "left").join(sums, ["conv", "d"]).join(digests_of_ends(ends), ["d", "h1", "h2"], "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), "enter_at", "exit_at")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``; see ``prefix_trie``."""
    return prefix_trie(read(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


OP11_SQL = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT DISTINCT c, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT) AS bytes FROM t),
v AS (SELECT c, c - c % 5 AS b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, s: list_reduce(list_prepend(xor(a, s), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda w, z: xor(w >> 1, (w & 1) * 3988292384)))) % 9 AS h FROM u),
s AS (SELECT v.c, 0 AS z, k, r, x FROM v JOIN t ON t.c = v.b WHERE k <= h UNION ALL SELECT v.c, 1, k, r, x FROM v JOIN t ON t.c = v.c WHERE k > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY z, k) AS d, sha256(octet_length(encode(r)) || ':' || r || x) AS g, octet_length(encode(x)) AS n FROM s),
p AS (SELECT c, d, list(g) OVER (PARTITION BY c ORDER BY d) AS path, n FROM q UNION ALL SELECT c, 0, [], 0 FROM v),
nodes AS (SELECT d, path, min(c) AS conv, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved FROM p GROUP BY d, path),
m AS (SELECT p.c, p.d, nodes.conv FROM p JOIN nodes USING (d, path)),
kids AS (SELECT m.conv, m.d, count(*) AS n_children FROM nodes JOIN m ON m.c = nodes.conv AND m.d = nodes.d - 1 GROUP BY ALL),
sub AS (SELECT m.conv, m.d, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM nodes LEFT JOIN kids ON kids.conv = nodes.conv AND kids.d = nodes.d JOIN m ON m.c = nodes.conv AND m.d <= nodes.d GROUP BY ALL),
ends AS (SELECT m.conv, m.d, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends_sha256 FROM m JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) e USING (c, d) GROUP BY ALL)
SELECT nodes.conv AS conv_id, nodes.d::BIGINT AS depth, up.conv AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes LEFT JOIN m up ON up.c = nodes.conv AND up.d = nodes.d - 1 LEFT JOIN kids ON kids.conv = nodes.conv AND kids.d = nodes.d JOIN sub ON sub.conv = nodes.conv AND sub.d = nodes.d LEFT JOIN ends ON ends.conv = nodes.conv AND ends.d = nodes.d"""
