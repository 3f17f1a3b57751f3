"""Property graphs as two tables, ``nodes(id, label, name, content, ..)`` and ``edges(src, dst, type, ..)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.steps import kept


def directed(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """``(a, b, type)``: edges as steps from a to b, along, against or both ways."""
    edges = edges.where(F.col("type").isin(*types)) if types else edges
    along = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type")
    against = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type")
    return {"out": along, "in": against}.get(direction) if direction != "both" else along.unionByName(against)


def neighbors(edges: DataFrame, starts: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """G11. ``(id, other, type)``: the steps from some nodes."""
    return directed(edges, direction, types).join(starts.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("other"), "type")


def traverse(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """G07. ``(start, path, depth)``: all paths of 1 to ``depth`` steps that visit no node twice. Each level is written out, and
    the next starts from it."""
    steps = directed(edges, direction, types).select("a", "b").distinct()
    front = starts.select(F.col("id").alias("start"), F.array("id").alias("path"))
    out = None
    for d in range(1, depth + 1):
        at = front.withColumn("a", F.element_at("path", -1))
        front = at.join(steps, "a").where(~F.array_contains("path", F.col("b"))).select("start", F.concat("path", F.array("b")).alias("path"))
        front = kept(front) if d < depth else front
        level = front.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    return out


def reached(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """``(start, id, depth)``: nodes within some steps and the fewest it takes, the start itself at 0. Level by level, each node
    once a start, so nothing grows with the number of paths."""
    steps = directed(edges, direction, types).select("a", "b").distinct()
    seen = starts.select(F.col("id").alias("start"), "id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        new = front.select("start", F.col("id").alias("a")).join(steps, "a").select("start", F.col("b").alias("id")).distinct()
        front = kept(new.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def subgraph(edges: DataFrame, starts: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """G08. ``(start, id, depth)``: nodes within some steps either way, and the fewest."""
    return reached(edges, starts, depth, "both", types).where("depth > 0")


def shortest_path(edges: DataFrame, pairs: DataFrame, most: int = 5, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """G09. ``(a, b, depth)`` of the pairs ``(a, b)`` within ``most`` steps."""
    seen = reached(edges, pairs.select(F.col("a").alias("id")), most, direction, types)
    return pairs.distinct().join(seen.select(F.col("start").alias("a"), F.col("id").alias("b"), "depth"), ["a", "b"])


def all_paths(edges: DataFrame, pairs: DataFrame, most: int = 3, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """G10. ``(a, b, path)``: all paths between pairs."""
    paths = traverse(edges, pairs.select(F.col("a").alias("id")).distinct(), most, direction, types)
    return paths.withColumn("b", F.element_at("path", -1)).withColumnRenamed("start", "a").join(pairs.distinct(), ["a", "b"], "left_semi").select("a", "b", "path")


def chain_end(edges: DataFrame, types: list[str]) -> DataFrame:
    """G21. ``(id, last, depth)``: for each node with a newer version, the end of the longest chain of changes.

    Chains double at each step (a pointer jumps to where its target points) until no pointer moves, so a
    few joins suffice; a node that several others change takes the smallest. A node whose pointer never
    comes to an end leads into a cycle, which shows by a depth above the number of nodes: its ``last`` is
    the node after as many steps as that took, its depth their number. Steps are written to the
    checkpoint folder.
    """
    at = kept(edges.where(F.col("type").isin(*types)).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("last")).withColumn("depth", F.lit(1).cast("long")))
    n = at.count()
    while True:
        on = at.select(F.col("id").alias("k"), F.col("last").alias("further"), F.col("depth").alias("more"))
        # a depth above the number of nodes with a newer version: the pointer goes round in a cycle
        moves = F.col("further").isNotNull() & (F.col("depth") <= n)
        at = kept(at.join(on, F.col("last") == F.col("k"), "left").select("id", F.when(moves, F.col("further")).otherwise(F.col("last")).alias("last"), (F.col("depth") + F.when(moves, F.col("more")).otherwise(0)).alias("depth"), moves.alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("id", "last", F.col("depth").cast("int").alias("depth"))
        at = at.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; a component is named by its smallest node.

    Large-star and small-star steps in turn until nothing changes. Each takes minima by node and joins
    them back; a node with very many edges is never gathered. Null ends and self loops are ignored.
    """
    links = kept(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
        small = large.join(least, "a").select(F.inline(F.array(pair(F.col("b"), F.col("m")), pair(F.col("a"), F.col("m")))))
        links = kept(small.where("a != b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            roots = links.select(F.col("b").alias("node")).distinct()
            return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        before = now


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A06. ``(kind, name, n)``: counts by label, by type, and both totals."""
    part = lambda df, kind, c: df.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return part(nodes, "label", F.col("label")).unionByName(part(edges, "type", F.col("type"))).unionByName(part(nodes, "total", F.lit("nodes"))).unionByName(part(edges, "total", F.lit("edges")))


def nodes_by_type(nodes: DataFrame, label: str, **wanted) -> DataFrame:
    """G12."""
    out = nodes.where(F.col("label") == label)
    for k, v in wanted.items():
        out = out.where(F.col(k) == v)
    return out


def below(edges: DataFrame, roots: DataFrame, depth: int, type: str = "THUOC_VE") -> DataFrame:
    """``(root, id)``: nodes under some roots, up to a depth."""
    return reached(edges, roots, depth, "in", [type]).where("depth > 0").select(F.col("start").alias("root"), "id")


def related_articles(edges: DataFrame, articles: DataFrame | None = None, type: str = "MENTIONS") -> DataFrame:
    """G19. ``(a, b)`` with a < b: articles that name one entity; with ``articles(id)`` only pairs that hold one of those.

    Given articles go before the join, so an entity that very many name is met by theirs alone.
    """
    named = edges.where(F.col("type") == type).select("dst", "src").distinct()
    own = named if articles is None else named.join(articles.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("dst", "src")
    pairs = own.select("dst", F.col("src").alias("x")).join(named.select("dst", F.col("src").alias("y")), "dst")
    return pairs.where("x < y" if articles is None else "x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keyword_search_nodes(nodes: DataFrame, word: str, fields: dict[str, list[str]]) -> DataFrame:
    """P10. Nodes one of whose label's fields contains a word, whatever the case."""
    low = word.lower()
    hit = F.lit(False)
    for label, names in fields.items():
        for n in names:
            hit = hit | ((F.col("label") == label) & F.contains(F.lower(F.coalesce(F.col(n), F.lit(""))), F.lit(low)))
    return nodes.where(hit).withColumn("score", F.lit(1.0))


def scored_search(nodes: DataFrame, words: list[str], n: int) -> DataFrame:
    """P11. Three points for each word in the name, one for each in the content; the n best."""
    hits = lambda c: sum(F.when(F.contains(F.lower(F.col(c)), F.lit(w.lower())), 1).otherwise(0) for w in words)
    return nodes.withColumn("score", 3 * hits("name") + hits("content")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(n)


def shared_entities(mentions: DataFrame) -> DataFrame:
    """J08. ``(id, articles)``: entities that different articles name, and how many do."""
    return mentions.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("articles")).where("articles > 1")


def entity_stats(nodes: DataFrame, mentions: DataFrame, n: int = 5) -> DataFrame:
    """A07. The entities named most."""
    top = mentions.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("mentions")).orderBy(F.col("mentions").desc(), "id").limit(n)
    return top.join(nodes.select("id", "name"), "id")


def upsert_nodes(nodes: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("label", "id")) -> DataFrame:
    """S09. Merged by key: a property of the batch that is not null stands, else the old one."""
    rest = [c for c in nodes.columns if c not in keys]
    new = batch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest])
    return nodes.join(new, list(keys), "full_outer").select(*keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in rest])


def upsert_edges(edges: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """S10. Merged by ends and type; an edge of the batch is made only if both ends exist."""
    ids = nodes.select("id").distinct()
    ok = batch.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return upsert_nodes(edges, ok.select(*edges.columns), ("src", "dst", "type"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cascade: bool) -> tuple[DataFrame, DataFrame]:
    """S11. With cascade the nodes and their edges go; without it only nodes that have no edge."""
    gone = ids.select("id").distinct()
    if not cascade:
        used = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        gone = gone.join(used, "id", "left_anti")
    left = nodes.join(gone, "id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, kept


def upsert(target: DataFrame, batch: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """S05. One row a key: the one with the highest version; among equal versions the batch's stands."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("late").desc()))
    every = target.withColumn("late", F.lit(0)).unionByName(batch.withColumn("late", F.lit(1)))
    return every.withColumn("n", row).where("n = 1").drop("n", "late")


def fix_relations(relations: DataFrame, renamed: DataFrame, nodes: DataFrame) -> DataFrame:
    """J05, U03. Ends renamed by ``(old, new)``; without self loops, ends that are no nodes, and repeats."""
    at = lambda c: renamed.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"))
    out = relations.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "type").where("src != dst").distinct()
    ids = nodes.select("id").distinct()
    return out.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def merge_entities(entities: DataFrame, key: list[Column]) -> DataFrame:
    """A01, A03. One entity a key: the surest, with the widest span and the number merged."""
    best = F.max_by(F.struct("entity_id", "text"), F.struct("confidence", -F.col("entity_id")))
    out = entities.groupBy(*key).agg(best.alias("b"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.max("confidence").alias("confidence"), F.count("*").alias("merged"))
    return out.select("b.*", "start_pos", "end_pos", "confidence", "merged")


def valid_entities(entities: DataFrame, types: list[str], least: float = 0.7) -> DataFrame:
    """P07. Adds ``reason``: null for entities that are accepted."""
    reason = F.when(F.col("confidence") < least, "confidence").when(F.trim("text") == "", "empty").when(~F.col("type").isin(*types), "type")
    return entities.withColumn("reason", reason)
