"""Graphs as edges (src, dst): reachability, centrality, order, neighbours. Loops run over the cluster."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut
from .relational import SMALL_ROWS, dealt_by, tasks_for, top_per

#: Rounds between tests of convergence.
EVERY = 4
#: Targets in one row of a node's links.
LINKS = 1024
#: Edges that one task orders, after chains and trees are gone: some 30 MB, however large the graph was.
SMALL_EDGES = 1 << 18


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def distances(edges: DataFrame, start, depth: int, reverse: bool = False, include_start: bool = False) -> DataFrame:
    """node, distance: the least number of steps from the start, at most `depth`."""
    spark = edges.sparkSession
    e = cut((reversed_edges(edges) if reverse else edges).select("src", "dst").distinct())
    e = dealt_by(e, tasks_for(spark, e.count()), "src")
    kind = edges.schema["src"].dataType
    frontier = spark.range(1).select(F.lit(start).cast(kind).alias("node"))
    seen = frontier.withColumn("distance", F.lit(0))
    for step in range(1, depth + 1):
        frontier = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = cut(seen.unionAll(frontier.withColumn("distance", F.lit(step))))
        frontier = seen.where(F.col("distance") == step).select("node")
        if frontier.isEmpty():
            break
    return seen if include_start else seen.where("distance > 0")


def closure_count(edges: DataFrame, start, depth: int) -> DataFrame:
    """How many different nodes walks of 1 to `depth` edges reach; the start counts if a cycle leads back."""
    e = cut(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    layer = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    reached = None
    for _ in range(depth):
        layer = cut(layer.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct())
        reached = layer if reached is None else reached.unionAll(layer)
    return reached.agg(F.count_distinct("node").alias("total_affected"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-6, fixed_rounds: int | None = None) -> DataFrame:
    """node, rank: power iteration, dangling rank spread over all nodes; uniform if it doesn't converge.

    A node's links are rows of some LINKS targets at most; a round joins them with what the nodes
    were given, a row each, and sums what they give. Dangling nodes give to null, which is no target, and of which a
    round knows what all nodes share. Convergence is tested every few rounds, so there may be up to three more than needed.

    fixed_rounds: exactly so many rounds, without a test for convergence.
    """
    e = cut(edges.select("src", "dst").distinct())
    degree = e.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = cut(e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node"))).distinct().join(degree, F.col("node") == F.col("src"), "left").select("node", "degree"))
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    tasks = tasks_for(edges.sparkSession, e.count())
    targets, keys = dealt_by(e.where("dst IS NOT NULL").select(F.col("src").alias("node"), "dst"), tasks, "node"), ["node"]
    hubs = nodes.where(F.col("degree") > LINKS)
    n_hubs = hubs.count()
    if n_hubs:
        targets = targets.join(F.broadcast(hubs) if n_hubs <= SMALL_ROWS else hubs, "node", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / LINKS)), F.lit(0)))
        keys = ["node", "part"]
    lists = targets.groupBy(*keys).agg(F.collect_list("dst").alias("to")).select("node", "to")
    kind = lists.schema["to"].dataType.simpleString()
    to_null = F.array(F.lit(None)).cast(kind)
    links = lists.join(nodes.where("degree IS NOT NULL"), "node").unionAll(nodes.where("degree IS NULL").select("node", to_null.alias("to"), F.lit(1).cast("long")))
    links = cut(links)
    # What links, or nodes, have as their rank after a round.
    ranked = lambda rows, given, base, name="rank": dealt_by(rows, tasks, "node").join(dealt_by(given, tasks, "dst"), F.col("node") == F.col("dst"), "left").withColumn(name, F.lit(alpha) * F.coalesce("given", F.lit(0.0)) + F.lit(base)).drop("dst", "given")
    ids, uniform = nodes.select("node"), F.lit(1.0 / n)
    rank, before = links.withColumn("rank", uniform), ids.withColumn("before", uniform)
    steps = rounds if fixed_rounds is None else fixed_rounds
    for step in range(steps):
        given = cut(rank.select(F.explode("to").alias("dst"), (F.col("rank") / F.col("degree")).alias("r")).groupBy("dst").agg(F.sum("r").alias("given")))
        loose = given.where("dst IS NULL").agg(F.sum("given")).first()[0] or 0.0
        base = alpha * loose / n + (1 - alpha) / n
        if fixed_rounds is None and (step % EVERY == EVERY - 1 or step == steps - 1):
            after = cut(ranked(before, given, base))
            if after.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < n * tolerance:
                return after.select("node", "rank")
        rank, before = ranked(links, given, base), ranked(ids, given, base, "before")
    return before.select("node", F.col("before").alias("rank")) if fixed_rounds is not None else ids.withColumn("rank", uniform)


#: Stands for the level of what is in or behind a cycle; longer than any path.
_ENDLESS = 1 << 60


def levels(edges: DataFrame, finish: int = SMALL_EDGES) -> DataFrame:
    """node, level: the round in which all that a node waits for is done; nodes in or behind cycles have -1.

    Edges lead from what comes first to what waits for it; those from a node to itself don't
    count.  A node's level is max(floor, level of p + w) over the edges (p, w) into it.  Where only
    one edge leads into a node, that is a function of its predecessor's level, and such functions
    are composed by pointer doubling: chains and trees of any depth take a number of rounds that
    grows with the logarithm of the depth.  What is left are the nodes with several edges, joined
    by longest edges that stand for whole paths; parallel ones become one, and it starts again.
    An edge from such a node to itself is a cycle.  Once `finish` edges at most are left, one task
    orders them; 0 leaves all of it to the cluster.  Graphs that stay a mesh of nodes with several
    edges (a deep ladder) lose one layer in each round.
    """
    scratch = Scratch(edges.sparkSession)
    edge = scratch.put(edges.select("src", "dst").where("src <> dst").distinct().withColumn("w", F.lit(1).cast("long")))
    left = scratch.put(edge.select(F.col("src").alias("node")).unionAll(edge.select(F.col("dst").alias("node"))).distinct().withColumn("floor", F.lit(0).cast("long")))
    known, stages = None, []
    n_left, n_edges = left.count(), edge.count()
    while n_left:
        if n_edges <= finish and (stages or known is not None or n_edges == 0):
            known = _both(known, _ordered(edge, left))
            break
        into = edge.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("p"), F.min("w").alias("w"))
        seen = left.join(into, F.col("node") == F.col("dst"), "left").select("node", "floor", F.coalesce("n", F.lit(0)).alias("n"), "p", "w")
        ready = (F.col("n") == 0) | (F.col("floor") >= _ENDLESS)
        single = ~ready & (F.col("n") == 1)
        # level(node) = max(c, level(anchor) + d); `end`: the anchor is ready (R) or has several edges (J).
        kind = F.when(ready, "R").when(single, None).otherwise("J")
        at = seen.select(
            "node",
            "floor",
            F.when(single, F.col("p")).otherwise(F.col("node")).alias("anchor"),
            F.when(single, F.col("floor")).otherwise(F.lit(0)).cast("long").alias("c"),
            F.when(single, F.col("w")).otherwise(F.lit(0)).cast("long").alias("d"),
            kind.alias("end"),
        )
        at = _doubled(scratch, scratch.put(at), n_left)
        roots = at.where("end = 'R' AND node = anchor").select(F.col("node").alias("anchor"), F.col("floor").alias("level"))
        level = F.when(F.col("end").isNull(), F.lit(_ENDLESS)).when(F.col("end") == "R", F.greatest("c", F.col("level") + F.col("d")))
        at = scratch.put(at.join(roots, "anchor", "left").withColumn("level", level))
        known = _both(known, at.where("level IS NOT NULL").select("node", "level"))
        stages.append(at.where("level IS NULL AND node <> anchor").select("node", "anchor", "c", "d"))
        # Edges into nodes with several edges come from anchors now, or raise the floor.
        joints = at.where("end = 'J' AND node = anchor").select("node", "floor")
        lead = edge.join(joints.select(F.col("node").alias("dst")), "dst").join(at.select(F.col("node").alias("src"), "anchor", "c", "d", "level"), "src")
        floor = F.when(F.col("anchor") == F.col("dst"), F.lit(_ENDLESS)).when(F.col("level").isNotNull(), F.col("level") + F.col("w")).otherwise(F.col("c") + F.col("w"))
        lead = scratch.put(lead.select("anchor", "dst", (F.col("d") + F.col("w")).alias("w"), floor.alias("floor"), F.col("level").isNull().alias("open")))
        raised = lead.groupBy(F.col("dst").alias("node")).agg(F.max("floor").alias("to"))
        left = scratch.put(joints.join(raised, "node", "left").select("node", F.least(F.greatest("floor", "to"), F.lit(_ENDLESS)).alias("floor")))
        edge = scratch.put(lead.where("open AND anchor <> dst").groupBy(F.col("anchor").alias("src"), "dst").agg(F.max("w").alias("w")))
        before, n_left, n_edges = n_left, left.count(), edge.count()
        if n_left == before:  # every node has several edges into it: all are in or behind cycles
            known = _both(known, left.select("node", F.lit(_ENDLESS).alias("level")))
            break
    if known is None:
        return left.select("node", F.lit(0).alias("level"))  # no rows
    for stage in reversed(stages):
        ends = known.select(F.col("node").alias("anchor"), "level")
        known = scratch.put(known.unionByName(stage.join(ends, "anchor").select("node", F.greatest("c", F.col("level") + F.col("d")).alias("level"))))
    result = scratch.keep(known.select("node", F.when(F.col("level") >= _ENDLESS, -1).otherwise(F.col("level")).cast("int").alias("level")))
    scratch.drop()
    return result


def _both(one: DataFrame | None, other: DataFrame) -> DataFrame:
    return other if one is None else one.unionByName(other)


def _doubled(scratch: Scratch, at: DataFrame, nodes: int) -> DataFrame:
    """Follows anchors to their ends; what has none after as many rounds as nodes have binary digits leads into a cycle."""
    done, open_ = at.where("end IS NOT NULL"), at.where("end IS NULL")
    for _ in range(nodes.bit_length() + 1):
        if open_.isEmpty():
            break
        ends = done.unionByName(open_).select(F.col("node").alias("anchor"), F.col("anchor").alias("far"), F.col("c").alias("far_c"), F.col("d").alias("far_d"), F.col("end").alias("far_end"))
        step = scratch.put(
            open_.join(ends, "anchor").select(
                "node", "floor", F.col("far").alias("anchor"), F.greatest("c", F.col("far_c") + F.col("d")).alias("c"), (F.col("d") + F.col("far_d")).alias("d"), F.col("far_end").alias("end")
            )
        )
        done, open_ = done.unionByName(step.where("end IS NOT NULL")), step.where("end IS NULL")
    return done.unionByName(open_)


def _ordered(edges: DataFrame, left: DataFrame) -> DataFrame:
    """node, level of few nodes with floors and weighted edges, in one task."""
    node = left.schema["node"].dataType
    rows = edges.select("src", "dst", "w").unionByName(left.select(F.lit(None).cast(node).alias("src"), F.col("node").alias("dst"), F.col("floor").alias("w")))

    def run(batches):
        after: dict = {}
        waits: dict = {}
        level: dict = {}
        for b in batches:
            for x, y, w in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if x is None:
                    level[y] = w
                    waits.setdefault(y, 0)
                else:
                    after.setdefault(x, []).append((y, w))
                    waits[y] = waits.get(y, 0) + 1
        final: dict = {}
        ready = [x for x, n in waits.items() if n == 0 or level[x] >= _ENDLESS]
        while ready:
            x = ready.pop()
            if x in final:
                continue
            final[x] = level[x]
            for y, w in after.get(x, ()):
                level[y] = max(level[y], level[x] + w)
                waits[y] -= 1
                if waits[y] == 0 or level[y] >= _ENDLESS:
                    ready.append(y)
        found = [final.get(x, _ENDLESS) for x in level]
        yield pa.RecordBatch.from_arrays([pa.array(list(level), to_arrow_type(node)), pa.array(found, pa.int64())], ["node", "level"])

    from pyspark.sql.pandas.types import to_arrow_type

    return rows.coalesce(1).mapInArrow(run, f"node {node.simpleString()}, level long")


def topological_order(edges: DataFrame) -> DataFrame:
    """node, level: first what waits for nothing, last what is in cycles; equals by name."""
    return levels(edges).orderBy((F.col("level") < 0), "level", "node")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree and out_degree over different edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def stats(nodes: DataFrame, edges: DataFrame, kind: str = "type") -> DataFrame:
    """Counts of nodes and edges of each type, and their totals."""
    part = lambda df, what: df.groupBy(kind).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.col(kind).cast("string").alias("kind"), "n")
    total = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("total").alias("kind"), "n")
    return part(nodes, "node").unionAll(total(nodes, "node")).unionAll(part(edges, "edge")).unionAll(total(edges, "edge"))


def neighbours(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, imports and imported_by: sorted neighbours either way."""
    e = edges.select("src", "dst").distinct()
    # With a limit no more than that is gathered of a node, however many neighbours it has.
    most = lambda key, other: e if limit is None else top_per(e, [key], [F.asc(other)], limit)
    out = most("src", "dst").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("imports"))
    back = most("dst", "src").groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("imported_by"))
    none = F.array().cast(f"array<{e.schema['src'].dataType.simpleString()}>")
    return out.join(back, "node", "full_outer").select("node", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def collapsed(edges: DataFrame, order: str) -> DataFrame:
    """One edge of each ordered pair: the last one's attributes."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e")).select("src", "dst", "_e.*")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both; where both have one, the new one's attributes."""
    rest = [c for c in old.columns if c not in ("src", "dst")]
    both = old.select("src", "dst", F.struct(*rest).alias("o")).join(new.select("src", "dst", F.struct(*rest).alias("n")), ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.coalesce("n", "o").alias("e")).select("src", "dst", "e.*")


def valid_edges(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select(key).distinct()
    return edges.join(ids.withColumnRenamed(key, "src"), "src", "left_semi").join(ids.withColumnRenamed(key, "dst"), "dst", "left_semi").select(*edges.columns)


def tree_edges(paths: DataFrame, path: str = "path") -> DataFrame:
    """Edges from each folder to what is in it, for all folders above the paths."""
    parts = F.split(F.col(path), "/")
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("src"), F.array_join(F.slice(parts, 1, i), "/").alias("dst"))))
    return paths.select(steps.alias("e")).select("e.*").distinct()


def visible(nodes: DataFrame, collapsed_folders: DataFrame, path: str = "path") -> DataFrame:
    """Nodes that lie in no collapsed folder."""
    parts = F.split(F.col(path), "/")
    above = nodes.select(path, F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))).alias("folder"))
    hidden = above.join(collapsed_folders.select(F.col(collapsed_folders.columns[0]).alias("folder")), "folder", "left_semi").select(path).distinct()
    return nodes.join(hidden, path, "left_anti")


def transposed_for_docs(dependencies: DataFrame) -> DataFrame:
    """Edges from what is used to what uses it: the order in which documentation is written."""
    return dependencies.select(F.col("target").alias("src"), F.col("source").alias("dst"))
