"""Graph queries over the parts that follow each other in orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import git, graph
from ..operators.relational import dealt_by
from ..session import cut
from .registry import query

_BFS = """b1 AS (SELECT DISTINCT src AS node, 1 AS distance FROM edges WHERE dst = 1 AND src <> 1),
b2 AS (SELECT DISTINCT e.src AS node, 2 AS distance FROM edges e JOIN b1 ON e.dst = b1.node WHERE e.src <> 1 AND e.src NOT IN (SELECT node FROM b1)),
b3 AS (SELECT DISTINCT e.src AS node, 3 AS distance FROM edges e JOIN b2 ON e.dst = b2.node WHERE e.src <> 1 AND e.src NOT IN (SELECT node FROM b1 UNION ALL SELECT node FROM b2)),
b4 AS (SELECT DISTINCT e.src AS node, 4 AS distance FROM edges e JOIN b3 ON e.dst = b3.node WHERE e.src <> 1 AND e.src NOT IN (SELECT node FROM b1 UNION ALL SELECT node FROM b2 UNION ALL SELECT node FROM b3)),
bfs AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4)"""

_RANKS = 12


def _pagerank_sql() -> str:
    out = [
        "nodes AS (SELECT DISTINCT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges))",
        "cnt AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "deg AS (SELECT src, count(*)::DOUBLE AS degree FROM edges GROUP BY src)",
        "p0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank, degree FROM nodes CROSS JOIN cnt LEFT JOIN deg ON node = src)",
    ]
    for i in range(1, _RANKS + 1):
        out.append(
            f"p{i} AS MATERIALIZED (SELECT a.node, 0.85::DOUBLE * (coalesce(g.given, 0) + (SELECT coalesce(sum(rank), 0) FROM p{i - 1} WHERE degree IS NULL) / n) + 0.15::DOUBLE / n AS rank, a.degree "
            f"FROM p{i - 1} a CROSS JOIN cnt LEFT JOIN (SELECT e.dst, sum(p.rank / p.degree) AS given FROM edges e JOIN p{i - 1} p ON p.node = e.src GROUP BY e.dst) g ON g.dst = a.node)"
        )
    return ",\n".join(out)


@query("graph_reverse_bfs", "G3 T3", f"WITH {_BFS} SELECT node, distance FROM bfs WHERE distance <= 3", views="edges")
def reverse_bfs(t):
    return graph.distances(t.edges, 1, 3, reverse=True)


@query(
    "graph_forward_closure",
    "G5 A1 U1 J2",
    """WITH c1 AS (SELECT DISTINCT dst AS node FROM edges WHERE src = 1), c2 AS (SELECT DISTINCT dst AS node FROM edges JOIN c1 ON src = node), c3 AS (SELECT DISTINCT dst AS node FROM edges JOIN c2 ON src = node)
SELECT count(DISTINCT node) AS total_affected FROM (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3)""",
    views="edges",
)
def closure(t):
    return graph.closure_count(t.edges, 1, 3)


@query("graph_pagerank", "G6", f"WITH {_pagerank_sql()} SELECT node, round(rank, 9) AS rank FROM p{_RANKS}", views="edges")
def pagerank(t):
    return graph.pagerank(t.edges, fixed_rounds=_RANKS).select("node", F.round("rank", 9).alias("rank"))


@query(
    "graph_blast_report",
    "G4 F43 F44 F45 T2 F31",
    f"""WITH {_BFS}, {_pagerank_sql()},
ch AS (SELECT l_partkey AS node, least(count(*) / 20.0::DOUBLE, 1.0) AS churn FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY GROUP BY 1),
x AS (SELECT bfs.node, distance, round(rank / (SELECT max(rank) FROM p{_RANKS}), 6) AS share, coalesce(churn, 0.0) AS churn FROM bfs JOIN p{_RANKS} USING (node) LEFT JOIN ch USING (node)),
y AS (SELECT *, round_even((1.0::DOUBLE / distance) * share * churn, 4) AS risk FROM x)
SELECT node, distance, risk, CASE WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS level,
concat_ws('; ', CASE WHEN distance = 1 THEN 'direct importer' ELSE distance || ' hops away' END, CASE WHEN share >= 0.7 THEN 'high centrality' WHEN share >= 0.3 THEN 'moderate centrality' END, CASE WHEN churn >= 0.7 THEN 'high recent churn' WHEN churn >= 0.3 THEN 'moderate recent churn' END) AS reason FROM y""",
    views="edges",
)
def blast(t):
    edges = cut(t.edges)
    near = graph.distances(edges, 1, 4, reverse=True)
    rank = graph.pagerank(edges, fixed_rounds=_RANKS)
    most = rank.agg(F.max("rank").alias("most"))
    last = t.lineitem.agg(F.max("l_shipdate").alias("now"))
    recent = t.lineitem.crossJoin(F.broadcast(last)).where(F.col("l_shipdate") >= F.col("now") - F.expr("INTERVAL 30 DAYS")).groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("commits"))
    x = near.join(rank, "node").join(recent, "node", "left").crossJoin(F.broadcast(most))
    x = x.withColumn("share", F.round(F.col("rank") / F.col("most"), 6)).withColumn("churn", scores.churn_factor("commits"))
    x = x.withColumn("risk", scores.risk("distance", "share", F.lit(1.0), "churn"))
    return x.select("node", "distance", "risk", scores.risk_level("risk").alias("level"), scores.risk_reason("distance", "share", "churn").alias("reason"))


@query(
    "graph_modules_affected",
    "A27",
    f"WITH {_BFS} SELECT p_brand AS module, count(*) AS files FROM bfs JOIN part ON p_partkey = node WHERE distance <= 2 GROUP BY p_brand",
    views="edges",
)
def modules(t):
    return graph.distances(t.edges, 1, 2, reverse=True).join(t.part, F.col("node") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("files"))


@query(
    "graph_reviewers",
    "J23 A28",
    f"""WITH {_BFS}, o AS (SELECT file, author, count(DISTINCT sha) AS commits FROM blame GROUP BY 1, 2), p AS (SELECT file, min(author) FILTER (commits = m) AS owner FROM (SELECT *, max(commits) OVER (PARTITION BY file) AS m FROM o) GROUP BY file),
f AS (SELECT node, row_number() OVER (ORDER BY distance, node) AS r FROM bfs WHERE distance <= 2 ORDER BY distance, node LIMIT 20)
SELECT owner AS reviewer, min(r) AS rank FROM f JOIN p ON file = node GROUP BY owner ORDER BY rank LIMIT 10""",
    views="edges blame",
)
def reviewers(t):
    top = graph.distances(t.edges, 1, 2, reverse=True).orderBy("distance", "node").limit(20)
    from pyspark.sql import Window

    ranked = top.withColumn("r", F.row_number().over(Window.orderBy("distance", "node")))
    owners = git.primary_owner(git.expertise_map(t.blame, t.tasks("lineitem")))
    return ranked.join(owners, F.col("node") == F.col("file")).groupBy(F.col("owner").alias("reviewer")).agg(F.min("r").cast("long").alias("rank")).orderBy("rank").limit(10)


@query(
    "graph_stats",
    "A3 G10",
    """WITH n AS (SELECT p_brand AS type FROM part WHERE p_partkey IN (SELECT src FROM edges UNION SELECT dst FROM edges)), e AS (SELECT CASE WHEN src < dst THEN 'up' ELSE 'down' END AS type FROM edges)
SELECT 'node' AS what, type AS kind, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'node', 'total', count(*) FROM n UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'edge', 'total', count(*) FROM e""",
    views="edges",
)
def stats(t):
    e = t.edges
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    nodes = t.part.join(ends, F.col("p_partkey") == F.col("id"), "left_semi").select(F.col("p_brand").alias("type"))
    return graph.stats(nodes, e.select(F.when(F.col("src") < F.col("dst"), "up").otherwise("down").alias("type")))


@query(
    "graph_degree",
    "G9",
    """WITH x AS (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY node""",
    views="edges",
)
def degree(t):
    return graph.degrees(t.edges)


@query(
    "graph_file_context",
    "J8 G10",
    """WITH o AS (SELECT src AS node, list(dst ORDER BY dst)[1:5] AS imports FROM edges GROUP BY src), b AS (SELECT dst AS node, list(src ORDER BY src)[1:5] AS imported_by FROM edges GROUP BY dst)
SELECT node, array_to_string(coalesce(imports, []), ',') AS imports, array_to_string(coalesce(imported_by, []), ',') AS imported_by FROM o FULL JOIN b USING (node)""",
    views="edges",
)
def file_context(t):
    n = graph.neighbours(t.edges, 5)
    return n.select("node", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"))


@query(
    "graph_module_overview",
    "J10 U9 G10",
    """WITH m AS (SELECT min(p_brand) AS brand FROM part WHERE contains(p_brand, '3')), f AS (SELECT p_partkey FROM part JOIN m ON p_brand = brand)
SELECT count(DISTINCT p_partkey) AS files, count(DISTINCT src) AS importers FROM f LEFT JOIN edges ON dst = p_partkey""",
    views="edges",
)
def overview(t):
    name = t.part.where(F.contains("p_brand", F.lit("3"))).agg(F.min("p_brand").alias("brand"))
    f = t.part.join(F.broadcast(name), F.col("p_brand") == F.col("brand")).select("p_partkey")
    return f.join(t.edges, F.col("dst") == F.col("p_partkey"), "left").agg(F.count_distinct("p_partkey").alias("files"), F.count_distinct("src").alias("importers"))


@query(
    "graph_edge_lastwins",
    "G2",
    """WITH x AS (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey AS seq, l_returnflag AS kind FROM lineitem) SELECT src, dst, max(seq) AS seq FROM x GROUP BY src, dst""",
)
def lastwins(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("seq"))
    return graph.collapsed(e, "seq")


@query(
    "graph_merge",
    "J21 G1",
    """WITH a AS (SELECT src, dst, 'import' AS kind FROM edges), b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'owns' AS kind FROM lineitem)
SELECT kind, count(*) AS n FROM (SELECT coalesce(b.kind, a.kind) AS kind FROM a FULL JOIN b USING (src, dst)) GROUP BY kind""",
    views="edges",
)
def merge(t):
    a = t.edges.withColumn("kind", F.lit("import"))
    tasks = t.tasks("lineitem")
    b = dealt_by(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), tasks, "src", "dst").distinct().withColumn("kind", F.lit("owns"))
    return graph.merged(a, b).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "graph_toposort_level",
    "G7 G8",
    """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS src, 1000 + n_nationkey AS dst FROM nation UNION SELECT DISTINCT 1000 + c_nationkey, 100000 + c_custkey FROM customer UNION SELECT DISTINCT 100000 + o_custkey, 10000000 + o_orderkey FROM orders),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), l0 AS (SELECT node FROM n WHERE node NOT IN (SELECT dst FROM e)),
l AS (SELECT node, 0 AS level FROM l0 UNION ALL SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node)
SELECT node::BIGINT AS node, max(level)::INT AS level FROM l GROUP BY node""",
)
def toposort(t):
    e = t.nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 1000).cast("long").alias("dst"))
    e = e.unionAll(t.customer.select((F.col("c_nationkey") + 1000).cast("long"), F.col("c_custkey") + 100000)).unionAll(t.orders.select(F.col("o_custkey") + 100000, F.col("o_orderkey") + 10000000))
    used = graph.transposed_for_docs(e.select(F.col("dst").alias("source"), F.col("src").alias("target")))
    return graph.levels(used)


@query(
    "graph_deep_levels",
    "G7 G8",
    """WITH k AS (SELECT DISTINCT o_orderkey AS k FROM orders), c AS (SELECT a.k FROM k a JOIN k b ON b.k = a.k + 1), n AS (SELECT k FROM c UNION SELECT k + 1 FROM c),
i AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM n), s AS (SELECT k, island, min(k) OVER (PARTITION BY island) AS first, max(k) OVER (PARTITION BY island) AS last FROM i),
ring AS (SELECT island, min(k - 3) AS ring FROM s WHERE k % 5000 = 4999 AND k - 3 >= first GROUP BY island)
SELECT k AS node, CASE WHEN k >= ring THEN -1 ELSE k - first END::INT AS level FROM s LEFT JOIN ring USING (island)""",
)
def deep(t):
    """A chain over each stretch of following orders, with shortcuts and a few rings, ordered by the cluster alone."""
    k = t.orders.select(F.col("o_orderkey").alias("src")).distinct()
    chain = k.select("src", (F.col("src") + 1).alias("dst")).join(k.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
    chain = graph.cut(chain)
    inside = chain.select(F.explode(F.array("src", "dst")).alias("k")).distinct()
    # A shortcut or a ring stays within a stretch: all steps that it leaps over are there.
    leap = lambda rows, back, by: rows.select(F.explode(F.sequence(F.lit(0), F.lit(by - 1))).alias("j"), "k").select("k", (F.col("k") - by + F.col("j") if back else F.col("k") + F.col("j")).alias("src")).join(chain, "src").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") == by).select(F.col("k").alias("src"), (F.col("k") - by if back else F.col("k") + by).alias("dst"))
    shortcuts = leap(inside.where("k % 7 = 0"), False, 5)
    rings = leap(inside.where("k % 5000 = 4999"), True, 3)
    return graph.levels(chain.unionAll(shortcuts).unionAll(rings), finish=0)


@query("graph_valid_edges", "J18", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def valid(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    nodes = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    ids = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    return e.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(ids, "dst", "left_semi").agg(F.count("*").alias("n"))


@query(
    "graph_tree_edges",
    "G11",
    """WITH f AS (SELECT DISTINCT file FROM commits), p AS (SELECT string_split(file, '/') AS p FROM f), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p)
SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS src, array_to_string(p[1:i], '/') AS dst FROM x""",
    views="commits",
)
def tree(t):
    return graph.tree_edges(t.commits.select("file").distinct(), "file")


@query("graph_visible_nodes", "P27", "SELECT DISTINCT file FROM commits WHERE NOT starts_with(file, 'src/m3/') AND NOT starts_with(file, 'src/m7/')", views="commits")
def visible(t):
    folders = t.spark.createDataFrame([("src/m3",), ("src/m7",)], "folder string")
    return graph.visible(t.commits.select("file").distinct(), folders, "file")
