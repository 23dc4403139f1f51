"""What callers see: SQL functions, whole pipelines, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, parsing
from ..functions.register import register
from ..operators import rules
from ..operators.relational import within_budget
from ..sources import contexts
from .q_parse import _py
from .registry import query


@query("sql_functions", "X16 F40 F46", "SELECT doc_id, 1.0::DOUBLE AS same, 0.95::DOUBLE AS health, 'low' AS level, 25 AS weight, 'c.py' AS base FROM documents")
def sql_functions(t):
    register(t.spark)
    d = t.documents.select("doc_id")
    return t.spark.sql("SELECT doc_id, round(cosine_of(array(1D, 2D), array(2D, 4D)), 9) AS same, line_health_of(10) AS health, risk_level_of(0.1D) AS level, severity_weight_of('critical') AS weight, basename_of('a/b/c.py') AS base FROM {d}", d=d)


@query("sql_table_functions", "X16 C1 C9", "SELECT p_partkey AS id, k.* FROM part, (VALUES ('function', 'f_', 4), ('class', 'C', 10)) AS k(kind, name, line)")
def table_functions(t):
    register(t.spark)
    return t.spark.sql("SELECT p.id, s.kind, regexp_replace(s.name, '[0-9]+$', '') AS name, s.start_line AS line FROM {p} p, LATERAL code_symbols(p.code, p.path) s", p=_py(t))


@query(
    "context_generated",
    "X7 G11",
    """WITH f AS (SELECT DISTINCT file FROM commits), d AS (SELECT array_to_string(string_split(file, '/')[1:2], '/') AS directory, count(*) AS n FROM f GROUP BY 1)
SELECT directory, 'Directory containing ' || n || ' files and 0 subdirectories.' AS description, n FROM d UNION ALL SELECT 'src', 'Directory containing 0 files and ' || (SELECT count(*) FROM d) || ' subdirectories.', 0 UNION ALL SELECT '', 'Directory containing 0 files and 1 subdirectories.', 0""",
    views="commits",
)
def generated(t):
    c = contexts.generated(t.commits.select("file").distinct(), "file")
    return c.select("directory", "description", F.size("files").cast("long").alias("n"))


@query(
    "context_updated",
    "X7 J24",
    """WITH r AS (SELECT array_to_string(string_split(file, '/')[1:2], '/') AS directory, sha, row_number() OVER (PARTITION BY array_to_string(string_split(file, '/')[1:2], '/') ORDER BY date DESC, sha DESC) AS r FROM commits) SELECT directory, array_to_string(list(sha ORDER BY r), ',') AS shas FROM r WHERE r <= 10 GROUP BY directory""",
    views="commits",
)
def updated(t):
    base = contexts.generated(t.commits.select("file").distinct(), "file").where("directory LIKE 'src/%'")
    return contexts.updated(base, t.commits).select("directory", F.array_join(F.transform("recent", lambda c: c["sha"].cast("string")), ",").alias("shas"))


_DIFF = "concat('+++ b/f', o_orderkey, '.py\\n@@ -1 +1,3 @@\\n+api_key = \\'abcdefghij', o_orderkey, '\\'\\n ctx\\n+x = open(request.path)\\n')"


@query(
    "review_findings",
    "X2 R4 U4 T4 C13",
    "SELECT 'f' || o_orderkey || '.py' AS file, k.* FROM orders, (VALUES (1, 'secret', 'critical', 0), (3, 'path_traversal', 'high', 1)) AS k(line, category, severity, rank)",
)
def review(t):
    d = t.dealt("orders").select(F.col("o_orderkey").alias("id"), F.expr(_DIFF).alias("text"))
    added = parsing.flat(d, parsing.added_lines, parsing.ADDED, "id", "text").select(F.struct("file", "line").alias("at"), "content")
    found = rules.multi_scan(added, fixed.REVIEW_PATTERNS, key="at", text="content").drop("line").select("*", "at.file", "at.line")
    from ..functions import scores

    return rules.deduped(found.select("file", "line", "category", "message", "severity"), [F.col("severity")], ["file"]).select("file", "line", "category", "severity", scores.severity_rank("severity").alias("rank"))


@query(
    "onboarding_path",
    "X3 T8 T13",
    """WITH f AS (SELECT source, max(length(text)) AS score, arg_max(left(text, 400), struct_pack(n := length(text), d := -doc_id)) AS snippet FROM documents GROUP BY source), t AS (SELECT * FROM f ORDER BY score DESC, source LIMIT 20)
SELECT source, score::INT AS score, total::BIGINT AS total FROM (SELECT *, sum(length(snippet)) OVER (ORDER BY score DESC, source ROWS UNBOUNDED PRECEDING) AS total FROM t) WHERE total <= 3000""",
)
def onboarding(t):
    n = F.length("text")
    best = t.documents.groupBy("source").agg(F.max(n).alias("score"), F.max_by(F.substring("text", 1, 400), F.struct(n, -F.col("doc_id"))).alias("snippet"))
    top = best.orderBy(F.desc("score"), "source").limit(20).withColumn("k", F.lit(1))
    return within_budget(top, ["k"], [F.desc("score"), F.asc("source")], F.length("snippet"), 3000).select("source", "score", "total")


@query("scan_pushdown", "S2 U7 P4", "SELECT DISTINCT file FROM commits WHERE ends_with(file, '.ts') AND (starts_with(file, 'src/m1') OR starts_with(file, 'src/m2'))", views="commits")
def pushdown(t):
    from ..functions import text as tx

    wanted = F.array_intersect(F.array(F.lit(".ts"), F.lit(".md")), F.array(*[F.lit(e) for e in fixed.SOURCE_EXTENSIONS]))
    f = t.commits.select("file").distinct()
    return f.where(F.array_contains(wanted, tx.suffix("file")) & (F.col("file").startswith("src/m1") | F.col("file").startswith("src/m2")))
