"""Documentation: gaps, order, references, reviews, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..sources import exports
from .registry import query

_E = """e AS (SELECT p_partkey AS id, p_brand AS file, p_name AS name, p_type, CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'module' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'typescript' END AS language,
p_size % 5 AS total, least(p_size % 3, p_size % 5) AS documented, p_size % 7 <> 0 AS has_doc, p_size AS description, p_size % 2 = 0 AS has_returns, p_size % 11 = 0 AS returns_nothing, p_size % 4 = 0 AS has_examples FROM part)"""


def _elements(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), "p_type",
        F.when(k % 4 == 0, "class").when(k % 4 == 1, "function").when(k % 4 == 2, "method").otherwise("module").alias("kind"),
        F.when(k % 3 == 0, "python").when(k % 3 == 1, "javascript").otherwise("typescript").alias("language"),
        (s % 5).alias("total"), F.least(s % 3, s % 5).alias("documented"), (s % 7 != 0).alias("has_doc"), s.alias("description"),
        (s % 2 == 0).alias("has_returns"), (s % 11 == 0).alias("returns_nothing"), (s % 4 == 0).alias("has_examples"),
    )


_Q = f"""{_E}, q AS (SELECT *, CASE WHEN has_doc THEN least(100.0::DOUBLE, 40.0::DOUBLE + CASE WHEN description >= 20 THEN 20.0 WHEN description >= 10 THEN 10.0 ELSE 0.0 END::DOUBLE + CASE WHEN total > 0 THEN documented::DOUBLE / total * 20.0 ELSE 20.0 END::DOUBLE
+ CASE WHEN kind NOT IN ('function', 'method') THEN 10.0 WHEN has_returns OR returns_nothing THEN 10.0 ELSE 0.0 END::DOUBLE + CASE WHEN has_examples THEN 10.0 ELSE 0.0 END::DOUBLE) ELSE 0.0::DOUBLE END AS quality FROM e)"""


def _quality(t):
    return _elements(t).withColumn("quality", scores.doc_quality("has_doc", "description", "documented", "total", "kind", "has_returns", "returns_nothing", "has_examples"))


@query("doc_quality", "F55 P23", f"WITH {_Q} SELECT id, round(quality, 6) AS quality, quality < 70 AS gap FROM q")
def quality(t):
    return _quality(t).select("id", F.round("quality", 6).alias("quality"), (F.col("quality") < 70).alias("gap"))


@query(
    "doc_gap_report",
    "A10 P23",
    f"WITH {_Q} SELECT coalesce(kind, language, 'all') AS name, count(*) AS elements, count(*) FILTER (quality < 70) AS gaps, round(avg(quality), 6) AS mean FROM q GROUP BY GROUPING SETS ((kind), (language), ())",
)
def gap_report(t):
    q = _quality(t)
    g = q.groupingSets([["kind"], ["language"], []], "kind", "language").agg(F.count("*").alias("elements"), F.sum(F.when(F.col("quality") < 70, 1).otherwise(0)).alias("gaps"), F.round(F.avg("quality"), 6).alias("mean"))
    return g.select(F.coalesce("kind", "language", F.lit("all")).alias("name"), "elements", "gaps", "mean")


@query("doc_gap_simple", "A11 F56", "WITH d AS (SELECT p_brand AS file, CASE WHEN length(trim(d)) > 20 THEN 100.0 WHEN length(trim(d)) > 0 THEN 50.0 ELSE 0.0 END::DOUBLE AS q FROM (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE repeat('d', p_size) END AS d FROM part)) SELECT file, round_even(coalesce(avg(q), 100.0), 1) AS mean FROM d GROUP BY file")
def gap_simple(t):
    doc = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.expr("repeat('d', p_size)"))
    return t.part.groupBy(F.col("p_brand").alias("file")).agg(F.bround(F.coalesce(F.avg(scores.simple_doc_quality(doc)), F.lit(100.0)), 1).alias("mean"))


@query(
    "doc_cross_refs",
    "J19 J15",
    """WITH e AS (SELECT c_custkey AS id, 'Cust' || c_custkey AS name, 'see cust' || (c_custkey * 7 % 1500) || ' and (CUST' || (c_custkey + 1) || '), also nation' || c_nationkey AS doc FROM customer)
SELECT DISTINCT d.id AS source, e.id AS target FROM e AS d JOIN e ON strpos(lower(d.doc), lower(e.name)) > 0 WHERE d.id <> e.id""",
)
def cross_refs(t):
    e = t.dealt("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Cust"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("see cust"), (F.col("c_custkey") * 7 % 1500).cast("string"), F.lit(" and (CUST"), (F.col("c_custkey") + 1).cast("string"), F.lit("), also nation"), F.col("c_nationkey").cast("string")).alias("doc"))
    return exports.cross_references(e)


@query("doc_export_order", "T11 S28", f"WITH {_E} SELECT id, file, (row_number() OVER (PARTITION BY file ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, name, id))::INT AS place FROM e")
def export_order(t):
    from pyspark.sql import Window

    return _elements(t).select("id", "file", F.row_number().over(Window.partitionBy("file").orderBy(exports.kind_order(), "name", "id")).alias("place"))


@query("doc_markdown_index", "S28", f"WITH {_E} SELECT file, '- [' || file || '](' || regexp_replace(file, '[/.]', '_', 'g') || '.md) (' || count(*) || ' elements)' AS line FROM e GROUP BY file")
def markdown_index(t):
    return exports.markdown_index(_elements(t))


@query("doc_markdown_pages", "S28 S29", f"WITH {_E} SELECT file, md5('# ' || file || chr(10) || chr(10) || string_agg('## ' || name || chr(10) || chr(10) || '*' || kind || '*' || chr(10) || chr(10) || p_type || chr(10), chr(10) ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, name, p_type)) AS digest FROM e GROUP BY file")
def pages(t):
    # Equal names come in order of their sections.
    return exports.markdown(_elements(t).withColumn("doc", F.col("p_type"))).select("file", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("doc_html_pages", "S29", None)
def html(t):
    p = exports.html(_elements(t).withColumn("doc", F.col("p_type")))
    return p.select("file", "name", F.length("content").alias("size"), F.col("content").endswith("</body></html>").alias("whole"))


_R = "r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'edited' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'Python' ELSE 'TypeScript' END AS language, o_orderpriority AS kind FROM orders)"


def _reviews(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("edited").alias("status"), F.when(F.col("o_custkey") % 2 == 0, "Python").otherwise("TypeScript").alias("language"), F.col("o_orderpriority").alias("kind"))


@query("doc_review_stats", "A18 P19 P20", f"WITH {_R} SELECT coalesce(status, language, kind, 'all') AS name, count(*) AS n, round(count(*) FILTER (status <> 'pending') * 100.0::DOUBLE / count(*), 6) AS progress FROM r GROUP BY GROUPING SETS ((status), (language), (kind), ())")
def review_stats(t):
    r = _reviews(t).withColumn("done", (F.col("status") != "pending").cast("int"))
    g = r.groupingSets([["status"], ["language"], ["kind"], []], "status", "language", "kind").agg(F.count("*").alias("n"), F.sum("done").alias("d"))
    return g.select(F.coalesce("status", "language", "kind", F.lit("all")).alias("name"), "n", F.round(scores.percent("d", "n"), 6).alias("progress"))


@query("doc_review_filters", "P19 P20", f"WITH {_R} SELECT id, status FROM r WHERE status IN ('approved', 'edited') AND lower(language) = 'python' AND kind = '2-HIGH' AND contains(id::VARCHAR, '7')")
def review_filters(t):
    r = _reviews(t).where(F.col("status").isin("approved", "edited") & (F.lower("language") == "python") & (F.col("kind") == "2-HIGH"))
    return r.where(F.contains(F.col("id").cast("string"), F.lit("7"))).select("id", "status")


@query(
    "doc_error_summary",
    "A19 X12",
    """WITH e AS (SELECT CASE event_id % 5 WHEN 0 THEN 'analysis' WHEN 1 THEN 'context' WHEN 2 THEN 'generation' WHEN 3 THEN 'export' ELSE 'other' END AS stage, event_type AS message FROM events),
c AS (SELECT stage, CASE stage WHEN 'analysis' THEN 'parsing' WHEN 'context' THEN 'context_analysis' WHEN 'generation' THEN 'llm_generation' WHEN 'export' THEN 'export' ELSE 'unknown' END AS category FROM e)
SELECT stage, category, count(*) AS n, CASE WHEN category = 'parsing' THEN 'high' WHEN category IN ('context_analysis', 'llm_generation') THEN 'medium' ELSE 'low' END AS severity, bool_and(category <> 'unknown') AS recoverable FROM c GROUP BY stage, category""",
)
def error_summary(t):
    from ..operators.errors import classified

    k = F.col("event_id") % 5
    e = t.events.select(F.when(k == 0, "analysis").when(k == 1, "context").when(k == 2, "generation").when(k == 3, "export").otherwise("other").alias("stage"), F.col("event_type").alias("message"))
    return classified(e).groupBy("stage", "category", "severity").agg(F.count("*").alias("n"), F.bool_and("recoverable").alias("recoverable"))


@query("doc_child_classes", "J16", "SELECT n_regionkey AS id, list(n_nationkey ORDER BY n_nationkey)::VARCHAR AS children FROM nation GROUP BY n_regionkey")
def child_classes(t):
    from ..operators.resolve import children

    c = children(t.nation.select(F.col("n_regionkey").alias("target_id"), F.col("n_nationkey").alias("source")))
    return c.select("id", F.concat(F.lit("["), F.array_join(F.transform("children", lambda x: x.cast("string")), ", "), F.lit("]")).alias("children"))


@query("doc_name_links", "J15 U8", "WITH f AS (SELECT p_name AS name, min(p_partkey) AS target FROM part GROUP BY p_name) SELECT DISTINCT l_suppkey AS source, target AS target_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN f ON f.name = p_name WHERE l_suppkey <> target")
def name_links(t):
    from ..operators.resolve import linked_names

    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("source"), F.col("p_name").alias("target"))
    return linked_names(d, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")))
