"""Things that come with Spark, beside what the engine needs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relational import full_merge, within_budget
from .registry import query


@query("rollup_events", "A9", "SELECT user_id % 10 AS grp, event_type, count(*) AS n FROM events GROUP BY ROLLUP (user_id % 10, event_type)")
def rollup(t):
    return t.events.withColumn("grp", F.col("user_id") % 10).rollup("grp", "event_type").agg(F.count("*").alias("n"))


@query("cube_docs", "A10 A18", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def cube(t):
    return t.documents.cube("lang", "source").agg(F.count("*").alias("n"))


@query("approx_distinct_users", "A25")
def approx(t):
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("percentiles", "F59", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles(t):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.99)), 6).alias("p99"))


@query("semi_anti_labels", "J18 J22", "SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) AS unlabelled")
def semi_anti(t):
    a = t.documents.join(t.labels, "doc_id", "left_semi").agg(F.count("*").alias("labelled"))
    return a.crossJoin(t.documents.join(t.labels, "doc_id", "left_anti").agg(F.count("*").alias("unlabelled")))


@query("setops_intersect_except", "U1 U2 U7", "SELECT 'both' AS what, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def setops(t):
    c, s = t.customer.select("c_nationkey"), t.supplier.select("s_nationkey")
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(c.intersect(s), "both").unionAll(n(t.customer.select("c_custkey").subtract(t.orders.select("o_custkey")), "customers only")).unionAll(n(c.union(s).distinct(), "either"))


@query("array_setops", "U2 U7", "SELECT source, array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(['en', 'it'], x))), ',') AS without, array_to_string(list_sort(list_filter(l, lambda x: list_contains(['en', 'it'], x))), ',') AS common FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source)")
def array_setops(t):
    g = t.documents.groupBy("source").agg(F.collect_set("lang").alias("l"))
    two = F.array(F.lit("en"), F.lit("it"))
    return g.select("source", F.array_join(F.array_sort(F.array_except("l", two)), ",").alias("without"), F.array_join(F.array_sort(F.array_intersect("l", two)), ",").alias("common"))


@query("asof_last_event", "J14", "SELECT a.event_id, arg_max(b.event_id, b.event_id) AS previous FROM events a ASOF JOIN events b ON a.user_id = b.user_id AND a.event_id > b.event_id GROUP BY a.event_id")
def asof(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", F.lag("event_id").over(w).alias("previous")).where("previous IS NOT NULL")


@query("full_outer_defaults", "J11 P29", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, -1) AS quality, coalesce(d.lang, '?') AS lang FROM documents d FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def full_outer(t):
    both = full_merge(t.documents.select("doc_id", "lang"), t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), ["doc_id"])
    return both.select("doc_id", F.coalesce("r.quality", F.lit(-1)).alias("quality"), F.coalesce("l.lang", F.lit("?")).alias("lang"))


@query("tpch_q1", "A7 A16", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2")
def q1(t):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("budget_by_customer", "T13", "SELECT o_custkey, o_orderkey, round(total, 2) AS total FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders) WHERE total <= 300000")
def budget(t):
    return within_budget(t.orders, ["o_custkey"], [F.col("o_orderkey")], F.col("o_totalprice"), 300000).select("o_custkey", "o_orderkey", F.round("total", 2).alias("total"))
