"""Health, structure, complexity, runtime."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..operators import resolve
from ..operators.relational import top_per
from .registry import query


@query(
    "health_linecount",
    "F46 F70 S4",
    r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS lines FROM documents), h AS (SELECT doc_id, lines, CASE WHEN lines = 0 THEN 0.80 WHEN lines < 50 THEN 0.95 WHEN lines <= 200 THEN 1.00 WHEN lines <= 500 THEN 0.85 WHEN lines <= 1000 THEN 0.65 ELSE 0.40 END::DOUBLE AS health FROM n)
SELECT doc_id, lines::INT AS lines, health, round_even(health * 10, 0)::INT AS bar, CASE WHEN health >= 0.8 THEN 'good' WHEN health >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM h""",
)
def linecount(t):
    text = F.coalesce("text", F.lit(""))
    n = t.documents.select("doc_id", (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("lines"))
    h = n.withColumn("health", scores.line_health("lines"))
    return h.select("doc_id", "lines", "health", scores.health_bar("health").alias("bar"), scores.health_band("health").alias("band"))


@query("health_newlines", "S4", "SELECT doc_id, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::INT AS newlines FROM documents")
def newlines(t):
    from ..functions import text as tx

    return t.documents.select("doc_id", tx.line_count(F.coalesce("text", F.lit(""))).alias("newlines"))


_F = "f AS (SELECT l_partkey AS file, avg(l_quantity) / 2 AS cc, max(l_quantity)::INT AS worst, sum(l_quantity)::BIGINT AS total, count(*) * 3 AS commits FROM lineitem GROUP BY 1)"


def _files(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("file")).agg((F.avg("l_quantity") / 2).alias("cc"), F.max("l_quantity").cast("int").alias("worst"), F.sum("l_quantity").cast("long").alias("total"), (F.count("*") * 3).alias("commits"))


@query(
    "health_route",
    "F47",
    f"""WITH {_F} SELECT file, round_even(greatest(0.0::DOUBLE, least(10.0::DOUBLE, 10.0::DOUBLE - CASE WHEN cc > 15 THEN 4.0 WHEN cc > 10 THEN 2.5 WHEN cc > 5 THEN 1.0 ELSE 0.0 END::DOUBLE - CASE WHEN commits > 100 THEN 2.0 WHEN commits > 50 THEN 1.0 ELSE 0.0 END::DOUBLE)) / 10, 1) AS health, cc > 10 AND commits > 30 AS hotspot FROM f""",
)
def route(t):
    return _files(t).select("file", scores.route_health("cc", "commits").alias("health"), scores.is_route_hotspot("cc", "commits").alias("hotspot"))


@query(
    "health_legacy",
    "F48 F49",
    f"""WITH {_F}, h AS (SELECT file, worst, commits // 10 AS churn, greatest(0, 100 - least(worst, 50) - least(2 * (commits // 10), 50)) AS health FROM f)
SELECT file, health::BIGINT AS health, health < 50 AND churn > 5 AS hotspot, CASE WHEN health >= 80 THEN 'none' WHEN health >= 60 THEN 'low' WHEN health >= 40 THEN 'medium' ELSE 'high' END AS priority,
CASE WHEN health >= 80 THEN NULL WHEN health >= 60 THEN 'Consider cleanup during next related change' WHEN health >= 40 AND churn > 10 THEN 'Schedule refactoring in next sprint' WHEN health >= 40 THEN 'Review for extraction opportunities' ELSE 'Prioritize refactoring immediately. Consider pair programming.' END AS action FROM h""",
)
def legacy(t):
    h = _files(t).withColumn("churn", F.floor(F.col("commits") / 10)).withColumn("health", scores.legacy_health("worst", "churn"))
    r = scores.recommendation("health", "churn")
    return h.select("file", F.col("health").cast("long").alias("health"), scores.is_legacy_hotspot("health", "churn").alias("hotspot"), r["priority"].alias("priority"), r["action"].alias("action"))


_S = "s AS (SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS root, count(DISTINCT lang) AS folders, (max(doc_id) % 2 = 0) AS has_git FROM documents GROUP BY source)"


def _structure(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("total"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("root"), F.count_distinct("lang").alias("folders"), (F.max("doc_id") % 2 == 0).alias("has_git"))


@query("structure_score_v1", "F52 A15", f"WITH {_S} SELECT source, total, root, folders, round(least(10.0::DOUBLE, CASE WHEN has_git THEN 2.0 ELSE 0.0 END::DOUBLE + (total - root)::DOUBLE / total * 8), 6) AS score FROM s")
def structure1(t):
    return _structure(t).select("source", "total", F.col("root").cast("long").alias("root"), "folders", F.round(scores.structure_v1("has_git", "total", "root"), 6).alias("score"))


@query("structure_score_v2", "F53 A15", f"WITH {_S} SELECT source, greatest(0.0, least(10.0, 5.0 + CASE WHEN has_git THEN 1.5 ELSE 0 END + CASE WHEN folders >= 3 THEN 1.5 WHEN folders >= 1 THEN 0.5 ELSE 0 END + CASE WHEN root::DOUBLE / total < 0.3 THEN 2.0 WHEN root::DOUBLE / total < 0.6 THEN 1.0 ELSE -1.0 END))::DOUBLE AS score FROM s")
def structure2(t):
    return _structure(t).select("source", scores.structure_v2("has_git", "folders", "total", "root").cast("double").alias("score"))


@query("hotspots_bottom10", "P21 T5", f"WITH {_F} SELECT file, round(least(1.0::DOUBLE, cc / 15), 6) AS health FROM f WHERE round(least(1.0::DOUBLE, cc / 15), 6) < 0.5 ORDER BY health, file LIMIT 10")
def hotspots(t):
    h = _files(t).select("file", F.round(F.least(F.lit(1.0), F.col("cc") / 15), 6).alias("health"))
    return h.where("health < 0.5").orderBy("health", "file").limit(10)


_KEYWORDS = "|".join(fixed.CONTROL_WORDS)


@query(
    "complexity_element",
    "F57 F69",
    rf"""WITH l AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(regexp_replace(coalesce(text, ''), '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS l FROM documents),
x AS (SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '\S') AND NOT starts_with(ltrim(x), '#') AND NOT starts_with(ltrim(x), '//'))) AS loc, len(regexp_extract_all(text, '\b({_KEYWORDS})\b')) + 1 AS flow, coalesce(list_max(list_transform(list_filter(l, lambda x: regexp_matches(x, '\S')), lambda x: length(regexp_extract(x, '^\s*')))), 0) AS indent FROM l)
SELECT doc_id, round_even(least(40.0::DOUBLE, loc::DOUBLE / 100 * 40) + least(40.0::DOUBLE, flow::DOUBLE / 20 * 40) + least(20.0::DOUBLE, (indent // 4)::DOUBLE / 5 * 20), 2) AS score FROM x""",
)
def element(t):
    return t.documents.select("doc_id", scores.element_complexity(F.coalesce("text", F.lit(""))).alias("score"))


@query(
    "complexity_test",
    "F58 F69",
    r"""WITH l AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(regexp_replace(coalesce(text, ''), '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS l FROM documents),
s AS (SELECT doc_id, round_even(1.0::DOUBLE + CASE WHEN text = '' THEN 0 ELSE len(l) END * 0.1::DOUBLE + len(list_filter(l, lambda x: contains(x, 'if ') OR contains(x, 'for ') OR contains(x, 'while ') OR contains(x, 'except ') OR contains(x, 'with '))), 2) AS score FROM l)
SELECT doc_id, score, CASE WHEN score > 10 THEN 'high' WHEN score > 5 THEN 'moderate' WHEN score > 0 THEN 'low' END AS label FROM s""",
)
def test(t):
    s = t.documents.select("doc_id", scores.test_complexity(F.coalesce("text", F.lit(""))).alias("score"))
    return s.withColumn("label", scores.complexity_label("score"))


@query("cc_rank", "F50 A16", f"WITH {_F} SELECT file, total, round(cc, 6) AS average, worst, CASE WHEN cc <= 5 THEN 'A' WHEN cc <= 10 THEN 'B' WHEN cc <= 20 THEN 'C' WHEN cc <= 30 THEN 'D' ELSE 'F' END AS rank FROM f")
def cc_rank(t):
    return _files(t).select("file", "total", F.round("cc", 6).alias("average"), "worst", scores.complexity_rank("cc").alias("rank"))


@query("cc_top_functions", "A16 T6", "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 10")
def cc_top(t):
    top = top_per(t.lineitem, ["l_suppkey"], [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 10)
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


_LEVEL = "CASE WHEN error_rate > 5 OR p99_latency_ms > 5000 THEN 'critical' WHEN error_rate > 1 OR p99_latency_ms > 2000 THEN 'warning' ELSE 'none' END"


@query(
    "runtime_alerts",
    "F59 F60",
    f"""SELECT key, error_rate, p99_latency_ms, {_LEVEL} AS level, CASE {_LEVEL} WHEN 'critical' THEN '🔴 CRITICAL:' WHEN 'warning' THEN '⚠️ WARNING:' ELSE '✅ Healthy:' END || ' | ' || CASE WHEN error_rate > 0 THEN 'Error rate: ' || format('{{:.1f}}', error_rate) || '%' ELSE 'No errors' END AS summary FROM runtime""",
    views="runtime",
)
def alerts(t):
    r = t.runtime.withColumn("level", scores.alert_level("error_rate", "p99_latency_ms"))
    short = F.split(scores.runtime_summary("level", "error_rate", "avg_latency_ms", F.lit(None).cast("string")), r" \| ")
    # The rate with one digit, as format() rounds halves in its own way.
    rate = F.when(F.col("error_rate") > 0, F.concat(F.lit("Error rate: "), F.format_string("%.1f", "error_rate"), F.lit("%"))).otherwise(short[1])
    return r.select("key", "error_rate", "p99_latency_ms", "level", F.concat_ws(" | ", short[0], rate).alias("summary"))


@query("runtime_unhealthy", "P22 A30", f"WITH l AS (SELECT {_LEVEL} AS level FROM runtime) SELECT count(*) AS total, count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'warning') AS warning FROM l WHERE level <> 'none'", views="runtime")
def unhealthy(t):
    r = t.runtime.withColumn("level", scores.alert_level("error_rate", "p99_latency_ms")).where("level <> 'none'")
    n = lambda s: F.sum(F.when(F.col("level") == s, 1).otherwise(0))
    return r.agg(F.count("*").alias("total"), F.coalesce(n("critical"), F.lit(0)).alias("critical"), F.coalesce(n("warning"), F.lit(0)).alias("warning"))


@query(
    "runtime_suffix_join",
    "J20 F19",
    r"""WITH f AS (SELECT DISTINCT file, regexp_replace(regexp_replace(file, '^/+', ''), '^(src/|lib/|app/)', '') AS p FROM commits), k AS (SELECT DISTINCT replace(file, 'src/', '') AS key FROM commits WHERE contains(file, 'm3') UNION SELECT DISTINCT 'deep/' || replace(file, 'src/', '') FROM commits WHERE contains(file, 'm4') UNION SELECT DISTINCT split_part(file, '/', 3) FROM commits WHERE contains(file, 'm5')),
j AS (SELECT file, key, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN p = key THEN 0 ELSE 1 END, key) AS r FROM f JOIN k ON p = key OR ends_with(p, key) OR ends_with(key, p)) SELECT f.file, j.key, length(j.key) AS requests FROM f LEFT JOIN j ON f.file = j.file AND r = 1""",
    views="commits",
)
def suffix_join(t):
    f = t.commits.select("file").distinct()
    bare = F.replace(F.col("file"), F.lit("src/"), F.lit(""))
    k = f.where(F.contains("file", F.lit("m3"))).select(bare.alias("key")).union(f.where(F.contains("file", F.lit("m4"))).select(F.concat(F.lit("deep/"), bare))).union(f.where(F.contains("file", F.lit("m5"))).select(F.split("file", "/")[2])).distinct()
    stats = k.withColumn("requests", F.length("key"))
    return resolve.nearest_runtime(f, stats, "file").select("file", "key", F.col("requests").cast("long").alias("requests"))


@query("eta", "F62 F67", "SELECT source, count(*) AS files, count(*) * 15.0::DOUBLE / 60 AS minutes, round(count(*) FILTER (lang = 'en') / count(*)::DOUBLE * 100, 6) AS percent FROM documents GROUP BY source")
def eta(t):
    g = t.documents.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("done"))
    return g.select("source", "files", scores.eta_minutes("files").alias("minutes"), F.round(scores.percent("done", "files"), 6).alias("percent"))


@query("service_health", "A36", "SELECT event_type, CASE WHEN bool_and(value > 1) THEN 'healthy' WHEN bool_or(value < 0.5) THEN 'unhealthy' ELSE 'degraded' END AS status FROM events GROUP BY event_type")
def service(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.when(F.bool_and(v > 1), "healthy").when(F.bool_or(v < 0.5), "unhealthy").otherwise("degraded").alias("status"))


@query("backoff", "F63", "SELECT l_linenumber AS attempt, count(*) AS n, 0.5::DOUBLE * pow(2.0, l_linenumber) AS seconds FROM lineitem GROUP BY l_linenumber")
def backoff(t):
    return t.lineitem.groupBy(F.col("l_linenumber").alias("attempt")).agg(F.count("*").alias("n")).withColumn("seconds", scores.backoff_seconds("attempt", 0.5))
