"""Rule scans over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..operators import rules
from .registry import query

_RULES = ", ".join(f"({i}, '{c}', '{p}', '{s}', '{m}')" for i, (c, p, s, m) in enumerate(fixed.TEXT_RULES))
_SCAN = rf"""r AS (SELECT * FROM (VALUES {_RULES}) AS v(rule_id, category, pattern, severity, message)),
l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
f AS (SELECT doc_id, line::INT AS line, rule_id, category, severity, message, regexp_extract(content, '(?i)(' || pattern || ')', 1) AS matched, trim(content) AS snippet, content FROM l, r WHERE regexp_matches(content, '(?i)(' || pattern || ')'))"""


def _findings(t):
    return rules.line_scan(t.documents, fixed.TEXT_RULES)


@query("rules_line_scan", "R1 F7 R10", f'WITH {_SCAN} SELECT doc_id, line, rule_id, severity, matched, (strpos(content, matched) - 1)::INT AS "column" FROM f')
def line_scan(t):
    return _findings(t).select("doc_id", "line", "rule_id", "severity", "matched", "column")


@query(
    "rules_multi_match",
    "R3 R4",
    rf"""WITH r AS (SELECT * FROM (VALUES {_RULES}) AS v(rule_id, category, pattern, severity, message)),
m AS (SELECT doc_id, category, message, severity, unnest(regexp_extract_all(coalesce(text, ''), '(?i)(' || pattern || ')', 1)) AS matched FROM documents, r) SELECT doc_id, category, message, severity, left(matched, 80) AS matched, count(*) AS n FROM m GROUP BY ALL""",
)
def multi(t):
    found = rules.multi_scan(t.documents, [(c, p, m, s) for c, p, s, m in fixed.TEXT_RULES])
    return found.groupBy("doc_id", "category", "message", "severity", "matched").agg(F.count("*").alias("n"))


@query("rules_multi_lines", "R3", None)
def multi_lines(t):
    """Lines of whole-text matches; a rule that can't cross lines must find what the line scan finds."""
    a = rules.multi_scan(t.documents, [("token", r"token\s*=", "Token in text")]).select("doc_id", "line").distinct()
    b = _findings(t).where("rule_id = 0").select("doc_id", F.col("line").alias("scanned"))
    return a.join(b, (a.doc_id == b.doc_id) & (a.line == b.scanned), "left").select(a.doc_id, "line", F.col("scanned").isNotNull().alias("right"))


@query(
    "rules_severity_hist",
    "A4 A5 A6",
    f"""WITH {_SCAN}, h AS (SELECT doc_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM f GROUP BY doc_id)
SELECT *, greatest(0.0::DOUBLE, least(100.0, 100.0 - (25 * critical + 10 * high + 3 * medium + low))::DOUBLE) AS score, greatest(0.0, 100.0 - (25 * critical + 10 * high + 3 * medium + low)) >= 70 AND critical = 0 AS passed FROM h""",
)
def hist(t):
    return rules.histogram(_findings(t), ["doc_id"]).withColumn("score", F.col("score").cast("double"))


@query(
    "rules_score",
    "A5 A6 F66",
    f"""WITH {_SCAN}, h AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) AS total, sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 3 ELSE 1 END) AS w FROM f)
SELECT total, greatest(0.0::DOUBLE, 100.0::DOUBLE - w) AS score, greatest(0.0, 100.0 - w) >= 70 AND critical = 0 AS passed, CASE WHEN total = 0 THEN 'No compliance violations found.' WHEN critical > 0 THEN 'Found ' || total || ' violation(s), ' || critical || ' critical.' ELSE 'Found ' || total || ' violation(s).' END AS summary FROM h""",
)
def score(t):
    h = rules.histogram(_findings(t))
    return h.select("total", F.col("score").cast("double").alias("score"), "passed", scores.compliance_summary("total", "critical").alias("summary"))


@query(
    "rules_dedupe_rank",
    "U4 T4",
    f"""WITH {_SCAN}, u AS (SELECT doc_id, category, message, severity, min(line) AS line FROM f GROUP BY ALL), d AS (SELECT DISTINCT ON (doc_id, category, left(message, 60), line) * FROM u)
SELECT doc_id, category, severity, line, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM d ORDER BY rank, doc_id, line""",
)
def dedupe(t):
    f = _findings(t).groupBy("doc_id", "category", "message", "severity").agg(F.min("line").alias("line"))
    both = f.unionByName(f)
    d = rules.deduped(both, [F.col("severity"), F.col("message")], ["doc_id"])
    return rules.ranked(d, [F.col("doc_id"), F.col("line")]).select("doc_id", "category", "severity", "line", scores.severity_rank("severity").alias("rank"))


@query("rules_category_group", "A35", f"WITH {_SCAN} SELECT category, count(*) AS n, count(DISTINCT doc_id) AS files, list(DISTINCT severity ORDER BY severity)::VARCHAR AS severities FROM f GROUP BY category")
def category(t):
    sev = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("severity")), ", "), F.lit("]"))
    return _findings(t).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files"), sev.alias("severities"))


@query("rules_worst_status", "A37", f"WITH {_SCAN} SELECT doc_id, CASE WHEN min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) <= 1 THEN 'flag' WHEN min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) = 2 THEN 'warn' ELSE 'clean' END AS status FROM f GROUP BY doc_id")
def worst(t):
    return rules.worst_status(_findings(t), "doc_id")


@query("rules_grep_limit", "R9", f"WITH {_SCAN} SELECT doc_id, line::INT AS line FROM l WHERE regexp_matches(content, 'license') ORDER BY doc_id, line LIMIT 20")
def grep(t):
    return rules.grep(t.documents, "license", limit=20).select("doc_id", "line")


@query("rules_read_lines", "R9", r"SELECT doc_id, md5(array_to_string(string_split(coalesce(text, ''), chr(10))[2:201], chr(10))) AS digest FROM documents")
def read(t):
    return rules.read_lines(t.documents, 2, 200).select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("rules_glob", "R9", r"SELECT DISTINCT file FROM commits WHERE regexp_matches(file, '^src/m[13]/f[^/]*\.py$')", views="commits")
def glob(t):
    files = t.commits.select("file").distinct()
    return rules.glob(files, "src/m1/f*.py", "file").union(rules.glob(files, "**/m3/f*.py", "file"))


@query("rules_secret_tokens", "R4 F22", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS s FROM documents) SELECT doc_id, left(s, 8) || '...' || right(s, 4) AS masked, count(*) AS n FROM m GROUP BY ALL""")
def secrets(t):
    from ..functions import text as tx

    m = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))).alias("s"))
    return m.select("doc_id", tx.masked("s").alias("masked")).groupBy("doc_id", "masked").agg(F.count("*").alias("n"))


@query(
    "rules_checks",
    "R8",
    f"WITH {_SCAN}, c AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in c) + ")" for c in fixed.CHECKS) + """) AS v(id, name, description, category, default_severity))
SELECT id, name, description, c.category, default_severity, (SELECT count(*) FROM f WHERE f.severity = c.default_severity) AS findings FROM c""",
)
def checks(t):
    """The registry of checks, each with the findings in documents that have its severity."""
    found = _findings(t).groupBy(F.col("severity").alias("default_severity")).agg(F.count("*").alias("findings"))
    return rules.checks_table(t.spark).join(found, "default_severity", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


@query(
    "rules_catalogue",
    "R10",
    "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n})" for c, n in sorted({c: sum(r[0] == c for r in fixed.RULES) for c, *_ in fixed.RULES}.items())) + ") AS v(category, n)) SELECT category, n, count(doc_id) AS documents FROM c LEFT JOIN documents ON contains(lower(text), split_part(category, '_', 1)) GROUP BY category, n",
)
def catalogue(t):
    """How many rules each category has (one that doesn't compile is left out), and how many documents name it."""
    sizes = rules.rules_table(t.spark, [*fixed.RULES, ("broken", "(", "high", "left out")]).groupBy("category").agg(F.count("*").cast("int").alias("n"))
    names = sorted({c for c, *_ in fixed.RULES})
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(c.split("_")[0])), c) for c in names]))
    told = t.documents.select(F.explode(named).alias("category")).groupBy("category").agg(F.count("*").alias("documents"))
    return sizes.join(told, "category", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


@query(
    "rules_complexity",
    "R5",
    "SELECT 'medium' AS severity, 'complexity' AS category, '`' || p_name || '` has cyclomatic complexity ' || p_size AS message, p_brand AS file_path, p_partkey AS line FROM part WHERE p_size > 10",
)
def complexity(t):
    f = t.part.select(F.col("p_name").alias("name"), F.col("p_size").alias("complexity"), F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("line"))
    return rules.complexity_findings(f)


_CODE = "CASE doc_id % 4 WHEN 0 THEN 'async def f(): await g()' WHEN 1 THEN 'async def f():\n try:\n  await g()\n except E: pass' WHEN 2 THEN 'def f(): log.info(1)' ELSE 'try { logger.error(1) } catch (e) {}' END"


@query("rules_unguarded_async", "R6", "SELECT doc_id, doc_id % 4 = 0 AS unguarded FROM documents")
def unguarded(t):
    return t.documents.select("doc_id", rules.unguarded_async(F.expr(_CODE.replace("\n", "\\n"))).alias("unguarded"))


@query(
    "rules_peer_patterns",
    "R7 A24",
    """WITH f AS (SELECT doc_id::VARCHAR AS name, doc_id % 4 AS k, source FROM documents), p AS (SELECT f.name, f.k, count(*) AS n, count(*) FILTER (g.doc_id % 4 IN (1, 3)) AS handled, count(*) FILTER (g.doc_id % 4 IN (2, 3)) AS logged FROM f JOIN documents g ON g.source = f.source GROUP BY 1, 2)
SELECT name, 'medium' AS severity, 'lacks error handling' AS message, round(handled / n::DOUBLE, 2) AS confidence FROM p WHERE k IN (0, 2) AND n >= 3 AND handled >= n * 0.6::DOUBLE
UNION ALL SELECT name, 'low', 'has no logging', round(logged / n::DOUBLE, 2) FROM p WHERE k IN (0, 1) AND n >= 3 AND logged >= n * 0.7::DOUBLE""",
)
def peers(t):
    code = F.expr(_CODE.replace("\n", "\\n"))
    f = t.documents.select(F.col("doc_id").cast("string").alias("name"), code.alias("code"), "source")
    # Peers share a source; what they have is counted once for each source and joined to its documents.
    per = f.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("code").rlike(r"\btry\b").cast("int")).alias("handled"), F.sum(F.col("code").rlike(r"(?i)\blog(?:ger)?\.(?:info|debug|warning|error|warn)\s*\(").cast("int")).alias("logged"))
    both = f.join(per, "source").where("n >= 3")
    a = both.where(~F.col("code").rlike(r"\btry\b") & (F.col("handled") >= F.col("n") * 0.6)).select("name", F.lit("medium").alias("severity"), F.lit("lacks error handling").alias("message"), F.round(F.col("handled") / F.col("n"), 2).alias("confidence"))
    b = both.where(~F.col("code").rlike(r"(?i)\blog(?:ger)?\.(?:info|debug|warning|error|warn)\s*\(") & (F.col("logged") >= F.col("n") * 0.7)).select("name", F.lit("low"), F.lit("has no logging"), F.round(F.col("logged") / F.col("n"), 2))
    return a.unionAll(b)
