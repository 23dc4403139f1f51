"""Trees of files, contexts, rules, statistics and decisions, written as files from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import shared_folder
from ..sources import files, tree
from .registry import query


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# A document is a file: its folder and its extension come from its number; some are empty, some end in a byte that is no UTF-8.
_PLACE = "CASE doc_id % 6 WHEN 0 THEN concat('src/', source, '/') WHEN 1 THEN 'src/node_modules/x/' WHEN 2 THEN '.git/' WHEN 3 THEN 'lib/_own/' WHEN 4 THEN 'lib/a/b/c/' ELSE '' END"
_NAME = "concat(CASE doc_id % 4 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE 'f' END, doc_id, CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.PY' WHEN 2 THEN '.ts' WHEN 3 THEN '.md' WHEN 4 THEN '.jsx' WHEN 5 THEN '' ELSE '.js' END)"
_FILES = f"f AS (SELECT {_PLACE} || {_NAME} AS path, {_NAME} AS name, doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS text, doc_id % 5 = 0 AS odd FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"


def _tree(t) -> str:
    root = _folder(t, "tree")
    body = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).cast("binary")
    rows = t.documents.where("source IS NOT NULL AND text IS NOT NULL").select(F.concat(F.expr(_PLACE), F.expr(_NAME)).alias("path"), F.when(F.col("doc_id") % 5 == 0, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body).alias("content"))
    tree.write(rows, root)
    return root


@query(
    "tree_files",
    "S1 S3",
    rf"""WITH {_FILES} SELECT path, (octet_length(encode(text)) + odd::INT)::BIGINT AS size, sha256(text || CASE WHEN odd THEN chr(65533) ELSE '' END) AS text_sha256 FROM f
WHERE regexp_matches(lower(path), '\.(py|js|jsx|ts|tsx)$') AND doc_id % 6 NOT IN (1, 2)""",
)
def tree_files(t):
    """The supported files outside of skipped folders, as text."""
    texts = files.texts(files.source_files(t.spark, _tree(t)))
    return texts.select("path", "size", F.sha2("text", 256).alias("text_sha256"))


@query("tree_files_below", "S1 S2", rf"""WITH {_FILES} SELECT path FROM f WHERE regexp_matches(lower(path), '\.py$') AND (path LIKE 'lib/a/%' OR path LIKE 'src/src1%') AND doc_id % 6 NOT IN (1, 2)""")
def below(t):
    """Files of one kind below some folders; no other folder is listed."""
    return files.source_files(t.spark, _tree(t), [".py"], ["lib/a/", "src/src1"]).select("path")


@query("tree_listing", "S33", f"WITH {_FILES} SELECT name, (octet_length(encode(text)) + odd::INT)::BIGINT AS size FROM f")
def listing(t):
    return files.listing(t.spark, _tree(t)).select("name", "size")


@query(
    "tree_walk",
    "S34",
    f"""WITH {_FILES}, k AS (SELECT * FROM f WHERE doc_id % 6 NOT IN (1, 2)), p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM k),
d AS (SELECT DISTINCT array_to_string(parts[:i], '/') AS path FROM p, range(1, 9) r(i) WHERE i < len(parts))
SELECT path, string_split(path, '/')[-1] AS name, 'directory' AS type, NULL::BIGINT AS size FROM d
UNION ALL SELECT path, name, 'file', (octet_length(encode(text)) + odd::INT)::BIGINT FROM k WHERE lower(path) LIKE '%.py' OR lower(path) LIKE '%.ts'""",
)
def walk(t):
    """All folders that are gone into, and the files with some suffixes."""
    found = tree.entries(t.spark, _tree(t))
    return tree.with_folders(found.where((F.col("type") == "directory") | tx.suffix("path").isin(".py", ".ts")))


@query(
    "context_inherited",
    "S17 F84",
    """WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), v AS (SELECT * FROM c WHERE source <> 'src3')
SELECT 'code/' || source || '/' || lang || '/f' || doc_id AS path, CASE WHEN v.source IS NULL THEN 'all' ELSE source END AS directory, CASE WHEN v.source IS NULL THEN 'everything' ELSE n || ' documents' END AS description
FROM documents LEFT JOIN v USING (source) WHERE source IS NOT NULL AND lang IS NOT NULL""",
)
def inherited(t):
    """Each file with the context of the nearest folder that has a valid one; the folder src3's is broken."""
    root = _folder(t, "contexts")
    per = t.documents.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    text = F.when(F.col("source") == "src3", F.lit("directory: [broken")).otherwise(F.concat(F.lit("directory: "), "source", F.lit("\ndescription: "), "n", F.lit(" documents\nfiles:\n  - name: f0\n    key_apis: [go]\n")))
    rows = per.select(F.concat(F.lit("code/"), "source", F.lit("/.context.yaml")).alias("path"), text.alias("content"))
    top = t.spark.range(1).select(F.lit("code/.context.yaml").alias("path"), F.lit("directory: all\ndescription: everything\n").alias("content"))
    tree.write(rows.unionAll(top), root)
    paths = t.documents.where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat_ws("/", F.lit("code"), "source", "lang", F.concat(F.lit("f"), "doc_id")).alias("path"))
    found = files.inherited(files.contexts_at(t.spark, root), paths)
    return found.select("path", "context.directory", "context.description")


@query(
    "rules_from_yaml",
    "S16 R10",
    """SELECT row_number() OVER (ORDER BY r_name, n_nationkey)::INT - 1 AS rule_id, r_name AS category, '\\b' || n_name || '\\b' AS pattern, CASE n_nationkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, n_name AS message
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""",
)
def yaml_rules(t):
    """A file of rules for each region, one of them broken, with a rule that doesn't compile in each."""
    root = _folder(t, "rules")
    severity = F.element_at(F.array(F.lit("critical"), F.lit("LOW"), F.lit("unheard")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    line = F.concat(F.lit("  - {pattern: '\\b"), "n_name", F.lit("\\b', severity: "), severity, F.lit(", message: '"), "n_name", F.lit("'}\n"))
    per = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r["line"]), "").alias("lines"))
    text = F.when(F.col("r_name") == "ASIA", F.lit("rules: {ASIA: [")).otherwise(F.concat(F.lit("rules:\n "), "r_name", F.lit(":\n"), "lines", F.lit("  - {pattern: '(', severity: high}\n")))
    tree.write(per.select(F.concat("r_name", F.lit(".yaml")).alias("path"), text.alias("content")), root)
    return files.rules(t.spark, root)


@query(
    "runtime_from_json",
    "S18 F59",
    "SELECT key, error_rate, avg_latency_ms, p99_latency_ms, request_count FROM runtime",
    views="runtime",
)
def runtime(t):
    """Statistics written as JSON objects, a file for each task, and read back; a broken file beside them gives nothing."""
    root = _folder(t, "runtime")
    one = F.to_json(F.map_from_entries(F.collect_list(F.struct("key", F.struct("error_rate", "avg_latency_ms", "p99_latency_ms", "request_count")))))
    rows = t.runtime.groupBy(F.pmod(F.xxhash64("key"), F.lit(7)).alias("part")).agg(one.alias("content")).select(F.concat(F.lit("stats-"), "part", F.lit(".json")).alias("path"), "content")
    tree.write(rows.unionAll(t.spark.range(1).select(F.lit("broken.json").alias("path"), F.lit('{"x": {').alias("content"))), root)
    return files.runtime_stats(t.spark, root).select("key", "error_rate", "avg_latency_ms", "p99_latency_ms", "request_count")


@query("decisions_from_json", "S19 F82", "SELECT 'd' || item_id AS id, text AS title, '' AS reasoning, 'active' AS status, 0 AS tags FROM benchmark WHERE text IS NOT NULL")
def decision_files(t):
    """A file of JSON for each decision, broken ones beside them, the newest first."""
    root = _folder(t, "decisions")
    rows = t.benchmark.where("text IS NOT NULL").select(F.concat("item_id", F.lit(".json")).alias("path"), F.to_json(F.struct(F.concat(F.lit("d"), "item_id").alias("id"), F.col("text").alias("title"))).alias("content"))
    broken = t.spark.range(2).select(F.concat(F.lit("broken"), "id", F.lit(".json")).alias("path"), F.lit('{"id": "x", "title').alias("content"))
    tree.write(rows.unionAll(broken), root)
    return files.decisions(t.spark, root, None).select("id", "title", "reasoning", "status", F.size("tags").alias("tags"))
