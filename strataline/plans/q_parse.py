"""Parsers, over code made from rows of tables, so that SQL knows what they must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, scores
from ..operators import resolve
from .registry import query

_PY = (
    "concat('import os\\nfrom pkg.m', p_size, ' import thing\\n\\ndef f_', p_partkey, '(a, b=', p_size, '):\\n    \"\"\"Doc of ', p_partkey, ' is here for it.\"\"\"\\n    if a and b:\\n        return a\\n    return eval(b)\\n\\n"
    "class C', p_partkey, '(Base):\\n    def m(self, x):\\n        return x\\n')"
)
_JS = (
    "concat('import x from \\'./y', p_size, '\\'\\nconst z = require(\\'lib', p_size, '\\')\\n/** Says it. */\\nexport function f', p_partkey, '(a, b = 1) {\\n  if (a) { return b }\\n}\\n\\nclass K', p_partkey, ' extends Base {\\n}\\n')"
)


def _py(t):
    return t.dealt("part").select(F.col("p_partkey").alias("id"), F.expr(_PY).alias("code"), F.lit("a.py").alias("path"))


def _js(t):
    return t.dealt("part").select(F.col("p_partkey").alias("id"), F.expr(_JS).alias("code"), F.lit("a.ts").alias("path"))


def _flat(df, parse, schema):
    return parsing.flat(df, parse, schema, "id", "code", "path")


@query("parse_py_chunks", "C1 C3 C6 W8", "SELECT p_partkey AS id, k.* FROM part, (VALUES ('module', 1, 5), ('function', 2, 10), ('class', 8, 12)) AS k(chunk_type, start_line, end_line)")
def py_chunks(t):
    return _flat(_py(t), parsing.chunks, parsing.CHUNK).drop("text")


@query("parse_js_chunks", "C2 C19 W9", "SELECT p_partkey AS id, k.* FROM part, (VALUES ('function', 2, 8), ('class', 6, 9), ('module', 1, 5)) AS k(chunk_type, start_line, end_line)")
def js_chunks(t):
    return _flat(_js(t), parsing.chunks, parsing.CHUNK).drop("text")


@query("parse_symbols", "C8", "SELECT p_partkey AS id, 'f_' || p_partkey AS name, 'function' AS kind, 4 AS start_line, 8 AS end_line FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey, 'class', 10, 12 FROM part")
def symbols(t):
    return _flat(_py(t), parsing.symbols, parsing.SYMBOL)


@query("parse_blocks", "C7 C14", "SELECT p_partkey AS id, 'f_' || p_partkey AS name, 'function' AS block_type, NULL::VARCHAR AS parent_class, 4 AS start_line, 8 AS end_line FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey, 'class', NULL, 10, 12 FROM part UNION ALL SELECT p_partkey, 'm', 'method', 'C' || p_partkey, 11, 12 FROM part")
def blocks(t):
    return _flat(_py(t), parsing.blocks, parsing.BLOCK)


@query(
    "parse_imports",
    "C9",
    "SELECT p_partkey AS id, 'py' AS lang, 'os' AS specifier, 'absolute' AS import_type, 1 AS line FROM part UNION ALL SELECT p_partkey, 'py', 'pkg.m' || p_size, 'absolute', 2 FROM part UNION ALL SELECT p_partkey, 'js', './y' || p_size, 'relative', 1 FROM part UNION ALL SELECT p_partkey, 'js', 'lib' || p_size, 'external', 2 FROM part",
)
def imports(t):
    a = _flat(_py(t), parsing.imports, parsing.IMPORT).withColumn("lang", F.lit("py"))
    return a.unionByName(_flat(_js(t), parsing.imports, parsing.IMPORT).withColumn("lang", F.lit("js")))


@query("parse_dependencies", "C10", "SELECT kind, target, count(*) AS n FROM (SELECT k.* FROM part, (VALUES ('import', 'os'), ('call', 'eval'), ('base', 'Base')) AS k(kind, target) UNION ALL SELECT 'import', 'pkg.m' || p_size FROM part UNION ALL SELECT 'import', 'pkg.m' || p_size || '.thing' FROM part) GROUP BY 1, 2")
def dependencies(t):
    return _flat(_py(t), parsing.dependencies, parsing.DEPENDENCY).groupBy("kind", "target").agg(F.count("*").alias("n"))


@query("parse_signatures", "C12", "SELECT p_partkey AS id, 'f_' || p_partkey AS symbol, 'a,b' AS params, 'a' AS required FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey || '.m', 'x', 'x' FROM part UNION ALL SELECT p_partkey, 'f' || p_partkey, 'a,b', 'a' FROM part")
def signatures(t):
    rows = _flat(_py(t).unionByName(_js(t)), parsing.signatures, parsing.SIGNATURE)
    return rows.select("id", "symbol", F.array_join("params", ",").alias("params"), F.array_join("required", ",").alias("required"))


@query(
    "parse_elements",
    "C15 C16 C17 C18 A16",
    "SELECT p_partkey AS id, 'f_' || p_partkey AS name, 'function' AS kind, true AS has_doc, 3 AS complexity FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey, 'class', false, 1 FROM part UNION ALL SELECT p_partkey, 'm', 'method', false, 1 FROM part UNION ALL SELECT p_partkey, 'f' || p_partkey, 'function', true, 2 FROM part UNION ALL SELECT p_partkey, 'K' || p_partkey, 'class', false, 1 FROM part",
)
def elements(t):
    return _flat(_py(t).unionByName(_js(t)), parsing.elements, parsing.ELEMENT).select("id", "name", "kind", "has_doc", "complexity")


@query("parse_variables", "C11", "SELECT p_partkey AS id, count(*) AS n FROM part, range(9) GROUP BY 1")
def variables(t):
    return _flat(_py(t), parsing.variables, parsing.VARIABLE).groupBy("id").agg(F.count("*").alias("n"))


_OLD = "concat('def f(a, b) -> int:\\n    return 1\\n')"
_NEW = "concat(CASE p_size % 5 WHEN 0 THEN 'x = 1' WHEN 1 THEN 'def f(a, b, c) -> int:\\n    return 1' WHEN 2 THEN 'def f(a) -> int:\\n    return 1' WHEN 3 THEN 'def f(a, b) -> str:\\n    return 1' ELSE 'def f(a, b, *args, c=2) -> int:\\n    return 1' END, CASE WHEN p_size % 2 = 0 THEN '\\ndef g(): pass\\n' ELSE '\\n' END)"


@query(
    "api_diff_py",
    "J13 C12 A32 U2",
    """SELECT p_partkey AS id, 'f' AS symbol, CASE p_size % 5 WHEN 0 THEN 'removed_function' WHEN 1 THEN 'added_required_param' WHEN 2 THEN 'removed_param' ELSE 'changed_return_type' END AS change_type, 'breaking' AS severity,
CASE p_size % 5 WHEN 0 THEN '`f` was removed.' WHEN 1 THEN '`f` gained required parameter(s): `c`.' WHEN 2 THEN '`f` removed parameter(s): `b`.' ELSE '`f` return type changed from `int` to `str`.' END AS description FROM part WHERE p_size % 5 <> 4
UNION ALL SELECT p_partkey, 'g', 'added_function', 'non-breaking', '`g` was added.' FROM part WHERE p_size % 2 = 0""",
)
def api_diff(t):
    side = lambda code: _flat(t.dealt("part").select(F.col("p_partkey").alias("id"), F.expr(code).alias("code"), F.lit("a.py").alias("path")), parsing.signatures, parsing.SIGNATURE)
    return resolve.api_changes(side(_OLD), side(_NEW), ["id"])


@query("api_diff_js", "J13 C12 F83", "SELECT p_partkey AS id, 'f' AS symbol, CASE WHEN p_size % 2 = 0 THEN 'added_required_param' ELSE 'removed_param' END AS change_type FROM part")
def api_diff_js(t):
    side = lambda code: _flat(t.dealt("part").select(F.col("p_partkey").alias("id"), code.alias("code"), F.lit("a.ts").alias("path")), parsing.signatures, parsing.SIGNATURE)
    new = F.when(F.col("p_size") % 2 == 0, "export const f = async (a, b = 1, c) => {\n}\n").otherwise("function f(a) {\n}\n")
    return resolve.api_changes(side(F.lit("export function f(a, b = 1) {\n}\n")), side(new), ["id"]).select("id", "symbol", "change_type")


_DIFF = "concat('diff --git a/f b/f\\n--- a/f', o_orderkey, '.py\\n+++ b/f', o_orderkey, '.py\\n@@ -1,2 +5,3 @@\\n ctx\\n+added ', o_custkey, '\\n-gone\\n+more\\n@@ -20 +', 30 + o_orderkey % 5, ' @@\\n+last\\n')"


@query("diff_parse", "C13 S15", "SELECT o_orderkey AS id, 'f' || o_orderkey || '.py' AS file, 6 AS line, 'added ' || o_custkey AS content FROM orders UNION ALL SELECT o_orderkey, 'f' || o_orderkey || '.py', 7, 'more' FROM orders UNION ALL SELECT o_orderkey, 'f' || o_orderkey || '.py', (30 + o_orderkey % 5)::INT, 'last' FROM orders")
def diff(t):
    d = t.dealt("orders").select(F.col("o_orderkey").alias("id"), F.expr(_DIFF).alias("code"), F.lit("").alias("path"))
    return _flat(d, parsing.added_lines, parsing.ADDED)


_DOC = "CASE p_size % 3 WHEN 0 THEN 'Adds numbers of all kinds.\\n\\nArgs:\\n    a (int): one\\n    b: two\\n\\nReturns:\\n    The sum.\\n\\nExample:\\n    >>> f(1, 2)\\n' WHEN 1 THEN 'Adds.\\n\\nParameters\\n----------\\na : int\\n    one\\n\\nReturns\\n-------\\nint\\n' ELSE '/**\\n * Adds numbers of some kinds.\\n * @param {number} a one\\n * @param b two\\n * @returns {number} the sum\\n */' END"


@query(
    "doc_parse",
    "F17 F55 C17",
    "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Adds numbers of all kinds.' WHEN 1 THEN 'Adds.' ELSE 'Adds numbers of some kinds.' END AS description, CASE p_size % 3 WHEN 1 THEN 'a' ELSE 'a,b' END AS params, CASE p_size % 3 WHEN 0 THEN 'The sum.' WHEN 1 THEN 'int' ELSE 'the sum' END AS returns, p_size % 3 = 0 AS has_examples, CASE p_size % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 60.0 ELSE 90.0 END::DOUBLE AS quality FROM part",
)
def doc_parse(t):
    d = t.dealt("part").select(F.col("p_partkey").alias("id"), F.expr(_DOC).alias("code"), F.lit("").alias("path"))
    p = _flat(d, parsing.docstring, parsing.DOCSTRING)
    q = scores.doc_quality(F.lit(True), F.length("description"), F.size("params"), F.lit(2), F.lit("function"), F.col("returns").isNotNull(), F.lit(False), "has_examples")
    return p.select("id", "description", F.array_join("params", ",").alias("params"), "returns", "has_examples", q.alias("quality"))


@query("ast_scan", "R2", "SELECT p_partkey AS id, 8 AS line, 11 AS \"column\", 'dangerous_functions' AS category, o AS origin FROM part, (VALUES ('name'), ('call')) AS v(o)")
def ast_scan(t):
    return _flat(_py(t), parsing.syntax_findings, parsing.FINDING).select("id", "line", "column", "category", "origin")


@query(
    "import_resolve",
    "J4 J5 C9",
    """WITH f AS (SELECT DISTINCT file FROM commits), i AS (SELECT DISTINCT file, CASE sha % 4 WHEN 0 THEN '.f' || (sha % 100) WHEN 1 THEN 'm' || (sha % 10) || '.f' || (sha % 100) WHEN 2 THEN '../m' || (sha % 10) || '/f' || (sha % 100) ELSE 'os.path' END AS specifier FROM commits),
w AS (SELECT file, specifier, CASE WHEN starts_with(specifier, '../') THEN 'src/' || substr(specifier, 4) WHEN starts_with(specifier, '.') THEN array_to_string(string_split(file, '/')[1:2], '/') || '/' || substr(specifier, 2) WHEN specifier = 'os.path' THEN '-' ELSE 'src/' || replace(specifier, '.', '/') END AS base FROM i)
SELECT w.file, specifier, f.file AS resolved FROM w LEFT JOIN f ON f.file = base || '.py' OR f.file = base || '.ts'""",
    views="commits",
)
def import_resolve(t):
    files = t.commits.select(F.col("file").alias("path")).distinct()
    s = F.col("sha")
    text = lambda c: c.cast("string")
    spec = F.when(s % 4 == 0, F.concat(F.lit(".f"), text(s % 100))).when(s % 4 == 1, F.concat(F.lit("m"), text(s % 10), F.lit(".f"), text(s % 100))).when(s % 4 == 2, F.concat(F.lit("../m"), text(s % 10), F.lit("/f"), text(s % 100))).otherwise("os.path")
    return resolve.resolved(t.commits.select("file", spec.alias("specifier")).distinct(), files)


_DECISION = "CASE turn % 3 WHEN 0 THEN concat('```json\\n[{\"title\": \"use ', conv_id, '\", \"confidence\": 1.5}, {\"title\": \"two\", \"tags\": [\"a\"]}]\\n```') WHEN 1 THEN '{\"title\": \"one\", \"status\": \"done\"}' ELSE 'no decision' END"


@query(
    "decisions_parsed",
    "F82 X6",
    """SELECT conv_id, turn, 'use ' || conv_id AS title, 'active' AS status, 1.0::DOUBLE AS confidence, 0 AS tags FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, 'two', 'active', 0.5, 1 FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, 'one', 'done', 0.5, 0 FROM conversations WHERE turn % 3 = 1""",
)
def decisions(t):
    from ..sources.files import parsed_decisions

    a = t.conversations.select("conv_id", "turn", F.expr(_DECISION).alias("text"))
    return parsed_decisions(a).select("conv_id", "turn", "title", "status", "confidence", F.size("tags").alias("tags"))


@query("graph_json_round_trip", "S20 S32", "SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM nation) AS edges, (SELECT sum(n_nationkey * 100 + n_regionkey)::BIGINT FROM nation) AS checksum")
def graph_json(t):
    from ..sources import stores

    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    edges = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit("in").alias("type"))
    n, e = stores.parsed_graph(stores.graph_json(nodes, edges), "id int, name string", "source int, target int, type string")
    return n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges"), F.sum(F.col("src") * 100 + F.col("dst")).alias("checksum")))
