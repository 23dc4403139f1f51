"""Predicates and functions over text, paths and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from .registry import query


def _quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


@query("sql_select_filters", "P1 P2 P5", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def select_filters(t):
    from ..operators.relational import optional_filter, select

    rows = select(t.orders, ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return optional_filter(rows, "o_orderkey", None)


@query("text_ilike", "P8 J3", "SELECT DISTINCT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.text ILIKE '%LICENSE%'")
def ilike(t):
    return t.documents.where(F.col("text").ilike("%LICENSE%")).join(t.labels, "doc_id").select("doc_id", "quality").distinct()


@query(
    "path_parts",
    "F1 F2 F20",
    r"""SELECT DISTINCT file, split_part(file, '/', -1) AS base, array_to_string(string_split(file, '/')[1:2], '/') AS folder, regexp_replace(split_part(file, '/', -1), '\.[^.]+$', '') AS stem, '.' || split_part(file, '.', -1) AS ext, CASE split_part(file, '.', -1) WHEN 'py' THEN 'python' ELSE 'typescript' END AS language, replace(file, 'src/', '') AS below FROM commits""",
    views="commits",
)
def path_parts(t):
    f = t.commits.select("file").distinct()
    return f.select("file", tx.basename("file").alias("base"), tx.dirname("file").alias("folder"), tx.stem("file").alias("stem"), tx.suffix("file").alias("ext"), tx.language_of("file").alias("language"), tx.relative_to("file", "src").alias("below"))


_NAME = "CASE doc_id % 9 WHEN 0 THEN 'test_' || source || '.py' WHEN 1 THEN 'routes' WHEN 2 THEN source || '_schema.py' WHEN 3 THEN 'middleware.ts' WHEN 4 THEN 'user_model.py' WHEN 5 THEN 'config' WHEN 6 THEN 'helpers' WHEN 7 THEN 'useThing' ELSE source || '.vue' END"


@query("file_kind", "F3 P28", f"SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'test' WHEN 1 THEN 'api' WHEN 2 THEN 'schema' WHEN 3 THEN 'middleware' WHEN 4 THEN 'model' WHEN 5 THEN 'config' WHEN 6 THEN 'util' WHEN 7 THEN 'hook' ELSE 'component' END AS kind, doc_id % 9 = 0 AS is_test, {_NAME} AS name FROM documents")
def file_kind(t):
    d = t.documents.select("doc_id", F.expr(_NAME).alias("name"))
    return d.select("doc_id", tx.file_kind("name").alias("kind"), tx.is_test_file("name").alias("is_test"), "name")


@query("file_suggested_test", "F16", "SELECT DISTINCT file, CASE WHEN ends_with(file, '.py') THEN array_to_string(string_split(file, '/')[1:2], '/') || '/test_' || split_part(file, '/', -1) ELSE replace(file, '.ts', '.test.ts') END AS test FROM commits", views="commits")
def suggested(t):
    return t.commits.select("file").distinct().select("file", tx.suggested_test_path("file").alias("test"))


@query(
    "file_validator",
    "P11 P24",
    r"""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a.py' WHEN p_size % 3 = 1 THEN 'b.TSX' ELSE 'c.md' END AS path, (p_retailprice * 10000)::BIGINT AS size FROM part)
SELECT p_partkey, CASE WHEN path = 'c.md' THEN 'Unsupported file type. Supported types: .js, .jsx, .py, .ts, .tsx' WHEN size > 10485760 THEN 'too large' ELSE '' END AS error FROM x""",
)
def validator(t):
    m = F.col("p_size") % 3
    x = t.part.select("p_partkey", F.when(m == 0, "a.py").when(m == 1, "b.TSX").otherwise("c.md").alias("path"), (F.round(F.col("p_retailprice") * 10000)).cast("long").alias("size"))
    e = tx.file_error("path", "size")
    return x.select("p_partkey", F.when(e.startswith("File size"), "too large").otherwise(e).alias("error"))


_NAMES = "CASE c_custkey % 6 WHEN 0 THEN ' my set ' || c_custkey WHEN 1 THEN 'con' WHEN 2 THEN repeat('x', 70) WHEN 3 THEN '   ' WHEN 4 THEN 'ok-' || c_custkey ELSE '1 bad!' END"


@query(
    "names_checked",
    "P12 P29",
    f"""WITH n AS (SELECT c_custkey, {_NAMES} AS name FROM customer), s AS (SELECT c_custkey, name, trim(name) AS n FROM n), r AS (SELECT *, regexp_replace(replace(n, ' ', '_'), '[^a-zA-Z0-9_-]', '', 'g') AS c FROM s)
SELECT c_custkey, CASE WHEN n = '' THEN 'Collection name cannot be whitespace only' WHEN length(n) > 63 THEN 'Collection name must be at most 63 characters' WHEN NOT regexp_full_match(n, '[a-zA-Z0-9_-]+') THEN 'Collection name can only contain letters, numbers, underscores, and hyphens' WHEN lower(n) = 'con' THEN '''con'' is a reserved name and cannot be used' ELSE '' END AS error,
CASE WHEN c = '' THEN 'default_collection' ELSE left(c, 63) END AS clean, length(name) > 64 OR NOT regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_-]*') AS refused FROM r""",
)
def names(t):
    n = t.customer.select("c_custkey", F.expr(_NAMES).alias("name"))
    return n.select("c_custkey", tx.collection_error("name").alias("error"), tx.collection_name("name").alias("clean"), (tx.project_name_error("name") != "").alias("refused"))


_ASK = "CASE turn % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' a  b ' WHEN 2 THEN 'why   this decision ' || conv_id WHEN 3 THEN 'ok' ELSE text END"


@query(
    "questions_checked",
    "P13 P18",
    rf"""WITH q AS (SELECT conv_id, turn, {_ASK} AS q FROM conversations), s AS (SELECT *, regexp_replace(q, '^\s+|\s+$', '', 'g') AS s FROM q)
SELECT conv_id, turn, CASE WHEN s = '' THEN 'Question cannot be whitespace only' WHEN length(s) < 3 THEN 'Question must be at least 3 characters' WHEN length(s) > 2000 THEN 'Question must be at most 2000 characters' ELSE '' END AS error, md5(left(regexp_replace(s, '\s+', ' ', 'g'), 2000)) AS clean,
contains(lower(q), 'why') OR contains(lower(q), 'who') OR contains(lower(q), 'decision') OR contains(lower(q), 'reason') AS asks FROM s""",
)
def questions(t):
    q = t.conversations.select("conv_id", "turn", F.expr(_ASK).alias("q"))
    return q.select("conv_id", "turn", tx.question_error("q").alias("error"), F.md5(tx.clean_question("q").cast("binary")).alias("clean"), tx.asks_for_decisions("q").alias("asks"))


_PATHS = "CASE l_linenumber % 6 WHEN 0 THEN '../etc/x' WHEN 1 THEN '/abs/' || l_partkey WHEN 2 THEN '~/h' WHEN 3 THEN 'a$b.py' WHEN 4 THEN 'dir/my file(' || l_partkey || ').py' ELSE 'dir/.env' END"


@query(
    "paths_checked",
    "P14 P17",
    rf"""WITH p AS (SELECT DISTINCT l_linenumber, l_partkey, {_PATHS} AS p FROM lineitem) SELECT l_linenumber, l_partkey, contains(p, '..') OR starts_with(p, '/') OR contains(p, '~') OR contains(p, '$') AS unsafe, regexp_replace(split_part(p, '/', -1), '[^\w\s\-.]', '_', 'g') AS safe, split_part(p, '/', -1) = '.env' AS sensitive FROM p""",
)
def paths(t):
    p = t.lineitem.select("l_linenumber", "l_partkey", F.expr(_PATHS).alias("p")).distinct()
    return p.select("l_linenumber", "l_partkey", tx.is_unsafe_path("p").alias("unsafe"), tx.safe_basename("p").alias("safe"), tx.is_sensitive_path("p").alias("sensitive"))


@query("api_keys_checked", "P15", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'API key appears to be too short' WHEN 1 THEN 'API key appears to be a placeholder value' WHEN 2 THEN 'API key cannot be empty' ELSE '' END AS error FROM customer")
def api_keys(t):
    k = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'Your_Api_Key' WHEN 2 THEN '' ELSE 'k' || repeat('9', 12) END")
    return t.customer.select("c_custkey", tx.api_key_error(k).alias("error"))


@query("text_blank_filter", "P10", r"SELECT count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN '  ' || chr(10) ELSE text END AS text FROM documents) WHERE regexp_matches(coalesce(text, ''), '\S')")
def blank(t):
    text = F.when(F.col("doc_id") % 3 == 0, "  \n").otherwise(F.col("text"))
    return t.documents.where(~tx.is_blank(text)).agg(F.count("*").alias("n"))


@query("token_estimate", "F4", r"SELECT doc_id, floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) * 1.3::DOUBLE)::INT AS tokens FROM documents")
def tokens(t):
    return t.documents.select("doc_id", tx.token_estimate("text").alias("tokens"))


_CASES = "CASE l_linenumber % 7 WHEN 0 THEN 'getUserName' WHEN 1 THEN 'set_value' WHEN 2 THEN 'isReady' WHEN 3 THEN 'ComputeTotal' WHEN 4 THEN 'make_it' WHEN 5 THEN 'verifyAll' ELSE 'other' END"


@query(
    "names_cased",
    "F8 F10",
    rf"""WITH n AS (SELECT DISTINCT {_CASES} AS name FROM lineitem) SELECT name, regexp_matches(name, '^[a-z][a-z0-9_]*$') AS snake, regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches(name, '[A-Z]') AS camel, lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g')) AS suggested,
CASE name WHEN 'getUserName' THEN 'Retrieves or fetches data' WHEN 'set_value' THEN 'Sets or updates data' WHEN 'isReady' THEN 'Performs a boolean check' WHEN 'ComputeTotal' THEN 'Performs calculations' WHEN 'make_it' THEN 'Creates or constructs objects' WHEN 'verifyAll' THEN 'Validates or checks conditions' END AS purpose FROM n""",
)
def cased(t):
    n = t.lineitem.select(F.expr(_CASES).alias("name")).distinct()
    return n.select("name", tx.is_snake_case("name").alias("snake"), tx.is_camel_case("name").alias("camel"), tx.snake_case("name").alias("suggested"), tx.purpose_of("name").alias("purpose"))


@query("ids_hashed", "F9", "SELECT doc_id, sha256(doc_id || ':' || source) AS id, left(sha256(source), 16) AS short FROM documents")
def hashed(t):
    return t.documents.select("doc_id", tx.stable_id("doc_id", "source").alias("id"), tx.stable_id("source", short=True).alias("short"))


@query("text_truncated", "F7", r"SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '... truncated ' || (length(text) - 500) || ' characters ...' ELSE text END) AS digest FROM documents")
def truncated(t):
    return t.documents.select("doc_id", F.md5(tx.truncated("text", 500).cast("binary")).alias("digest"))


_ANSWER = "CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || '{\"a\": ' || conv_id || '}' || chr(10) || '```' WHEN 1 THEN '<think>no' || chr(10) || 'way</think> {\"a\": 1}' WHEN 2 THEN 'text [1, 2] end' ELSE 'nothing here' END"


@query(
    "answers_salvaged",
    "F13 F14 F80",
    f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{{"a": ' || conv_id || '}}' WHEN 1 THEN '{{"a": 1}}' WHEN 2 THEN '[1, 2]' END AS json, CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || '{{"a": ' || conv_id || '}}' || chr(10) || '```' WHEN 1 THEN '{{"a": 1}}' WHEN 2 THEN 'text [1, 2] end' ELSE 'nothing here' END AS thoughtless FROM conversations""",
)
def salvaged(t):
    a = t.conversations.select("conv_id", "turn", F.expr(_ANSWER).alias("a"))
    return a.select("conv_id", "turn", tx.salvaged_json("a").alias("json"), tx.without_thoughts("a").alias("thoughtless"))


@query("lists_cleaned", "F81", "SELECT source, array_to_string((list(DISTINCT trim(lang) ORDER BY trim(lang)) FILTER (lang <> 'en'))[1:8], ',') AS langs FROM documents GROUP BY source")
def cleaned(t):
    g = t.documents.groupBy("source").agg(F.array_sort(F.collect_set(F.when(F.col("lang") == "en", F.lit("  ")).otherwise(F.concat(F.lit(" "), "lang")))).alias("l"))
    return g.select("source", F.array_join(F.array_sort(tx.cleaned_list(F.col("l"), F.array(F.lit("none")))), ",").alias("langs"))


_JS = "CASE l_linenumber % 3 WHEN 0 THEN 'a, b = 5, ...rest' WHEN 1 THEN 'x: number, y?: string, {' ELSE '' END"


@query("js_parameters", "F83", "SELECT DISTINCT l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'a,b,rest' WHEN 1 THEN 'x,y?' ELSE '' END AS params, CASE l_linenumber % 3 WHEN 0 THEN 'a,rest' WHEN 1 THEN 'x,y?' ELSE '' END AS required FROM lineitem")
def js(t):
    r = t.lineitem.select("l_linenumber", F.expr(_JS).alias("raw")).distinct()
    return r.select("l_linenumber", F.array_join(tx.js_parameters("raw"), ",").alias("params"), F.array_join(tx.js_parameters("raw", required=True), ",").alias("required"))


@query("json_defaults", "F84 F85", "SELECT event_id, coalesce((json_extract(props, '$.k'))::INT, 0) AS k, 'none' AS missing FROM events")
def json_defaults(t):
    p = F.from_json("props", "k int, note string")
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.coalesce(p["k"], F.lit(0)).alias("k"), F.coalesce(p["note"], F.element_at(m, "note"), F.lit("none")).alias("missing"))


@query("anchors_exports", "F18", r"SELECT DISTINCT file, regexp_replace(file, '[/\\.]', '_', 'g') || '.md' AS name, regexp_replace(lower('My ' || file || ' (x)'), '[^\w\s-]', '', 'g') AS plain FROM commits", views="commits")
def anchors(t):
    f = t.commits.select("file").distinct()
    return f.select("file", tx.export_name("file").alias("name"), F.replace(tx.anchor(F.concat(F.lit("My "), "file", F.lit(" (x)"))), F.lit("-"), F.lit(" ")).alias("plain"))


@query("palette_filter", "P30 P31", f"SELECT name, category, n FROM (SELECT p_name AS name, p_type AS category, count(*) AS n FROM part GROUP BY 1, 2) WHERE contains(lower(name), 'a') OR contains(lower(category), 'brass') AND name NOT IN ({_quoted(fixed.RESERVED_NAMES)})")
def palette(t):
    g = t.part.groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("category")).agg(F.count("*").alias("n"))
    return g.where(F.contains(F.lower("name"), F.lit("a")) | (F.contains(F.lower("category"), F.lit("brass")) & ~F.col("name").isin(*fixed.RESERVED_NAMES)))


@query("filter_options", "P31", "SELECT list(DISTINCT lang ORDER BY lang)::VARCHAR AS langs, count(DISTINCT source) AS sources FROM documents")
def options(t):
    return t.documents.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("lang")), ", "), F.lit("]")).alias("langs"), F.count_distinct("source").alias("sources"))
