"""Building an index and keeping it up to date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, git, maintenance
from ..operators.relational import last_wins, upsert
from .registry import query

_FILES = """files AS (SELECT file, count(*) AS lines FROM commits GROUP BY file), e AS (SELECT lower(regexp_extract(file, '\\.[^./]+$')) AS ext, array_to_string(string_split(file, '/')[1:2], '/') AS dir, lines, greatest(1, ceil(lines / 40.0))::BIGINT AS chunks FROM files)"""


def _files(t):
    return t.commits.groupBy("file").agg(F.count("*").alias("lines"))


@query("idx_estimate_ext", "A7 A34", f"WITH {_FILES} SELECT ext, count(*) AS files, sum(lines)::BIGINT AS lines, sum(chunks)::BIGINT AS chunks FROM e GROUP BY ext", views="commits")
def estimate_ext(t):
    return maintenance.estimate(_files(t), "file").where("level = 'ext'").select(F.col("name").alias("ext"), "files", "lines", "chunks")


@query(
    "idx_estimate_grouping_sets",
    "A7 A8 A9",
    f"WITH {_FILES} SELECT 'ext' AS level, ext AS name, count(*) AS files, sum(lines)::BIGINT AS lines, sum(chunks)::BIGINT AS chunks FROM e GROUP BY ext UNION ALL SELECT 'dir', dir, count(*), sum(lines)::BIGINT, sum(chunks)::BIGINT FROM e GROUP BY dir UNION ALL SELECT 'total', '', count(*), sum(lines)::BIGINT, sum(chunks)::BIGINT FROM e",
    views="commits",
)
def estimate(t):
    return maintenance.estimate(_files(t), "file")


_LINES = r"""l AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') END AS l FROM documents)"""


@query(
    "idx_chunk_split",
    "C3 W14 P10 C6",
    rf"""WITH {_LINES}, s AS (SELECT doc_id, l, unnest(range(0, CASE WHEN len(l) <= 40 THEN 1 ELSE ceil((len(l) - 40) / 35.0)::INT + 1 END)) * 35 AS s FROM l WHERE len(l) > 0)
SELECT doc_id, (s + 1)::INT AS start_line, least(s + 40, len(l))::INT AS end_line, md5(array_to_string(l[s + 1:s + 40], chr(10))) AS digest, (greatest(0, s - 2) + 1)::INT AS context_start, least(len(l), least(s + 40, len(l)) + 2)::INT AS context_end
FROM s WHERE regexp_matches(array_to_string(l[s + 1:s + 40], chr(10)), '\S')""",
)
def chunk_split(t):
    w = chunking.line_windows(t.documents)
    n = t.documents.select(F.col("doc_id"), F.size(chunking.split_lines("text")).alias("n"))
    c = chunking.with_context(F.col("start_line") - 1, F.col("end_line"), F.col("n"))
    return w.join(n, "doc_id").select("doc_id", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("digest"), c["start_line"].alias("context_start"), c["end_line"].alias("context_end"))


@query(
    "idx_window_chunks",
    "C4 C5 F4 W14",
    rf"""WITH {_LINES}, t AS (SELECT doc_id, l, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE)::INT AS t FROM l JOIN documents USING (doc_id) WHERE len(l) > 0),
c AS (SELECT doc_id, l, CASE WHEN t = 0 THEN greatest(10, len(l)) ELSE greatest(10, floor(500.0::DOUBLE / (t::DOUBLE / len(l))))::INT END AS c, CASE WHEN t = 0 THEN 2 ELSE greatest(2, floor(50.0::DOUBLE / (t::DOUBLE / len(l))))::INT END AS o FROM t),
s AS (SELECT doc_id, l, c, unnest(range(0, greatest(1, ceil((len(l) - o)::DOUBLE / greatest(c - o, 1))::INT))) * greatest(c - o, 1) AS s FROM c)
SELECT doc_id, (s + 1)::INT AS start_line, least(s + c, len(l))::INT AS end_line, floor(len(list_filter(regexp_split_to_array(array_to_string(l[s + 1:s + c], chr(10)), '\s+'), lambda x: x <> '')) * 1.3::DOUBLE)::INT AS token_count
FROM s WHERE s < len(l) AND regexp_matches(array_to_string(l[s + 1:s + c], chr(10)), '\S')""",
)
def window_chunks(t):
    return chunking.token_windows(t.documents).select("doc_id", "start_line", "end_line", "token_count")


@query("idx_chunk_ids", "F9 W4 S21", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, sha256('p:' || source || ':' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)) AS id FROM documents")
def chunk_ids(t):
    rows = chunking.numbered(t.documents.select("source", "doc_id"), "source", [F.col("doc_id")])
    return rows.select("source", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), tx.stable_id(F.lit("p"), "source", "chunk_index").alias("id"))


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'same' END"


@query(
    "idx_incremental_upsert",
    "D5 J22 ST4",
    f"""WITH x AS (SELECT doc_id, {_KIND} AS kind, 'f' || doc_id AS path, 'old' || doc_id AS old FROM documents),
i AS (SELECT path AS file_path, 'before' AS v FROM x WHERE kind <> 'added' AND kind <> 'renamed' UNION ALL SELECT old, 'before' FROM x WHERE kind = 'renamed'),
gone AS (SELECT path AS p FROM x WHERE kind IN ('deleted', 'modified') UNION SELECT old FROM x WHERE kind = 'renamed'), come AS (SELECT path AS p FROM x WHERE kind IN ('added', 'modified', 'renamed'))
SELECT file_path, v FROM i WHERE file_path NOT IN (SELECT p FROM gone UNION SELECT p FROM come) UNION ALL SELECT p, 'after' FROM come""",
)
def incremental(t):
    x = t.documents.select(F.expr(_KIND).alias("kind"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("old_path"))
    index = x.where("kind NOT IN ('added', 'renamed')").select(F.col("path").alias("file_path")).unionAll(x.where("kind = 'renamed'").select("old_path")).withColumn("v", F.lit("before"))
    fresh = x.where("kind <> 'deleted'").select(F.col("path").alias("file_path"), F.lit("after").alias("v"))
    return maintenance.reindexed(index, x, fresh)


@query("idx_upsert_lastwins", "D2 S21", "SELECT o_custkey AS k, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS last_order FROM orders GROUP BY 1")
def upsert_last(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("last_order"), "o_orderdate")
    return last_wins(rows, ["k"], [F.col("o_orderdate"), F.col("last_order")]).select("k", "last_order")


@query(
    "idx_upsert_merge",
    "D1 D2",
    "WITH n AS (SELECT doc_id, 'new' AS v FROM labels) SELECT doc_id, 'old' AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT DISTINCT doc_id, v FROM n",
)
def upsert_merge(t):
    return upsert(t.documents.select("doc_id", F.lit("old").alias("v")), t.labels.select("doc_id", F.lit("new").alias("v")).distinct(), ["doc_id"])


@query("idx_history_keep20", "S24 W6", "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def keep20(t):
    return maintenance.keep_last(t.events, 20, [F.desc("ts"), F.desc("event_id")], ["event_type"]).select("event_id", "event_type")


@query("idx_latest_commit", "W11", "SELECT arg_max(sha, id) AS sha FROM (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'c' || event_id ELSE '' END AS sha FROM events) WHERE sha <> ''")
def latest_commit(t):
    return maintenance.latest_filled(t.events.select(F.when(F.col("event_type") == "error", F.concat(F.lit("c"), F.col("event_id").cast("string"))).otherwise("").alias("sha"), F.col("event_id").alias("id")), "sha", "id")


@query("idx_file_counts", "A25 A17", "SELECT lang, count(DISTINCT source) AS files, count(*) AS chunks FROM documents GROUP BY lang")
def file_counts(t):
    return t.documents.groupBy("lang").agg(F.count_distinct("source").alias("files"), F.count("*").alias("chunks"))


@query(
    "idx_eligibility",
    "D6 F85",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'refused' WHEN o_orderkey % 3 = 0 OR o_totalprice < 20000 THEN 'full' WHEN o_custkey % 5 = o_orderkey % 5 THEN 'none' ELSE 'incremental' END AS mode FROM orders",
)
def eligibility(t):
    last = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5)
    return t.orders.select("o_orderkey", git.eligible(F.col("o_custkey") % 5, last, F.col("o_orderstatus") == "P", F.col("o_totalprice") >= 20000).alias("mode"))


@query(
    "idx_brace_end",
    "C19",
    None,
)
def brace_end(t):
    """Where the first opened brace of each document's JSON-like rendering is closed."""
    body = F.concat(F.lit("head {\n"), F.regexp_replace(F.col("text"), r"[{}]", ""), F.lit("\n}\ntail"))
    lines = t.documents.select("doc_id", F.posexplode(F.split(body, "\n")).alias("p", "content")).select("doc_id", (F.col("p") + 1).alias("line"), "content")
    n = t.documents.select("doc_id", (F.size(F.split("text", "\n")) + 2).alias("expected"))
    return chunking.brace_end(lines, ["doc_id"]).join(n, "doc_id").select("doc_id", "end_line", (F.col("end_line") == F.col("expected")).alias("right"))


@query(
    "idx_leftover_blocks",
    "W9",
    """WITH l AS (SELECT DISTINCT l_suppkey % 10 AS file, l_partkey AS line FROM lineitem WHERE l_quantity > 20), g AS (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM l),
b AS (SELECT *, floor((row_number() OVER (PARTITION BY file, g ORDER BY line) - 1) / 50) AS b FROM g) SELECT file, min(line) AS start_line, max(line) AS end_line FROM b GROUP BY file, g, b""",
)
def leftover(t):
    l = t.lineitem.where("l_quantity > 20").select((F.col("l_suppkey") % 10).alias("file"), F.col("l_partkey").alias("line")).distinct()
    return chunking.leftover_blocks(l, "file")


@query("idx_gap_before", "W8", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS gap FROM lineitem")
def gaps(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") - F.lag("l_partkey").over(w)).alias("gap"))


@query(
    "idx_cascade_clear",
    "D3 D1 V9",
    "WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)) AS parents, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)) AS children",
)
def cascade(t):
    from ..operators.relational import delete_cascade

    parents, children = delete_cascade(t.customer, t.orders, t.customer.where("c_acctbal < 0"), "c_custkey", "o_custkey")
    return parents.agg(F.count("*").alias("parents")).crossJoin(children.agg(F.count("*").alias("children")))


@query(
    "idx_status_stamps",
    "D4 D1 P29",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE coalesce(nullif(o_orderstatus, 'P'), 'pending') END AS status, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS completed_at FROM orders""",
)
def stamps(t):
    from ..operators.relational import stamped, update, with_defaults

    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.lit(None).cast("string").alias("started_at"), F.lit(None).cast("string").alias("completed_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    rows = with_defaults(rows, {"status": "pending"})
    done = stamped(rows.where("status = 'F'"), "completed", F.col("at"))
    rest = update(rows.where("status <> 'F'"), {"started_at": None}, {"status": "pending"}).withColumn("started_at", F.col("started_at").cast("string"))
    return done.unionByName(rest).select("o_orderkey", "status", "completed_at")


@query("idx_delete_equal", "D1", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') GROUP BY 1")
def delete_equal(t):
    from ..operators.relational import delete

    return delete(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
