"""Conversations and their histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.maintenance import keep_last
from .registry import query


@query("chat_last_n", "W6 ST5 S27", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 3")
def last_n(t):
    return keep_last(t.conversations, 3, [F.desc("turn"), F.asc("role"), F.asc("text")], ["conv_id"]).select("conv_id", "turn", "role")


@query("chat_recent_sessions", "W12 S27 A31", "SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS title, count(*) AS messages, max(turn) AS last FROM conversations GROUP BY conv_id")
def recent(t):
    return t.conversations.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("title"), F.count("*").alias("messages"), F.max("turn").alias("last"))


@query("chat_status_log", "W15", "SELECT user_id, event_id, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS DISTINCT FROM event_type")
def status_log(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("old", F.lag("event_type").over(w)).where(~F.col("old").eqNullSafe(F.col("event_type")))
    return rows.select("user_id", "event_id", "old", F.col("event_type").alias("new"))


@query(
    "line_ranges",
    "W10",
    """WITH l AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS line FROM lineitem), g AS (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM l), r AS (SELECT file, min(line) AS a, max(line) AS b FROM g GROUP BY file, g)
SELECT file, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY file""",
)
def line_ranges(t):
    return chunking.line_ranges(t.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line")), "file", tasks=t.tasks("lineitem"))


@query("chat_role_counts", "A28 A29", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, bool_and(text IS NOT NULL) AS complete FROM conversations GROUP BY role")
def roles(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.bool_and(F.col("text").isNotNull()).alias("complete"))
