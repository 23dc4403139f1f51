"""Streams over tables of files, run until they have caught up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .registry import query


def _events(t):
    # The table may be one file: streams read folders.
    path = f"{t.folder}/events.parquet"
    schema = t.events.schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(t.spark, path) else f"{t.folder}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must be an instant


def _plain(*columns: str):
    """Times as they were in the table."""
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("stream_tumbling", "ST9", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    out = streams.drained(streams.tumbling(_events(t), "1 hour", ["event_type"]), "complete")
    return streams.latest_updates(out, ["start", "end", "event_type"]).select(*_plain("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding",
    "ST9",
    "WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start FROM events, range(2) r(k)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
)
def sliding(t):
    out = streams.drained(streams.sliding(_events(t), "1 hour", "30 minutes", ["event_type"]), "complete")
    return streams.latest_updates(out, ["start", "end", "event_type"]).select(*_plain("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_session",
    "ST9",
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def session(t):
    out = streams.drained(streams.sessions(_events(t), "30 minutes", ["user_id"]), "complete")
    return streams.latest_updates(out, ["user_id", "start", "end"]).select("user_id", *_plain("start", "end"), "n")


@query("stream_dedupe", "ST9", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def dedupe(t):
    twice = _events(t)
    return streams.drained(streams.deduped(twice.unionAll(_events(t)), ["event_id"], late="60 days").select("event_id")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stream_running_severity", "ST3", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def running(t):
    out = streams.drained(streams.running_counts(_events(t), ["event_type"]), "update")
    return streams.latest_updates(out, ["event_type"])


@query(
    "stream_incremental",
    "ST4 D5",
    "SELECT 'f' || event_id AS file_path, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'kept' END AS v FROM events WHERE event_type <> 'error'",
)
def incremental(t):
    from ..sources import stores

    base = streams.scratch(t.spark)
    changes = _events(t).select(F.when(F.col("event_type") == "error", "deleted").otherwise("added").alias("kind"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("old_path"))
    schema = "file_path string, v string"
    q = streams.apply_changes(changes, lambda: stores.read(t.spark, f"{base}/index", schema), lambda df: stores.replace(df, f"{base}/index"), lambda b: b.where("kind <> 'deleted'").select(F.col("path").alias("file_path"), F.lit("kept").alias("v")))
    q.awaitTermination()
    return stores.read(t.spark, f"{base}/index")


@query("stream_last_messages", "ST5 W7", "SELECT user_id::VARCHAR AS session, list_sort(list(event_id ORDER BY event_id DESC)[1:5])::VARCHAR AS turns FROM events GROUP BY user_id")
def last_messages(t):
    m = _events(t).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("turn"), F.col("event_type").alias("content"))
    out = streams.latest_updates(streams.drained(streams.last_messages(m, 5), "update"), ["session"])
    return out.select("session", F.concat(F.lit("["), F.array_join(F.transform("turns", lambda x: x.cast("string")), ", "), F.lit("]")).alias("turns"))


@query("stream_batches", "ST7 V8", "SELECT doc_id, length(coalesce(text, '')) AS n FROM documents")
def batches(t):
    d = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return streams.batches_of(d, 32, lambda texts: [len(x) for x in texts], "text", "n", "long").select("doc_id", "n")


# Tokens of each user's text: tags come in pieces, and the last token ends the text.
_TOKENS = "CASE event_id % 5 WHEN 0 THEN concat('w', event_id, ' <th') WHEN 1 THEN 'ink>' WHEN 2 THEN concat('n', event_id, '</') WHEN 3 THEN 'think>' ELSE '<' END"


@query(
    "stream_thoughts",
    "ST8 F14",
    rf"""WITH e AS (SELECT user_id, string_agg({_TOKENS}, '' ORDER BY event_id) AS t FROM events GROUP BY user_id), s AS (SELECT user_id, t, regexp_replace(t, '<think>.*?(</think>|$)', '', 'g') AS answer, regexp_extract_all(t, '<think>(.*?)(</think>|$)', 1) AS th FROM e)
SELECT user_id::VARCHAR AS session, answer, array_to_string(th, '') AS thought FROM s""",
)
def thoughts(t):
    """What each user's token stream thinks and answers, put together; it arrives in three parts, with a restart before each."""
    e = t.events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("place"), F.expr(_TOKENS).alias("token"))
    ends = e.groupBy("session").agg((F.max("place") + 1).alias("place")).select("session", "place", F.lit(None).cast("string").alias("token"))
    (low, high), n = t.events.agg(F.percentile_approx("event_id", [0.33, 0.7]), F.count("*")).first()
    parts = [e.where(F.col("place") <= low), e.where((F.col("place") > low) & (F.col("place") <= high)), e.where(F.col("place") > high).unionAll(ends)]
    out = streams.in_parts(parts, lambda s: streams.thoughts(s, streams.buckets_for(n))).groupBy("session", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    # Pieces of one place and kind stand next to each other in the text, and in no order that matters to which kind they are.
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return out.groupBy("session").agg(F.coalesce(F.max(F.when(F.col("kind") == "answer", text)), F.lit("")).alias("answer"), F.coalesce(F.max(F.when(F.col("kind") == "thought", text)), F.lit("")).alias("thought"))


@query(
    "stream_expiring",
    "ST6",
    """WITH RECURSIVE l AS (SELECT user_id, min(ts) AS t FROM events WHERE ts IS NOT NULL GROUP BY user_id
UNION ALL SELECT l.user_id, min(e.ts) FROM l JOIN events e ON e.user_id = l.user_id AND e.ts >= l.t + INTERVAL 300 SECOND GROUP BY l.user_id, l.t)
SELECT user_id AS key, count(*) AS loads, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last FROM l GROUP BY user_id""",
)
def expiring(t):
    """How often a value of each user that lasts 300 seconds is loaded, for requests that arrive in three parts with restarts between."""
    e = t.events.where("ts IS NOT NULL").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    first, last, n = e.agg(F.min("at"), F.max("at"), F.count("*")).first()
    steps = [first + (last - first) * k / 3 for k in (1, 2)]
    parts = [e.where(F.col("at") <= steps[0]), e.where((F.col("at") > steps[0]) & (F.col("at") <= steps[1])), e.where(F.col("at") > steps[1])]
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    out = streams.in_parts(parts, lambda s: streams.loads(s, buckets=streams.buckets_for(n)))
    return out.groupBy("key").agg(F.count("*").alias("loads"), stamp(F.min("at")).alias("first"), stamp(F.max("at")).alias("last"))
