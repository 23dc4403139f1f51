"""Structured Streaming: windows over event time, running counts, incremental indexes, bounded state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance
from ..session import shared_folder


def files_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now: run until it has caught up, read back from its sink."""
    spark = stream.sparkSession
    base = scratch(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of a drained stream of updates."""
    rest = [c for c in updates.columns if c not in (*keys, "_batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def tumbling(events: DataFrame, width: str, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    return _windowed(events.withWatermark(time, late) if events.isStreaming else events, F.window(time, width), keys)


def sliding(events: DataFrame, width: str, step: str, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    return _windowed(events.withWatermark(time, late) if events.isStreaming else events, F.window(time, width, step), keys)


def sessions(events: DataFrame, gap: str, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    return _windowed(events.withWatermark(time, late) if events.isStreaming else events, F.session_window(time, gap), keys)


def _windowed(events: DataFrame, window, keys: list[str]) -> DataFrame:
    rows = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def deduped(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def running_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts so far; a stream of updates."""
    return findings.groupBy(*keys).agg(F.count("*").alias("n"))


def apply_changes(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], chunk: Callable[[DataFrame], DataFrame]):
    """A query that brings an index up to date with each batch of changes. write must be safe to repeat."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates()
        write(maintenance.reindexed(read(), batch, chunk(batch)))

    return changes.writeStream.option("checkpointLocation", f"{scratch(changes.sparkSession)}/state").foreachBatch(one).trigger(availableNow=True).start()


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each session, kept as bounded state: session, turns and contents, newest last.

    messages: session, turn, content. State holds n messages of a session at most.
    """
    schema = "session string, turns array<long>, contents array<string>"

    def step(key, frames, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held = sorted([*held, *zip(f["turn"].tolist(), f["content"].tolist(), strict=True)])[-n:]
        turns, contents = [h[0] for h in held], [h[1] for h in held]
        state.update((turns, contents))
        yield pd.DataFrame({"session": [key[0]], "turns": [turns], "contents": [contents]})

    return messages.groupBy("session").applyInPandasWithState(step, schema, "turns array<long>, contents array<string>", "update", "NoTimeout")


def batches_of(df: DataFrame, rows: int, work: Callable[[list], list], column: str, out: str, kind: str) -> DataFrame:
    """A column made by a service that takes lists: `rows` values at once, order kept."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(f"{out} {kind}").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(parts):
        field = to_arrow_schema(schema).field(out)
        for b in parts:
            for at in range(0, b.num_rows, rows):
                s = b.slice(at, rows)
                made = work(s.column(s.schema.get_field_index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(made, field.type)], [*s.schema.names, out])

    return df.mapInArrow(run, schema)


def progress(query) -> dict:
    """Rows, batches and state of a running query."""
    last = query.lastProgress
    return {"batch": last.batchId if last else -1, "rows": last.numInputRows if last else 0, "active": query.isActive}


def expiring(spark: SparkSession, load: Callable[[], DataFrame], seconds: float = 300.0, clock: Callable[[], float] | None = None) -> Callable[[], DataFrame]:
    """A table that is loaded again when it is older than so many seconds."""
    import time

    clock = clock or time.monotonic
    held: dict = {}

    def get() -> DataFrame:
        if "df" not in held or clock() - held["at"] >= seconds:
            if "df" in held:
                held["df"].unpersist()
            held.update(df=load().cache(), at=clock())
        return held["df"]

    return get


_TAGS = {False: "<think>", True: "</think>"}


def _fed(held: str, inside: bool, part: str | None) -> tuple[list[tuple[str, str]], str, bool]:
    """What one more part of text makes certain, and what is held then; None ends the text."""
    out: list[tuple[str, str]] = []
    held += part or ""
    while held:
        tag, kind = _TAGS[inside], "thought" if inside else "answer"
        k = held.find(tag)
        if k >= 0:
            out += [(kind, held[:k])] * (k > 0)
            held, inside = held[k + len(tag) :], not inside
            continue
        # What may be a tag's beginning waits for more.
        keep = 0 if part is None else next((n for n in range(min(len(tag) - 1, len(held)), 0, -1) if tag.startswith(held[-n:])), 0)
        out += [(kind, held[: len(held) - keep])] * (len(held) > keep)
        held = held[len(held) - keep :]
        break
    return out, held, inside


def split_thoughts(parts: list[str]) -> list[tuple[str, str]]:
    """A stream of text parts as (thought or answer, text), whatever the parts' borders cut through."""
    out: list[tuple[str, str]] = []
    held, inside = "", False
    for part in [*parts, None]:
        found, held, inside = _fed(held, inside, part)
        out += found
    return out


#: Keys share states, so many to a bucket that Python is called for some thousands of rows and not for each key.
BUCKETS, BUCKET_ROWS = 64, 10_000


def buckets_for(rows: int) -> int:
    """Buckets for so many rows in all. A checkpoint keeps its number: the same one goes with it at each restart."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def _bucket(key: str, buckets: int):
    """The bucket of a key; nulls have one of their own, so that no column of keys turns into floats in pandas."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).alias("_bucket")


def _keys(bucket: tuple, column) -> list:
    return [None] * len(column) if bucket[0] == -1 else column.tolist()


def thoughts(tokens: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """session, place, kind (thought, answer) and text of a stream of tokens, each as soon as it is certain.

    tokens: session, place, token; a null token ends a session's text. State is the tail of the
    text that may be a tag's beginning, and whether a thought is open, of those sessions that have either; so tags may be
    cut by the borders of tokens, of batches and of restarts. A session's tokens come in order from batch to batch;
    those of one batch are sorted. Sessions are kept in so many buckets, each one state.
    """

    def step(bucket, frames, state):
        held = {s: (h, i) for s, h, i in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("place", kind="stable")
        out = []
        for session, place, token in zip(_keys(bucket, rows["session"]), rows["place"].tolist(), rows["token"].tolist(), strict=True):
            text, inside = held.get(session, ("", False))
            found, text, inside = _fed(text, inside, None if token is None or token != token else token)
            out += [(session, place, kind, piece) for kind, piece in found]
            if text or inside:
                held[session] = (text, inside)
            else:
                held.pop(session, None)
        if held or state.exists:
            state.update((list(held), [h for h, _ in held.values()], [i for _, i in held.values()]))
        yield pd.DataFrame(out, columns=["session", "place", "kind", "text"])

    rows = tokens.select(_bucket("session", buckets), "session", "place", "token")
    return rows.groupBy("_bucket").applyInPandasWithState(step, "session string, place long, kind string, text string", "sessions array<string>, held array<string>, inside array<boolean>", "append", "NoTimeout")


def loads(requests: DataFrame, seconds: int = 300, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """key and at of the requests (key, at) that find no value younger than so many seconds, and so load one.

    A key's state is when its value was loaded; it is dropped when the watermark has passed the
    value's end, so state holds the keys in use and not all that were ever asked for. Keys are kept in so many buckets,
    each one state. Requests without a time count for nothing.
    """
    width = seconds * 1_000_000

    def step(bucket, frames, state):
        loaded = dict(zip(*state.get, strict=True)) if state.exists else {}
        if not state.hasTimedOut:
            rows = [(at, key) for f in frames for key, at in zip(_keys(bucket, f["key"]), f["us"].tolist(), strict=True)]
            out = []
            for at, key in sorted(rows, key=lambda r: r[0]):
                if key not in loaded or at >= loaded[key] + width:
                    loaded[key] = at
                    out.append((key, at))
            yield pd.DataFrame(out, columns=["key", "us"])
        # No request before the watermark comes any more.
        now = state.getCurrentWatermarkMs() * 1000
        loaded = {k: at for k, at in loaded.items() if at + width > now}
        if not loaded:
            if state.exists:
                state.remove()
            return
        state.update((list(loaded), list(loaded.values())))
        state.setTimeoutTimestamp(-(-(max(loaded.values()) + width) // 1000))

    kind = requests.schema["key"].dataType.simpleString()
    timed = requests.where(F.col("at").isNotNull()).withWatermark("at", late).select(_bucket("key", buckets), "key", "at", F.unix_micros("at").alias("us"))
    made = timed.groupBy("_bucket").applyInPandasWithState(step, f"key {kind}, us long", f"keys array<{kind}>, loaded array<long>", "append", "EventTimeTimeout")
    return made.select("key", F.timestamp_micros("us").alias("at"))


def in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives whose rows arrive in parts, the query being started anew for each on the same checkpoint."""
    spark = parts[0].sparkSession
    base = scratch(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = build(files_stream(spark, f"{base}/in", part.schema))
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
