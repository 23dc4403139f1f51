"""Tables kept as Parquet: graphs, chunks, histories, reports, sessions, caches.

A table is a folder of data folders and of versions.  A version is a small file that names
the data folders that are the table at that time; it appears under its number in one step and
never changes, so a reader sees a whole version, old or new, and a writer that is lost leaves
the last one in place.  A writer computes from the version it has read and takes the next
number; if another has taken it, it reads again and computes again.  Appending adds a folder.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance
from ..operators.relational import upsert
from ..session import cut

#: Versions before the newest whose data stay for readers that have begun.
KEEP = 3

#: Times that a writer begins again when others are faster.
TRIES = 20


class Conflict(Exception):
    """Another writer has taken the version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, in order."""
    fs, path_of = _fs(spark, path)
    at = path_of(f"{path}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _folders(spark: SparkSession, path: str, version: int) -> list[str]:
    fs, path_of = _fs(spark, path)
    stream = fs.open(path_of(f"{path}/_versions/{version:010d}"))
    text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    return json.loads(text)["folders"]


def _take(spark: SparkSession, path: str, version: int, folders: list[str]) -> None:
    """Makes a version, whole and in one step; Conflict if it is there."""
    fs, path_of = _fs(spark, path)
    draft, final = path_of(f"{path}/_versions/.draft-{uuid.uuid4().hex}"), path_of(f"{path}/_versions/{version:010d}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"folders": folders}).encode()))
    out.close()
    if fs.getUri().getScheme() == "file":  # a local rename would replace what is there; a link doesn't
        try:
            os.link(draft.toUri().getPath(), final.toUri().getPath())
        except FileExistsError:
            raise Conflict(f"{path} has a version {version} already") from None
        finally:
            fs.delete(draft, False)
    elif not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"{path} has a version {version} already")


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def read(spark: SparkSession, path: str, schema=None, version: int | None = None) -> DataFrame:
    """The newest version of a table, or another; an empty one of the schema if there is none yet."""
    known = versions(spark, path)
    if not known:
        if schema is None:
            raise FileNotFoundError(f"no table at {path}")
        return spark.createDataFrame([], schema)
    folders = [f"{path}/{f}" for f in _folders(spark, path, known[-1] if version is None else version)]
    return spark.read.option("mergeSchema", len(folders) > 1).parquet(*folders)


def change(spark: SparkSession, path: str, build: Callable[[int | None], DataFrame], append: bool = False) -> int:
    """Writes what build(version) gives as the next version, and returns its number.

    version is what the table is at when building begins (None: there is no table). If another
    writer is faster, building begins again. append: the old folders stay part of the table.
    """
    for attempt in range(TRIES):
        known = versions(spark, path)
        last = known[-1] if known else None
        fresh = f"data-{uuid.uuid4().hex}"
        build(last).write.parquet(f"{path}/{fresh}")
        try:
            for again in range(TRIES if append else 1):
                old = _folders(spark, path, last) if append and last is not None else []
                try:
                    _take(spark, path, (last or 0) + 1, [*old, fresh])
                    break
                except Conflict:
                    if not append or again == TRIES - 1:
                        raise
                    last = versions(spark, path)[-1]  # rows that are added don't depend on those before
        except Conflict:
            fs, path_of = _fs(spark, path)
            fs.delete(path_of(f"{path}/{fresh}"), True)
            time.sleep(0.05 * attempt)
            continue
        _forget(spark, path, (last or 0) + 1)
        return (last or 0) + 1
    raise Conflict(f"{path} was changed {TRIES} times meanwhile")


def _forget(spark: SparkSession, path: str, newest: int) -> None:
    """Drops versions that are older than KEEP, and the folders that only they name."""
    known = [v for v in versions(spark, path) if v <= newest]
    old, kept = known[: -1 - KEEP], known[-1 - KEEP :]
    if not old:
        return
    fs, path_of = _fs(spark, path)
    needed = {f for v in kept for f in _folders(spark, path, v)}
    for v in old:
        for f in set(_folders(spark, path, v)) - needed:
            fs.delete(path_of(f"{path}/{f}"), True)
        fs.delete(path_of(f"{path}/_versions/{v:010d}"), False)


def orphans(spark: SparkSession, path: str) -> list[str]:
    """Data folders that no version names: those of writers at work, or of lost ones, which may be deleted when none is at work."""
    fs, path_of = _fs(spark, path)
    needed = {f for v in versions(spark, path) for f in _folders(spark, path, v)}
    found = [s.getPath().getName() for s in fs.listStatus(path_of(path))] if fs.exists(path_of(path)) else []
    return sorted(f for f in found if f.startswith("data-") and f not in needed)


def replace(df: DataFrame, path: str) -> None:
    change(df.sparkSession, path, lambda _: df)


def put(new: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert by key: chunks by id, reports by project, impact results by file."""
    spark = new.sparkSession
    change(spark, path, lambda v: new if v is None else upsert(read(spark, path, version=v), new, keys))


def append_history(new: DataFrame, path: str, order: str, keep: int = 20) -> None:
    """Appends, and keeps the last 20."""
    spark = new.sparkSession
    old = lambda v: new.limit(0) if v is None else read(spark, path, version=v)
    change(spark, path, lambda v: maintenance.keep_last(old(v).unionByName(new, allowMissingColumns=True), keep, [F.desc(order)]))


def append_vectors(new: DataFrame, path: str) -> None:
    """Adds rows under new random ids; all embeddings must have one length."""
    sizes = new.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.sum(F.col("embedding").isNull().cast("int")).alias("n")).first()
    if sizes["n"] or sizes["a"] != sizes["b"]:
        raise ValueError("each row needs an embedding, all of one length")
    change(new.sparkSession, path, lambda _: new.withColumn("id", F.expr("uuid()")), append=True)


def drop_rows(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Deletes the rows of some keys."""
    change(spark, path, lambda v: read(spark, path, version=v).join(keys, keys.columns, "left_anti"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    replace(nodes, f"{path}/nodes")
    replace(edges, f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, f"{path}/nodes"), read(spark, f"{path}/edges")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and links as lines of JSON, which a reader of node-link files puts together."""
    a = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    b = edges.select(F.lit("link").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])).alias("json"))
    return a.unionAll(b)


def parsed_graph(lines: DataFrame, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    nodes = lines.where("part = 'node'").select(F.from_json("json", node_schema).alias("n")).select("n.*")
    edges = lines.where("part = 'link'").select(F.from_json("json", edge_schema).alias("e")).select("e.*")
    return nodes, edges.withColumnRenamed("source", "src").withColumnRenamed("target", "dst")


def to_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


class Sessions:
    """Chat sessions as an append log of messages; the newest write of a message counts."""

    SCHEMA = "session_id string, turn long, role string, content string, updated_at timestamp, deleted boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        return read(self.spark, self.path, self.SCHEMA)

    def add(self, rows: DataFrame) -> None:
        change(self.spark, self.path, lambda _: rows, append=True)

    def messages(self) -> DataFrame:
        from ..operators.relational import last_wins

        now = last_wins(self.log(), ["session_id", "turn"], [F.col("updated_at")])
        return now.where("not coalesce(deleted, false)").drop("deleted")

    def delete(self, session_id: str) -> None:
        gone = self.messages().where(F.col("session_id") == session_id).withColumn("deleted", F.lit(True)).withColumn("updated_at", F.current_timestamp())
        self.add(cut(gone))

    def recent(self, n: int = 20) -> DataFrame:
        """Sessions with their first question, size and last change, the newest first."""
        m = self.messages()
        return (
            m.groupBy("session_id")
            .agg(F.min_by("content", F.when(F.col("role") == "user", F.col("turn"))).alias("title"), F.count("*").alias("messages"), F.max("updated_at").alias("updated_at"))
            .orderBy(F.desc("updated_at"), "session_id")
            .limit(n)
        )
