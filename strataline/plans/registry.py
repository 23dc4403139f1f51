"""Queries by name, each with the SQL that checks it where SQL can, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import dealt_by, tasks_for
from ..session import ship

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


class Tables:
    """The tables of a folder, and views of them as the engine's own entities."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def dealt(self, name: str) -> DataFrame:
        """A table's rows for work that is heavy for each row: dealt to all cores where its files have too few parts for them."""
        rows = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() >= 3 * cores:
            return rows
        return rows.repartition(max(4 * cores, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def tasks(self, name: str) -> int | None:
        """Into how many parts a table's rows are dealt by their keys."""
        return tasks_for(self.spark, getattr(self, name).count())

    @property
    def edges(self) -> DataFrame:
        """src, dst: parts that follow each other in an order."""
        tasks = self.tasks("lineitem")
        follow = self.spark.sql(
            """SELECT s AS src, t AS dst FROM (SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS t FROM {lineitem}) WHERE t IS NOT NULL AND s <> t""",
            lineitem=dealt_by(self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), tasks, "l_orderkey"),
        )
        return dealt_by(follow, tasks, "src", "dst").distinct()

    @property
    def commits(self) -> DataFrame:
        """sha, author, date, message, file: events, the file by a number in their properties."""
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        path = F.concat(F.lit("src/m"), (k % 10).cast("string"), F.lit("/f"), k.cast("string"), F.when(k % 3 == 0, ".ts").otherwise(".py"))
        return self.events.select(F.col("event_id").alias("sha"), F.col("user_id").alias("author"), F.col("ts").alias("date"), F.col("event_type").alias("message"), path.alias("file"))

    @property
    def blame(self) -> DataFrame:
        return self.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("sha"), F.col("l_shipdate").alias("date"))

    @property
    def runtime(self) -> DataFrame:
        """key, error_rate, avg_latency_ms, p99_latency_ms, request_count by file of commits."""
        rows = self.events.withColumn("key", F.concat(F.lit("f"), F.regexp_extract("props", r"(\d+)", 1)))
        return rows.groupBy("key").agg(
            F.round(F.avg(F.when(F.col("event_type") == "error", 100.0).otherwise(0.0)), 6).alias("error_rate"),
            F.round(F.avg("value") * 10, 6).alias("avg_latency_ms"),
            F.round(F.percentile("value", F.lit(0.99)) * 10, 6).alias("p99_latency_ms"),
            F.count("*").alias("request_count"),
        )


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

# Views in DuckDB SQL, put where a query names them.
VIEWS = {
    "edges": "edges AS (SELECT DISTINCT s AS src, t AS dst FROM (SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS t FROM lineitem) WHERE t IS NOT NULL AND s <> t)",
    "commits": "commits AS (SELECT event_id AS sha, user_id AS author, ts AS date, event_type AS message, 'src/m' || (k % 10) || '/f' || k || CASE WHEN k % 3 = 0 THEN '.ts' ELSE '.py' END AS file FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events))",
    "blame": "blame AS (SELECT l_partkey AS file, l_suppkey AS author, l_orderkey AS sha, l_shipdate AS date FROM lineitem)",
    "runtime": "runtime AS (SELECT 'f' || regexp_extract(props, '(\\d+)', 1) AS key, round(avg(CASE WHEN event_type = 'error' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS error_rate, round(avg(value) * 10, 6) AS avg_latency_ms, round(quantile_cont(value, 0.99) * 10, 6) AS p99_latency_ms, count(*) AS request_count FROM events GROUP BY 1)",
}


def query(name: str, covers: str, sql: str | None = None, views: str = ""):
    """Registers a query: what it covers of the survey, and DuckDB SQL over the tables and views."""
    def keep(build: Callable[[Tables], DataFrame]):
        text = sql
        if sql is not None and views:
            extra = ",\n".join(VIEWS[v] for v in views.split())
            text = f"WITH {extra},\n{sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {extra}\n{sql.strip()}"
        if name in REGISTRY:
            raise ValueError(f"{name} is there already")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, text)
        return build

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: (lambda spark, folder, q=q: q.build(Tables(spark, folder))) for q in REGISTRY.values()}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in REGISTRY.values() if q.sql is not None}


def covered() -> dict[str, list[str]]:
    """The survey's operators and the queries that show each."""
    out: dict[str, list[str]] = {}
    for q in REGISTRY.values():
        for c in q.covers:
            out.setdefault(c, []).append(q.name)
    return out
