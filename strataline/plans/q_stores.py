"""Stores written from the given tables in several commits, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import git
from ..session import shared_folder
from ..sources import stores
from .registry import query


def _path(t, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "store_upserts",
    "S25 S26 D2",
    """WITH r AS (SELECT client_id AS key, seq, max(balance) AS balance FROM client_changes WHERE seq < 3 GROUP BY 1, 2),
l AS (SELECT key, max(seq) AS seq FROM r GROUP BY 1) SELECT key, seq, balance FROM r JOIN l USING (key, seq)""",
)
def upserts(t):
    """Reports by client in three commits: a later report takes the place of an earlier one of the same client."""
    path = _path(t, "reports")
    rows = t.client_changes.where("seq < 3").groupBy(F.col("client_id").alias("key"), "seq").agg(F.max("balance").alias("balance"))
    for k in range(3):
        stores.put(rows.where(F.col("seq") == k), path, ["key"])
    return stores.read(t.spark, path)


@query(
    "store_expertise",
    "S23",
    "WITH own AS (SELECT file, author, count(DISTINCT sha) AS commits FROM blame GROUP BY 1, 2) SELECT file, author, commits, (row_number() OVER (PARTITION BY file ORDER BY commits DESC, author))::INT AS rank FROM own",
    views="blame",
)
def expertise(t):
    """The map of experts, replaced by itself and read back."""
    path = _path(t, "expertise")
    for _ in range(2):
        stores.replace(git.expertise_map(t.blame).select("file", "author", "commits", "rank"), path)
    return stores.read(t.spark, path)


@query("store_vectors", "S22", "SELECT vec_id, label, len(embedding)::INT AS dimension, TRUE AS own_id FROM embeddings")
def vectors(t):
    """Vectors added in two commits, each under an id of its own; a row of another length is refused."""
    path = _path(t, "vectors")
    for part in (t.embeddings.where("label < 5"), t.embeddings.where("label >= 5 OR label IS NULL")):
        stores.append_vectors(part, path)
    try:
        stores.append_vectors(t.embeddings.limit(1).select("vec_id", F.array(F.lit(1.0)).alias("embedding")).unionByName(t.embeddings.limit(1).select("vec_id", F.col("embedding").cast("array<double>"))), path)
        raise AssertionError("lengths differ")
    except ValueError:
        pass
    found = stores.read(t.spark, path)
    ids = found.groupBy("id").agg(F.count("*").alias("n"))
    return found.join(ids, "id").select("vec_id", "label", F.size("embedding").alias("dimension"), (F.col("n") == 1).alias("own_id"))
