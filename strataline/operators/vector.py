"""Vector search: exact cosine neighbours, filters, thresholds; the approximate index is in `annindex`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .annindex import cut_up, matrix, unit
from .relational import top_per

#: Queries in one block, and how many of them are compared with a block of rows at once; rows in a block.
QUERY_BLOCK = 4096
ROWS_AT_ONCE = 512
ROW_BLOCK = 2048

#: Bytes of packed queries that are broadcast; more meet the rows by a join, each block of queries in so many copies.
BROADCAST_BYTES = 16 << 20
SALTS = 64


def similar(vectors: DataFrame, query: list[float], embedding: str = "embedding") -> DataFrame:
    """vectors with their cosine similarity to one query, to six places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(embedding).isNotNull()).withColumn("sim", F.round(scores.cosine(embedding, q), 6))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "id", where: Column | None = None, threshold: float | None = None, embedding: str = "embedding") -> DataFrame:
    """The k most similar rows; filters come before the sort. Ties by key."""
    rows = vectors if where is None else vectors.where(where)
    rows = similar(rows, query, embedding)
    if threshold is not None:
        rows = rows.where(F.col("sim") > threshold)
    return rows.orderBy(F.desc("sim"), key).limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", skip_self: bool = True) -> DataFrame:
    """query_id, key, sim and rank of each query's k nearest, exactly.

    Queries are packed into blocks, batches of rows into blocks, and every block of rows meets
    every block of queries by the number of the latter: broadcast where the blocks are few, else
    by a join that the rows' blocks are salted for.  A block of rows keeps its own k best of each
    query, so what meets in the end grows with queries and blocks, not rows.
    """
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).where("e IS NOT NULL AND id IS NOT NULL")
    width = vectors.select(F.max(F.size(embedding)).alias("n")).first()["n"] or 1
    n = -(-asked.count() // QUERY_BLOCK)
    if n == 0:
        return vectors.sparkSession.createDataFrame([], f"query_id long, {key} long, sim double, rank int")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).where("e IS NOT NULL AND id IS NOT NULL")

    def pack(batches):
        for b in cut_up(batches, ROW_BLOCK):
            m, place = matrix(b.column(1), width)
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).take(pa.array(place)).to_numpy().tobytes()], pa.binary()), pa.array([unit(m).tobytes()], pa.binary())], ["ids", "units"])

    def pack_queries(group: pa.Table) -> pa.Table:
        m, place = matrix(group["e"].combine_chunks(), width)
        ids = group["id"].combine_chunks().take(pa.array(place)).to_numpy()
        return pa.table([pa.array([group["part"][0].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([unit(m).tobytes()], pa.binary())], names=["part", "names", "asked"])

    blocks = rows.mapInArrow(pack, "ids binary, units binary")
    packed = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("part").applyInArrow(pack_queries, "part int, names binary, asked binary")
    few = n * QUERY_BLOCK * (width + 1) * 8 <= BROADCAST_BYTES
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if few:
        met = blocks.join(F.broadcast(packed), "part")
    else:
        salts = F.lit(SALTS)
        salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        met = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), salts).cast("int")).join(salted, ["part", "salt"])

    def run(batches):
        for b in cut_up(batches, 1):
            for ids, units, names, asked in [[c[0].as_buffer() for c in b.columns]]:
                mine, m = np.frombuffer(ids, np.int64), np.frombuffer(units, np.float64).reshape(-1, width)
                who, q = np.frombuffer(names, np.int64), np.frombuffer(asked, np.float64).reshape(-1, width)
                for at in range(0, len(who), ROWS_AT_ONCE):
                    some = who[at : at + ROWS_AT_ONCE]
                    sims = q[at : at + ROWS_AT_ONCE] @ m.T
                    np.round(sims, 6, out=sims)
                    sims += 0.0
                    if skip_self:
                        sims[some[:, None] == mine[None, :]] = -np.inf
                    best = min(k, sims.shape[1])
                    # All that tie with the k-th stay, so that ties are broken over all rows.
                    least = np.partition(sims, sims.shape[1] - best, axis=1)[:, sims.shape[1] - best]
                    i, j = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
                    yield pa.RecordBatch.from_arrays([pa.array(some[i]), pa.array(mine[j]), pa.array(sims[i, j])], ["query_id", key, "sim"])

    out = met.select("ids", "units", "names", "asked").mapInArrow(run, f"query_id long, {key} long, sim double")
    return top_per(out, ["query_id"], [F.desc("sim"), F.col(key)], k)


def best_per_group(hits: DataFrame, group: str, key: str) -> DataFrame:
    """The best hit of each group: its score and its row's key."""
    return hits.groupBy(group).agg(F.max("sim").alias("best_sim"), F.min_by(key, F.struct(-F.col("sim"), F.col(key))).alias("best_key"))


def stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """How many rows there are, whether there are any, and their dimension."""
    return vectors.agg(F.count("*").alias("n"), (F.count("*") > 0).alias("has_index"), F.max(F.size(embedding)).alias("dimension"))


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """An offline stand-in for an embedding model: signed hashes of words, summed and scaled to length 1."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(counts, lambda x: x / length)).otherwise(counts)


def last_state(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete_files(vectors: DataFrame, gone: DataFrame, file: str = "file_path") -> DataFrame:
    return vectors.join(gone.select(file).distinct(), file, "left_anti")
