"""An approximate index of vectors: spilled cells of short codes, and exact scores for a few rows of each query.

Centres are fitted on a bounded sample; every row stands in its `spill` nearest cells, as a code
of four bits for each dimension (after a fixed rotation, so that dimensions are alike).  A search
reads the codes of each query's nearest `probes` cells, keeps the `refine` best estimates, and
only those rows' vectors are met and scored exactly.  So what is read of the rest is a sixteenth
of vectors of doubles, and what is scored is a number of rows that doesn't grow with the table.

Codes lie in blocks of bounded size, queries meet the blocks of a cell by an equal join, and a
block keeps its own best of each query, so neither a hot cell nor many queries make a large task
and nothing but centres (bounded by `cells`) is on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from .relational import top_per

#: Rows of the sample that centres are fitted on, at most.
SAMPLE = 20_000

#: Rows of codes, and queries, in one block.
CODE_BLOCK = 4096
QUERY_BLOCK = 512

#: Queries that are compared with a block at once.
QUERIES_AT_ONCE = 128

#: A code's steps, and how many standard deviations of a dimension they span to either side.
STEPS = 16
SPAN = 3.0

BLOCK = "cell int, ids binary, codes binary"


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def centres(m: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = m[np.linspace(0, len(m) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (m @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        c = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, unit(sums), c)
    return c


def rotation(dimension: int) -> np.ndarray:
    """A fixed rotation, so that no dimension holds more than others."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(m: np.ndarray) -> np.ndarray:
    """Four bits for each dimension of rotated unit vectors, two in a byte."""
    step = 2 * SPAN / math.sqrt(m.shape[1]) / STEPS
    q = np.clip(np.floor(m / step) + STEPS // 2, 0, STEPS - 1).astype(np.uint8)
    if q.shape[1] % 2:
        q = np.concatenate((q, np.full((len(q), 1), STEPS // 2, np.uint8)), 1)
    return q[:, ::2] << 4 | q[:, 1::2]


def decode(codes: np.ndarray, dimension: int) -> np.ndarray:
    step = 2 * SPAN / math.sqrt(dimension) / STEPS
    q = np.empty((len(codes), 2 * codes.shape[1]), np.float32)
    q[:, ::2], q[:, 1::2] = codes >> 4, codes & 15
    return ((q + (0.5 - STEPS // 2)) * np.float32(step))[:, :dimension]


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have this many numbers, all finite, as a matrix, and their places."""
    place = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimension)
    m = column.take(pa.array(place)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(place), dimension)
    good = np.isfinite(m).all(axis=1)
    return m[good], place[good]


def cut_up(batches, rows: int):
    """Batches in slices of so many rows: what is made of a batch is bounded, however many blocks it holds."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class CodedIndex:
    """Built by `fit`, kept by `save` and `load`, asked by `search`. Rows without a vector of the index's dimension aren't in it."""

    def __init__(self, centre: np.ndarray, blocks: DataFrame, vectors: DataFrame, key: str, embedding: str):
        self.centre, self.blocks, self.vectors, self.key, self.embedding = centre, blocks, vectors, key, embedding

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int, spill: int = 2, key: str = "vec_id", embedding: str = "embedding", rounds: int = 10) -> CodedIndex:
        vectors = vectors.select(F.col(key).cast("long").alias(key), F.col(embedding).cast("array<double>").alias(embedding)).where(F.col(embedding).isNotNull() & F.col(key).isNotNull())
        sample = [r[0] for r in vectors.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(embedding).collect()]
        sample = [e for e in sample if None not in e and len(e) == max(map(len, sample))]
        m = unit(np.array(sample, np.float64)) if sample else np.zeros((1, 1))
        centre = centres(m, min(cells, len(m)), rounds)
        return cls(centre, cls._packed(cls._assigned(vectors, centre, spill)), vectors, key, embedding)

    @staticmethod
    def _assigned(vectors: DataFrame, centre: np.ndarray, spill: int) -> DataFrame:
        """cell, id, code of each row, in its nearest cells."""
        sent = vectors.sparkSession.sparkContext.broadcast(centre)

        def run(batches):
            c = sent.value
            turn = rotation(c.shape[1])
            n = min(spill, len(c))
            for b in batches:
                m, place = matrix(b.column(1), c.shape[1])
                if len(m):
                    m = unit(m)
                    near = np.argpartition(-(m @ c.T), n - 1, axis=1)[:, :n]
                    codes = encode(m @ turn)
                    ids = b.column(0).take(pa.array(np.repeat(place, n)))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), ids, pa.array([x.tobytes() for x in np.repeat(codes, n, axis=0)], pa.binary())], ["cell", "id", "code"])

        return vectors.mapInArrow(run, "cell int, id long, code binary")

    @staticmethod
    def _packed(rows: DataFrame) -> DataFrame:
        """Codes of a cell in blocks; a cell's number of blocks follows its rows, so that a hot cell is many blocks."""
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / CODE_BLOCK).cast("int").alias("parts"))
        placed = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row for each cell

        def pack(group: pa.Table) -> pa.Table:
            out = []
            for at in range(0, group.num_rows, 2 * CODE_BLOCK):
                g = group.slice(at, 2 * CODE_BLOCK)
                out.append((g["cell"][0].as_py(), g["id"].to_numpy().tobytes(), b"".join(g["code"].to_pylist())))
            cell, ids, codes = zip(*out, strict=True)
            return pa.table([pa.array(cell, pa.int32()), pa.array(ids, pa.binary()), pa.array(codes, pa.binary())], names=["cell", "ids", "codes"])

        return placed.groupBy("cell", "part").applyInArrow(pack, BLOCK)

    def save(self, folder: str) -> None:
        """Writes the index (centres and blocks of codes) as Parquet."""
        spark = self.blocks.sparkSession
        self.blocks.write.parquet(f"{folder}/codes")
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centre)], "cell int, centre array<double>").write.parquet(f"{folder}/centres")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> CodedIndex:
        centre = np.array([r["centre"] for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()])
        return cls(centre, spark.read.parquet(f"{folder}/codes"), vectors, key, embedding)

    def _asked(self, queries: DataFrame, probes: int) -> DataFrame:
        """cell, ids, vectors: the queries of each cell that they probe, in blocks."""
        sent = queries.sparkSession.sparkContext.broadcast(self.centre)

        def run(batches):
            c = sent.value
            turn, n = rotation(c.shape[1]), min(probes, len(c))
            for b in cut_up(batches, 1024):
                m, place = matrix(b.column(1), c.shape[1])
                if len(m):
                    m = unit(m)
                    near = np.argpartition(-(m @ c.T), n - 1, axis=1)[:, :n]
                    turned = [x.tobytes() for x in (m @ turn).astype(np.float32)]
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(pa.array(np.repeat(place, n))), pa.array([t for t in turned for _ in range(n)], pa.binary())], ["cell", "id", "q"])

        rows = queries.mapInArrow(run, "cell int, id long, q binary")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
        placed = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        packed = placed.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "q")).alias("asked"))
        return packed.select("cell", "asked")

    def candidates(self, queries: DataFrame, probes: int, refine: int) -> DataFrame:
        """query_id, key: of each query's probed cells the rows with the best estimates, itself left out."""
        dimension = self.centre.shape[1]
        queries = queries.select(F.col(self.key).cast("long"), F.col(self.embedding).cast("array<double>")).where(F.col(self.embedding).isNotNull() & F.col(self.key).isNotNull())
        met = self.blocks.join(self._asked(queries, probes), "cell")

        def run(batches):
            for b in cut_up(batches, 1):
                mine = np.frombuffer(b.column(0)[0].as_buffer(), np.int64)
                rows = decode(np.frombuffer(b.column(1)[0].as_buffer(), np.uint8).reshape(len(mine), -1), dimension)
                every = b.column(2).flatten()
                for some in cut_up([pa.RecordBatch.from_arrays(every.flatten(), ["id", "q"])], QUERIES_AT_ONCE):
                    names = some.column(0).to_numpy()
                    q = np.frombuffer(b"".join(some.column(1).to_pylist()), np.float32).reshape(len(names), dimension)
                    guess = q @ rows.T
                    guess[names[:, None] == mine[None, :]] = -np.inf
                    n = min(refine, len(mine))
                    best = np.argpartition(-guess, n - 1, axis=1)[:, :n]
                    sims = np.take_along_axis(guess, best, 1).ravel()
                    keep = np.isfinite(sims)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)[keep]), pa.array(mine[best.ravel()][keep]), pa.array(sims[keep].astype(np.float64))], ["query_id", "id", "guess"])

        found = met.select("ids", "codes", "asked").mapInArrow(run, "query_id long, id long, guess double")
        once = found.groupBy("query_id", "id").agg(F.max("guess").alias("guess"))  # a spilled row is met in several cells
        return top_per(once, ["query_id"], [F.desc("guess"), F.col("id")], refine).select("query_id", F.col("id").alias(self.key))

    def search(self, queries: DataFrame, k: int, probes: int, refine: int) -> DataFrame:
        """query_id, key, sim, rank of each query's k nearest among its candidates, scored exactly."""
        asked = queries.select(F.col(self.key).cast("long").alias("query_id"), F.col(self.embedding).cast("array<double>").alias("_q"))
        pairs = self.candidates(queries, probes, refine).join(self.vectors.select(self.key, F.col(self.embedding).alias("_v")), self.key).join(asked, "query_id")
        scored = pairs.select("query_id", self.key, F.round(scores.cosine("_v", "_q"), 6).alias("sim"))
        return top_per(scored, ["query_id"], [F.desc("sim"), F.col(self.key)], k)

