"""What the training-data operators share: tables, sizes, hash buckets, checkpoints."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: Bytes of text that one hash bucket of documents is meant to hold.
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column: one small aggregate over one column."""
    return df.select(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(total_bytes: int, each: int = BUCKET_BYTES) -> int:
    """Hash buckets of a few MB of text each, however large or small the input is."""
    return max(LEAST_BUCKETS, -(-total_bytes // each))


#: The shared folder for what must outlive executors.
checkpoint_dir = shared_folder


#: Rows of a few numbers that one file of a checkpoint is meant to hold.
FILE_ROWS = 500_000


def cut(spark: SparkSession, df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows with their lineage cut at a checkpoint in the shared folder, which outlives executors.

    rows: about how many small rows there are at most, where that is known: so many files are written and no more.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(spark))
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Returns freed memory to the system as a task's rows end: Spark keeps the worker, and the executor's memory has what its allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it, and alone needs it
    if trim is not None:
        trim(0)


def free_name(columns: list[str], base: str) -> str:
    """A name like base that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with its columns of these names renamed, and the expressions that give df's columns back."""
    clash = {c: free_name([*df.columns, *names], f"own_{c}") for c in df.columns if c.lower() in {n.lower() for n in names}}
    return df.withColumnsRenamed(clash), [F.col(f"`{clash.get(c, c)}`").alias(c) for c in df.columns]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, n: int, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for d in map(np.dtype, dtypes):
        out.append(np.frombuffer(data, d, n, at))
        at += n * d.itemsize
    return out
