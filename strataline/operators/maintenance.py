"""Keeping an index up to date, and histories short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindexed(index: DataFrame, changes: DataFrame, fresh: DataFrame, file: str = "file_path") -> DataFrame:
    """An index after a diff: without the chunks of deleted, renamed and modified files, with the new ones of what is there.

    changes: kind (added, modified, deleted, renamed), path, old_path.
    """
    gone = changes.where(F.col("kind").isin("deleted", "modified")).select(F.col("path").alias(file)).unionAll(changes.where(F.col("kind") == "renamed").select(F.col("old_path").alias(file))).distinct()
    come = changes.where(F.col("kind").isin("added", "modified", "renamed")).select(F.col("path").alias(file)).distinct()
    return index.join(gone, file, "left_anti").join(come, file, "left_anti").unionByName(fresh.join(come, file, "left_semi"))


def keep_last(rows: DataFrame, n: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The last n rows in order, of each key if there are keys."""
    if not keys:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_filled(history: DataFrame, value: str, order: str) -> DataFrame:
    """The last value that isn't empty."""
    return history.where(F.coalesce(F.col(value), F.lit("")) != "").agg(F.max_by(value, order).alias(value))


def estimate(files: DataFrame, path: str = "path", lines: str = "lines") -> DataFrame:
    """Files, lines and chunks of 40 lines by extension, by the two first folders, and in all: one pass."""
    from ..functions import text as tx

    parts = F.split(F.col(path), "/")
    folder = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    rows = files.select(tx.suffix(path).alias("ext"), folder.alias("dir"), F.col(lines).alias("lines"), F.greatest(F.lit(1), F.ceil(F.col(lines) / 40)).cast("long").alias("chunks"))
    out = rows.groupingSets([["ext"], ["dir"], []], "ext", "dir").agg(F.grouping_id().alias("g"), F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("chunks").alias("chunks"))
    level = F.when(F.col("g") == 1, "ext").when(F.col("g") == 2, "dir").otherwise("total")
    return out.select(level.alias("level"), F.coalesce("ext", "dir", F.lit("")).alias("name"), "files", "lines", "chunks")
