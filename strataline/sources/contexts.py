"""Directory contexts made from listings and histories, without a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def generated(files: DataFrame, path: str = "path") -> DataFrame:
    """directory, description, files and subdirectories of every folder that holds files or folders."""
    folder = tx.dirname(path)
    kind = tx.file_kind(tx.basename(path))
    entry = F.struct(tx.basename(path).alias("name"), F.concat(F.lit("File of type "), kind).alias("purpose"), kind.alias("type"))
    own = files.groupBy(folder.alias("directory")).agg(F.array_sort(F.collect_list(entry)).alias("files"))
    parts = F.split(F.col(path), "/")
    above = files.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("directory"), F.element_at(parts, i).alias("name")))).otherwise(F.array())).alias("s")).select("s.*").distinct()
    below = above.groupBy("directory").agg(F.array_sort(F.collect_list("name")).alias("subdirectories"))
    both = own.join(below, "directory", "full_outer")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    both = both.withColumn("files", F.coalesce("files", F.array().cast("array<struct<name:string,purpose:string,type:string>>"))).withColumn("subdirectories", F.coalesce("subdirectories", F.array().cast("array<string>")))
    words = F.concat(F.lit("Directory containing "), n("files").cast("string"), F.lit(" files and "), n("subdirectories").cast("string"), F.lit(" subdirectories."))
    return both.select("directory", words.alias("description"), "files", "subdirectories")


def updated(contexts: DataFrame, commits: DataFrame, n: int = 10) -> DataFrame:
    """Contexts with the newest changes below each: sha, message and author of up to n commits."""
    parts = F.split(F.col("file"), "/")
    at = commits.select("sha", "message", "author", "date", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("directory")).distinct()
    from ..operators.relational import top_per

    top = top_per(at, ["directory"], [F.desc("date"), F.desc("sha")], n)
    recent = top.groupBy("directory").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sha", "message", "author"))), lambda c: F.struct(c["sha"].alias("sha"), c["message"].alias("message"), c["author"].alias("author"))).alias("recent"))
    return contexts.join(recent, "directory", "left")
