"""Windows of lines as expressions, and stable ids of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .relational import dealt_by

#: Lines of a window, and how many it shares with the next.
LINES, OVERLAP = 40, 5
#: Tokens that a chunk of the other kind aims at, shares with the next, and has at least.
TOKENS, TOKEN_OVERLAP, LEAST_TOKENS = 500, 50, 100


def split_lines(text) -> Column:
    """Lines of a text; a newline at its end begins none."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))


def line_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """key, start_line, end_line and content of windows of lines; a text of at most `lines` lines is one. Blank windows go."""
    all_lines = split_lines(text)
    n = F.size("_l")
    step = lines - overlap
    count = F.when(n <= lines, 1).otherwise(F.ceil((n - lines) / step) + 1)
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * step).cast("int"))
    rows = docs.select(key, all_lines.alias("_l")).where(F.size("_l") > 0).select(key, "_l", F.explode(starts).alias("_s"))
    rows = rows.select(key, (F.col("_s") + 1).alias("start_line"), F.least(F.col("_s") + lines, n).alias("end_line"), F.array_join(F.slice("_l", F.col("_s") + 1, lines), "\n").alias("content"))
    return rows.where(F.col("content").rlike(r"\S"))


def token_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_short: bool = True) -> DataFrame:
    """Windows of so many lines that they have about 500 tokens, 50 of them shared; ten lines at least.

    keep_short: also windows of under 100 tokens that don't reach the last line.
    """
    base = docs.select(key, split_lines(text).alias("_l"), tx.token_estimate(text).alias("_t")).where(F.size("_l") > 0)
    n = F.size("_l")
    # A text without tokens has as many lines to a chunk as it has lines.
    size = F.when(F.col("_t") == 0, n).otherwise(F.floor(F.lit(float(TOKENS)) / (F.col("_t") / n)))
    shared = F.when(F.col("_t") == 0, 2).otherwise(F.floor(F.lit(float(TOKEN_OVERLAP)) / (F.col("_t") / n)))
    base = base.withColumn("_c", F.greatest(F.lit(10), size).cast("int")).withColumn("_o", F.greatest(F.lit(2), shared).cast("int"))
    step = F.greatest(F.col("_c") - F.col("_o"), F.lit(1))
    # It goes on while a start lies before the last overlap.
    count = F.greatest(F.lit(1), F.ceil((n - F.col("_o")) / step))
    rows = base.select(key, "_l", "_c", F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * step).cast("int"))).alias("_s"))
    rows = rows.where(F.col("_s") < n)
    rows = rows.select(key, (F.col("_s") + 1).alias("start_line"), F.least(F.col("_s") + F.col("_c"), n).alias("end_line"), n.alias("_n"), F.array_join(F.slice("_l", F.col("_s") + 1, F.col("_c")), "\n").alias("content"))
    rows = rows.where(F.col("content").rlike(r"\S")).withColumn("token_count", tx.token_estimate("content"))
    if not keep_short:
        rows = rows.where((F.col("token_count") >= LEAST_TOKENS) | (F.col("end_line") == F.col("_n")))
    return rows.drop("_n")


def with_context(start: Column, end: Column, total: Column, around: int = 2) -> Column:
    """First and last line (from 1) of a span (from 0, end exclusive) with some lines around it."""
    return F.struct((F.greatest(F.lit(0), start - around) + 1).alias("start_line"), F.least(total, end + around).alias("end_line"))


def numbered(chunks: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """chunk_index from 0 in each file, and an id of project, file and index."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def brace_end(lines: DataFrame, keys: list[str]) -> DataFrame:
    """For lines (keys, line, content) of blocks: the first line at which all braces are closed again, else the last."""
    depth = F.regexp_count("content", F.lit(r"\{")) - F.regexp_count("content", F.lit(r"\}"))
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_d", F.sum(depth).over(w)).withColumn("_o", F.sum(F.regexp_count("content", F.lit(r"\{"))).over(w))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when((F.col("_o") > 0) & (F.col("_d") <= 0), F.col("line"))), F.max("line")).alias("end_line"))


def leftover_blocks(lines: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Runs of neighbouring lines (key, line), cut after `most` lines."""
    w = Window.partitionBy(key).orderBy("line")
    rows = lines.withColumn("_g", F.col("line") - F.row_number().over(w))
    rows = rows.withColumn("_b", F.floor((F.row_number().over(Window.partitionBy(key, "_g").orderBy("line")) - 1) / most))
    return rows.groupBy(key, "_g", "_b").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("_g", "_b")


def line_ranges(lines: DataFrame, key: str, line: str = "line", tasks: int | None = None) -> DataFrame:
    """key, ranges: runs of neighbouring lines as text such as 1-3, 7. tasks: into how many parts they are dealt, if they are many."""
    w = Window.partitionBy(key).orderBy(line)
    once = dealt_by(lines.select(key, line), tasks, key, line).distinct()
    runs = dealt_by(once, tasks, key).withColumn("_g", F.col(line) - F.row_number().over(w)).groupBy(key, "_g").agg(F.min(line).alias("a"), F.max(line).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("a", shown.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), ", ").alias("ranges"))
