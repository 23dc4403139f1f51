"""Connected components over links, without gathering any of them.

Large-star and small-star rounds: each round hangs every node on the least of its
neighbours, and stops when nothing moves.  A round's links are written to the shared
checkpoint folder, so that lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A stop for links that change for ever, which they can't; rounds grow with the logarithm of a component.
MOST_ROUNDS = 100


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """a, b (bigint; any order, repeats allowed) to node, root: every linked node and the least node that it reaches."""
    spark = links.sparkSession
    links = cut(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hung = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A round makes no more links than there are ends of links.
        links = cut(spark, low.select(F.col("u").alias("a"), F.col("m").alias("b")).unionAll(hung).distinct(), 2 * before[0])
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
