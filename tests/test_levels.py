"""Levels of graphs of any depth against a plain queue, by the cluster alone and with a last task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strataline.operators import graph


def plain_levels(edges) -> dict:
    edges = {(a, b) for a, b in edges if a != b}
    nodes = {x for e in edges for x in e}
    level, left = {}, set(nodes)
    step = 0
    while True:
        ready = {x for x in left if not any(b == x and a in left for a, b in edges)}
        if not ready:
            return level | dict.fromkeys(left, -1)
        level |= dict.fromkeys(ready, step)
        left -= ready
        step += 1


def some_graphs():
    rng = random.Random(4)
    yield [(i, i + 1) for i in range(70)]
    yield [(i, (i + 1) % 9) for i in range(9)] + [(3, 100), (100, 101), (200, 100), (200, 201)]
    yield [(i, i + 1) for i in range(40)] + [(i, i + 5) for i in range(0, 36, 7)] + [(30, 27)]
    yield [(a, b) for i in range(6) for a in (2 * i, 2 * i + 1) for b in (2 * i + 2, 2 * i + 3)]
    yield [(1, 1), (2, 3), (2, 3), (3, 2), (3, 4), (5, 4), (4, 4)]
    for n, m in ((12, 14), (25, 30), (30, 60)):
        yield [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        yield [tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)]
    yield [(i, rng.randrange(max(0, i - 4), i)) for i in range(1, 50)]


@pytest.mark.parametrize("finish", [0, 1 << 18])
def test_levels(spark, finish):
    """All graphs side by side, each with numbers of its own."""
    edges = [(1000 * k + a, 1000 * k + b) for k, g in enumerate(some_graphs()) for a, b in g]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(2)
    assert {r["node"]: r["level"] for r in graph.levels(df, finish).collect()} == plain_levels(edges)


def test_no_edges(spark):
    assert graph.levels(spark.createDataFrame([], "src string, dst string")).collect() == []
    assert graph.levels(spark.createDataFrame([("a", "a")], "src string, dst string")).collect() == []


def test_a_long_chain_takes_few_rounds(spark):
    """Nodes in a row, dealt at random, a ring near the end: rounds grow with the logarithm."""
    n = 20_000
    far = F.xxhash64("id")
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).orderBy(far)
    df = chain.unionAll(spark.createDataFrame([(n - 10, n - 20)], "src long, dst long"))
    got = graph.levels(df, 0)
    right = F.when(F.col("node") >= n - 20, -1).otherwise(F.col("node")) == F.col("level")
    assert got.count() == n + 1 and got.where(~right).isEmpty()
