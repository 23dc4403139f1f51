"""What one task gets of large tables: parts of so many rows, links by node."""

from __future__ import annotations

import random
import re

import pytest

from strataline import plans
from strataline.operators import graph, relational

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["graph_merge", "line_ranges", "git_expertise_map"])
def test_parts_grow_in_number_with_the_rows(spark, name, monkeypatch):
    """Groups, windows and joins of many rows keep to the parts that the rows ask for; before, the session's number held however many they were."""
    build = plans.queries()[name]
    want = sorted(map(tuple, build(spark, FOLDER).collect()), key=str)
    monkeypatch.setattr(relational, "TASK_ROWS", 1000)
    df = build(spark, FOLDER)
    assert sorted(map(tuple, df.collect()), key=str) == want
    tasks = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 1000)
    parts = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().sparkPlan().toString())]
    shuffles = re.findall(r"hashpartitioning\((.*?), (\d+)\), (\w+)", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert tasks > 4 and (parts or shuffles)
    # Only the two counts of graph_merge, a row of each kind from a task, are left to the session.
    assert {int(n) for keys, n, _ in shuffles if not keys.startswith("kind")} == {tasks}


def test_pagerank_joins_a_row_for_each_node(spark, monkeypatch):
    """After the edges themselves nothing of a row for each edge is written or joined, and hubs come in parts."""
    rng = random.Random(5)
    edges = {(a, rng.randrange(70)) for a in range(60) for _ in range(25)} | {(0, b) for b in range(70)}
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rank = dict.fromkeys(range(70), 1 / 70)
    for _ in range(7):
        loose = sum(r for x, r in rank.items() if x not in out)
        given = dict.fromkeys(rank, 0.0)
        for a, to in out.items():
            for b in to:
                given[b] += rank[a] / len(to)
        rank = {x: 0.85 * (g + loose / 70) + 0.15 / 70 for x, g in given.items()}
    plain, rows = graph.cut, []

    def counted(df):
        made = plain(df)
        rows.append(made.count())
        return made

    monkeypatch.setattr(graph, "cut", counted)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(df, fixed_rounds=7).collect()}
    assert got == pytest.approx(rank, abs=1e-12)
    assert max(rows[1:]) <= 71 < rows[0]
    monkeypatch.setattr(graph, "LINKS", 8)
    monkeypatch.setattr(relational, "TASK_ROWS", 100)
    assert {r["node"]: r["rank"] for r in graph.pagerank(df, fixed_rounds=7).collect()} == pytest.approx(rank, abs=1e-12)


def test_blast_report_makes_its_edges_once(spark, monkeypatch):
    from strataline.plans import registry

    made, plain = [], registry.Tables.edges.fget
    monkeypatch.setattr(registry.Tables, "edges", property(lambda t: made.append(1) or plain(t)))
    assert plans.queries()["graph_blast_report"](spark, FOLDER).columns == ["node", "distance", "risk", "level", "reason"]
    assert made == [1]
