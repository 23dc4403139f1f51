"""Graphs that are deep, and texts that contain names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataline.operators import graph, rag
from strataline.operators.relational import containing
from strataline.streaming import streams


def test_a_long_chain_is_ordered(spark):
    n = 12_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    loop = spark.createDataFrame([(n, n + 1), (n + 1, n + 2), (n + 2, n + 1), (n + 2, n + 3), (5, 5)], "src long, dst long")
    got = {r["node"]: r["level"] for r in graph.levels(chain.unionAll(loop)).collect()}
    assert len(got) == n + 4 and all(got[k] == k for k in range(n + 1)) and got[n + 1] == got[n + 2] == got[n + 3] == -1


def test_levels_peeled_over_the_cluster(spark):
    rng = random.Random(3)
    edges = {(a, rng.randrange(a + 1, 40)) for a in range(39) for _ in range(2)} | {(50, 51), (51, 50), (51, 52)}
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")
    want: dict[str, int] = {}
    for b in range(40):
        before = [want[f"n{a}"] for a, x in edges if x == b]
        if before or any(a == b for a, _ in edges):
            want[f"n{b}"] = max(before) + 1 if before else 0
    want |= dict.fromkeys(("n50", "n51", "n52"), -1)
    for few in (30, 1 << 18):
        assert {r["node"]: r["level"] for r in graph.levels(df, few).collect()} == want
    assert graph.levels(df.where("src = 'x'")).count() == 0


def test_pagerank_converges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4)], "src long, dst long")
    long = {r["node"]: r["rank"] for r in graph.pagerank(edges, fixed_rounds=120).collect()}
    found = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and all(abs(found[k] - long[k]) < 1e-4 for k in long)


def test_containing_is_every_substring(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab./") for _ in range(n))
    texts = [(k, word(rng.randrange(30))) for k in range(60)] + [(90, None), (91, "")]
    names = [(k, word(rng.randrange(9))) for k in range(60)] + [(90, None), (91, "")]
    got = {tuple(r) for r in containing(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(names, "target long, name string")).collect()}
    assert got == {(k, t) for k, x in texts for t, n in names if x and n and n in x} and len(got) > 100


def test_names_that_are_alike_meet_only_texts_that_hold_them(spark):
    """Pairs to test grow with what is found, though all names begin alike; names beyond the whole length are tested."""
    from strataline.operators.relational import candidates

    names = [(k, f"cust{k}") for k in range(1, 1500)] + [(k, f"a/folder/that/many/names/have/in/common/{k}.py") for k in range(2000, 2040)]
    texts = [(k, f"see cust{k * 7} and {k}.py, a/folder/that/many/names/have/in/common/{2000 + k % 50}.py, cust") for k in range(400)]
    df = spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(names, "target long, name string")
    want = {(k, t) for k, x in texts for t, n in names if n in x}
    assert {tuple(r) for r in containing(*df).collect()} == want
    assert candidates(*df).distinct().count() <= 2 * len(want)


def test_one_file_is_parsed_by_all_cores(spark, tmp_path):
    """Rows of a table in one file are dealt out before they are parsed, and each text is parsed once."""
    import ast

    from strataline.functions import parsing
    from strataline.plans import q_parse
    from strataline.plans.registry import Tables

    spark.range(50).selectExpr("id AS p_partkey", "CAST(id % 7 AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    for rows in (q_parse._py(t), q_parse._js(t)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert q_parse.dependencies(t).where("target = 'eval'").first()["n"] == 50

    code = q_parse._py(t).first()["code"]
    called, real = [], ast.parse
    parsing.ast.parse = lambda *a, **k: called.append(1) or real(*a, **k)
    try:
        found = parsing.dependencies(code, "a.py")
    finally:
        parsing.ast.parse = real
    assert len(called) == 1 and [f["target"] for f in found if f["kind"] == "base"] == ["Base"]
    shown = lambda nodes: [ast.dump(n) for n in nodes if not isinstance(n, ast.expr_context)]
    assert shown(parsing._walk(ast.parse(code))) == shown(ast.walk(ast.parse(code)))


def test_reviewed_diffs_are_parsed_once(spark, tmp_path):
    from strataline.plans import queries

    spark.range(20).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = queries()["review_findings"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.count() == 40


def test_loose_imports(spark):
    nodes = spark.createDataFrame([("a/b.py", "b.py", 0), ("x/a/b/c.py", "c.py", 1), ("d.py", "d.py", 2)], "id string, name string, place int")
    imports = spark.createDataFrame([("d.py", "a.b"), ("a/b.py", "b"), ("d.py", "c"), ("d.py", "none"), ("d.py", "c")], "source string, name string")
    assert {tuple(r) for r in rag.loose_imports(imports, nodes).collect()} == {("d.py", "a/b.py"), ("d.py", "x/a/b/c.py")}


def test_thoughts_in_a_stream_equal_the_whole_text(spark):
    """Every way to cut a text into tokens and batches gives its thoughts and answers."""
    rng = random.Random(3)
    texts = {f"s{k}": "".join(rng.choice(["<think>", "</think>", "<", "thi", "x", "</", "k>", "é "]) for _ in range(40)) for k in range(6)}
    rows, place = [], 0
    for s, text in texts.items():
        at = 0
        while at < len(text):
            n = rng.randrange(1, 6)
            rows.append((s, place, text[at : at + n]))
            at, place = at + n, place + 1
        rows.append((s, place, None))
        place += 1
    kinds = "session string, place long, token string"
    third = len(rows) // 3
    parts = [spark.createDataFrame(rows[a:b], kinds) for a, b in ((0, third), (third, 2 * third), (2 * third, len(rows)))]
    got: dict = {}
    for r in streams.in_parts(parts, streams.thoughts).orderBy("place").collect():
        got.setdefault((r["session"], r["kind"]), []).append(r["text"])
    want: dict = {}
    for s, text in texts.items():
        for kind, piece in streams.split_thoughts([text]):
            want.setdefault((s, kind), []).append(piece)
    assert {k: "".join(v) for k, v in got.items()} == {k: "".join(v) for k, v in want.items()}


def test_values_expire_over_restarts(spark):
    import datetime as d

    start = d.datetime(2024, 1, 1)
    times = [0, 10, 299, 300, 301, 599, 600, 5000, 5299, 5300, 20_000]
    frames = [spark.createDataFrame([("a", start + d.timedelta(seconds=s)) for s in times[i:j]] + [("b", start + d.timedelta(seconds=times[i]))], "key string, at timestamp") for i, j in ((0, 4), (4, 8), (8, 11))]
    got = sorted((r["key"], int((r["at"] - start).total_seconds())) for r in streams.in_parts(frames, lambda s: streams.loads(s, 300, "1 second")).collect())
    assert got == [("a", s) for s in (0, 300, 600, 5000, 5300, 20_000)] + [("b", s) for s in (0, 301, 5299)]


def test_streams_keep_a_state_for_many_keys(spark):
    """Python is called for a bucket of keys, not for each: states don't grow with the keys, and null is a key like any other."""
    import datetime as d

    start = d.datetime(2024, 1, 1)
    states = lambda base: spark.read.format("statestore").load(f"{base}/state").count()
    made: list[str] = []
    plain = streams.scratch

    def noted(s):
        made.append(plain(s))
        return made[-1]

    streams.scratch = noted
    try:
        keys = [*range(300), None, 2**62 + 1]
        at = lambda k, s, us=0: (k, start + d.timedelta(seconds=s, microseconds=us))
        frames = [[at(k, 0, 500) for k in keys], [at(k, 300) for k in keys] + [at(k, 300, 500) for k in keys]]
        got = streams.in_parts([spark.createDataFrame(f, "key long, at timestamp") for f in frames], lambda s: streams.loads(s, 300, "1 day", buckets=8))
        rows = sorted(((r["key"], r["at"]) for r in got.collect()), key=str)
        assert rows == sorted((at(k, s, 500) for k in keys for s in (0, 300)), key=str)
        tokens = [[(f"s{k}", 0, "a<th")] for k in range(300)], [[(f"s{k}", 1, "ink>b"), (f"s{k}", 2, None)] for k in range(300)]
        tokens = [[r for rows in part for r in rows] for part in tokens]
        got = streams.in_parts([spark.createDataFrame(p, "session string, place long, token string") for p in tokens], lambda s: streams.thoughts(s, 8))
        assert sorted(tuple(r) for r in got.collect()) == sorted(x for k in range(300) for x in [(f"s{k}", 0, "answer", "a"), (f"s{k}", 1, "thought", "b")])
    finally:
        streams.scratch = plain
    assert [0 < states(base) <= 9 for base in made] == [True, True]
