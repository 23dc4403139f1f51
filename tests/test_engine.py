"""Sources, stores, exports, parsers, graphs and the facade on small things of their own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strataline.functions import parsing, scores
from strataline.functions import text as tx
from strataline.operators import annindex, chunking, git, graph, rag, resolve, rules, vector
from strataline.plans.api import Engine
from strataline.sources import exports, files, stores
from strataline.streaming import streams

TREE = {
    "a.py": "import pkg.b\nfrom pkg import c\n\ndef top(x, y=1):\n    '''Says top things loudly.'''\n    if x and y:\n        return eval(x)\n    return y\n\n\nclass K(Base):\n    def m(self):\n        return 1\n",
    "pkg/__init__.py": "",
    "pkg/b.py": "from . import c\nfrom .c import thing\n\nasync def go():\n    await x()\n",
    "pkg/c.py": "thing = 1\n",
    "web/x.ts": "import { y } from './y'\nimport z from '../z'\nexport const f = async (a, b = 2) => {\n  return y\n}\n",
    "web/y.ts": "export class Y {\n  m() { return 1 }\n}\n",
    "z.ts": "export const z = 1\n",
    "broken.py": "def broken(:\n",
    "node_modules/skip.js": "x",
    ".hidden/h.py": "x = 1",
    "readme.md": "no code",
    "UPPER.PY": "x = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        p = base / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (base / "latin.py").write_bytes(b"s = '\xe9'\n")
    (base / "pkg" / ".context.yaml").write_text("directory: pkg\ndescription: parts that parse\nfiles:\n  - name: b.py\n    purpose: runs things\n    key_apis: [go]\n")
    return str(base)


@pytest.fixture(scope="module")
def texts(spark, root):
    return files.texts(files.source_files(spark, root)).cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tree_is_read(texts):
    found = {r["path"]: r for r in texts.collect()}
    assert set(found) == {"a.py", "pkg/__init__.py", "pkg/b.py", "pkg/c.py", "web/x.ts", "web/y.ts", "z.ts", "broken.py", "UPPER.PY", "latin.py"}
    assert found["latin.py"]["text"] == "s = '�'\n" and found["a.py"]["language"] == "python" and found["a.py"]["lines"] == TREE["a.py"].count("\n")


def test_tree_filters(spark, root):
    assert rows(files.source_files(spark, root, [".ts"]), "path") == [("web/x.ts",), ("web/y.ts",), ("z.ts",)]
    assert rows(files.source_files(spark, root, folders=["pkg"]), "path") == [("pkg/__init__.py",), ("pkg/b.py",), ("pkg/c.py",)]
    tree = files.tree(files.source_files(spark, root, folders=["pkg", "web"]))
    assert ("pkg", "directory") in rows(tree, "path", "type") and ("web/y.ts", "file") in rows(tree, "path", "type")
    assert ("y.ts", len(TREE["web/y.ts"])) in [(n, s) for n, s in rows(files.listing(spark, root), "name", "size")]


def test_contexts(spark, root):
    c = files.contexts(spark, root)
    assert c.first()["files"][0]["key_apis"] == ["go"]
    assert rag.context_search(c, "pkg").first()["score"] == 5.5
    assert rag.validated(c).first()["valid"] == 1
    assert files.context_rows("- x")[0]["error"] == "not a mapping" and files.context_rows(": : :\n\t-")[0]["error"]


def test_project_graph(spark, texts, tmp_path):
    e = Engine(spark, str(tmp_path))
    nodes, edges = e.project_graph(texts)
    imports = rows(edges.where("type = 'imports'"), "src", "dst")
    assert imports == [("a.py", "pkg/__init__.py"), ("a.py", "pkg/b.py"), ("pkg/b.py", "pkg/__init__.py"), ("pkg/b.py", "pkg/c.py"), ("web/x.ts", "web/y.ts"), ("web/x.ts", "z.ts")]
    assert ("mod:pkg", "module") in rows(nodes, "id", "type") and ("fn:a.py:top:4", "function") in rows(nodes, "id", "type")
    n2, e2 = e.with_owners(nodes, edges, spark.createDataFrame([("a.py", "ann"), ("gone.py", "bob")], "file string, owner string"))
    assert n2.where("type = 'author'").count() == 1 and e2.where("type = 'owns'").count() == 1
    _, e3 = e.with_decisions(nodes, edges, spark.createDataFrame([(1, "we split pkg/b.py today."), (2, "none")], "id long, text string"))
    assert rows(e3.where("type = 'affects'"), "src", "dst") == [("dec:1", "pkg/b.py")]
    hit = e.impact(edges.where("type = 'imports'"), "pkg/c.py")
    assert rows(hit, "node", "distance") == [("a.py", 2), ("pkg/b.py", 1)]
    assert "affects 2 file(s)" in e.impact_report(edges.where("type = 'imports'"), "pkg/c.py").first()["narrative"]


def test_index_and_update(spark, root, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    first = e.index(root).first()
    assert first["n"] > 8 and first["dimension"] == 64
    chunks = stores.read(spark, f"{e.store}/chunks")
    one = chunks.where("file_path = 'a.py' and chunk_type = 'function'").first()
    assert (one["start_line"], one["end_line"]) == (2, 10)
    top = e.search(list(one["embedding"]), 3)
    assert top.first()["id"] == one["id"] and top.first()["sim"] == 1.0
    assert e.ask(list(one["embedding"])).count() == 10
    changes = spark.createDataFrame([("deleted", "a.py", None), ("modified", "z.ts", None)], "kind string, path string, old_path string")
    after = e.update(root, changes).first()["n"]
    now = stores.read(spark, f"{e.store}/chunks")
    assert now.where("file_path = 'a.py'").count() == 0 and now.where("file_path = 'z.ts'").count() == 1 and after < first["n"]
    e.index_history(spark.createDataFrame([(k, f"c{k}") for k in range(25)], "date long, sha string"))
    assert e.index_history().count() == 20
    queries = spark.createDataFrame([(1, [float(x) for x in one["embedding"]])], "vec_id long, embedding array<double>")
    assert e.onboard(queries, 200).agg(F.sum(F.length("snippet"))).first()[0] <= 200
    assert set(e.dashboard(git_commits(spark))) == {"graph", "commits", "sessions"}
    e.delete_index()
    assert e.index_check().first()["n"] == 0


def git_commits(spark):
    import datetime as d

    at = lambda k: d.datetime(2024, 1, 1) + d.timedelta(days=k)
    return spark.createDataFrame([("s1", "ann", at(1), "m", "a.py"), ("s2", "bob", at(2), "m", "a.py"), ("s3", "bob", at(3), "m", "z.ts")], "sha string, author string, date timestamp, message string, file string")


def test_reviews_and_rules(spark, texts, tmp_path):
    e = Engine(spark, str(tmp_path))
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n+api_key = 'abcdefghij123'\n+password = 'hunter22'\n"
    found = e.review(spark.createDataFrame([(1, diff)], "id long, text string"))
    assert rows(found, "file", "line", "severity") == [("x.py", 1, "critical"), ("x.py", 2, "critical")]
    snippet = spark.createDataFrame([(1, "a\nx = eval (1)\nquery(f'x')\nEVAL(2)")], "id long, text string")
    assert rows(e.scan_snippet(snippet), "line", "category") == [(2, "dangerous_call"), (3, "sql_injection"), (4, "dangerous_call")]
    assert ("a.py", 7, "call") in rows(e.scan_syntax(texts), "path", "line", "origin")
    report = e.compliance_report(e.scan_project(texts.select("path", "text")))
    r = report.first()
    assert r["critical"] >= 1 and not r["passed"] and e.checks().count() == 6
    assert parsing.syntax_findings("retrieval = 1", whole_words=True) == [] and parsing.syntax_findings("retrieval = 1")
    assert e.compliance_report(e.scan_project(texts.select("path", F.lit("fine").alias("text")))).first()["score"] == 100.0


def test_scores_by_hand(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(scores.compliance_score(F.lit(25 + 20 + 3))) == 52.0
    assert value(scores.risk(F.lit(2), F.lit(0.8), F.lit(1.0), scores.churn_factor(F.lit(10)))) == 0.2
    assert value(scores.risk_reason(F.lit(1), F.lit(1.0), F.lit(1.0), False)) == "direct importer; high centrality"
    assert [value(scores.line_health(F.lit(n))) for n in (0, 49, 50, 200, 201, 500, 501, 1000, 1001)] == [0.8, 0.95, 1.0, 1.0, 0.85, 0.85, 0.65, 0.65, 0.4]
    assert value(scores.structure_v1(F.lit(True), F.lit(10), F.lit(2))) == pytest.approx(8.4)
    assert value(scores.structure_v2(F.lit(True), F.lit(3), F.lit(10), F.lit(2))) == 10.0
    assert value(scores.legacy_health(F.lit(30), F.lit(12))) == 46
    assert value(scores.expertise(F.lit(120), F.lit(4))) == 140.0
    assert value(scores.doc_quality(F.lit(True), F.lit(40), F.lit(1), F.lit(2), F.lit("function"), F.lit(True), F.lit(False), F.lit(False))) == 80.0
    assert value(scores.rerank_score(F.lit(0.4), F.lit("alpha beta"), F.split(F.lit("alpha beta gamma delta"), " "), F.lit("function"))) == pytest.approx(0.73)
    assert value(tx.token_estimate(F.lit("a b c d e f g h i j"))) == 13
    assert value(tx.keywords(F.lit("how does the indexing pipeline work"))) == ["indexing", "pipeline", "work"]
    assert value(tx.is_trivial_commit(F.lit("chore: bump deps and regenerate lockfiles today"))) and not value(tx.is_trivial_commit(F.lit("switch REST to gRPC because of latency")))
    alerts = [(0.5, 120.0), (0.2, 2500.0), (0.1, 450.0), (0.0, 95.0), (0.3, 15000.0), (0.2, 8000.0)]
    assert [value(scores.alert_level(F.lit(e), F.lit(p))) for e, p in alerts] == ["none", "warning", "none", "none", "critical", "critical"]
    assert value(scores.clamp01(F.lit(None).cast("double"))) is None


def test_line_windows_cover_every_line(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(100))), (2, "\n".join("x" * 40)), (3, None), (4, ""), (5, "one\r\ntwo\rthree\n")], "doc_id long, text string")
    w = rows(chunking.line_windows(docs), "doc_id", "start_line", "end_line")
    assert w == [(1, 1, 40), (1, 36, 75), (1, 71, 100), (2, 1, 40), (5, 1, 3)]
    ranges = chunking.line_ranges(spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 7, 9)], "f long, line long"), "f")
    assert ranges.first()["ranges"] == "1-3, 7, 9"


def test_graph_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert graph.closure_count(e, 1, 5).first()[0] == 3
    assert rows(graph.distances(e, 1, 4, reverse=True), "node", "distance") == [(2, 2), (3, 1)]
    rank = {r["node"]: r["rank"] for r in graph.pagerank(e).collect()}
    assert all(abs(v - 1 / 3) < 1e-6 for v in rank.values())
    rng = random.Random(1)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(50)]
    got = graph.pagerank(spark.createDataFrame(edges, "src long, dst long"))
    assert abs(got.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert [(r["node"], r["level"]) for r in graph.topological_order(chain).collect()] == [("a", 0), ("b", 1), ("c", 2), ("x", -1), ("y", -1)]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(graph.valid_edges(chain, nodes), "src", "dst") == [("a", "b")]


def test_nearest_are_nested(spark):
    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(8)]) for i in range(200)] + [(900, None), (901, [0.0] * 8)], "vec_id long, embedding array<double>")
    few, more = (rows(vector.nearest_many(v, v.where("vec_id % 50 = 0"), k), "query_id", "vec_id") for k in (3, 4))
    assert set(few) < set(more) and len(few) == 3 * 4
    exact = annindex.CodedIndex.fit(v, 8).search(v.where("vec_id = 0"), 5, 8, 200)
    assert rows(exact, "vec_id") == rows(vector.nearest_many(v, v.where("vec_id = 0"), 5), "vec_id")


def test_parsers_take_anything():
    for code in ("", "def f(:", "\x00", "class A:\n  def m(self): pass", "x" * 5000, "{" * 100):
        for path in ("a.py", "a.ts"):
            for parse in (parsing.chunks, parsing.blocks, parsing.symbols, parsing.imports, parsing.signatures, parsing.dependencies, parsing.elements, parsing.variables, parsing.docstring, parsing.added_lines):
                assert isinstance(parse(code, path), list)
    assert parsing.block_end(["f() {", "{ }", "}", "x"], 0) == 3


def test_docs_are_written_into_code():
    code = 'def a():\n    return 1\n\nclass B:\n    """Old."""\n    x = 1\n'
    out = parsing.insert_docs(code, [(1, "Does a."), (4, "New.\n\nMore.")])
    compile(out, "x", "exec")
    assert '"""Does a."""' in out and "Old." not in out and "More." in out
    assert parsing.insert_docs("function f() {\n}\n", [(1, "Says.")], "x.js").startswith("/**\n * Says.\n */\nfunction f")


def test_git_parsers(spark):
    one = lambda *ls: spark.createDataFrame([(k, x) for k, x in enumerate(ls)], "n long, line string")
    assert rows(git.name_status(one("A\ta.py", "R100\told\tnew", "")), "kind", "path") == [("added", "a.py"), ("renamed", "new")]
    assert rows(git.numstat(one("3\t1\ta", "-\t-\tbin")), "path", "additions") == [("a", 3), ("bin", 0)]
    assert git.log_lines(one("h|ann|a | b|2024")).first()["date"] == " b|2024"
    clean = git.totals(spark.createDataFrame([], "path string, additions long, deletions long, staged boolean, unstaged boolean"))
    assert clean.first()["summary"].startswith("The working tree is clean")


def test_breaking_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    old = spark.createDataFrame([("a.py", "def f(a): pass\ndef g(): pass\n")], "path string, text string")
    new = spark.createDataFrame([("a.py", "def f(a, b): pass\ndef h(): pass\n")], "path string, text string")
    assert rows(e.breaking_changes(old, new), "symbol", "change_type") == [("f", "added_required_param"), ("g", "removed_function"), ("h", "added_function")]


def test_health_and_documentation(spark, texts, tmp_path):
    e = Engine(spark, str(tmp_path))
    health = {r["path"]: r for r in e.health(texts, git_commits(spark)).collect()}
    assert health["a.py"]["average"] == 2.0 and health["broken.py"]["health"] == 1.0
    gaps = {r["name"]: r["quality"] for r in e.doc_gaps(texts.select("path", "text")).collect()}
    assert gaps["top"] == 60.0 and gaps["K"] == 0.0
    assert e.structure(texts, True).first()["folders"] == 2
    pages = spark.createDataFrame([("a.py", "class", "Z", "Zed <b>"), ("a.py", "function", "f", None)], "file string, kind string, name string, doc string")
    md = exports.markdown(pages).first()["content"]
    assert md.index("## Z") < md.index("## f") and "&lt;b&gt;" in exports.html(pages).first()["content"]
    e.export(pages, str(tmp_path / "md"))
    stats = spark.createDataFrame([("a.py", 6.0, 1.0, 10.0, "boom")], "key string, error_rate double, avg_latency_ms double, p99_latency_ms double, last_error string")
    got = {r["path"]: r["alert_level"] for r in e.runtime(texts.select("path"), stats).collect()}
    assert got["a.py"] == "critical"


def test_stores(spark, tmp_path):
    p = str(tmp_path / "t")
    df = lambda *xs: spark.createDataFrame(list(xs), "id long, v string")
    stores.put(df((1, "a"), (2, "b")), p, ["id"])
    stores.put(df((2, "c"), (3, "d")), p, ["id"])
    assert rows(stores.read(spark, p), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    stores.drop_rows(spark, p, spark.createDataFrame([(1,)], "id long"))
    assert stores.read(spark, p).count() == 2
    with pytest.raises(ValueError):
        stores.append_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k long, embedding array<double>"), str(tmp_path / "v"))
    s = stores.Sessions(spark, str(tmp_path / "s"))
    import datetime as d

    now = d.datetime(2024, 1, 1)
    s.add(spark.createDataFrame([("x", 0, "user", "hi", now, False), ("x", 0, "user", "hello", now + d.timedelta(1), False), ("y", 0, "user", "yo", now, False)], stores.Sessions.SCHEMA))
    assert rows(s.messages(), "session_id", "content") == [("x", "hello"), ("y", "yo")]
    s.delete("y")
    assert rows(s.recent(), "session_id", "title") == [("x", "hello")]


def test_streams(spark, tmp_path):
    assert streams.split_thoughts(["a<th", "ink>b</thi", "nk>c <t"]) == [("answer", "a"), ("thought", "b"), ("answer", "c "), ("answer", "<t")]
    clock = [0.0]
    loads = []
    get = streams.expiring(spark, lambda: loads.append(1) or spark.range(3), 300, lambda: clock[0])
    get(), get()
    clock[0] = 301.0
    assert get().count() == 3 and len(loads) == 2


def test_resolution_of_runtime_paths(spark):
    paths = spark.createDataFrame([("/src/a/b.py",), ("lib/b.py",), ("c.py",)], "path string")
    stats = spark.createDataFrame([("b.py", 1), ("deep/x/c.py", 2)], "key string, n long")
    assert rows(resolve.nearest_runtime(paths, stats).select("path", "n"), "path", "n") == [("/src/a/b.py", 1), ("c.py", 2), ("lib/b.py", 1)]
    broken = rules.rules_table(spark, [("c", "(", "high", "m"), ("c", "x", "odd", "m")])
    assert rows(broken, "pattern", "severity") == [("x", "medium")]


def test_neighbours_of_hot_nodes_are_bounded(spark):
    e = spark.createDataFrame([(0, k) for k in range(50)] + [(1, 0)], "src long, dst long")
    n = {r["node"]: r for r in graph.neighbours(e, 3).collect()}
    assert n[0]["imports"] == [0, 1, 2] and n[0]["imported_by"] == [0, 1] and n[49]["imports"] == []


def test_sql_functions(spark):
    from strataline.functions.register import register

    names = register(spark)
    assert "cosine_of" in names and "code_imports" in names
    assert spark.sql("SELECT cosine_of(array(0D), array(1D)) AS c").first()["c"] == 0.0
    assert spark.sql("SELECT * FROM code_imports('import os', 'a.py')").first()["specifier"] == "os"


def test_generated_contexts(spark):
    from strataline.sources import contexts

    df = spark.createDataFrame([("a.py",), ("pkg/b.py",), ("pkg/sub/test_c.py",)], "path string")
    got = {r["directory"]: r for r in contexts.generated(df).collect()}
    assert set(got) == {"", "pkg", "pkg/sub"}
    assert got["pkg"]["description"] == "Directory containing 1 files and 1 subdirectories."
    assert got["pkg/sub"]["files"][0]["purpose"] == "File of type test" and got[""]["subdirectories"] == ["pkg"]
