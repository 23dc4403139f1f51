"""Trees walked by tasks, and folders of contexts, rules, statistics and decisions."""

from __future__ import annotations

import os

import pytest

from strataline.functions import fixed
from strataline.sources import files, tree


def put(base, **named):
    for name, text in named.items():
        at = base / name.replace("__", "/").replace("_dot_", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def root(tmp_path):
    for k in range(12):
        for j in range(5):
            at = tmp_path / f"d{k % 3}" / f"e{k}" / "deep" / f"_f{j}.py"
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(f"{k}{j}\n" * j)
    for skipped in ("node_modules", ".hidden", "d0/dist"):
        (tmp_path / skipped).mkdir(parents=True)
        (tmp_path / skipped / "x.py").write_text("x")
    (tmp_path / "d0" / "empty").mkdir()
    (tmp_path / ".dotted.py").write_bytes(b"\xff\xfe")
    (tmp_path / "a&b ü.ts").write_text("é")
    return tmp_path


@pytest.mark.parametrize("budget", [1, 7, 20_000])
def test_a_walk_in_any_number_of_rounds(spark, root, monkeypatch, budget):
    monkeypatch.setattr(tree, "BUDGET", budget)
    want = set()
    for at, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not tree.skipped(f)]
        want |= {(os.path.relpath(os.path.join(at, n), root), kind) for kind, ns in (("file", names), ("directory", folders)) for n in ns}
    got = [(r["path"], r["type"]) for r in tree.entries(spark, str(root)).collect()]
    assert set(got) == want and len(got) == len(want)
    below = {p for p, kind in want if p.startswith(("d1/e4", "d2/"))}
    assert {r["path"] for r in tree.entries(spark, str(root), beginnings=["d1/e4", "d2/"]).collect()} == below


def test_all_names_when_nothing_is_pruned(spark, root):
    got = {r["path"] for r in tree.entries(spark, f"file://{root}", prune=False).collect()}
    assert {"node_modules/x.py", ".hidden/x.py", "d0/dist/x.py", "d0/empty", ".dotted.py"} <= got


def test_contents_and_errors_are_rows(spark, root):
    found = spark.createDataFrame([("a&b ü.ts", 2, None), ("gone.py", 1, None), ("d0", 0, None)], "path string, size long, modified timestamp")
    got = {r["path"]: r for r in tree.contents(spark, str(root), found).collect()}
    assert bytes(got["a&b ü.ts"]["content"]) == "é".encode() and got["gone.py"]["content"] is None and got["gone.py"]["error"] and got["d0"]["error"]
    all_ = tree.contents(spark, str(root), found)
    assert {r["path"] for r in files.unreadable(all_).collect()} >= {"gone.py"} and files.texts(all_).count() == 1
    missing = tree.entries(spark, str(root / "nowhere")).collect()
    assert [(r["path"], r["type"]) for r in missing] == [("", "directory")] and missing[0]["error"]


def test_small_batches_are_whole(spark, root, monkeypatch):
    monkeypatch.setattr(tree, "BATCH_BYTES", 5)
    texts = {r["path"]: r["text"] for r in files.texts(files.source_files(spark, str(root))).collect()}
    assert len(texts) == 62 and texts["d1/e4/deep/_f3.py"] == "43\n" * 3 and texts["d1/e4/deep/_f0.py"] == "" and texts[".dotted.py"] == "��"


def test_contexts_are_inherited(spark, tmp_path):
    put(tmp_path, a___dot_context_dot_yaml="directory: a\ndescription: of a\n", a__b___dot_context_dot_yaml=": : :\n\t-", a__c___dot_context_dot_yaml="directory: c\ndescription: of c\n")
    (tmp_path / "a" / "b" / "x.py").write_text("")
    c = files.contexts_at(spark, str(tmp_path))
    assert {(r["at"], r["error"] is None) for r in c.collect()} == {("a", True), ("a/b", False), ("a/c", True)}
    paths = spark.createDataFrame([(p,) for p in ("a/x.py", "a/b/x.py", "a/c/d/x.py", "x.py", "ab/x.py")], "path string")
    got = {r["path"]: r["context"] and r["context"]["description"] for r in files.inherited(c, paths).collect()}
    assert got == {"a/x.py": "of a", "a/b/x.py": "of a", "a/c/d/x.py": "of c", "x.py": None, "ab/x.py": None}


def test_rules_and_their_fallback(spark, tmp_path):
    built_in = files.rules(spark, str(tmp_path)).count()
    assert built_in == len(fixed.RULES)
    (tmp_path / "broken.yaml").write_text("rules: [")
    (tmp_path / "other.txt").write_text("rules: {a: [b]}")
    assert files.rules(spark, str(tmp_path)).count() == built_in
    (tmp_path / "b.yml").write_text("later:\n  - plain\n  - {pattern: '('}\n  - {pattern: 7}\n  - {severity: low}\nother: 5\n")
    (tmp_path / "a.yaml").write_text("rules:\n  first:\n  - {pattern: 'x+', severity: HIGH, message: m}\n")
    got = [tuple(r) for r in files.rules(spark, str(tmp_path)).orderBy("rule_id").collect()]
    assert got == [(0, "first", "x+", "high", "m"), (1, "later", "plain", "medium", "")]


def test_decisions_come_newest_first(spark, tmp_path):
    for k, age in enumerate((30, 10, 20)):
        at = tmp_path / f"{k}.json"
        at.write_text(f'{{"id": "d{k}", "title": "t{k}"}}')
        os.utime(at, (1_700_000_000 - age, 1_700_000_000 - age))
    (tmp_path / "bad.json").write_text('{"id": ')
    (tmp_path / "word.json").write_text('"text"')
    assert [r["id"] for r in files.decisions(spark, str(tmp_path)).collect()] == ["d1", "d2", "d0"]
    assert [r["id"] for r in files.decisions(spark, str(tmp_path), 2).collect()] == ["d1", "d2"]
    assert {r["name"] for r in files.broken_decisions(spark, str(tmp_path)).collect()} == {"bad.json", "word.json"}
