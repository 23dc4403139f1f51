"""Line differences against a differ of its own kind, and histories replayed."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest

from strataline.functions import linediff
from strataline.operators import history


def plain_unified(old: str, new: str, context: int = 3) -> str:
    """The same hunks by a table of all pairs of lines."""
    split = lambda t: [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
    a, b = split(old), split(new)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - tail, len(b) - tail
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, head - 1, -1):
        for j in range(m, head - 1, -1):
            if i == n or j == m:
                cost[i][j] = n - i + m - j
            elif a[i] == b[j]:
                cost[i][j] = cost[i + 1][j + 1]
            else:
                cost[i][j] = 1 + min(cost[i + 1][j], cost[i][j + 1])
    script = [(" ", x) for x in a[:head]]
    i = j = head
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            script.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif j == m or i < n and cost[i + 1][j] <= cost[i][j + 1]:
            script.append(("-", a[i]))
            i += 1
        else:
            script.append(("+", b[j]))
            j += 1
    script += [(" ", x) for x in a[n:]]
    # Within a change all that goes stands before what comes.
    changed = [k for k, s in enumerate(script) if s[0] != " "]
    out, at = "", 0
    while at < len(changed):
        end = at
        while end + 1 < len(changed) and changed[end + 1] - changed[end] <= 2 * context + 1:
            end += 1
        lo, hi = max(0, changed[at] - context), min(len(script), changed[end] + context + 1)
        part, before = script[lo:hi], script[:lo]
        sizes = [sum(s[0] in " -" for s in part), sum(s[0] in " +" for s in part)]
        starts = [sum(s[0] in " -" for s in before) + (sizes[0] > 0), sum(s[0] in " +" for s in before) + (sizes[1] > 0)]
        one = [f"{s},{z}" if z != 1 else f"{s}" for s, z in zip(starts, sizes, strict=True)]
        out += f"@@ -{one[0]} +{one[1]} @@\n"
        k = 0
        while k < len(part):
            if part[k][0] == " ":
                block = [part[k]]
            else:
                block = []
                while k + len(block) < len(part) and part[k + len(block)][0] != " ":
                    block.append(part[k + len(block)])
            for kind, line in sorted(block, key=lambda s: "- +".index(s[0])):
                out += kind + line if line.endswith("\n") else f"{kind}{line}\n\\ No newline at end of file\n"
            k += len(block)
        at = end + 1
    return out


def pairs(seed: int, n: int):
    rng = random.Random(seed)
    for k in range(n):
        lines = [rng.choice(["a", "b", "c", "", "-x", "+y", "@@ -1 +1 @@", " d", "\\ No", "é\r", f"l{rng.randrange(40)}"]) for _ in range(rng.randrange(40))]
        other = [x for x in lines if rng.random() > 0.2]
        for _ in range(rng.randrange(6)):
            other.insert(rng.randrange(len(other) + 1), rng.choice(["a", "new", "b"]))
        if k % 5 == 0:
            other = [rng.choice("ab") for _ in range(rng.randrange(30))]
        end = lambda x: "\n".join(x) + rng.choice(["\n", "", "\n\n"]) * bool(x)
        yield end(lines), end(other)


@pytest.mark.parametrize("keep", [1, 3, 64])
def test_hunks_equal_a_plain_differs(monkeypatch, keep):
    monkeypatch.setattr(linediff, "KEEP", keep)
    for old, new in pairs(keep, 250):
        hunks = linediff.unified(old, new)
        assert hunks == plain_unified(old, new)
        assert linediff.applied(old, hunks) == new
        added, removed = linediff.counts(hunks)
        assert added - removed == len(linediff.lines_of(new)) - len(linediff.lines_of(old))


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_texts_of_usual_size_take_no_search(monkeypatch):
    """The table of common lines gives the scripts that the search gives, and the search isn't needed for them."""
    rng = random.Random(8)
    cases = []
    for _ in range(300):
        a = [f"{rng.randrange(6)}\n" for _ in range(rng.randrange(40))]
        b = [x for x in a if rng.random() > 0.2] + [f"{rng.randrange(6)}\n" for _ in range(rng.randrange(9))]
        cases.append((a, b))
    found = [linediff.changes(a, b) for a, b in cases]
    monkeypatch.setattr(linediff, "TABLE", -1)
    assert found == [linediff.changes(a, b) for a, b in cases]
    monkeypatch.undo()
    monkeypatch.setattr(linediff, "_Furthest", None)
    lines = [f"{k % 50} of {k}\n" for k in range(3000)]
    hunks, added, removed = linediff.compared("".join(lines), "".join(lines[::2] + lines[:900:3]))
    assert (added, removed) == linediff.counts(hunks) and removed - added == 1200


def test_scripts_are_as_short_as_git_s(tmp_path):
    """Another program has no shorter script, and takes the hunks."""
    for k, (old, new) in enumerate(pairs(9, 40)):
        (tmp_path / "a").write_bytes(old.encode())
        (tmp_path / "b").write_bytes(new.encode())
        said = subprocess.run(["git", "diff", "--no-index", "--minimal", "--numstat", "a", "b"], cwd=tmp_path, capture_output=True, text=True).stdout.split()
        hunks = linediff.unified(old, new)
        added, removed = linediff.counts(hunks)
        theirs = (int(said[0]), int(said[1])) if said else (0, 0)  # longer at times: it passes over lines that are frequent
        assert added - removed == theirs[0] - theirs[1] and added <= theirs[0]
        if hunks and old and new:
            folder = tmp_path / f"t{k}"
            folder.mkdir()
            (folder / "f").write_bytes(old.encode())
            subprocess.run(["git", "apply", "--whitespace=nowarn", "-"], cwd=folder, input=f"--- a/f\n+++ b/f\n{hunks}".encode(), check=True, env={"PATH": "/usr/bin:/bin", "GIT_CEILING_DIRECTORIES": str(tmp_path)})
            assert (folder / "f").read_bytes() == new.encode()


def test_long_texts_in_bounded_time():
    rng = random.Random(1)
    lines = [f"line {rng.randrange(5000)}" for _ in range(30_000)]
    other = [x for x in lines if rng.random() > 0.03]
    old, new = "\n".join(lines), "\n".join(other)
    assert linediff.applied(old, linediff.unified(old, new)) == new
    assert linediff.counts(linediff.unified("x\n" * 40_000, "x\n" * 39_000)) == (0, 1000)


@pytest.mark.parametrize("hunks", ["@@ -1 +1 @@\n-b\n+c\n", "@@ -9 +9 @@\n-a\n+c\n", "@@ -1,2 +1 @@\n-a\n", "nonsense\n", "@@ -1 +1 @@\n?a\n"])
def test_foreign_hunks_are_refused(hunks):
    with pytest.raises(ValueError):
        linediff.applied("a\n", hunks)


def repository(seed: int, n: int):
    """Trees of n commits in a forest of first parents, files that come, change, go and come back."""
    rng = random.Random(seed)
    trees, commits = {}, []
    for i in range(n):
        parent = None if i % 17 == 0 else rng.randrange(max(0, i - 3), i) if rng.random() < 0.3 else i - 1
        tree = dict(trees[parent]) if parent is not None else {}
        for _ in range(rng.randrange(4)):
            path = f"f{rng.randrange(6)}"
            kind = rng.random()
            if kind < 0.25:
                tree.pop(path, None)
            elif kind < 0.35:
                tree[path] = ""
            else:
                lines = linediff.lines_of(tree.get(path, ""))
                lines.insert(rng.randrange(len(lines) + 1), f"{i}\n")
                tree[path] = "".join(lines)
        trees[i] = tree
        commits.append((f"c{i}", [] if parent is None else [f"c{parent}", "other"]))
    return trees, commits


@pytest.mark.parametrize("every", [1, 2, 5, 64])
def test_every_file_at_every_commit(spark, every):
    trees, commits = repository(7, 60)
    rows = [(f"c{i}", p, text) for i, tree in trees.items() for p, text in tree.items()]
    t = spark.createDataFrame(rows, "sha string, path string, content string").repartition(3)
    c = spark.createDataFrame(commits, "sha string, parents array<string>").repartition(2)
    depth = {}
    for sha, parents in commits:
        depth[sha] = depth[parents[0]] + 1 if parents else 0
    assert {r["sha"]: r["depth"] for r in history.depths(c).collect()} == depth
    whole, diffs = history.packed(t, c, every)
    assert {r["sha"] for r in whole.collect()} <= {s for s, d in depth.items() if d % every == 0}
    wanted = spark.createDataFrame([(f"c{i}", f"f{k}") for i in trees for k in range(7)], "sha string, path string")
    got = {(r["sha"], r["path"]): r["content"] for r in history.contents(wanted, c, whole, diffs, every).collect()}
    assert got == {(f"c{i}", f"f{k}"): trees[i].get(f"f{k}") for i in trees for k in range(7)}


def test_diffs_of_commits(spark):
    commits = spark.createDataFrame([("r", []), ("s", ["r", "x"]), ("t", None), ("u", ["away"])], "sha string, parents array<string>")
    trees = spark.createDataFrame([("r", "a", "1\n2\n"), ("r", "b", "x"), ("r", "same", "s"), ("s", "a", "1\n3\n"), ("s", "c", None), ("s", "same", "s"), ("t", "a", "q\n"), ("u", "e", "z\n")], "sha string, path string, content string")
    got = {(r["sha"], r["path"]): r for r in history.patch_text(history.commit_diffs(trees, commits)).collect()}
    assert {k: (r["status"], r["additions"], r["deletions"]) for k, r in got.items()} == {("r", "a"): ("A", 2, 0), ("r", "b"): ("A", 1, 0), ("r", "same"): ("A", 1, 0), ("s", "a"): ("M", 1, 1), ("s", "b"): ("D", 0, 1), ("s", "c"): ("A", 0, 0), ("t", "a"): ("A", 1, 0), ("u", "e"): ("A", 1, 0)}
    assert got["s", "a"]["patch"] == "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1,2 +1,2 @@\n 1\n-2\n+3\n"
    assert got["s", "b"]["patch"] == "diff --git a/b b/b\n--- a/b\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n\\ No newline at end of file\n"
    assert history.commit_diffs(trees.limit(0), commits).collect() == [] and history.commit_diffs(trees, commits.limit(0)).collect() == []
    ring = spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", [])], "sha string, parents array<string>")
    assert [r["sha"] for r in history.depths(ring).collect()] == ["c"]


def test_hunks_that_do_not_fit_are_told(spark):
    commits = spark.createDataFrame([("a", []), ("b", ["a"])], "sha string, parents array<string>")
    whole = spark.createDataFrame([("a", "f", "1\n")], "sha string, path string, content string")
    bad = spark.createDataFrame([("b", "f", "M", "@@ -1 +1 @@\n-2\n+3\n")], "sha string, path string, status string, diff string")
    got = history.contents(spark.createDataFrame([("b", "f"), ("a", "f")], "sha string, path string"), commits, whole, bad).collect()
    assert {(r["sha"], r["content"], r["error"] is None) for r in got} == {("a", "1\n", True), ("b", None, False)}


def test_diffs_across_segments(spark):
    """Commits whose first parent is in another segment, on a ring, or no commit of the history: each text is met there too."""
    trees, commits = repository(3, 60)
    commits += [("ring1", ["ring2"]), ("ring2", ["ring1"]), ("late", ["elsewhere"])]
    tree = {f"c{i}": t for i, t in trees.items()} | {"ring1": {"a": "1\n"}, "ring2": {"a": "2\n", "b": "x"}, "late": {"a": "n\n"}, "elsewhere": {"a": "o\n", "gone": "g"}}
    expected = set()
    for sha, parents in commits:
        old, new = tree.get(parents[0], {}) if parents else {}, tree[sha]
        for path in {*old, *new}:
            if old.get(path) != new.get(path):
                expected.add((sha, path, "A" if path not in old else "D" if path not in new else "M", linediff.unified(old.get(path), new.get(path))))
    t = spark.createDataFrame([(sha, p, text) for sha, files in tree.items() for p, text in files.items()], "sha string, path string, content string").repartition(3)
    got = history.commit_diffs(t, spark.createDataFrame(commits, "sha string, parents array<string>")).collect()
    assert {(r["sha"], r["path"], r["status"], r["diff"]) for r in got} == expected and len(got) == len(expected)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_texts_of_a_history_move_once(spark, tmp_path):
    """Commits are few and sent to the texts: one shuffle for diffs, one more for contents."""
    trees, commits = repository(4, 40)
    spark.createDataFrame([(f"c{i}", p, text) for i, tree in trees.items() for p, text in tree.items()], "sha string, path string, content string").write.parquet(f"{tmp_path}/trees")
    t, c = spark.read.parquet(f"{tmp_path}/trees"), spark.createDataFrame(commits, "sha string, parents array<string>")
    assert shuffles(history.commit_diffs(t, c)) == 1
    whole, diffs = history.packed(t, c, 2)
    assert shuffles(whole) == 0
    assert shuffles(history.contents(t.select("sha", "path"), c, whole, diffs, 2)) == 2


def test_versions_of_a_file_are_packed_together(spark):
    """Twelve versions of each file, side by side, take little more room than one."""
    rng = random.Random(1)
    rows = []
    for k in range(20):
        lines = [f"{rng.getrandbits(64):x}" for _ in range(200)]
        for v in range(12):
            lines[rng.randrange(200)] = f"{v}"
            rows.append(("all", f"f{k}", f"{v}", "\n".join(lines)))
    df = spark.createDataFrame(rows, "group string, path string, sha string, content string").coalesce(1)
    moved = []
    repartition = type(df).repartition
    type(df).repartition = lambda self, *by: moved.append(self) or repartition(self, *by)
    try:
        got = history._dealt(df, lambda path, items: [(path, len(items), "".join(t for _, t in items))], "path string, n int, texts string").collect()
    finally:
        type(df).repartition = repartition
    assert sorted((r["path"], r["n"]) for r in got) == sorted((f"f{k}", 12) for k in range(20))
    one = sum(len(r[3]) for r in rows[::12])
    assert sum(len(r["items"]) for r in moved[0].collect()) < 1.2 * one
