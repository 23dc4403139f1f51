"""Histories with contents: six commits of each source, whose files are the documents' lines, changed from commit to commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from .registry import query

#: Commits of a source by number, and the number of each one's first parent: the fourth and fifth both follow the third.
_PARENTS = {0: None, 1: 0, 2: 1, 3: 2, 4: 2, 5: 4}

_VIEW = r"""w AS (SELECT doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, source, list_transform(range(0, (len(words) + 5) // 6), lambda i: array_to_string(words[6 * i + 1:6 * i + 6], ' ')) AS lines FROM w),
trees AS (SELECT source || '@' || v AS sha, v, source, doc_id || '.txt' AS path,
  array_to_string(flatten(list_transform(lines, lambda x, i: CASE WHEN ((i - 1) * 7 + length(x) + v * v) % 9 = 0 THEN []::VARCHAR[] WHEN (i - 1 + v) % 13 = 0 THEN [x, '+' || (i - 1) || x] ELSE [x] END)), chr(10)) || CASE WHEN v % 2 = 0 THEN chr(10) ELSE '' END AS content
  FROM l, range(6) r(v) WHERE (doc_id + v) % 5 <> 0)"""


def _history(t):
    """trees (sha, path, content) and commits (sha, parents)."""
    words = t.documents.where("source IS NOT NULL AND text IS NOT NULL").selectExpr("doc_id", "source", r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) AS words")
    lines = words.selectExpr("doc_id", "source", "IF(size(words) = 0, CAST(array() AS array<string>), transform(sequence(0, (size(words) + 5) DIV 6 - 1), i -> array_join(slice(words, CAST(6 * i + 1 AS INT), 6), ' '))) AS lines")
    rows = lines.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(5)))).where("(doc_id + v) % 5 <> 0")
    changed = "flatten(transform(lines, (x, i) -> CASE WHEN (i * 7 + length(x) + v * v) % 9 = 0 THEN CAST(array() AS array<string>) WHEN (i + v) % 13 = 0 THEN array(x, concat('+', i, x)) ELSE array(x) END))"
    trees = rows.selectExpr("concat(source, '@', v) AS sha", "concat(doc_id, '.txt') AS path", f"concat(array_join({changed}, '\\n'), IF(v % 2 = 0, '\\n', '')) AS content")
    steps = t.documents.sparkSession.createDataFrame(list(_PARENTS.items()), "v int, parent int")
    sources = t.documents.where("source IS NOT NULL").select("source").distinct()
    every = sources.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(5)))).join(F.broadcast(steps), "v")  # six rows
    return trees, every.selectExpr("concat(source, '@', v) AS sha", "IF(parent IS NULL, CAST(array() AS array<string>), array(concat(source, '@', parent), 'merged')) AS parents")


_PARENT = "CASE v " + " ".join(f"WHEN {v} THEN {p}" for v, p in _PARENTS.items() if p is not None) + " END"
_LINES = "(length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN {0} = '' OR {0} LIKE '%' || chr(10) THEN 0 ELSE 1 END)"


@query(
    "git_commit_diffs",
    "S15",
    f"""WITH {_VIEW}, p AS (SELECT source || '@' || v AS sha, source || '@' || {_PARENT} AS parent FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), range(6) r(v)),
b AS (SELECT p.sha, path, content FROM p JOIN trees ON trees.sha = p.parent)
SELECT sha, path, CASE WHEN b.content IS NULL THEN 'A' WHEN a.content IS NULL THEN 'D' ELSE 'M' END AS status, ({_LINES.format("coalesce(a.content, '')")} - {_LINES.format("coalesce(b.content, '')")})::BIGINT AS grown,
'diff --git a/' || path || ' b/' || path AS head FROM trees a FULL JOIN b USING (sha, path) WHERE a.content IS DISTINCT FROM b.content""",
)
def diffs(t):
    trees, commits = _history(t)
    found = history.patch_text(history.commit_diffs(trees, commits))
    return found.select("sha", "path", "status", (F.col("additions") - F.col("deletions")).cast("long").alias("grown"), F.substring_index("patch", "\n", 1).alias("head"))


@query("git_content_at", "S14", f"WITH {_VIEW} SELECT sha, path, length(content)::BIGINT AS n_chars, sha256(content) AS content_sha256 FROM trees")
def content(t):
    """Every file at every commit, from every second commit's tree and the hunks between."""
    trees, commits = _history(t)
    whole, diffs = history.packed(trees, commits, 2)
    found = history.contents(trees.select("sha", "path"), commits, whole, diffs, 2)
    return found.where("error IS NULL").select("sha", "path", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))
