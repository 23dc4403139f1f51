"""History with contents: what each commit changed against its first parent, and any file at any commit.

A commit has sha and parents (an array; the first counts; none: the empty tree).  A tree is rows
of sha, path, content: every file of every commit.  `commit_diffs` brings each commit's files together
with its first parent's and puts the unified hunks of those that differ in place of their texts.  A text
moves once, to its commit's segment (see below), and once more for each other segment that a child of its
commit begins; what a task has of a file moves as one compressed value, since its versions are alike.

`packed` keeps of a history those hunks, and whole trees only every so many commits of the
first-parent chain; `contents` gives any (sha, path) back.  A commit belongs to the segment of
the nearest whole tree at or before it; places in chains come from pointer doubling, in as many
rounds as the length of the longest chain has binary digits.  Each segment of a path replays its own
hunks; short segments that follow each other share a group, of some EVERY commits of a chain, so a long
history is many groups and none holds more than its own stretch.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linediff
from ..session import cut

#: Commits between whole trees.
EVERY = 16

DIFF = "sha string, path string, status string, additions int, deletions int, diff string"

#: Commits that are broadcast, at most; more are joined by a shuffle.
SMALL = 1 << 18
#: Rows that are packed at once.
PACKED = 512


def _small(commits: DataFrame) -> DataFrame:
    """Commits to join with: broadcast, so that texts needn't move, if they are few enough."""
    return F.broadcast(commits) if commits.count() <= SMALL else commits


def _dealt(rows: DataFrame, run: Callable[[str, list], Iterable[tuple]], schema: str) -> DataFrame:
    """What run(path, items) gives for each group and path: rows have these two, and an item has their other columns.

    Rows of a key that follow each other in a task move as one compressed value.
    """
    names = [c for c in rows.columns if c not in ("group", "path")]
    kinds = [(field.split()[0], {"string": pa.string(), "int": pa.int32()}[field.split()[1]]) for field in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        for b in batches:
            for at in range(0, b.num_rows, PACKED):
                part, found = b.slice(at, PACKED), {}
                for group, path, *item in zip(*(part[c].to_pylist() for c in ("group", "path", *names)), strict=True):
                    found.setdefault((group, path), []).append(item)
                raw = [pickle.dumps(items, 5) for items in found.values()]
                columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(map(len, raw), pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["group", "path", "size", "items"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
        codec, key, items = pa.Codec("zstd"), None, []
        for b in batches:
            for at in range(0, b.num_rows, PACKED):
                for group, path, size, raw in zip(*(b.slice(at, PACKED)[c].to_pylist() for c in ("group", "path", "size", "items")), strict=True):
                    if (group, path) != key and items:
                        yield key[1], items
                        items = []
                    key = (group, path)
                    items += pickle.loads(codec.decompress(raw, size, asbytes=True))
        if items:
            yield key[1], items

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])
        for path, items in groups(batches):
            for row in run(path, items):
                out.append(row)
                if len(out) == 64:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    packed = rows.select("group", "path", *names).mapInArrow(pack, "group string, path string, size long, items binary")
    return packed.repartition("group", "path").sortWithinPartitions("group", "path").mapInArrow(made, schema)


def commit_diffs(trees: DataFrame, commits: DataFrame) -> DataFrame:
    """sha, path, status (A, M, D), additions, deletions, diff (unified hunks) of every file that each commit changed."""
    first = commits.where("sha IS NOT NULL").select("sha", F.get("parents", 0).alias("parent")).distinct()
    # A commit on a cycle is in no segment and is a group of its own.
    first = cut(first.join(segments(commits).select("sha", "segment"), "sha", "left").select("sha", "parent", F.coalesce("segment", "sha").alias("group")))
    # Where a commit's files go, and which commits there follow it.
    ends = first.select("sha", "group", F.lit(None).cast("string").alias("child")).unionAll(first.where("parent IS NOT NULL").select(F.col("parent").alias("sha"), "group", F.col("sha").alias("child")))
    owns = first.select("sha", "group", F.lit(True).alias("own")).distinct()
    sent = ends.groupBy("sha", "group").agg(F.array_sort(F.collect_set("child")).alias("children")).join(owns, ["sha", "group"], "left")
    rows = trees.join(_small(cut(sent)), "sha").select("group", "path", "sha", "children", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("content", F.lit("")).alias("content"))

    def run(path: str, items: list) -> Iterator[tuple]:
        texts = {sha: text for sha, _, own, text in items if own}
        pairs = [(child, old, texts.get(child)) for _, children, _, old in items for child in children]
        followed = {child for child, _, _ in pairs}
        for sha, old, new in [*pairs, *((sha, None, text) for sha, text in texts.items() if sha not in followed)]:
            if old != new:
                hunks, added, removed = linediff.compared(old, new)
                yield sha, path, "A" if old is None else "D" if new is None else "M", added, removed, hunks

    return _dealt(rows, run, DIFF)


def patch_text(diffs: DataFrame) -> DataFrame:
    """diffs with the column patch: the hunks under the usual heads of files."""
    old = F.when(F.col("status") == "A", "/dev/null").otherwise(F.concat(F.lit("a/"), "path"))
    new = F.when(F.col("status") == "D", "/dev/null").otherwise(F.concat(F.lit("b/"), "path"))
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"))
    names = F.when(F.col("diff") == "", "").otherwise(F.concat(F.lit("--- "), old, F.lit("\n+++ "), new, F.lit("\n")))
    return diffs.withColumn("patch", F.concat(head, names, "diff"))


def depths(commits: DataFrame) -> DataFrame:
    """sha, parent (first, if it is among the commits), depth: how many commits are before it on the first-parent chain.

    Commits on a cycle, which no history has, don't come to an end and are left out.
    """
    first = commits.select("sha", F.get("parents", 0).alias("parent")).dropDuplicates(["sha"])
    known = first.select(F.col("sha").alias("parent"), F.lit(True).alias("known"))
    rows = first.join(known, "parent", "left").select("sha", F.when(F.col("known"), F.col("parent")).alias("parent"))
    # far: the commit that `steps` parents lead to; null once the chain's start is passed.
    state = cut(rows.select("sha", "parent", F.col("parent").alias("far"), F.col("parent").isNotNull().cast("long").alias("steps")))
    for _ in range(2 + math.ceil(math.log2(max(2, rows.count())))):
        if state.where("far IS NOT NULL").isEmpty():
            break
        beyond = state.select(F.col("sha").alias("far"), F.col("far").alias("farther"), F.col("steps").alias("more"))
        state = cut(state.join(beyond, "far", "left").select("sha", "parent", F.col("farther").alias("far"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return state.where("far IS NULL").select("sha", "parent", F.col("steps").alias("depth"))


def segments(commits: DataFrame, every: int = EVERY) -> DataFrame:
    """sha, segment (the commit with a whole tree at or before it), chain (the commits after that, up to itself)."""
    return _segments(depths(commits), every)


def _segments(found: DataFrame, every: int) -> DataFrame:
    whole = F.col("depth") % every == 0
    state = cut(found.select("sha", F.when(whole, F.col("sha")).otherwise(F.col("parent")).alias("segment"), F.when(whole, F.array().cast("array<string>")).otherwise(F.array("sha")).alias("chain"), whole.alias("done")))
    for _ in range(math.ceil(math.log2(max(2, every)))):
        before = state.select(F.col("sha").alias("segment"), F.col("segment").alias("to"), F.col("chain").alias("earlier"))
        state = cut(state.join(before, "segment").select("sha", F.col("to").alias("segment"), F.when(F.col("done"), F.col("chain")).otherwise(F.concat("earlier", "chain")).alias("chain"), "done"))
    return state.select("sha", "segment", "chain")


def packed(trees: DataFrame, commits: DataFrame, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """(whole, diffs): the trees of every `every`-th commit of the chains, and what all commits changed."""
    ends = depths(commits).where(F.col("depth") % every == 0).select("sha")
    return trees.join(_small(cut(ends)), "sha"), commit_diffs(trees, commits).select("sha", "path", "status", "diff")


def contents(wanted: DataFrame, commits: DataFrame, whole: DataFrame, diffs: DataFrame, every: int = EVERY) -> DataFrame:
    """wanted (sha, path) with content, null where the commit has no such file, and error where hunks don't fit."""
    found = cut(depths(commits))
    place = _segments(found, every)
    # Segments that follow each other go together: their files are alike, and so take little room.
    stretch = _segments(found, every * max(1, EVERY // every)).select("sha", F.col("segment").alias("group"))
    place = cut(place.join(stretch, "sha"))
    small = _small(place)
    begin = _small(place.where(F.size("chain") == 0).select("sha", "segment", "group"))
    steps = _small(place.where(F.size("chain") > 0).select("sha", "segment", "group"))
    none = F.lit(None).cast("array<string>").alias("chain")
    rows = wanted.select("sha", "path").join(small, "sha").select("group", "path", "segment", "sha", "chain", F.lit(None).cast("string").alias("text"), F.lit("?").alias("kind"))
    rows = rows.unionAll(whole.join(begin, "sha").select("group", "path", "segment", "sha", none, F.coalesce("content", F.lit("")).alias("text"), F.lit("=").alias("kind")))
    rows = rows.unionAll(diffs.join(steps, "sha").select("group", "path", "segment", "sha", none, F.col("diff").alias("text"), F.col("status").alias("kind")))

    def replay(path: str, items: list) -> Iterator[tuple]:
        starts: dict[str, str] = {}
        diff: dict[str, tuple[str, str]] = {}
        asked: dict[str, tuple[str, list[str]]] = {}
        for segment, sha, chain, text, kind in items:
            if kind == "?":
                asked[sha] = (segment, chain)
            elif kind == "=":
                starts[segment] = text
            else:
                diff[sha] = (kind, text)
        made: dict[str, str | None] = {}

        def content(segment: str, chain: list[str]) -> str | None:
            # Back to the last commit that is made already, then forward.
            todo = [c for c in chain if c in diff]
            known = max((i for i, c in enumerate(todo) if c in made), default=-1)
            at = made[todo[known]] if known >= 0 else starts.get(segment)
            for c in todo[known + 1 :]:
                kind, hunks = diff[c]
                at = made[c] = None if kind == "D" else linediff.applied(None if kind == "A" else at, hunks)
            return at

        for sha, (segment, chain) in asked.items():
            try:
                yield sha, path, content(segment, chain), None
            except ValueError as e:
                yield sha, path, None, str(e)

    return _dealt(rows, replay, "sha string, path string, content string, error string")
