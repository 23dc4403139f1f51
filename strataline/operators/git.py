"""What histories tell: owners, churn, status, recommendations. Commits and blame are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as tx
from .relational import dealt_by, top_per


def expertise_map(blame: DataFrame, tasks: int | None = None) -> DataFrame:
    """file, author, commits (different), last_date, rank by commits of each file. tasks: into how many parts the rows are dealt, if they are many."""
    rows = dealt_by(blame, tasks, "file", "author").groupBy("file", "author").agg(F.count_distinct("sha").alias("commits"), F.max("date").alias("last_date"))
    return dealt_by(rows, tasks, "file").withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("commits"), "author")))


def primary_owner(owners: DataFrame) -> DataFrame:
    """Each file's owner of most commits; of equals the first by name."""
    return owners.groupBy("file").agg(F.min_by("author", F.struct(-F.col("commits"), F.col("author"))).alias("owner"), F.max("commits").alias("commits"))


def owner_scores(blame: DataFrame, commits: DataFrame, since: Column) -> DataFrame:
    """file, author, lines, recent_commits, score: lines owned and commits since a time, either may lack."""
    lines = blame.groupBy("file", "author").agg(F.count("*").alias("lines"))
    recent = commits.where(F.col("date") >= since).groupBy("file", "author").agg(F.count("*").alias("recent"))
    both = lines.join(recent, ["file", "author"], "full_outer").fillna(0, ["lines", "recent"])
    return both.select("file", "author", "lines", F.col("recent").alias("recent_commits"), scores.expertise("lines", "recent").alias("score"))


def experts(scored: DataFrame, n: int = 2) -> DataFrame:
    """Each file's primary and backup expert."""
    top = top_per(scored, ["file"], [F.desc("score"), F.asc("author")], n)
    return top.groupBy("file").agg(F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("primary"), F.max(F.when(F.col("rank") == 2, F.col("author"))).alias("backup"))


def churn(commits: DataFrame, since: Column, months: int) -> DataFrame:
    """file, commits, authors, risk of commits since a time."""
    rows = commits.where(F.col("date") >= since).groupBy("file").agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"))
    return rows.withColumn("risk", scores.churn_risk("commits", F.lit(months))).withColumn("rank", scores.churn_rank("commits"))


def recent(commits: DataFrame, n: int, file: str | None = None) -> DataFrame:
    """The newest n commits, of one file if given."""
    rows = commits if file is None else commits.where(F.col("file") == file)
    return rows.orderBy(F.desc("date"), F.desc("sha")).limit(n)


def summary(commits: DataFrame) -> DataFrame:
    """file, commits, authors, and the last one's author and message."""
    return commits.groupBy("file").agg(
        F.count("*").alias("commits"),
        F.count_distinct("author").alias("authors"),
        F.max_by("author", F.struct("date", "sha")).alias("last_author"),
        F.max_by("message", F.struct("date", "sha")).alias("last_message"),
    )


def blame_ranges(blame: DataFrame, keys: list[str], order: list[Column], size: str) -> DataFrame:
    """Runs of lines with their first and last line, from the runs' sizes."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blame.withColumn("end_line", F.sum(size).over(w)).withColumn("start_line", F.col("end_line") - F.col(size) + 1)


def merged_status(staged: DataFrame, unstaged: DataFrame) -> DataFrame:
    """Changes (path, status, additions, deletions) of both sides: statuses joined, numbers added."""
    s = staged.select("path", F.col("status").alias("s1"), F.col("additions").alias("a1"), F.col("deletions").alias("d1"))
    u = unstaged.select("path", F.col("status").alias("s2"), F.col("additions").alias("a2"), F.col("deletions").alias("d2"))
    both = s.join(u, "path", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        "path",
        F.when(F.col("s1") == F.col("s2"), F.col("s1")).otherwise(F.concat_ws("/", "s1", "s2")).alias("status"),
        (zero("a1") + zero("a2")).alias("additions"),
        (zero("d1") + zero("d2")).alias("deletions"),
        F.col("s1").isNotNull().alias("staged"),
        F.col("s2").isNotNull().alias("unstaged"),
    )


def with_stats(changes: DataFrame, stats: DataFrame) -> DataFrame:
    """Changes with their numbers; files of which only numbers are known count as modified."""
    return changes.join(stats, "path", "full_outer").select("path", F.coalesce("status", F.lit("M")).alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("additions", "deletions")))


def totals(changes: DataFrame) -> DataFrame:
    """files, additions, deletions, staged and unstaged counts, the first six paths, and a sentence."""
    flag = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    # Six paths at most are gathered.
    six = changes.select("path").orderBy("path").limit(6).agg(F.array_sort(F.collect_list("path")).alias("first"))
    row = changes.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
        flag("staged").alias("staged"),
        flag("unstaged").alias("unstaged"),
    ).join(F.broadcast(six))  # one row each
    s = lambda c: F.col(c).cast("string")
    more = F.when(F.col("files") > 6, F.concat(F.lit(", and "), (F.col("files") - 6).cast("string"), F.lit(" more"))).otherwise("")
    sentence = F.concat(s("files"), F.lit(" file(s) have uncommitted changes (+"), s("additions"), F.lit("/-"), s("deletions"), F.lit("). "), s("staged"), F.lit(" staged, "), s("unstaged"), F.lit(" unstaged. Affected files: "), F.array_join("first", ", "), more, F.lit("."))
    return row.withColumn("summary", F.when(F.col("files") == 0, F.lit("The working tree is clean. There are no staged, unstaged, or untracked changes to commit.")).otherwise(sentence)).drop("first")


def suggested_message(changes: DataFrame, keys: list[str]) -> DataFrame:
    """A commit message from what its paths have in common."""
    p = F.col("path")
    docs = F.bool_and(p.startswith("docs/") | p.startswith("README") | p.contains("/docs/"))
    tests = F.bool_and(F.lower(p).contains("/test") | F.lower(p).startswith("test"))
    plain = lambda c: F.regexp_replace(c, "[_-]", " ")
    root = F.when(p.contains("/"), F.split(p, "/")[0])
    return (
        changes.groupBy(*keys)
        .agg(docs.alias("_d"), tests.alias("_t"), F.count("*").alias("n"), F.min(tx.stem("path")).alias("_s"), F.min(root).alias("_r"), F.max(root).alias("_r2"))
        .select(
            *keys,
            F.when(F.col("_d"), F.lit("Update documentation"))
            .when(F.col("_t"), F.lit("Update tests"))
            .when(F.col("n") == 1, F.concat(F.lit("Update "), plain(F.col("_s"))))
            .when(F.col("_r") == F.col("_r2"), F.concat(F.lit("Update "), plain(F.col("_r"))))
            .otherwise(F.lit("Update project changes"))
            .alias("message"),
        )
    )


def recommendation(changes: DataFrame, keys: list[str], conflicts: Column | None = None) -> DataFrame:
    """Whether to commit, a title, and the concerns."""
    # Three sensitive paths of a key at most are gathered.
    three = top_per(changes.where(tx.is_sensitive_path("path")).select(*keys, "path"), keys, [F.asc("path")], 3)
    seen = three.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("_seen"))
    rows = changes.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("changed"))
    rows = rows.join(seen, keys, "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
    rows = rows.withColumn("concerns", scores.commit_concerns(F.lit(False) if conflicts is None else conflicts, F.col("_seen"), "files", "changed"))
    return rows.select(*keys, "files", "changed", (F.size("concerns") == 0).alias("should_commit"), F.when(F.size("concerns") == 0, "Ready to commit").otherwise("Review before committing").alias("title"), "concerns")


def under_folder(commits: DataFrame, folder: str) -> DataFrame:
    """Commits with a file in or below a folder, each once."""
    return commits.where(F.col("file").startswith(folder) | F.contains(F.col("file"), F.lit(folder))).select("sha", "author", "date", "message").distinct()


def last_change(commits: DataFrame, now: Column) -> DataFrame:
    """file, days since its last commit, and the same in words."""
    rows = commits.groupBy("file").agg(F.max("date").alias("last")).withColumn("days", F.datediff(now, F.col("last")))
    return rows.select("file", "days", scores.age_phrase("days").alias("phrase"))


# -- parsers of git's own output ---------------------------------------------


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """status, path, old_path and kind of lines of `git diff --name-status`."""
    p = F.split(F.col(line), "\t")
    code = F.substring(p[0], 1, 1)
    kind = F.when(code == "A", "added").when(code.isin("M", "C"), "modified").when(code == "D", "deleted").when(code == "R", "renamed")
    return lines.where(F.col(line).contains("\t")).select(code.alias("status"), F.when(F.size(p) > 2, p[2]).otherwise(p[1]).alias("path"), F.when(F.size(p) > 2, p[1]).alias("old_path"), kind.alias("kind"))


def numstat(lines: DataFrame, line: str = "line") -> DataFrame:
    """path, additions, deletions of lines of `git diff --numstat`; a binary file's dashes are 0."""
    p = F.split(F.col(line), "\t", 3)
    number = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("int")).otherwise(0)
    return lines.where(F.size(p) >= 3).select(p[2].alias("path"), number(p[0]).alias("additions"), number(p[1]).alias("deletions"))


def log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """sha, author, subject, date of lines `%h|%an|%s|%ci`; bars after the third stay in the last part."""
    p = F.split(F.col(line), r"\|", 4)
    return lines.where(F.size(p) == 4).select(p[0].alias("sha"), p[1].alias("author"), p[2].alias("subject"), p[3].alias("date"))


def porcelain_blame(lines: DataFrame, key: str = "file", number: str = "n", line: str = "line") -> DataFrame:
    """file, sha, author, epoch and summary of `git blame --porcelain` lines, each sha once."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract(line, r"^([0-9a-f]{40}) \d+ \d+", 1)
    rows = lines.withColumn("sha", F.last(F.when(head != "", head), ignorenulls=True).over(w))
    field = lambda name: F.min_by(F.when(F.col(line).startswith(name + " "), F.substring(F.col(line), len(name) + 2, 1 << 20)), F.when(F.col(line).startswith(name + " "), F.col(number)))
    return rows.where("sha is not null").groupBy(key, "sha").agg(field("author").alias("author"), field("author-time").cast("long").alias("epoch"), field("summary").alias("summary"))


def eligible(head: Column, last: Column, dirty: Column, known: Column) -> Column:
    """Whether an index can be brought up to date from a diff: full, none, refused or incremental."""
    return F.when(dirty, "refused").when(last.isNull() | ~known, "full").when(head == last, "none").otherwise("incremental")
