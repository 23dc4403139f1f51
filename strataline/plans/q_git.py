"""Histories, owners, changes and recommendations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as tx
from ..operators import git
from ..operators.relational import top_per
from .registry import query

_OWN = "own AS (SELECT file, author, count(DISTINCT sha) AS commits, max(date) AS last_date FROM blame GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY commits DESC, author) AS rank FROM own)"


@query("git_expertise_map", "A2 S5 W1", f"WITH {_OWN} SELECT file, author, commits, last_date, rank::INT AS rank FROM rk", views="blame")
def expertise_map(t):
    return git.expertise_map(t.blame, t.tasks("lineitem"))


@query("git_primary_owner", "W2 J7", f"WITH {_OWN} SELECT file, author AS owner, commits, p_brand FROM rk JOIN part ON p_partkey = file WHERE rank = 1", views="blame")
def primary(t):
    own = git.primary_owner(git.expertise_map(t.blame, t.tasks("lineitem")))
    return own.join(t.part, F.col("file") == F.col("p_partkey")).select("file", "owner", "commits", "p_brand")


_SCORE = """b AS (SELECT file % 100 AS f, author % 150 AS a, count(*) AS lines FROM blame GROUP BY 1, 2),
c AS (SELECT regexp_extract(file, 'f(\\d+)', 1)::BIGINT AS f, author AS a, count(*) AS recent FROM commits WHERE date >= (SELECT max(date) FROM commits) - INTERVAL 10 DAY GROUP BY 1, 2),
s AS (SELECT coalesce(b.f, c.f) AS file, coalesce(b.a, c.a) AS author, coalesce(lines, 0) AS lines, coalesce(recent, 0) AS recent_commits FROM b FULL JOIN c ON b.f = c.f AND b.a = c.a)"""


def _scored(t):
    blame = t.blame.select((F.col("file") % 100).alias("file"), (F.col("author") % 150).alias("author"))
    commits = t.commits.withColumn("file", F.regexp_extract("file", r"f(\d+)", 1).cast("long"))
    now = commits.agg(F.max("date").alias("now")).first()["now"]
    return git.owner_scores(blame, commits, F.lit(now) - F.expr("INTERVAL 10 DAYS"))


@query("git_owner_score", "A13 A14 J14 U3 F54", f"WITH {_SCORE} SELECT file, author, lines, recent_commits, round_even(lines * 1.0::DOUBLE + recent_commits * 5.0::DOUBLE, 1) AS score FROM s", views="blame commits")
def owner_score(t):
    return _scored(t)


@query(
    "git_experts",
    "W3",
    f"WITH {_SCORE}, r AS (SELECT file, author, row_number() OVER (PARTITION BY file ORDER BY lines * 1.0::DOUBLE + recent_commits * 5.0::DOUBLE DESC, author) AS rank FROM s) SELECT file, max(author) FILTER (rank = 1) AS \"primary\", max(author) FILTER (rank = 2) AS backup FROM r WHERE rank <= 2 GROUP BY file",
    views="blame commits",
)
def experts(t):
    return git.experts(_scored(t))


@query(
    "git_churn_window",
    "A12 F31 F51",
    """SELECT file, count(*) AS commits, count(DISTINCT author) AS authors, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk,
CASE WHEN count(*) <= 3 THEN 'low' WHEN count(*) <= 10 THEN 'medium' ELSE 'high' END AS rank, CASE WHEN count(*) > 30 THEN 'high' WHEN count(*) > 10 THEN 'medium' ELSE 'low' END AS history
FROM commits WHERE date >= (SELECT max(date) FROM commits) - INTERVAL 7 DAY GROUP BY file""",
    views="commits",
)
def churn(t):
    now = t.commits.agg(F.max("date").alias("now")).first()["now"]
    return git.churn(t.commits, F.lit(now) - F.expr("INTERVAL 7 DAYS"), 1).withColumn("history", scores.history_risk("commits"))


@query("git_recent_topn", "S7 S8 T12", "SELECT * FROM (SELECT 'all' AS what, sha, author, file FROM commits ORDER BY date DESC, sha DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 'one', sha, author, file FROM commits WHERE file = 'src/m7/f7.py' ORDER BY date DESC, sha DESC LIMIT 20)", views="commits")
def recent(t):
    a = git.recent(t.commits, 10).select(F.lit("all").alias("what"), "sha", "author", "file")
    return a.unionAll(git.recent(t.commits, 20, "src/m7/f7.py").select(F.lit("one"), "sha", "author", "file"))


@query(
    "git_last_modified_phrase",
    "F12 F32",
    """WITH x AS (SELECT o_custkey AS file, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders))::INT AS days FROM orders GROUP BY 1)
SELECT file, days, CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || ' days ago' WHEN days < 30 THEN (days // 7) || ' week' || CASE WHEN days // 7 > 1 THEN 's' ELSE '' END || ' ago'
WHEN days < 365 THEN (days // 30) || ' month' || CASE WHEN days // 30 > 1 THEN 's' ELSE '' END || ' ago' ELSE (days // 365) || ' year' || CASE WHEN days // 365 > 1 THEN 's' ELSE '' END || ' ago' END AS phrase FROM x""",
)
def phrase(t):
    now = t.orders.agg(F.max("o_orderdate").alias("now")).first()["now"]
    return git.last_change(t.orders.select(F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("date")), F.lit(now))


@query(
    "git_history_summary",
    "W13",
    "SELECT file, count(*) AS commits, count(DISTINCT author) AS authors, arg_max(author, sha) AS last_author, arg_max(message, sha) AS last_message FROM commits GROUP BY file",
    views="commits",
)
def summary(t):
    return git.summary(t.commits)


@query(
    "git_blame_ranges",
    "W5",
    """SELECT l_orderkey AS file, l_linenumber AS line, l_partkey AS part, (sum(n) OVER w - n + 1)::BIGINT AS start_line, (sum(n) OVER w)::BIGINT AS end_line
FROM (SELECT *, l_quantity::BIGINT AS n FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)""",
)
def ranges(t):
    rows = t.lineitem.withColumn("n", F.col("l_quantity").cast("long"))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return git.blame_ranges(rows, ["l_orderkey"], order, "n").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "start_line", "end_line")


def _changes(t):
    """Changes as both sides of a working tree: filled orders staged, open ones not."""
    path = F.concat(F.lit("src/c"), (F.col("o_custkey") % 50).cast("string"), F.lit("/o"), (F.col("o_orderkey") % 400).cast("string"), F.lit(".py"))
    rows = t.orders.select(path.alias("path"), "o_orderstatus", F.length("o_orderpriority").alias("additions"), (F.col("o_orderkey") % 7).cast("int").alias("deletions"))
    side = lambda s, code: rows.where(F.col("o_orderstatus") == s).groupBy("path").agg(F.lit(code).alias("status"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return side("F", "A"), side("O", "M")


_SIDES = """o AS (SELECT 'src/c' || (o_custkey % 50) || '/o' || (o_orderkey % 400) || '.py' AS path, o_orderstatus AS st, length(o_orderpriority) AS a, o_orderkey % 7 AS d FROM orders),
f AS (SELECT path, 'A' AS s, sum(a)::BIGINT AS a, sum(d)::BIGINT AS d FROM o WHERE st = 'F' GROUP BY path), u AS (SELECT path, 'M' AS s, sum(a)::BIGINT AS a, sum(d)::BIGINT AS d FROM o WHERE st = 'O' GROUP BY path),
m AS (SELECT coalesce(f.path, u.path) AS path, concat_ws('/', f.s, u.s) AS status, coalesce(f.a, 0) + coalesce(u.a, 0) AS additions, coalesce(f.d, 0) + coalesce(u.d, 0) AS deletions, f.path IS NOT NULL AS staged, u.path IS NOT NULL AS unstaged FROM f FULL JOIN u ON f.path = u.path)"""


@query("git_status_merge", "J11 S11", f"WITH {_SIDES} SELECT * FROM m")
def status(t):
    return git.merged_status(*_changes(t))


@query(
    "commit_totals",
    "A20 A21",
    f"""WITH {_SIDES} SELECT count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(staged::INT)::BIGINT AS staged, sum(unstaged::INT)::BIGINT AS unstaged,
count(*) || ' file(s) have uncommitted changes (+' || sum(additions)::BIGINT || '/-' || sum(deletions)::BIGINT || '). ' || sum(staged::INT)::BIGINT || ' staged, ' || sum(unstaged::INT)::BIGINT || ' unstaged. Affected files: ' ||
array_to_string(list(path ORDER BY path)[1:6], ', ') || ', and ' || (count(*) - 6) || ' more.' AS summary FROM m""",
)
def totals(t):
    return git.totals(git.merged_status(*_changes(t)))


_LINES = """l AS (SELECT CASE sha % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'C75' ELSE 'R100' END || chr(9) || CASE WHEN sha % 5 >= 3 THEN 'old/' || sha || '.py' || chr(9) ELSE '' END || file AS line, sha FROM commits)"""


def _status_lines(t):
    code = F.element_at(F.array(*[F.lit(x) for x in ("A", "M", "D", "C75", "R100")]), (F.col("sha") % 5 + 1).cast("int"))
    old = F.when(F.col("sha") % 5 >= 3, F.concat(F.lit("old/"), F.col("sha").cast("string"), F.lit(".py\t"))).otherwise("")
    return t.commits.select(F.concat(code, F.lit("\t"), old, F.col("file")).alias("line"), "sha")


@query(
    "git_name_status",
    "S10 S13",
    f"""WITH {_LINES}, p AS (SELECT string_split(line, chr(9)) AS p FROM l) SELECT left(p[1], 1) AS status, CASE WHEN len(p) > 2 THEN p[3] ELSE p[2] END AS path, CASE WHEN len(p) > 2 THEN p[2] END AS old_path,
CASE left(p[1], 1) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'C' THEN 'modified' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' END AS kind FROM p""",
    views="commits",
)
def name_status(t):
    return git.name_status(_status_lines(t))


@query(
    "git_status_last",
    "S13",
    f"WITH {_LINES}, p AS (SELECT sha, string_split(line, chr(9)) AS p FROM l) SELECT path, arg_max(status, sha) AS status FROM (SELECT sha, p[1] AS status, p[len(p)] AS path FROM p) GROUP BY path",
    views="commits",
)
def status_last(t):
    p = F.split("line", "\t")
    return _status_lines(t).select("sha", p[0].alias("status"), F.element_at(p, -1).alias("path")).groupBy("path").agg(F.max_by("status", "sha").alias("status"))


@query(
    "git_numstat_join",
    "J12 S12",
    """WITH l AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE (o_orderkey % 30)::VARCHAR END AS a, (o_orderkey % 11)::VARCHAR AS d, 'f' || o_orderkey || '.py' AS path FROM orders),
s AS (SELECT path, coalesce(try_cast(a AS INT), 0) AS additions, try_cast(d AS INT) AS deletions FROM l), c AS (SELECT 'f' || (o_orderkey + 3) || '.py' AS path, 'A' AS status FROM orders)
SELECT coalesce(c.path, s.path) AS path, coalesce(status, 'M') AS status, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions FROM c FULL JOIN s ON c.path = s.path""",
)
def numstat(t):
    k = F.col("o_orderkey")
    line = F.concat_ws("\t", F.when(k % 9 == 0, "-").otherwise((k % 30).cast("string")), (k % 11).cast("string"), F.concat(F.lit("f"), k.cast("string"), F.lit(".py")))
    changes = t.orders.select(F.concat(F.lit("f"), (k + 3).cast("string"), F.lit(".py")).alias("path"), F.lit("A").alias("status"))
    return git.with_stats(changes, git.numstat(t.orders.select(line.alias("line"))))


@query("git_log_parse", "S9", "SELECT sha::VARCHAR AS sha, author::VARCHAR AS author, message AS subject, strftime(date, '%Y-%m-%d %H:%M:%S') || ' | late' AS date FROM commits", views="commits")
def log_parse(t):
    line = F.concat_ws("|", F.col("sha").cast("string"), F.col("author").cast("string"), F.col("message"), F.concat(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit(" | late")))
    return git.log_lines(t.commits.select(line.alias("line")))


@query(
    "git_porcelain_parse",
    "S6 F30",
    """SELECT file, md5(author::VARCHAR) || left(md5(author::VARCHAR), 8) AS sha, 'a' || author AS author, min(author)::BIGINT + 1700000000 AS epoch, make_timestamp((min(author)::BIGINT + 1700000000) * 1000000) AS at, 'commit of ' || author AS summary FROM commits GROUP BY file, author""",
    views="commits",
)
def porcelain(t):
    sha = F.concat(F.md5(F.col("author").cast("string")), F.substring(F.md5(F.col("author").cast("string")), 1, 8))
    rows = t.commits.select("file", "sha", F.array(F.concat(sha, F.lit(" 1 1")), F.concat(F.lit("author a"), F.col("author").cast("string")), F.concat(F.lit("author-time "), (F.col("author") + 1700000000).cast("string")), F.concat(F.lit("summary commit of "), F.col("author").cast("string"))).alias("ls"))
    lines = rows.select("file", F.col("sha").alias("c"), F.posexplode("ls").alias("p", "line")).withColumn("n", F.col("c") * 10 + F.col("p"))
    return git.porcelain_blame(lines).select("file", "sha", "author", "epoch", F.timestamp_seconds("epoch").cast("timestamp_ntz").alias("at"), "summary")


@query("git_dir_history", "J24", "SELECT sha, author, message FROM (SELECT DISTINCT sha, author, message, date FROM commits WHERE contains(file, 'src/m4')) ORDER BY date DESC, sha DESC LIMIT 10", views="commits")
def dir_history(t):
    return git.under_folder(t.commits, "src/m4").orderBy(F.desc("date"), F.desc("sha")).limit(10).select("sha", "author", "message")


@query(
    "commit_recommendation",
    "F61 P17",
    """WITH c AS (SELECT l_orderkey AS id, 'src/' || CASE WHEN l_partkey % 40 = 0 THEN 'token_' ELSE 'm' END || l_partkey || '.py' AS path, (l_quantity * 8)::BIGINT AS a, l_linenumber::BIGINT AS d FROM lineitem),
g AS (SELECT id, count(*) AS files, sum(a + d)::BIGINT AS changed, list(path ORDER BY path) FILTER (contains(path, 'token')) AS seen FROM c GROUP BY id)
SELECT id, files, changed, coalesce(len(seen), 0) = 0 AND files <= 25 AND changed <= 1200 AS should_commit, CASE WHEN coalesce(len(seen), 0) = 0 AND files <= 25 AND changed <= 1200 THEN 'Ready to commit' ELSE 'Review before committing' END AS title,
coalesce(nullif(concat_ws(' # ', CASE WHEN len(seen) > 0 THEN 'Potentially sensitive file path(s): ' || array_to_string(seen[1:3], ', ') || '.' END, CASE WHEN files > 25 THEN 'This touches more than 25 files; consider splitting it into smaller commits.' END,
CASE WHEN changed > 1200 THEN 'This is a large diff; consider reviewing and splitting it before committing.' END), ''), '') AS concerns FROM g""",
)
def recommendation(t):
    path = F.concat(F.lit("src/"), F.when(F.col("l_partkey") % 40 == 0, "token_").otherwise("m"), F.col("l_partkey").cast("string"), F.lit(".py"))
    c = t.lineitem.select(F.col("l_orderkey").alias("id"), path.alias("path"), (F.col("l_quantity") * 8).cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    return git.recommendation(c, ["id"]).withColumn("concerns", F.array_join("concerns", " # "))


@query(
    "commit_message",
    "F11",
    """WITH c AS (SELECT DISTINCT author AS id, CASE author % 4 WHEN 0 THEN 'docs/' || message || '.md' WHEN 1 THEN 'tests/' || message WHEN 2 THEN 'one_dir/' || message ELSE file END AS path FROM commits),
s AS (SELECT id, count(*) AS n, min(path) AS p, bool_and(starts_with(path, 'docs/')) AS d, bool_and(starts_with(path, 'tests/')) AS t, min(split_part(path, '/', 1)) AS r, max(split_part(path, '/', 1)) AS r2 FROM c GROUP BY id)
SELECT id, CASE WHEN d THEN 'Update documentation' WHEN t THEN 'Update tests' WHEN n = 1 THEN 'Update ' || replace(replace(regexp_replace(split_part(p, '/', -1), '\\.[^.]+$', ''), '_', ' '), '-', ' ') WHEN r = r2 THEN 'Update ' || replace(replace(r, '_', ' '), '-', ' ') ELSE 'Update project changes' END AS message FROM s""",
    views="commits",
)
def message(t):
    m = F.col("author") % 4
    path = F.when(m == 0, F.concat(F.lit("docs/"), "message", F.lit(".md"))).when(m == 1, F.concat(F.lit("tests/"), "message")).when(m == 2, F.concat(F.lit("one_dir/"), "message")).otherwise(F.col("file"))
    c = t.commits.select(F.col("author").alias("id"), path.alias("path")).distinct()
    return git.suggested_message(c, ["id"])


_MESSAGE = "CASE sha % 6 WHEN 0 THEN 'chore: bump deps and regenerate lockfiles today' WHEN 1 THEN 'switch REST to gRPC because of latency' WHEN 2 THEN 'wip ' || message WHEN 3 THEN 'Merge branch ' || message || ' into main line' WHEN 4 THEN 'too short ' || message ELSE 'we decided to keep ' || message || ' events forever' END"


@query(
    "trivial_commit_filter",
    "P16 X6 A31",
    f"""WITH m AS (SELECT sha, lower({_MESSAGE}) AS m FROM commits), t AS (SELECT sha, len(string_split(m, ' ')) < 5 OR starts_with(m, 'chore:') OR starts_with(m, 'wip') OR starts_with(m, 'merge branch') AS trivial FROM m)
SELECT trivial, count(*) AS processed, min(sha) AS first FROM t GROUP BY trivial""",
    views="commits",
)
def trivial(t):
    text = F.expr(_MESSAGE)
    return t.commits.select("sha", tx.is_trivial_commit(text).alias("trivial")).groupBy("trivial").agg(F.count("*").alias("processed"), F.min("sha").alias("first"))


@query("git_top_authors", "T12 A13", "SELECT file, author, n, rank::INT AS rank FROM (SELECT file, author, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, author) AS rank FROM commits GROUP BY 1, 2) WHERE rank <= 5", views="commits")
def top_authors(t):
    return top_per(t.commits.groupBy("file", "author").agg(F.count("*").alias("n")), ["file"], [F.desc("n"), F.asc("author")], 5)


@query(
    "git_iso_dates",
    "F34 F33",
    "SELECT sha, strftime(date, '%Y-%m-%dT%H:%M:%S') AS iso, (sha % 500 // 60) || ':' || lpad((sha % 500 % 60)::VARCHAR, 2, '0') AS took FROM commits",
    views="commits",
)
def iso(t):
    return t.commits.select("sha", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), scores.duration(F.col("sha") % 500).alias("took"))


@query("git_latest_by_window", "W13 W1", "SELECT author, sha FROM (SELECT author, sha, row_number() OVER (PARTITION BY author ORDER BY date DESC, sha DESC) AS r FROM commits) WHERE r = 1", views="commits")
def latest(t):
    w = Window.partitionBy("author").orderBy(F.desc("date"), F.desc("sha"))
    return t.commits.withColumn("r", F.row_number().over(w)).where("r = 1").select("author", "sha")
