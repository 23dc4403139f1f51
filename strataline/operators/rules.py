"""Rule scans over text and code, and what their findings add up to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scores
from .relational import first_wins


def rules_table(spark: SparkSession, rules: list[tuple] = fixed.RULES) -> DataFrame:
    """rule_id, category, pattern, severity, message: rules that compile, severity medium where none is known."""
    rows = []
    for i, (category, pattern, severity, message) in enumerate(rules):
        try:
            re.compile(pattern)
        except re.error:
            continue
        rows.append((i, category, pattern, severity if severity in fixed.SEVERITIES else "medium", message))
    return spark.createDataFrame(rows, "rule_id int, category string, pattern string, severity string, message string")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1) and content of each line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_p", "content")).select(key, (F.col("_p") + 1).alias("line"), "content")


def line_scan(docs: DataFrame, rules: list[tuple] = fixed.RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first match of each rule in each line: key, line, column (from 0), rule_id, category, severity, message, matched, snippet.

    The rules are literals of one expression, so each text is read once and nothing is joined.
    """
    found = lines(docs, key, text)
    tries = []
    for i, (category, pattern, severity, message) in enumerate(rules):
        try:
            re.compile(pattern)
        except re.error:
            continue
        any_case = f"(?i)({pattern})"
        at = F.regexp_instr("content", F.lit(any_case)) - 1
        tries.append(
            F.when(
                at >= 0,
                F.struct(
                    F.lit(i).alias("rule_id"),
                    F.lit(category).alias("category"),
                    F.lit(severity if severity in fixed.SEVERITIES else "medium").alias("severity"),
                    F.lit(message).alias("message"),
                    at.alias("column"),
                    F.regexp_extract("content", any_case, 1).alias("matched"),
                ),
            )
        )
    hit = F.explode(F.array_compact(F.array(*tries)))
    return found.select(key, "line", F.trim("content").alias("snippet"), hit.alias("h")).select(key, "line", "h.*", "snippet")


def multi_scan(docs: DataFrame, patterns: list[tuple], key: str = "doc_id", text: str = "text", limit: int = 80) -> DataFrame:
    """Every match of every pattern in whole texts: key, line, category, message, severity, matched (80 characters).

    patterns: kind, pattern, message and, if there is one, severity.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def matches(kind: str, pattern: str, message: str, severity: str | None = None) -> Column:
        # What lies before the n-th match is what n splits leave, and the matches between.
        found = F.regexp_extract_all(body, F.lit(f"(?i)({pattern})"), F.lit(1))
        between = F.split(body, f"(?i)(?:{pattern})", -1)

        def row(n: Column) -> Column:
            before = F.concat(F.array_join(F.slice(between, 1, n), ""), F.array_join(F.slice(found, 1, n - 1), ""))
            return F.struct(
                F.lit(kind).alias("category"),
                F.lit(message).alias("message"),
                F.lit(severity).cast("string").alias("severity"),
                (_newlines(before) + 1).alias("line"),
                F.substring(F.element_at(found, n), 1, limit).alias("matched"),
            )

        return F.transform(F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found))).otherwise(F.array().cast("array<int>")), row)

    return docs.select(key, F.explode(F.concat(*[matches(*p) for p in patterns])).alias("h")).select(key, "h.*")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def histogram(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of each severity, zeros included, their total, the score and whether it passes."""
    counts = [F.coalesce(F.sum(F.when(F.col("severity") == s, 1).otherwise(0)), F.lit(0)).cast("long").alias(s) for s in fixed.SEVERITIES]
    weight = F.sum(scores.severity_weight("severity"))
    out = (findings.groupBy(*keys) if keys else findings.groupBy()).agg(*counts, F.count("*").alias("total"), scores.compliance_score(weight).alias("score"))
    return out.withColumn("passed", (F.col("score") >= 70) & (F.col("critical") == 0))


def deduped(findings: DataFrame, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The first finding of each category, beginning of message and line, of each of the keys' values."""
    marked = findings.withColumn("_m", F.substring("message", 1, 60))
    names = [*(keys or []), "category", "_m", "line"]
    return first_wins(marked, names, order).drop("_m")


def ranked(findings: DataFrame, order: list[Column]) -> DataFrame:
    return findings.orderBy(scores.severity_rank("severity"), *order)


def worst_status(findings: DataFrame, key: str) -> DataFrame:
    """Each file's status by its worst finding: flag, warn or clean."""
    rank = F.min(scores.severity_rank("severity"))
    return findings.groupBy(key).agg(F.when(rank <= 1, "flag").when(rank == 2, "warn").otherwise("clean").alias("status"))


def grep(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", limit: int | None = None, any_case: bool = False) -> DataFrame:
    """Lines that match a pattern, in order."""
    hit = lines(docs, key, text).where(F.col("content").rlike(f"(?i){pattern}" if any_case else pattern))
    return hit if limit is None else hit.orderBy(key, "line").limit(limit)


def read_lines(docs: DataFrame, start: int = 1, count: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A range of lines of every text."""
    return docs.select(key, F.array_join(F.slice(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), start, count), "\n").alias("content"))


def glob(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Paths that fit a pattern of *, ** and ?."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return files.where(F.col(path).rlike(f"^{out}$"))


def checks_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.CHECKS, "id string, name string, description string, category string, default_severity string")


def complexity_findings(functions: DataFrame, most: int = 10) -> DataFrame:
    """functions (file_path, name, line, complexity) that are too complex, as findings."""
    return functions.where(F.col("complexity") > most).select(
        F.lit("medium").alias("severity"),
        F.lit("complexity").alias("category"),
        F.concat(F.lit("`"), F.col("name"), F.lit("` has cyclomatic complexity "), F.col("complexity").cast("string")).alias("message"),
        "file_path",
        "line",
    )


def unguarded_async(code) -> Column:
    """Code with an async function that awaits and has no try."""
    c = F.col(code) if isinstance(code, str) else code
    return c.rlike(r"(async\s+def|async\s+function|async\s*\()") & c.rlike(r"\bawait\b") & ~c.rlike(r"\btry\b")


def pattern_findings(functions: DataFrame, peers: DataFrame) -> DataFrame:
    """Functions that lack what most similar code has: error handling (60 of 100), logging (70 of 100).

    functions: name, code; peers: name, peer_code; three peers at least.
    """
    handles = lambda c: F.col(c).rlike(r"\btry\b")
    logs = lambda c: F.col(c).rlike(r"(?i)\blog(?:ger)?\.(?:info|debug|warning|error|warn)\s*\(")
    counts = peers.where(F.coalesce("peer_code", F.lit("")) != "").groupBy("name").agg(F.count("*").alias("n"), F.sum(handles("peer_code").cast("int")).alias("handled"), F.sum(logs("peer_code").cast("int")).alias("logged"))
    both = functions.join(counts, "name").where("n >= 3")
    finding = lambda severity, text, part: F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message"), F.round(F.col(part) / F.col("n"), 2).alias("confidence"))
    found = F.array_compact(
        F.array(
            F.when(~handles("code") & (F.col("handled") >= F.col("n") * 0.6), finding("medium", "lacks error handling", "handled")),
            F.when(~logs("code") & (F.col("logged") >= F.col("n") * 0.7), finding("low", "has no logging", "logged")),
        )
    )
    return both.select("name", F.explode(found).alias("f")).select("name", "f.*")
