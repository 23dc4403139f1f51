"""Source trees as tables: files, texts, contexts, statistics."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators.relational import last_wins
from ..session import cut
from . import tree as tree_walk


def source_files(spark: SparkSession, root: str, extensions: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """path (below root), size, modified, content and error of supported files; skipped and dotted folders are left out.

    folders: only paths that begin so. Names are filtered before contents are read, folders before they are listed.
    """
    wanted = [e for e in fixed.SOURCE_EXTENSIONS if extensions is None or e in extensions]
    test = reduce(or_, [F.lower("path").endswith(e) for e in wanted], F.lit(False))
    found = tree_walk.entries(spark, root, beginnings=folders or None).where("type = 'file'").where(test)
    return tree_walk.contents(spark, root, found)


def skipped(path) -> Column:
    """Whether a path lies in a folder that isn't read."""
    parts = F.split(tx.dirname(path), "/")
    return F.exists(parts, lambda p: p.isin(*fixed.SKIPPED_FOLDERS) | (p.startswith(".") & (p != ".")))


def texts(files: DataFrame) -> DataFrame:
    """Files as UTF-8 text with their language and lines; bytes that aren't UTF-8 become replacement characters."""
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = files.select("path", "size", "content").where("content IS NOT NULL")
    schema = T.StructType([*keep.drop("content").schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            out = [None if c is None else c.decode("utf-8", "replace") for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["path", "size", "text"])

    return keep.mapInArrow(run, schema).withColumn("language", tx.language_of("path")).withColumn("lines", tx.line_count("text"))


def unreadable(files: DataFrame) -> DataFrame:
    """Files that are refused or couldn't be read, and why."""
    own = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.select("path", F.coalesce(own, tx.file_error("path", "size")).alias("error")).where("error <> ''")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """name, kind and size of the files below a folder, skipped folders included."""
    rows = tree_walk.entries(spark, root, prune=False).where("type = 'file'")
    return rows.select(tx.basename("path").alias("name"), tx.file_kind(tx.basename("path")).alias("kind"), "size")


def tree(files: DataFrame, path: str = "path", suffixes: list[str] | None = None) -> DataFrame:
    """Files and all folders above them as path, name, type and size; suffixes hold for files only."""
    rows = files if suffixes is None else files.where(tx.suffix(path).isin(*suffixes))
    parts = F.split(F.col(path), "/")
    above = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).join(rows.select(F.col(path).alias("path")), "path", "left_anti").distinct()
    leaves = rows.select(F.col(path).alias("path"), tx.basename(path).alias("name"), F.lit("file").alias("type"), F.col("size").cast("long").alias("size"))
    return leaves.unionAll(above.select("path", tx.basename("path").alias("name"), F.lit("directory").alias("type"), F.lit(None).cast("long").alias("size")))


def contexts(spark: SparkSession, root: str) -> DataFrame:
    """directory, description and files of each `.context.yaml` below root; broken ones and unreadable ones have an error."""
    return contexts_at(spark, root).drop("at")


def contexts_at(spark: SparkSession, root: str) -> DataFrame:
    """contexts, and at: the folder that each file lies in."""
    from ..functions.parsing import flat

    found = tree_walk.entries(spark, root).where("type = 'file'").where(tx.basename("path") == ".context.yaml")
    raw = tree_walk.contents(spark, root, found).select(tx.dirname("path").alias("at"), F.col("error").alias("unread"), F.decode("content", "UTF-8").alias("text"))
    return flat(raw, context_rows, CONTEXT, "at", "text", "unread")


def inherited(contexts: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """files with the context (directory, description, at) of the nearest folder at or above each that has a valid one."""
    at = F.when(F.col("at") == ".", "").otherwise(F.col("at"))
    valid = contexts.where("error IS NULL").select(at.alias("_at"), F.struct("directory", "description", at.alias("at")).alias("context"))
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select(path, F.posexplode(above).alias("_depth", "_at")).join(valid, "_at")
    nearest = rows.groupBy(path).agg(F.max_by("context", "_depth").alias("context"))
    return files.join(nearest, path, "left")


CONTEXT = "directory string, description string, files array<struct<name:string,purpose:string,type:string,key_apis:array<string>>>, error string"


def context_rows(text: str, unread: str = "") -> list[dict]:
    """One row of a context file; what it lacks has defaults. unread: why the file couldn't be read, if it couldn't."""
    if unread:
        return [{"directory": "", "description": "", "files": [], "error": unread}]
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        import json

        try:
            data = json.loads(text)
        except ValueError as e:
            return [{"directory": "", "description": "", "files": [], "error": str(e)[:200]}]
    except Exception as e:  # noqa: BLE001  a broken file is a row with an error
        return [{"directory": "", "description": "", "files": [], "error": str(e)[:200]}]
    if not isinstance(data, dict):
        return [{"directory": "", "description": "", "files": [], "error": "not a mapping"}]
    files = [
        {"name": str(f.get("name", "")), "purpose": str(f.get("purpose", "")), "type": str(f.get("type", "unknown")), "key_apis": [str(a) for a in f.get("key_apis") or []]}
        for f in data.get("files") or []
        if isinstance(f, dict)
    ]
    return [{"directory": str(data.get("directory", "")), "description": str(data.get("description", "")), "files": files, "error": None}]


def runtime_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row for each key of the JSON objects of statistics in a file or a folder of files; a broken file gives no rows."""
    kind = "map<string,struct<error_rate:double,avg_latency_ms:double,p99_latency_ms:double,request_count:long,last_error:string,last_error_time:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return raw.select(F.explode("m").alias("key", "s")).select("key", "s.*")


_DECISION = "id string, title string, description string, context string, decision string, reasoning string, source_ref string, status string, tags array<string>, made_at string, embedding array<double>"


def decisions(spark: SparkSession, root: str, limit: int | None = 1000) -> DataFrame:
    """JSON decisions of a folder, the newest files first (then by id); broken files are in `broken_decisions`."""
    rows = spark.read.schema(f"{_DECISION}, _broken string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").json(root)
    rows = rows.withColumn("modified", F.col("_metadata.file_modification_time")).where("_broken IS NULL").drop("_broken").orderBy(F.desc("modified"), "id")
    return with_decision_defaults(rows if limit is None else rows.limit(limit))


def broken_decisions(spark: SparkSession, root: str) -> DataFrame:
    """name and text of the files of a folder that hold no JSON object or array."""
    raw = spark.read.text(root, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return raw.where(kind.isNull() | ~kind.rlike("^(OBJECT|ARRAY)"))


def rules(spark: SparkSession, path: str, fallback: list[tuple] = fixed.RULES) -> DataFrame:
    """rule_id, category, pattern, severity, message of the YAML files of rules at a path, read by tasks.

    A file maps categories to lists of rules (pattern, severity, message), or has them under
    `rules`; a rule may be its pattern alone.  Rules without a pattern that compiles are left
    out.  Where no file gives a rule (none is there, or all are broken), the built-in ones hold.
    """
    from ..functions.parsing import flat
    from ..operators.rules import rules_table

    found = tree_walk.entries(spark, path).where("type = 'file'").where(F.lower("path").rlike(r"\.ya?ml$"))
    raw = tree_walk.contents(spark, path, found).select("path", F.decode("content", "UTF-8").alias("text"))
    loaded = cut(flat(raw, rule_rows, "place int, category string, pattern string, severity string, message string", "path", "text"))
    if loaded.isEmpty():
        return rules_table(spark, fallback)
    order = Window.orderBy("path", "place")  # as many rows as people have written rules
    return loaded.select((F.row_number().over(order) - 1).alias("rule_id"), "category", "pattern", "severity", "message")


def rule_rows(text: str, path: str = "") -> list[dict]:
    """The rules of one YAML text, in order; none if it is broken."""
    import re

    import yaml

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    data = data.get("rules", data) if isinstance(data, dict) else {}
    out = []
    for category, listed in data.items() if isinstance(data, dict) else ():
        for rule in listed if isinstance(listed, list) else ():
            rule = {"pattern": rule} if isinstance(rule, str) else rule
            if not isinstance(rule, dict) or not isinstance(rule.get("pattern"), str):
                continue
            try:
                re.compile(rule["pattern"])
            except re.error:
                continue
            severity = str(rule.get("severity", "medium")).lower()
            out.append({"place": len(out), "category": str(category), "pattern": rule["pattern"], "severity": severity if severity in fixed.SEVERITIES else "medium", "message": str(rule.get("message", ""))})
    return out


def with_decision_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "context", "decision", "reasoning", "source_ref")} | {"status": F.coalesce("status", F.lit("active")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def parsed_decisions(answers: DataFrame, text: str = "text") -> DataFrame:
    """Decisions in answers of language models: JSON objects or arrays, fenced or bare, one row each with defaults."""
    kind = "struct<title:string,description:string,context:string,decision:string,reasoning:string,status:string,tags:array<string>,confidence:double>"
    body = tx.salvaged_json(text)
    many = F.from_json(F.when(F.trim(body).startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), f"array<{kind}>")
    rows = answers.where(body.isNotNull()).select("*", F.explode(many).alias("_d")).where("_d is not null").select(*answers.columns, "_d.*")
    rows = rows.withColumn("source_ref", F.lit("")) if "source_ref" not in rows.columns else rows
    return with_decision_defaults(rows).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))).where("title <> ''")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return last_wins(rows, keys, [F.col(order)])
