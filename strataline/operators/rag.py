"""Retrieval: sources of an answer, context search, and what is put before a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .relational import containing, first_wins


def sources(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Relevance to four places, and each query's base confidence: its hits' mean."""
    rows = hits.withColumn("relevance", F.bround("sim", 4))
    mean = rows.groupBy(key).agg(F.bround(F.avg("relevance"), 4).alias("confidence"))
    return rows.join(mean, key)


def with_cited(found: DataFrame, cited: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Sources, and the cited paths that aren't among them, each once."""
    more = cited.join(found.select(*keys, path), [*keys, path], "left_anti")
    return found.unionByName(first_wins(more, [*keys, path], [F.col("seq")]).drop("seq"), allowMissingColumns=True)


def excluding(candidates: DataFrame, seen: DataFrame, key: str, order: list, n: int = 3) -> DataFrame:
    """The first n candidates that haven't been seen."""
    return candidates.join(seen.select(key), key, "left_anti").orderBy(*order).limit(n)


def context_score(query: str):
    """What a directory context scores for a query, from directory, description and files."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    files = F.aggregate("files", F.lit(0.0), lambda s, f: s + F.when(has(f["name"]), 1.5).otherwise(0.0) + F.when(has(f["purpose"]), 1.0).otherwise(0.0))
    return F.when(has(F.col("directory")), 3.0).otherwise(0.0) + F.when(has(tx.basename("directory")), 2.5).otherwise(0.0) + F.when(has(F.col("description")), 2.0).otherwise(0.0) + files


def context_search(contexts: DataFrame, query: str, n: int = 5) -> DataFrame:
    return contexts.withColumn("score", context_score(query)).where("score > 0").orderBy(F.desc("score"), "directory").limit(n)


def section_score(keywords: list[str], name, purpose, apis):
    """What a file's entry scores for keywords: 1 for the name, a half for the purpose, 1.5 for an API."""
    words = F.array(*[F.lit(k) for k in keywords])
    inside = lambda c: F.exists(words, lambda w: F.contains(F.lower(c), w))
    return F.when(inside(name), 1.0).otherwise(0.0) + F.when(inside(purpose), 0.5).otherwise(0.0) + F.when(F.exists(apis, inside), 1.5).otherwise(0.0)


def validated(contexts: DataFrame) -> DataFrame:
    """How many contexts there are, valid and invalid; errors are counted, not gathered."""
    ok = F.col("error").isNull() & (F.col("directory") != "") & (F.col("description") != "")
    return contexts.agg(F.count("*").alias("total"), F.sum(ok.cast("int")).alias("valid"), F.sum((~ok).cast("int")).alias("invalid"))


def affected_by_text(files: DataFrame, decisions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Decisions and the files whose path or name their texts contain, as part of a word too."""
    names = files.select(F.col(path).alias("target"), F.explode(F.array_distinct(F.array(F.col(path), tx.basename(path)))).alias("name"))
    return containing(decisions.select(F.col("id").alias("key"), F.col(text).alias("text")), names).select(F.col("key").alias("id"), F.col("target").alias(path))


def loose_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """imports (source, name) and nodes (id, name, place) to source, target: each import's first node, in order of place.

    A node fits if its name up to the first dot is the import, or its id contains the
    import with slashes for dots.  An import that first fits its own file gives no
    link; equal links are one.
    """
    wanted = imports.select("source", "name").distinct()
    stems = nodes.select("id", "place", F.substring_index("name", ".", 1).alias("name"))
    fits = wanted.join(stems, "name").select("source", "name", "id", "place")
    slashed = wanted.select("name").distinct().select(F.col("name").alias("target"), F.replace("name", F.lit("."), F.lit("/")).alias("name"))
    inside = containing(nodes.select(F.col("id").alias("key"), F.col("id").alias("text")), slashed)
    inside = inside.join(nodes.select(F.col("id").alias("key"), "place"), "key").join(wanted.withColumnRenamed("name", "target"), "target")
    fits = fits.unionByName(inside.select("source", F.col("target").alias("name"), F.col("key").alias("id"), "place"))
    first = fits.groupBy("source", "name").agg(F.min_by("id", F.struct("place", "id")).alias("target"))
    return first.where("source <> target").select("source", "target").distinct()


def narrative(report: DataFrame) -> DataFrame:
    """An impact report in words, without a language model: how many files, how risky, and what to do."""
    high, total = F.col("high"), F.col("total")
    return report.withColumn(
        "narrative",
        F.when(total == 0, F.lit("No other file depends on this one."))
        .when(high > 0, F.concat(F.lit("Changing this file affects "), total.cast("string"), F.lit(" file(s), "), high.cast("string"), F.lit(" of them at high risk. Review these first.")))
        .otherwise(F.concat(F.lit("Changing this file affects "), total.cast("string"), F.lit(" file(s), none of them at high risk."))),
    )
