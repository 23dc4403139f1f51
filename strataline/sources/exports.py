"""Documentation as Markdown and HTML: one row for each page, ordered inside by kind and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.relational import containing


def kind_order(kind: str = "kind") -> Column:
    return F.when(F.col(kind) == "class", 0).when(F.col(kind) == "function", 1).when(F.col(kind) == "method", 2).when(F.col(kind) == "module", 3).otherwise(4)


def ordered(elements: DataFrame) -> DataFrame:
    return elements.orderBy("file", kind_order(), "name")


def _pages(elements: DataFrame, section: Column) -> DataFrame:
    """file and its sections joined in order. A page holds one file's elements."""
    rows = elements.select("file", F.struct(kind_order().alias("k"), F.col("name"), section.alias("s")).alias("e"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["s"]), "\n").alias("body"), F.count("*").alias("n"))


def markdown(elements: DataFrame) -> DataFrame:
    """file, name and content of each page of elements (file, kind, name, doc)."""
    section = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n*"), F.col("kind"), F.lit("*\n\n"), F.coalesce("doc", F.lit("_No documentation._")), F.lit("\n"))
    pages = _pages(elements, section)
    return pages.select("file", tx.export_name("file").alias("name"), F.concat(F.lit("# "), F.col("file"), F.lit("\n\n"), F.col("body")).alias("content"))


def markdown_index(elements: DataFrame) -> DataFrame:
    """Lines of the index: a link and a count for each file."""
    return elements.groupBy("file").agg(F.count("*").alias("n")).select("file", F.concat(F.lit("- ["), F.col("file"), F.lit("]("), tx.export_name("file"), F.lit(") ("), F.col("n").cast("string"), F.lit(" elements)")).alias("line"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html(elements: DataFrame) -> DataFrame:
    section = F.concat(F.lit('<section id="'), tx.anchor("name"), F.lit('"><h2>'), escaped(F.col("name")), F.lit("</h2><p class=\"kind\">"), F.col("kind"), F.lit("</p><pre>"), escaped(F.coalesce("doc", F.lit(""))), F.lit("</pre></section>"))
    pages = _pages(elements, section)
    head = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), escaped(F.col("file")), F.lit("</title></head><body><h1>"), escaped(F.col("file")), F.lit("</h1>"))
    return pages.select("file", tx.export_name("file", ".html").alias("name"), F.concat(head, F.col("body"), F.lit("</body></html>")).alias("content"))


def cross_references(elements: DataFrame) -> DataFrame:
    """Pairs of elements where one's documentation contains the other's name, whatever their case, as part of a word too."""
    docs = elements.select(F.col("id").alias("key"), F.lower(F.coalesce("doc", F.lit(""))).alias("text"))
    found = containing(docs, elements.select(F.col("id").alias("target"), F.lower("name").alias("name")))
    return found.where("key <> target").select(F.col("key").alias("source"), "target")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as lines of JSON with their names; a web server or a copy job makes files of them."""
    pages.select("name", "content").write.mode("overwrite").json(path)
