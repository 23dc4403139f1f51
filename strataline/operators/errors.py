"""Errors by kind, severity, and whether work can go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category(stage, message) -> Column:
    """What went wrong, by the stage, else by words of the message."""
    s = F.col(stage) if isinstance(stage, str) else stage
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    return (
        F.when(s == "analysis", "parsing")
        .when(s == "context", "context_analysis")
        .when(s == "generation", "llm_generation")
        .when(s == "export", "export")
        .when(m.contains("memory") | m.contains("resource"), "resource")
        .when(m.contains("config") | m.contains("setting"), "configuration")
        .otherwise("unknown")
    )


def severity(kind) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "configuration", "critical").when(k.isin("resource", "parsing"), "high").when(k.isin("context_analysis", "llm_generation"), "medium").otherwise("low")


def recoverable(kind) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return ~k.isin("configuration", "resource", "unknown")


# What to do.
ADVICE = {
    "parsing": "Check the file for syntax errors",
    "context_analysis": "The element is documented without context",
    "llm_generation": "Check the key and the limits of the service, then try again",
    "export": "Check that the folder exists and may be written to",
    "resource": "Work on fewer files at once",
    "configuration": "Check the settings",
    "unknown": "See the log",
}


def classified(errors: DataFrame, stage: str = "stage", message: str = "message") -> DataFrame:
    rows = errors.withColumn("category", category(stage, message))
    advice = F.element_at(F.create_map(*[F.lit(x) for p in ADVICE.items() for x in p]), F.col("category"))
    return rows.withColumn("severity", severity("category")).withColumn("recoverable", recoverable("category")).withColumn("advice", advice)
