"""Functions for SQL: scalar ones as expressions, table-generating ones in Python, once for each session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import parsing

# SQL functions are expressions that Catalyst puts in place: nothing of Python runs.
_SCALARS = {
    "basename_of": ("path STRING", "STRING", "regexp_extract(path, '([^/]*)$', 1)"),
    "cosine_of": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) "
        "/ sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) / sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) END",
    ),
    "line_health_of": ("n BIGINT", "DOUBLE", "CASE WHEN n = 0 THEN 0.80D WHEN n < 50 THEN 0.95D WHEN n <= 200 THEN 1.00D WHEN n <= 500 THEN 0.85D WHEN n <= 1000 THEN 0.65D ELSE 0.40D END"),
    "severity_weight_of": ("s STRING", "INT", "CASE s WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 0 END"),
    "risk_level_of": ("r DOUBLE", "STRING", "CASE WHEN r >= 0.7 THEN 'high' WHEN r >= 0.3 THEN 'medium' ELSE 'low' END"),
}

_TABLES: dict[str, tuple[Callable[[str, str], list[dict]], str]] = {
    "code_chunks": (parsing.chunks, parsing.CHUNK),
    "code_imports": (parsing.imports, parsing.IMPORT),
    "code_symbols": (parsing.symbols, parsing.SYMBOL),
    "code_elements": (parsing.elements, parsing.ELEMENT),
    "added_lines": (parsing.added_lines, parsing.ADDED),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session's SQL; gives their names."""
    for name, (params, kind, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    for name, (parse, schema) in _TABLES.items():
        spark.udtf.register(name, _generator(parse, schema))
    return [*_SCALARS, *_TABLES]


def _generator(parse: Callable[[str, str], list[dict]], schema: str):
    names = [part.split()[0] for part in _top_level(schema)]

    class Rows:
        def eval(self, code: str, path: str):
            for row in parse(code or "", path or ""):
                yield tuple(row[n] for n in names)

    return udtf(Rows, returnType=schema)


def _top_level(schema: str) -> list[str]:
    """The columns of a schema; commas inside brackets don't part them."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]
