"""Line dedup: windows of three lines that overlap, later occurrences removed.

A line ends at a newline; an empty or null text has no lines, a text of fewer than
three lines no window.  Lines are compared as they are.  Every line inside a window
that also starts earlier (smaller doc_id, or the same document before it) goes;
windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .bytesops import byte_values, prefix, span_hash
from .common import bucket_count, text_bytes

WIDTH = 3


def line_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each line, and the lines of each row."""
    breaks = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    # A line starts with its row and after each newline; it ends before one or with its row.
    start = np.sort(np.concatenate((offsets[:-1][filled], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:][filled], breaks)), kind="stable")
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[filled] = 1 + np.searchsorted(breaks, offsets[1:][filled]) - np.searchsorted(breaks, offsets[:-1][filled])
    return span_hash(prefix(byte_values(data), 0), start, end, 0), counts


def later(docs: DataFrame, buckets: int) -> DataFrame:
    return repeats.later_windows(repeats.texts_and_ids(docs), line_symbols, WIDTH, buckets)


_DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the kept lines, joined by newlines) of every row."""
    docs = repeats.texts_and_ids(docs)
    buckets = bucket_count(text_bytes(docs))

    def result(rows: pa.Table, texts, runs) -> pa.Table:
        n, removed, sha = [], [], []
        for text, run in zip(texts, runs, strict=True):
            lines = text.split(b"\n") if text else []
            if len(run[0]):
                keep = repeats.kept(len(lines), run)
                n.append(len(lines))
                removed.append(int(len(lines) - keep.sum()))
                text = b"\n".join([x for x, k in zip(lines, keep, strict=True) if k])
            else:
                n.append(len(lines))
                removed.append(0)
            sha.append(hashlib.sha256(text or b"").hexdigest())
        return pa.table([rows["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=_DIGEST.names)

    return repeats.with_covered(repeats.placed(docs, buckets), later(docs, buckets), WIDTH, result, _DIGEST)


def deduped(docs: DataFrame) -> DataFrame:
    """Every row and column of docs, later windows' lines taken out of text. A column n_chars follows the text."""
    buckets = bucket_count(text_bytes(docs))
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = docs.schema

    def result(rows: pa.Table, texts, runs) -> pa.Table:
        out = []
        for text, run in zip(texts, runs, strict=True):
            if len(run[0]):
                lines = text.split(b"\n")
                keep = repeats.kept(len(lines), run)
                text = b"\n".join([x for x, k in zip(lines, keep, strict=True) if k])
            out.append(None if text is None else text.decode())
        column = pa.array(out, pa.string())
        return pa.table([column if name == "text" else rows[name] for name in schema.names], names=schema.names)

    out = repeats.with_covered(repeats.placed(docs, buckets), later(docs, buckets), WIDTH, result, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: The same digests in DuckDB SQL.
ORACLE = """
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM f WHERE r > 1),
x AS (SELECT d.doc_id, l, list(c.i) FILTER (c.i IS NOT NULL) AS gone FROM d LEFT JOIN c USING (doc_id) GROUP BY ALL)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(coalesce(gone, []))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda j: NOT list_contains(coalesce(gone, []), j)), lambda j: l[j]), chr(10)), '')) AS kept_sha256
FROM x
"""
