"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Words are runs of ASCII digits, ASCII letters (lower-cased) and all that isn't
ASCII.  An item's windows are its runs of ten words; an item with fewer words, but
some, is one window.  A text is normalised to its words, one space between, and
scanned once; matches are carried back to word numbers and to offsets in the
original text.

The items of a pass are bounded (`PASS_BYTES` of text, measured before any is fetched;
an item that is longer by itself makes a longer pass).  Items within the bound, as test
sets are, make one pass, and no row moves.  More are dealt to passes by a hash; the
driver holds one pass at a time, each pass's hits are written down by a row's number,
and rows meet their hits by that number, never by their texts.

A null text has no words and no hits; a null or wordless item, or an empty benchmark,
has no windows.  Rows that repeat, or share a null or other doc_id, each get their own
hits.  A null item_id is an empty one.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import pieces
from .common import cut, free_name, set_aside

WINDOW = 10
#: Bytes of items that one pass holds in an automaton, which takes some hundred times as many in every worker.
PASS_BYTES = 1 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_HITS = "n_words long, runs array<struct<first:int,after:int>>, spans array<struct<start:int,end:int>>, items array<string>"
_HITS_ARROW = [
    ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("items", pa.list_(pa.string())),
]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def automaton(items: list[tuple[str, str | None]], window: int = WINDOW):
    """One automaton over all windows of the items; each knows its length and whose it is. None without windows."""
    owners: dict[str, tuple[int, set[str]]] = {}
    for key, text in items:
        w = [x.decode() for x in words(text)]
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            owners.setdefault(f" {' '.join(part)} ", (len(part), set()))[1].add(key)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for part, (n, keys) in owners.items():
        found.add_word(part, (n, tuple(keys)))
    found.make_automaton()
    return found


def scan(found, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """How many words a text has, the runs of words inside windows that occur, and the items they are of."""
    w = words(text)
    runs: list[list[int]] = []
    items: set[str] = set()
    if w and found is not None:
        line = f" {b' '.join(w).decode()} "
        at, spaces = 0, 0
        for end, (n, keys) in found.iter(line):
            spaces += line.count(" ", at, end + 1)
            at = end + 1
            items.update(keys)
            first, after = spaces - 1 - n, spaces - 1
            while runs and runs[-1][0] >= first:
                runs.pop()
            if runs and runs[-1][1] >= first:
                runs[-1][1] = max(after, runs[-1][1])
            else:
                runs.append([first, after])
    return len(w), [(a, b) for a, b in runs], items


def _items(benchmark: DataFrame, passes: int) -> DataFrame:
    """key, text and pass of each item."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("pass", F.pmod(F.xxhash64("key", "text"), F.lit(passes)))


#: The automaton that this worker used last, by the pass it is of.
_held: dict[str, object] = {}


def _scanned(rows: DataFrame, items: list[tuple[str, str | None]], window: int, new: list[str]) -> DataFrame:
    """rows with the hits of these items."""
    sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

    def run(batches):
        name, own = sent.value
        if name not in _held:
            _held.clear()
            _held[name] = automaton(own, window)
        found = _held[name]
        for b in pieces(batches):
            got = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                n, runs, keys = scan(found, text)
                spans = []
                if runs:
                    at = [m.span() for m in _WORD.finditer(text)]
                    spans = [{"start": at[a][0], "end": at[z - 1][1]} for a, z in runs]
                got.append((n, [{"first": a, "after": z} for a, z in runs], spans, sorted(keys)))
            cols = list(zip(*got, strict=True)) if got else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, (_, t) in zip(cols, _HITS_ARROW, strict=True))], [*b.schema.names, *new])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T._parse_datatype_string(_HITS).fields]))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row and column of docs with n_words, runs (of word numbers), spans (of original characters) and items.

    Columns of docs that have these names are replaced.  Of several passes, runs and
    spans are those of each, so they may overlap.
    """
    new = ["n_words", "runs", "spans", "items"]
    spark = docs.sparkSession
    keep = docs.drop(*new).withColumn("text", F.col("text").cast("string"))
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-size // PASS_BYTES))
    items = _items(benchmark, passes)
    if passes == 1:
        return _scanned(keep, [tuple(r) for r in items.select("key", "text").collect()], window, new)
    row = free_name([*keep.columns, *new], "row")
    numbered = cut(spark, keep.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for k in range(passes):
        one = _scanned(numbered.select(row, "text"), [tuple(r) for r in items.where(F.col("pass") == k).select("key", "text").collect()], window, new).drop("text")
        # Each pass gives every row's number of words; the first one's counts.
        one = cut(spark, one if k == 0 else one.where(F.size("runs") > 0))
        found = one if found is None else found.unionAll(one)
    united = (F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in new[1:])
    return numbered.join(found.groupBy(row).agg(F.max("n_words").alias("n_words"), *united), row).select(*keep.columns, *new)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = hits(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), benchmark)
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["after"] - 1)))))
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("runs") == 0, F.lit(0)).otherwise(n_hit).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    plain, own = set_aside(docs, ["n_words", "runs", "spans", "items"])
    return hits(plain, benchmark).where(F.size("runs") == 0).select(*own)


#: The same result in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
