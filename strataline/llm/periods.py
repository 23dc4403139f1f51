"""Periodic run detection: every lag of a text's words is compared, at once for all of its words.

A run is a stretch of consecutive words with smallest period q that is at least `exponent`
periods and `least` words long and that no neighbouring word extends.  The word numbers of a
text are compared with themselves shifted by each lag up to n / exponent; a stretch of t true
places at lag q is a run of t + q words.  A lag with fewer true places than the shortest
stretch is done; of the others the stretches are taken from the places where truth changes.
A multiple of a run's period gives the same first word and length (no longer stretch has both
periods), so the smallest period of each place is the run's.

Texts of up to `LAGS` lags are done where they are read.  The lags of a longer one are cut into
ranges of that many; each range goes to a task of its own with the word numbers, and the ranges'
stretches meet by a digest of the text.  So one very long text is the work of many tasks; all
of its pairs of places are compared, which is the price of the method.

A null text has no words.  Rows are independent: repeated rows, ties and null ids change nothing.
Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import pieces
from .common import free_name

EXPONENT = 4
LEAST = 6

#: Lags of one text that one task compares.
LAGS = 2048

#: Pairs of places compared in one numpy call.
BLOCK = 1 << 18

RUN = "start long, length long, period long"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Numbers that are equal where words are."""
    numbers: dict[bytes, int] = {}
    fresh = count()
    return np.fromiter((k if (k := numbers.get(w)) is not None else numbers.setdefault(w, next(fresh)) for w in words), np.int32, len(words))


def last_lag(n: int) -> int:
    """The longest period that a run in n words can have."""
    return n // EXPONENT


def stretches(ids: np.ndarray, low: int, high: int) -> np.ndarray:
    """(start, length, lag) of every stretch long enough for a run, at the lags low .. high - 1."""
    n = len(ids)
    low, high = max(1, low), min(high, last_lag(n) + 1)
    if n < LEAST or low >= high:
        return np.zeros((0, 3), np.int64)
    step = max(1, min(BLOCK // n, high - low))
    padded = np.concatenate((ids, np.full(step + high, -1, ids.dtype)))
    shifted = np.lib.stride_tricks.sliding_window_view(padded, n)
    found = []
    for at in range(low, high, step):
        equal = shifted[at : min(at + step, high)] == ids
        for lag, row in enumerate(equal, at):
            least = max(LEAST, EXPONENT * lag) - lag
            if np.count_nonzero(row) < least:
                continue
            changes = np.flatnonzero(np.diff(row.view(np.int8), prepend=0, append=0))
            start, end = changes[::2], changes[1::2]
            long = np.flatnonzero(end - start >= least)
            if len(long):
                found.append(np.stack((start[long], end[long] - start[long] + lag, np.full(len(long), lag)), 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs_of(found: np.ndarray) -> np.ndarray:
    """The runs among stretches of all lags, by start, then period: of stretches in one place the smallest period's."""
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _row(words: list[bytes], found: np.ndarray) -> tuple[list[dict], str]:
    runs = runs_of(found)
    if len(runs):
        words = [w for w, k in zip(words, kept(len(words), runs), strict=True) if k]
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], b" ".join(words).decode("utf-8", "surrogatepass")


def _long(words: int) -> bool:
    return last_lag(words) > LAGS


def _found(docs: DataFrame) -> DataFrame:
    """key, found of each different long text in the columns key, text: its stretches at all lags."""

    def ranges(batches):
        for b in pieces(batches, 16):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _bytes(text).split()
                if _long(len(words)):
                    ids = word_numbers(words)
                    for low in range(1, last_lag(len(ids)) + 1, LAGS):
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([low], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["key", "low", "ids"])

    def scan(batches):
        for b in pieces(batches, 16):
            for key, low, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = stretches(np.frombuffer(ids, np.int32), low, low + LAGS)
                columns = [pa.array([key] * len(found), pa.string()), *(pa.array(found[:, k], pa.int64()) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "length", "period"])

    parts = docs.mapInArrow(ranges, "key string, low long, ids binary").repartition("key", "low")
    places = parts.mapInArrow(scan, f"key string, {RUN}")
    # A text that stands in several rows gives each stretch several times.
    return places.groupBy("key").agg(F.collect_set(F.struct("start", "length", "period")).alias("found"))


def _described(docs: DataFrame, text: str, names: tuple[str, str, str]) -> DataFrame:
    """All columns of docs and, in columns of these names, the number of words, the runs, and the text without them."""
    n_words, runs, rest = names
    out = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(runs, T.ArrayType(T._parse_datatype_string(RUN))), T.StructField(rest, T.StringType())])
    at = docs.columns.index(text)
    width = len(docs.columns)
    types = T.StructType(out.fields[width:])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = [f.type for f in to_arrow_schema(types)]

    def result(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        new = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), arrow, strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns[:width], *new], out.names)

    def here(batches):
        for b in pieces(batches, 256):
            rows, stay = [], []
            for k, value in enumerate(b.column(at).to_pylist()):
                words = _bytes(value).split()
                if not _long(len(words)):
                    stay.append(k)
                    rows.append((len(words), *_row(words, stretches(word_numbers(words), 1, len(words)))))
            if rows:
                yield result(b.take(pa.array(stay)), rows)

    def gathered(batches):
        for b in pieces(batches, 16):
            rows, stay = [], []
            for k, (value, found) in enumerate(zip(b.column(at).to_pylist(), b.column(width).to_pylist(), strict=True)):
                words = _bytes(value).split()
                if _long(len(words)):
                    stay.append(k)
                    rows.append((len(words), *_row(words, np.array([[f["start"], f["length"], f["period"]] for f in found or []], np.int64).reshape(-1, 3))))
            if rows:
                yield result(b.take(pa.array(stay)), rows)

    # A word and the space before it take two bytes at least, so shorter texts have few lags.
    key, found = free_name(docs.columns, "key"), free_name(docs.columns, "found")
    wide = docs.where(F.octet_length(F.col(f"`{text}`")) > 2 * EXPONENT * LAGS).withColumn(key, F.sha2(F.col(f"`{text}`"), 256))
    places = _found(wide.select(F.col(key).alias("key"), F.col(f"`{text}`").alias("text"))).withColumnsRenamed({"key": key, "found": found})
    far = wide.join(places, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)
    return docs.mapInArrow(here, out).unionAll(far.mapInArrow(gathered, out))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and collapsed of every row.

    collapsed: the words that no run contains after its first period, joined by one space.
    Other columns of docs are left out.
    """
    return _described(docs.select("doc_id", F.col("text").cast("string")), "text", ("n_words", "runs", "collapsed")).drop("text")


def collapsed(docs: DataFrame) -> DataFrame:
    """Every row and column of docs, text with each run cut to its first period (words joined by one space) where it has a run."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = tuple(free_name(docs.columns, c) for c in ("n_words", "runs", "collapsed"))
    text = F.when(F.size(F.col(f"`{names[1]}`")) > 0, F.col(f"`{names[2]}`")).otherwise(F.col("text"))
    return _described(docs, "text", names).withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def altered(docs: DataFrame) -> DataFrame:
    """doc_id, text: what the contract makes of documents; one text in ten becomes periodic from some word on."""

    def run(batches):
        for b in pieces(batches, 256):
            texts = b.column(1).to_pylist()
            for k, doc_id in enumerate(b.column(0).to_pylist()):
                h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
                words = _bytes(texts[k]).split() if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    tail = words[a : a + p] * (1 + (n - a) // p)
                    texts[k] = b" ".join(words[:a] + tail[: n - a]).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of every row."""
    df = periodic_runs(altered(docs)).withColumn("n_runs", F.size("runs").cast("long"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    df = df.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    df = df.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"), lines.alias("lines"), "collapsed")
    return df.select(
        *["doc_id", "n_runs", "start", "length", "period"],
        F.expr("(1000 * length) DIV period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
