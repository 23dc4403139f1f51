"""Context-triggered piecewise hashing: fingerprints of whole texts, and how alike two of them are.

A rolling hash of the last seven bytes ends a chunk wherever it is -1 modulo the
block size, so chunk borders follow the content.  Each chunk gives one letter of
64.  A fingerprint holds the letters at a block size and at twice that size;
two fingerprints are compared, by edit distance, where their block sizes meet.

A null text is an empty text; its fingerprint is `3::`, like itself only.
Equal texts have equal fingerprints.  Whole texts are read, however long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import byte_values, column_bytes, pieces, prefix, slices, span_hash
from .common import batch, bucket_count, text_bytes

#: Letters that a fingerprint's first half has at most, its smallest block size, the rolling hash's bytes.
LETTERS, LEAST_BLOCK, ROLLING = 64, 3, 7
#: Quantiles of the document ids that ranges of neighbours are cut at, at most.
QUANTILES = 16_384
#: Ranges whose neighbours are found together; there is one row for so many ranges where all must meet.
TOGETHER = 4096
#: Ranges of neighbours up to which their ends are broadcast (16 bytes each).
SMALL_RANGES = 100_000

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte; it starts anew with each row."""
    n = len(data)
    place = np.arange(n, dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), np.diff(offsets))
    value = data.astype(np.uint32)
    total, weighted, shifted = value.copy(), value * np.uint32(ROLLING), value.copy()
    for j in range(1, min(ROLLING, n)):
        back = np.zeros(n, np.uint32)
        back[j:] = value[:-j]
        back[place < j] = 0
        total += back
        weighted += back * np.uint32(ROLLING - j)
        shifted ^= back << np.uint32(5 * j)
    return total + weighted + shifted


def _letters(sums: np.ndarray, start: int, end: int, borders: np.ndarray) -> str:
    cuts = borders[: LETTERS - 1] + 1
    if start < end and (len(cuts) == 0 or cuts[-1] < end):
        cuts = np.append(cuts, end)
    if len(cuts) == 0:
        return ""
    firsts = np.concatenate(([start], cuts[:-1]))
    return _ALPHABET[(span_hash(sums, firsts, cuts, 0) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprints(column: pa.Array) -> list[str]:
    """The fingerprint of each text of a column."""
    out: list[str] = []
    data, offsets = column_bytes(column)
    for lo, hi in slices(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        roll, sums = rolling(part, off), prefix(byte_values(part), 0)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            block = LEAST_BLOCK
            while block * LETTERS < b - a:
                block *= 2
            own = roll[a:b]
            while True:
                ends = np.flatnonzero(own % np.uint32(block) == block - 1)
                if len(ends) >= LETTERS // 2 or block == LEAST_BLOCK:
                    break
                block //= 2
            wide = ends[own[ends] % np.uint32(2 * block) == 2 * block - 1]
            out.append(f"{block}:{_letters(sums, a, b, ends + a)}:{_letters(sums, a, b, wide + a)}")
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; the shorter string's column is one integer's bits."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = every, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        same = (((eq & plus) + plus) ^ plus) | eq | minus
        right, left = minus | ~(same | plus) & every, plus & same
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1 | 1) & every
        plus, minus = left << 1 & every | ~(same | right) & every, same & right
    return score


def likeness(one: str, other: str) -> float:
    """0 to 1: one less the edit distance by the longer length, the best of the block sizes that meet; 0 if none do."""
    if one == other:
        return 1.0
    (b1, x1, y1), (b2, x2, y2) = one.split(":"), other.split(":")
    n1, n2 = int(b1), int(b2)
    pairs = [(x1, x2), (y1, y2)] if n1 == n2 else [(x1, y2)] if n1 == 2 * n2 else [(y1, x2)] if n2 == 2 * n1 else []
    return max((1 - edit_distance(a, b) / max(len(a), len(b)) for a, b in pairs if a or b), default=0.0)


def fingerprinted(df: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Every row and column of df with its text's fingerprint; a column of that name is replaced."""
    from pyspark.sql import types as T

    keep = df.drop(column).withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for b in pieces(batches):
            found = fingerprints(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, column])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField(column, T.StringType())]))


_MOVED = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("own", pa.bool_()), ("z", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _ranges(spark: SparkSession, docs: DataFrame):
    """A function from document ids to ranges in their order, small ones whatever the ids are like."""
    buckets = bucket_count(text_bytes(docs))
    quantiles = min(buckets, QUANTILES)
    cuts = docs.approxQuantile("doc_id", [i / quantiles for i in range(quantiles + 1)], 0.25 / quantiles)
    edges = np.unique(np.array(cuts, np.float64)).astype(np.int64)
    parts = -(-buckets // quantiles)

    def bucket(ids: np.ndarray) -> np.ndarray:
        if len(edges) < 2:
            return np.zeros(len(ids), np.int64)
        k = np.clip(np.searchsorted(edges, ids, "right") - 1, 0, len(edges) - 2)
        width = np.maximum(1, -(-(edges[k + 1] - edges[k]) // parts))
        return k * parts + np.clip((np.maximum(ids, edges[k]) - edges[k]) // width, 0, parts - 1)

    return bucket


def _next_tops(tops: DataFrame) -> DataFrame:
    """For each range (bucket, top), as `to`, the top of the range before it; for the first one, the last one's.

    Ranges look among some thousand of their own; only one row for each such lot goes to a single task.
    """
    tops = tops.withColumn("lot", F.floor(F.col("bucket") / TOGETHER))
    lots = tops.groupBy("lot").agg(F.max_by("top", "bucket").alias("last"))
    before = lots.select("lot", F.lag("last").over(Window.orderBy("lot")).alias("before"), F.max("last").over(Window.partitionBy()).alias("end"))
    near = tops.select("lot", F.col("bucket").alias("to"), F.lag("top").over(Window.partitionBy("lot").orderBy("bucket")).alias("near"))
    return near.join(before, "lot").select("to", F.coalesce("near", "before", "end").alias("next_top"))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)


def against_next(df: DataFrame) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's.

    The next document has the next smaller doc_id; after the smallest comes the
    largest.  Rows of one doc_id come in order of their texts, a null doc_id last.
    The edited text's last half (rounded down) is the next text's beginning.  A
    sole document is its own next one; an empty table gives no rows.

    Documents move once, compressed, to ranges of neighbouring ids; each range also
    gets the one document that follows it.
    """
    spark = df.sparkSession
    docs = df.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    bucket = _ranges(spark, docs)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket(_ids(b.column(0)))), b.column(0)], ["bucket", "doc_id"])

    tops = docs.select("doc_id").mapInArrow(place, "bucket long, doc_id long").groupBy("bucket").agg(F.max("doc_id").alias("top"))
    ends = _next_tops(tops)
    n = ends.count()
    ends = F.broadcast(ends) if n <= SMALL_RANGES else ends

    def squeeze(own: bool):
        def run(batches):
            packer = zstandard.ZstdCompressor(level=1)
            for b in pieces(batches):
                z = [packer.compress((t or "").encode()) for t in b.column(1).to_pylist()]
                to = pa.array(bucket(_ids(b.column(0)))) if own else b.column(2)
                yield batch(_MOVED, to, b.column(0), np.full(len(z), own), z)

        return run

    schema = "bucket long, doc_id long, own boolean, z binary"
    mine = docs.mapInArrow(squeeze(True), schema)
    theirs = docs.join(ends, docs.doc_id.eqNullSafe(ends.next_top)).select("doc_id", "text", "to").mapInArrow(squeeze(False), schema)

    def run(group: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        least = np.iinfo(np.int64).min
        rows = [(least if i is None else i, own, unpacker.decompress(z).decode()) for i, own, z in zip(group["doc_id"].to_pylist(), group["own"].to_pylist(), group["z"].to_pylist(), strict=True)]
        own = sorted((r for r in rows if r[1]), key=lambda r: (-r[0], r[2]))
        after = sorted((r for r in rows if not r[1]), key=lambda r: (-r[0], r[2]))
        del rows, group
        texts = [r[2] for r in own] + [(after or own)[0][2]]
        plain = fingerprints(pa.array(texts, pa.large_string()))
        changed, digests = [], []
        for at in range(0, len(own), 256):  # edited texts live a few at a time
            some = texts[at : at + 257]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(some[:256], some[1:], strict=False)]
            changed += fingerprints(pa.array(edited, pa.large_string()))
            digests += [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        return pa.Table.from_batches(
            [
                batch(
                    _RESULT,
                    [None if r[0] == least else r[0] for r in own],
                    [len(t) for t in texts[:-1]],
                    digests,
                    plain[:-1],
                    changed,
                    [likeness(a, b) for a, b in zip(plain, changed, strict=False)],
                    [likeness(a, b) for a, b in zip(plain, plain[1:], strict=False)],
                )
            ]
        )

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mine.unionAll(theirs).groupBy("bucket").applyInArrow(run, out)
