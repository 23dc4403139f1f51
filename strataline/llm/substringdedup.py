"""Substring dedup: windows of twenty words, prefiltered by a count-min sketch, later occurrences removed.

Pass 1.  A window is counted by its anchor: of its shingles of twelve words the one
with the least hash.  Equal windows have equal anchors at equal places, so an
anchor's count is never less than its windows'.  Each bucket of documents counts its
anchors' places in a count-min sketch of two rows; the sketch is as wide as the text
needs and lives in blocks, which are merged each in one group and sent nowhere whole:
each bucket gets back which of its own counters came to two or more.

Pass 2.  Windows whose estimate is two or more are grouped exactly, by two 64-bit
hashes, as `repeats` tells; each word that a later occurrence covers goes.  Windows
are judged on the input, not on what is left.

Words are what ASCII white space separates, unchanged.  A null text has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .bytesops import SPACED, column_bytes, mix, prefix, slices, sliding_min, span_hash, word_hashes, word_spans
from .common import bucket_count, text_bytes

WIDTH, SHINGLE = 20, 12
ROWS = 2
#: Counters of a block. Bytes of text for one anchor, about; counters for one anchor.
BLOCK = 1 << 20
BYTES_AN_ANCHOR, CELLS_AN_ANCHOR = 30, 4


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, counts = word_spans(data, offsets, SPACED)
    return word_hashes(data, start, end), counts


def cells_for(total_bytes: int) -> int:
    """Counters in each row of a sketch, a power of two."""
    want = max(1, CELLS_AN_ANCHOR * total_bytes // BYTES_AN_ANCHOR)
    return max(BLOCK, 1 << (want - 1).bit_length())


def anchors(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's hash, and for each window (in the order of `repeats.window_keys`) the place of its anchor."""
    n = len(symbols) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(symbols) - SHINGLE + 1)
    shingle = span_hash(prefix(symbols, 0), at, at + SHINGLE, 0)
    low = np.uint64((1 << max(24, len(symbols).bit_length())) - 1)
    least = sliding_min((shingle & ~low) | at.astype(np.uint64), WIDTH - SHINGLE + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    return shingle, (least & low).astype(np.int64)[row[:n] == row[WIDTH - 1 :]]


def cell(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA5A5A5A5 * (row + 1))) & np.uint64(cells - 1)).astype(np.int64)


def places(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash at each place that is some window's anchor, each place once."""
    return shingle[at[np.append(True, at[1:] != at[:-1])]] if len(at) else shingle[:0]


def estimated_often(shingle: np.ndarray, at: np.ndarray, often: list[np.ndarray], cells: int) -> np.ndarray:
    """Which windows the sketch estimates twice or more. often: for each row the sorted counters of two or more."""
    if not len(at):
        return np.zeros(0, bool)
    new = np.append(True, at[1:] != at[:-1])
    found = shingle[at[new]]
    hit = np.ones(len(found), bool)
    for r in range(ROWS):
        c = cell(found, r, cells)
        k = np.searchsorted(often[r], c)
        k[k == len(often[r])] = 0
        hit &= (often[r][k] == c) if len(often[r]) else False
    return hit[np.cumsum(new) - 1]


_COUNTS = "block int, bucket int, n int, data binary"
_COUNTS_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def _counts(rows) -> pa.Table:
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_COUNTS_ARROW)], schema=_COUNTS_ARROW)])


def _slices(mine: pa.Table):
    """Slices of a bucket's texts: their first row, bytes and offsets."""
    data, off = column_bytes(pa.array([t or b"" for t in repeats.texts_of(mine)], pa.large_binary()).cast(pa.large_string()))
    for lo, hi in slices(off):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def counted(texts: DataFrame, cells: int) -> DataFrame:
    """Pass 1: for each bucket of `placed` documents and each block, its counters that come to two or more over all."""
    blocks = cells // BLOCK

    def count(key: tuple, mine: pa.Table) -> pa.Table:
        found = [places(*anchors(*word_symbols(part, o))) for _, _, part, o in _slices(repeats.unplaced(mine))]
        found = np.concatenate(found) if found else np.zeros(0, np.uint64)
        rows = []
        for r in range(ROWS):
            c, times = np.unique(cell(found, r, cells), return_counts=True)
            # A counter's place in its block, and whether this bucket alone brings it to two.
            value = ((c & (BLOCK - 1)) << 1 | (times > 1)).astype(np.uint32)
            rows += [(b, key[0].as_py(), n, d) for b, n, d in repeats.dealt((r * blocks + (c >> 20)).astype(np.int32), value)]
        return _counts(rows)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        parts = [repeats.unpacked(d.as_py(), n, 1)[0] for d, n in zip(group["data"], group["n"].to_pylist(), strict=True)]
        twice = np.zeros(BLOCK, np.int64)
        for p in parts:
            twice[p >> 1] += 1 + (p & 1)
        rows = []
        for p, bucket in zip(parts, group["bucket"].to_pylist(), strict=True):
            kept = (p >> 1)[twice[p >> 1] > 1]
            if len(kept):
                rows.append((key[0].as_py(), bucket, len(kept), repeats.packed(kept)))
        return _counts(rows)

    return texts.groupBy("_bucket").applyInArrow(count, _COUNTS).groupBy("block").applyInArrow(merge, _COUNTS)


def later(texts: DataFrame, buckets: int, total_bytes: int) -> DataFrame:
    """Pass 2: `repeats.settled` windows of `placed` documents that the sketch lets through."""
    cells = cells_for(total_bytes)
    blocks = cells // BLOCK

    def read(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = repeats.unplaced(mine)
        often: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for block, n, d in zip(theirs["block"].to_pylist(), theirs["n"].to_pylist(), theirs["data"], strict=True):
            often[block // blocks].append(repeats.unpacked(d.as_py(), n, 1)[0].astype(np.int64) + (block % blocks) * BLOCK)
        known = [np.sort(np.concatenate(o)) if o else np.zeros(0, np.int64) for o in often]
        held = []
        doc = repeats.ids(mine["doc_id"]) if mine.num_rows else np.zeros(0, np.int64)
        for lo, hi, part, o in _slices(mine):
            values, counts = word_symbols(part, o)
            pick = estimated_often(*anchors(values, counts), known, cells)
            if pick.any():
                k1, k2, row, pos = (x[pick] for x in repeats.window_keys(values, counts, WIDTH))
                held.append((k1, k2, doc[lo:hi][row], repeats.text_hashes(part, o)[row], pos))
        return pa.Table.from_batches([repeats.moved(repeats.held_rows(held, buckets) if held else [])])

    flags = counted(texts, cells).withColumnRenamed("bucket", "_bucket")
    sent = texts.groupBy("_bucket").cogroup(flags.groupBy("_bucket")).applyInArrow(read, repeats._MOVED)
    return repeats.settled(sent, buckets)


_DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by spaces) of every row."""
    docs = repeats.texts_and_ids(docs)
    total = text_bytes(docs)
    buckets = bucket_count(total)

    def result(rows: pa.Table, texts, runs) -> pa.Table:
        n, removed, sha = [], [], []
        for text, run in zip(texts, runs, strict=True):
            words = (text or b"").split()
            n.append(len(words))
            if len(run[0]):
                keep = repeats.kept(len(words), run)
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            removed.append(n[-1] - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table([rows["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=_DIGEST.names)

    texts = repeats.placed(docs, buckets)
    return repeats.with_covered(texts, later(texts, buckets, total), WIDTH, result, _DIGEST)


def deduped(docs: DataFrame) -> DataFrame:
    """Every row and column of docs, text being its kept words joined by spaces."""
    total = text_bytes(docs)
    buckets = bucket_count(total)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = docs.schema

    def result(rows: pa.Table, texts, runs) -> pa.Table:
        out = []
        for text, run in zip(texts, runs, strict=True):
            if len(run[0]):
                words = text.split()
                text = b" ".join([w for w, k in zip(words, repeats.kept(len(words), run).tolist(), strict=True) if k])
            out.append(None if text is None else text.decode())
        column = pa.array(out, pa.string())
        return pa.table([column if name == "text" else rows[name] for name in schema.names], names=schema.names)

    texts = repeats.placed(docs, buckets)
    return repeats.with_covered(texts, later(texts, buckets, total), WIDTH, result, schema)


#: The same digests in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + 19], ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS i FROM d WHERE len(l) >= 20)),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE r > 1),
p AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
