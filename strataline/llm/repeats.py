"""Later occurrences of windows of symbols, over all documents.

A window is `width` consecutive symbols (words, lines) of one document.  A window is
a later occurrence if an equal one starts earlier: in a smaller document, or in the
same document before it.  What is found are the symbols that later occurrences cover.

How rows move:

* each task reads its documents, keeps the first of equal windows that it has seen,
  and knows at once that its others are later ones;
* its firsts go, packed, to hash buckets of the windows, at most one row of a window
  from a task's flush, so that no window is hot however often it occurs;
* each bucket finds the firsts of all, and sends the others to buckets of documents;
* there they meet the documents' texts, which move once, compressed.

Documents that share a doc_id are told apart by a hash of their texts, in that
order; fully equal rows count as one document, which gets its result as often as it
is there.  A null doc_id comes first.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import column_bytes, mix, pieces, prefix, slices, span_hash

#: Windows that a task holds before it sends them.
FLUSH = 1_000_000
NO_ID = np.iinfo(np.int64).min

_MOVED = "bucket int, n int, data binary"
_MOVED_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def ids(column: pa.Array) -> np.ndarray:
    """doc_ids as int64; a null is the smallest of all."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([xxhash.xxh32_intdigest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint32)


def doc_buckets(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _small(a: np.ndarray) -> bytes:
    """An array's width and bytes; unsigned values in the narrowest type that holds them."""
    if a.dtype.kind != "u" and len(a) and a.min() >= 0:
        a = a.astype(np.min_scalar_type(int(a.max())))
    return a.dtype.str.encode().ljust(4) + a.tobytes()


def packed(*columns: np.ndarray) -> bytes:
    return b"".join(map(_small, columns))


def unpacked(data: bytes, n: int, count: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(count):
        kind = np.dtype(data[at : at + 4].decode().strip())
        out.append(np.frombuffer(data, kind, n, at + 4))
        at += 4 + n * kind.itemsize
    return out


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed row for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket)) if len(bucket) else [], strict=True):
        yield int(bucket[a]), int(b - a), packed(*(c[a:b] for c in columns))


def moved(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_MOVED_ARROW)], schema=_MOVED_ARROW)


def gathered(group: pa.Table, count: int) -> list[np.ndarray]:
    parts = [unpacked(d, n, count) for d, n in zip(group["data"].to_pylist(), group["n"].to_pylist(), strict=True)]
    # Windows come with two hashes, later windows without.
    wide = [np.uint64, np.uint64, np.int64, np.uint32, np.int64][5 - count :]
    return [np.concatenate([p[i].astype(w) for p in parts]) for i, w in enumerate(wide)]


def split_later(k1, k2, doc, tie, pos) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The firsts of equal windows, and (doc, tie, pos) of those that start later than their first."""
    order = np.lexsort((pos, tie, doc, k2, k1))
    k1, k2, doc, tie, pos = (a[order] for a in (k1, k2, doc, tie, pos))
    first = np.ones(len(k1), bool)
    first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = ~first & ((doc != doc[at]) | (tie != tie[at]) | (pos != pos[at]))
    return [a[first] for a in (k1, k2, doc, tie, pos)], [a[later] for a in (doc, tie, pos)]


def window_keys(symbols: np.ndarray, counts: np.ndarray, width: int):
    """Two hashes of each window, its row and its place in the row. symbols: one hash for each symbol."""
    n = len(symbols) - width + 1
    if n <= 0:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(row[:n] == row[width - 1 :])
    k1 = span_hash(prefix(symbols, 0), start, start + width, 0)
    k2 = span_hash(prefix(mix(symbols), 1), start, start + width, 1)
    base = np.cumsum(counts) - counts
    return k1, k2, row[start], start - base[row[start]]


Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def held_rows(held: list[tuple], buckets: int) -> list[tuple]:
    """Rows of the windows that a task holds: firsts to buckets of windows, later ones to -1 less their bucket of documents."""
    firsts, later = split_later(*(np.concatenate([h[i] for h in held]) for i in range(5)))
    rows = list(dealt((firsts[0] % np.uint64(buckets)).astype(np.int32), *firsts))
    return rows + [(-1 - b, n, d) for b, n, d in dealt(doc_buckets(later[0], buckets), *later)]


def settled(sent: DataFrame, buckets: int) -> DataFrame:
    """Packed (doc, tie, pos) of the starts of later windows, by bucket of documents, from what tasks have sent."""

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # later windows of one task, for a bucket of documents
            rows = [(-1 - key[0].as_py(), n, d) for n, d in zip(group["n"].to_pylist(), group["data"].to_pylist(), strict=True)]
            return pa.Table.from_batches([moved(rows)])
        _, later = split_later(*gathered(group, 5))
        return pa.Table.from_batches([moved(dealt(doc_buckets(later[0], buckets), *later))])

    return sent.groupBy("bucket").applyInArrow(settle, _MOVED)


def later_windows(docs: DataFrame, symbols: Symbols, width: int, buckets: int) -> DataFrame:
    """`settled` windows of doc_id and text. symbols: from bytes and offsets, each symbol's hash and the symbols in each row."""

    def read(batches):
        held: list[tuple] = []
        size = 0
        for b in pieces(batches, 4096):
            doc = ids(b.column(0))
            data, off = column_bytes(b.column(1))
            for lo, hi in slices(off):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                k1, k2, row, pos = window_keys(*symbols(part, o), width)
                if len(k1):
                    held.append((k1, k2, doc[lo:hi][row], text_hashes(part, o)[row], pos))
                    size += len(k1)
                if size >= FLUSH:
                    yield moved(held_rows(held, buckets))
                    held, size = [], 0
        if held:
            yield moved(held_rows(held, buckets))

    return settled(docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(read, _MOVED), buckets)


#: In front of the names of a document's own columns on their way.
OWN = "c"


def unplaced(table: pa.Table) -> pa.Table:
    """A bucket's documents under their own names."""
    return table.drop_columns(["_bucket"]).rename_columns([n.removeprefix(OWN) for n in table.column_names if n != "_bucket"])


def placed(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with their texts compressed and the bucket that each goes to.

    Their columns get a letter in front, so that none is called _bucket.
    """
    names = docs.columns
    text, key = names.index("text"), names.index("doc_id")

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in pieces(batches):
            doc = ids(b.column(key))
            null = b.column(text).is_null()
            z = pa.array([None if m else packer.compress(t.encode()) for t, m in zip(b.column(text).to_pylist(), null.to_pylist(), strict=True)], pa.binary())
            cols = [z if i == text else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_buckets(doc, buckets)), *cols], ["_bucket", *(OWN + n for n in names)])

    fields = [T.StructField("_bucket", T.IntegerType())] + [T.StructField(OWN + f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType(fields))


def texts_of(mine: pa.Table) -> list[bytes | None]:
    """The texts of a bucket of documents."""
    unpacker = zstandard.ZstdDecompressor()
    return [None if z.as_py() is None else unpacker.decompress(z.as_py()) for z in mine["text"]]


def with_covered(texts: DataFrame, later: DataFrame, width: int, result, schema: T.StructType) -> DataFrame:
    """result(rows, texts, covers) for each bucket of `placed` documents, where covers has, for each row, merged runs of covered symbols.

    rows: an Arrow table with all columns of docs but text; texts: bytes, None for null.
    """

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if mine.num_rows == 0:
            return schema_arrow.empty_table()
        mine = unplaced(mine)
        texts = texts_of(mine)
        doc = ids(mine["doc_id"])
        covers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if theirs.num_rows:
            d, t, p = gathered(theirs, 3)
            order = np.lexsort((p, t, d))
            d, t, p = d[order], t[order], p[order]
            cuts = np.append(np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))), len(d))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s = p[a:b]
                new = np.append(True, s[1:] > s[:-1] + width)
                last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
                covers[int(d[a]), int(t[a])] = (s[new], s[last] + width)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        runs = [covers.get((int(i), xxhash.xxh32_intdigest(x or b"")), none) for i, x in zip(doc, texts, strict=True)]
        return result(mine.drop_columns(["text"]), texts, runs)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_arrow = to_arrow_schema(schema)
    return texts.groupBy("_bucket").cogroup(later.withColumnRenamed("bucket", "_bucket").groupBy("_bucket")).applyInArrow(run, schema)


def kept(n: int, runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of n symbols no run covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[0], 1)
    np.add.at(change, runs[1], -1)
    return np.cumsum(change[:n]) == 0


def texts_and_ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
