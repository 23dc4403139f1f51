"""Byte-level substring dedup with suffix arrays: strings of 100 bytes that occur earlier.

Every text is its UTF-8 bytes.  A byte goes if some string of 100 bytes over it also
starts earlier: in a smaller document, or in the same document before it.  Strings
are judged on the input.  No string crosses documents.

All suffixes of a corpus can't be sorted in one place, so equal strings are first
brought together.  Of the 61 substrings of 40 bytes in a string, the one with the
least hash is its anchor; equal strings have equal anchors at equal places.
Neighbouring strings with one anchor are a segment.

1. Tasks send the segments' hashes to buckets of anchors.  Equal segments are settled
   there: all but the first are later ones.  Anchors with one segment are done.
2. Anchors with several different segments get the bytes of each one's first.  The
   segments of a bucket are joined into texts of bounded size, in which an anchor's
   bytes, equal for all its segments, are one letter; `suffix_array` sorts each text,
   and neighbours in its order that share a whole string are one string's occurrences.
3. Later occurrences meet the documents again, which give the remaining bytes.

What goes to a suffix array is one of each different segment: its copies are the same
suffixes again and need no order.  An anchor with more different segments than a text
to sort has room for (HOT, counted over all tasks; or `hot_from` in one task's rows) is
hot: its strings are anchors of their own, each in the bucket that its two 64-bit
hashes give, where a task sends one row of a string at most.  A group of equal strings
needs no order either.  So no task gets a frequent passage's surroundings, however many
tasks see few of them each.

Documents that share a doc_id are told apart by a hash of their texts, in that order;
fully equal rows count as one document.  A null doc_id comes first.  A null text is
empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import byte_values, column_bytes, merge_intervals, mix, pieces, prefix, slices, sliding_min, span_hash
from .common import bucket_count, text_bytes
from .repeats import doc_buckets, ids, packed, placed, split_later, text_hashes, texts_and_ids, unpacked, unplaced
from .suffixarray import suffix_array

WIDTH, ANCHOR = 100, 40
#: Segments that a task holds before it sends them, and the bytes of text that these are of, about.
FLUSH, FLUSH_BYTES = 250_000, 8 << 20
#: Letters of one text to sort, about; different segments of an anchor, in one task's rows and in all, beyond which it is hot.
TEXT, HOT_ONCE, HOT = 24_000, 64, 160
#: Rows of one anchor that a bucket gets at most, about.
ANCHOR_ROWS = 1 << 21

# Kinds of rows on the way: segments' hashes, hot anchors, later occurrences, wanted segments, segments' bytes, single strings.
SEGMENT, MARK, LATER, WANTED, BYTES, STRING = range(6)
_MOVED = "bucket int, kind int, n int, data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])

def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ARROW)], schema=_ARROW)


def _deal(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)] if len(bucket) else [0]
    return [(int(bucket[a]), kind, b - a, packed(*(c[a:b] for c in columns))) for a, b in zip(cuts, cuts[1:], strict=False)]


def _gather(group: pa.Table, kind: int, types) -> list[np.ndarray]:
    mine = [(d, n) for k, d, n in zip(group["kind"].to_pylist(), group["data"], group["n"].to_pylist(), strict=True) if k == kind]
    parts = [unpacked(d.as_py(), n, len(types)) for d, n in mine]
    return [np.concatenate([p[i].astype(t) for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]


def anchor_buckets(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(anchor) % np.uint64(buckets)).astype(np.int32)


def segments(data: np.ndarray, offsets: np.ndarray):
    """Anchor, content hash, row, start, strings and place of the anchor of each segment."""
    n = len(data)
    if n < WIDTH:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z
    sums = prefix(byte_values(data), 0)
    at = np.arange(n - ANCHOR + 1)
    shingle = span_hash(sums, at, at + ANCHOR, 0)
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    place = (sliding_min((shingle & ~low) | at.astype(np.uint64), WIDTH - ANCHOR + 1) & low).astype(np.int64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    start = np.flatnonzero(row[: n - WIDTH + 1] == row[WIDTH - 1 :])
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, place = start[first], place[first]
    content = span_hash(sums, begin, begin + count + WIDTH - 1, 0)
    content = mix(content ^ mix((place - begin).astype(np.uint64)))
    return shingle[place], content, row[begin], begin - offsets[row[begin]], count, place - begin


def strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each string of the rows, its row and its place in it."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.flatnonzero(row[: max(0, len(data) - WIDTH + 1)] == row[WIDTH - 1 :]) if len(data) >= WIDTH else np.zeros(0, np.int64)
    values = byte_values(data)
    return span_hash(prefix(values, 0), start, start + WIDTH, 0), span_hash(prefix(values, 1), start, start + WIDTH, 1), row[start], start - offsets[row[start]]


def _first_of_equal(anchor, content, doc, tie, at):
    """Order of rows by anchor and content, the first document's first; whether each is its group's first, and whether it is a later one."""
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    many = np.zeros(len(order), bool)
    many[:-1] |= ~new[1:]
    many |= ~new
    some = np.flatnonzero(many)  # only what is there several times needs its documents' order
    if len(some):
        part = order[some]
        group = (np.cumsum(new) - 1)[some]
        order[some] = part[np.lexsort((at[part], tie[part], doc[part], group))]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = order[head]
    later = ~new & ((doc[order] != doc[first]) | (tie[order] != tie[first]) | (at[order] != at[first]))
    return order, new, later


def _cut(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of data, one after another, and their offsets."""
    off = np.concatenate(([0], np.cumsum(lengths)))
    return data[np.repeat(starts - off[:-1], lengths) + np.arange(off[-1])], off


def _as_strings(data, off, doc, tie, at, buckets) -> list[tuple]:
    """Rows for single strings: a task's firsts to buckets of strings, its later ones to buckets of documents."""
    k1, k2, row, place = strings(data, off)
    firsts, later = split_later(k1, k2, doc[row], tie[row], at[row] + place)
    rows = _deal(STRING, (firsts[0] % np.uint64(buckets)).astype(np.int32), *firsts)
    return rows + _deal(LATER, -1 - doc_buckets(later[0], buckets), *later, np.full(len(later[0]), WIDTH))


def hot_once(total_bytes: int) -> int:
    """Different segments of an anchor in one task's rows beyond which it is hot: fewer if there are many tasks' rows."""
    return max(1, min(HOT_ONCE, ANCHOR_ROWS // (1 + total_bytes // FLUSH_BYTES)))


def sent_segments(docs: DataFrame, buckets: int, hot_from: int) -> DataFrame:
    """Step 1's rows. Buckets below zero are buckets of documents."""

    def run(batches):
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        size = room = 0

        def flush() -> pa.RecordBatch:
            anchor, content, doc, tie, at, count, place, begin = (np.concatenate([h[i] for h in held]) for i in range(8))
            order, new, later = _first_of_equal(anchor, content, doc, tie, at)
            gone = order[later]
            rows = _deal(LATER, -1 - doc_buckets(doc[gone], buckets), doc[gone], tie[gone], at[gone], count[gone] + WIDTH - 1)
            keep = order[~later]
            a = anchor[keep]
            differ = np.append(True, a[1:] != a[:-1])
            group = np.cumsum(differ) - 1
            hot = np.bincount(group)[group] > hot_from
            if hot.any():
                h = keep[hot]
                data = np.concatenate(texts)
                rows += _as_strings(*_cut(data, begin[h], count[h] + WIDTH - 1), doc[h], tie[h], at[h], buckets)
                marks = np.unique(anchor[h])
                rows += _deal(MARK, anchor_buckets(marks, buckets), marks)
            k = keep[~hot]
            rows += _deal(SEGMENT, anchor_buckets(anchor[k], buckets), anchor[k], content[k], doc[k], tie[k], at[k], count[k])
            return _rows(rows)

        for b in pieces(batches, 4096):
            doc = ids(b.column(0))
            data, off = column_bytes(b.column(1))
            for lo, hi in slices(off):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                anchor, content, row, at, count, place = segments(part, o)
                if len(anchor):
                    held.append((anchor, content, doc[lo:hi][row], text_hashes(part, o)[row], at, count, place, o[row] + at + room))
                    texts.append(part)
                    size, room = size + len(anchor), room + len(part)
                if size >= FLUSH:
                    yield flush()
                    held, texts, size, room = [], [], 0, 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _MOVED)


_SEGMENT_TYPES = (np.uint64, np.uint64, np.int64, np.uint32, np.int64, np.int64)


def settled_segments(sent: DataFrame, buckets: int, hot_in_all: int = HOT) -> DataFrame:
    """Step 1's end: later segments, and the segments whose bytes are wanted, by bucket of documents."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            return group
        anchor, content, doc, tie, at, count = _gather(group, SEGMENT, _SEGMENT_TYPES)
        (marks,) = _gather(group, MARK, (np.uint64,))
        order, new, later = _first_of_equal(anchor, content, doc, tie, at)
        gone = order[later]
        rows = _deal(LATER, -1 - doc_buckets(doc[gone], buckets), doc[gone], tie[gone], at[gone], count[gone] + WIDTH - 1)
        keep = order[~later]
        a = anchor[keep]
        hot = np.isin(a, marks)
        if len(a):
            g = np.cumsum(np.append(True, a[1:] != a[:-1])) - 1
            distinct = np.bincount(g, weights=new[~later])[g]  # equal rows of one document aren't different segments
            hot |= distinct > hot_in_all
            want = hot | (distinct > 1)
            k = keep[want]
            rows += _deal(WANTED, -1 - doc_buckets(doc[k], buckets), doc[k], tie[k], at[k], count[k], anchor[k], hot[want].astype(np.uint8))
        rows += [(bucket, STRING, n, d) for kind, n, d in zip(group["kind"].to_pylist(), group["n"].to_pylist(), group["data"].to_pylist(), strict=True) if kind == STRING]
        return pa.Table.from_batches([_rows(rows)])

    return sent.groupBy("bucket").applyInArrow(run, _MOVED)


def wanted_bytes(texts: DataFrame, settled: DataFrame, buckets: int) -> DataFrame:
    """Step 2's rows: from `placed` documents the wanted segments' bytes, to buckets of anchors, and hot anchors' strings.

    Later segments and strings of step 1 pass through, so that step 1 is read once.
    """

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        doc, tie, at, count, anchor, hot = _gather(theirs, WANTED, (np.int64, np.uint32, np.int64, np.int64, np.uint64, np.uint8))
        # What else came this way goes on: later segments to the documents, strings to their buckets.
        rows = [(-1 - b if kind == LATER else b, kind, n, d.as_py()) for b, kind, n, d in zip(theirs["_bucket"].to_pylist(), theirs["kind"].to_pylist(), theirs["n"].to_pylist(), theirs["data"], strict=True) if kind != WANTED]
        if not len(doc) or mine.num_rows == 0:
            return pa.Table.from_batches([_rows(rows)])
        mine = unplaced(mine)
        unpacker = zstandard.ZstdDecompressor()
        raw = [b"" if z.as_py() is None else unpacker.decompress(z.as_py()) for z in mine["text"]]
        off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        data = np.frombuffer(b"".join(raw), np.uint8)
        where = {(int(i), int(t)): k for k, (i, t) in enumerate(zip(ids(mine["doc_id"]), text_hashes(data, off), strict=True))}
        row = np.array([where[int(i), int(t)] for i, t in zip(doc, tie, strict=True)])
        place = _anchor_places(data, off, row, at, count, anchor)
        begin, length = off[row] + at, count + WIDTH - 1
        h = hot.astype(bool)
        if h.any():
            rows += _as_strings(*_cut(data, begin[h], length[h]), doc[h], tie[h], at[h], buckets)
        k = np.flatnonzero(~h)
        if len(k):
            b = anchor_buckets(anchor[k], buckets)
            k, b = k[np.argsort(b, kind="stable")], np.sort(b, kind="stable")
            cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])).tolist() + [len(b)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                s = k[x:y]
                rows.append((int(b[x]), BYTES, y - x, packed(anchor[s], doc[s], tie[s], at[s], count[s], place[s]) + _cut(data, begin[s], length[s])[0].tobytes()))
        return pa.Table.from_batches([_rows(rows)])

    theirs = settled.select(F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")).alias("_bucket"), "kind", "n", "data")
    return texts.groupBy("_bucket").cogroup(theirs.groupBy("_bucket")).applyInArrow(run, _MOVED)


def _anchor_places(data, off, row, at, count, anchor) -> np.ndarray:
    """Where in each segment its anchor is: the substring of 40 bytes that all its strings hold and whose hash it is."""
    lengths = count + WIDTH - 1
    part, o = _cut(data, off[row] + at, lengths)
    sums = prefix(byte_values(part), 0)
    # It begins not before the last string and ends not after the first.
    tries = WIDTH - ANCHOR - count + 2
    base = np.repeat(o[:-1] + count - 1, tries)
    to = np.concatenate(([0], np.cumsum(tries)))
    start = base + np.arange(to[-1]) - np.repeat(to[:-1], tries)
    same = span_hash(sums, start, start + ANCHOR, 0) == np.repeat(anchor, tries)
    hit = np.flatnonzero(same)
    first = hit[np.searchsorted(hit, to[:-1])]
    return start[first] - o[:-1]


def sorted_later(anchor, doc, tie, at, count, place, data) -> tuple[np.ndarray, ...]:
    """doc, tie, at of strings of different segments of equal anchors that start later than an equal one, by suffix arrays."""
    off = np.concatenate(([0], np.cumsum(count + WIDTH - 1)))
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    new = np.append(True, a[1:] != a[:-1])
    size = count[order] + WIDTH - ANCHOR + 1  # letters of a segment: its bytes, the anchor's as one, and an end
    reach = np.cumsum(size)
    # A text is some anchors' segments; one anchor is never divided, as it has HOT of them at most.
    heads = np.flatnonzero(new)
    start = 0
    cuts = [0]
    ends = np.append(reach[heads[1:] - 1], reach[-1])
    for k, e in enumerate(ends.tolist()):
        if e - start >= TEXT:
            start = e
            cuts.append(int(heads[k + 1]) if k + 1 < len(heads) else len(order))
    if cuts[-1] != len(order):
        cuts.append(len(order))
    found: list[tuple[np.ndarray, ...]] = []
    group = np.cumsum(new) - 1
    inside = WIDTH - ANCHOR + 1  # letters of a string
    for x, y in zip(cuts, cuts[1:], strict=False):
        rows = order[x:y]
        n = count[rows] + WIDTH - ANCHOR + 1
        o = np.concatenate(([0], np.cumsum(n)))
        letters = np.zeros(o[-1], np.int32)  # 0: a segment's end
        where = np.arange(o[-1]) - np.repeat(o[:-1], n)
        p, last = np.repeat(place[rows], n), np.repeat(n, n) - 1
        source = np.repeat(off[rows], n) + where + np.where(where > p, ANCHOR - 1, 0)
        body = where < last
        letters[body] = data[source[body]].astype(np.int32) + 1
        one = where == p
        letters[one] = 257 + (group[x:y] - group[x])
        sa = suffix_array(letters)
        starts = np.repeat(count[rows], n) > where  # places at which a string starts
        s = sa[starts[sa]]
        if len(s) < 2:
            continue
        both = letters[s[1:, None] + np.arange(inside)] == letters[s[:-1, None] + np.arange(inside)]
        equal = both.all(axis=1)
        string = np.concatenate(([0], np.cumsum(~equal)))
        owner = np.repeat(np.arange(len(rows)), n)[s]
        d, t, q = doc[rows][owner], tie[rows][owner], at[rows][owner] + where[s]
        many = np.append(equal, False) | np.append(False, equal)
        string, d, t, q = string[many], d[many], t[many], q[many]
        by = np.lexsort((q, t, d, string))
        string, d, t, q = string[by], d[by], t[by], q[by]
        if len(string):
            first = np.append(True, string[1:] != string[:-1])
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = ~first & ((d != d[head]) | (t != t[head]) | (q != q[head]))
            found.append((d[later], t[later], q[later]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _runs(doc, tie, at) -> tuple[np.ndarray, ...]:
    """Neighbouring later strings as one longer stretch of bytes each."""
    by = np.lexsort((at, tie, doc))
    doc, tie, at = doc[by], tie[by], at[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > at[:-1] + WIDTH)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1) if len(doc) else np.zeros(0, np.int64)
    return doc[new], tie[new], at[new], at[last] + WIDTH - at[new]


def sorted_segments(rows: DataFrame, buckets: int) -> DataFrame:
    """Step 2's end: later strings by bucket of documents."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return group
        out = []
        cols, raw = [], []
        for kind, n, d in zip(group["kind"].to_pylist(), group["n"].to_pylist(), group["data"], strict=True):
            if kind == BYTES:
                d = d.as_py()
                got = unpacked(d, n, 6)
                length = int((got[4].astype(np.int64) + WIDTH - 1).sum())
                cols.append(got)
                raw.append(np.frombuffer(d, np.uint8, length, len(d) - length))
        if cols:
            anchor, doc, tie, at, count, place = (np.concatenate([c[i].astype(t) for c in cols]) for i, t in enumerate((np.uint64, np.int64, np.uint32, np.int64, np.int64, np.int64)))
            doc, tie, at, length = _runs(*sorted_later(anchor, doc, tie, at, count, place, np.concatenate(raw)))
            out += _deal(LATER, -1 - doc_buckets(doc, buckets), doc, tie, at, length)
        single = _gather(group, STRING, (np.uint64, np.uint64, np.int64, np.uint32, np.int64))
        if len(single[0]):
            _, later = split_later(*single)
            doc, tie, at, length = _runs(*later)
            out += _deal(LATER, -1 - doc_buckets(doc, buckets), doc, tie, at, length)
        return pa.Table.from_batches([_rows(out)])

    return rows.groupBy("bucket").applyInArrow(run, _MOVED)


def covered(docs: DataFrame, total_bytes: int, result, schema: T.StructType, hot_from: int | None = None, hot_in_all: int = HOT) -> DataFrame:
    """result(rows, texts, runs) for each bucket of documents, with each row's runs of removed bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    buckets = bucket_count(total_bytes)
    plain = texts_and_ids(docs)
    settled = settled_segments(sent_segments(plain, buckets, hot_once(total_bytes) if hot_from is None else hot_from), buckets, hot_in_all)
    moved = placed(docs, buckets)
    later = sorted_segments(wanted_bytes(moved, settled, buckets), buckets)
    empty = to_arrow_schema(schema).empty_table()

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if mine.num_rows == 0:
            return empty
        mine = unplaced(mine)
        unpacker = zstandard.ZstdDecompressor()
        texts = [None if z.as_py() is None else unpacker.decompress(z.as_py()) for z in mine["text"]]
        doc, tie, at, length = _gather(theirs, LATER, (np.int64, np.uint32, np.int64, np.int64))
        order = np.lexsort((at, tie, doc))
        doc, tie, at, length = doc[order], tie[order], at[order], length[order]
        cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))).tolist() + [len(doc)] if len(doc) else [0]
        runs = {(int(doc[a]), int(tie[a])): merge_intervals(at[a:b], at[a:b] + length[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)}
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        mine_runs = [runs.get((int(i), xxhash.xxh32_intdigest(t or b"")), none) for i, t in zip(ids(mine["doc_id"]), texts, strict=True)]
        return result(mine.drop_columns(["text"]), texts, mine_runs)

    theirs = later.select((-1 - F.col("bucket")).alias("_bucket"), "kind", "n", "data")
    return moved.groupBy("_bucket").cogroup(theirs.groupBy("_bucket")).applyInArrow(run, schema)


def remaining(text: bytes, runs: tuple[np.ndarray, np.ndarray]) -> bytes:
    out, at = [], 0
    for a, b in zip(*(r.tolist() for r in runs), strict=True):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


_DIGEST = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)


def digests(docs: DataFrame, hot_from: int | None = None, hot_in_all: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row.

    hot_from, hot_in_all: different segments of an anchor beyond which it is hot; they don't change the result.
    """
    docs = texts_and_ids(docs)

    def result(rows: pa.Table, texts, runs) -> pa.Table:
        cols = [[len(t or b"") for t in texts], [int((r[1] - r[0]).sum()) for r in runs], [len(r[0]) for r in runs], [hashlib.sha256(remaining(t or b"", r)).hexdigest() for t, r in zip(texts, runs, strict=True)]]
        return pa.table([rows["doc_id"], *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=_DIGEST.names)

    return covered(docs, text_bytes(docs), result, _DIGEST, hot_from, hot_in_all)


def deduped(docs: DataFrame) -> DataFrame:
    """Every row and column of docs, removed bytes taken out of text; a character cut in two loses its rest."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = docs.schema

    def result(rows: pa.Table, texts, runs) -> pa.Table:
        column = pa.array([None if t is None else remaining(t, r).decode("utf-8", "ignore") for t, r in zip(texts, runs, strict=True)], pa.string())
        return pa.table([column if name == "text" else rows[name] for name in schema.names], names=schema.names)

    return covered(docs, text_bytes(docs), result, schema)
