"""SimHash near-dedup: fingerprints of word shingles, compared exactly in tiles.

Words are what ASCII white space separates, A-Z lower-cased; a shingle is some words
in a row, joined by spaces (a shorter text is one shingle; no words give fingerprint
zero, linked like any other).  A bit of the fingerprint is 1 if it is 1 in over half
the shingles' hashes.

Equal fingerprints are one class, kept once with its smallest doc_id.  Classes are
dealt to blocks by their number of one-bits; two blocks meet in one task unless their
counts differ beyond the radius.  In a task tiles of some hundred fingerprints are
compared by exclusive-or and bit counts, and a pair of tiles is skipped if the
counts of ones in the fingerprints' quarters already differ beyond the radius.  A
task sends one link for each class that it joins to another, never all pairs.  The
comparison is exact, so its work grows with the square of the number of different
fingerprints, divided among as many tasks.

Where a similarity is asked for, classes are dealt to blocks by their number of
shingles instead, and blocks, tiles and pairs are left out whose numbers alone keep
the similarity from being reached: of sets of 79 and 100 not even 0.8 are common.

Rows that share a doc_id are one document.  A null doc_id is the smallest of all.  A
null text has no words.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import mix, pieces
from .common import cut, free_name, give_back
from .components import components
from .repeats import NO_ID, ids

#: Classes of a block at most, and blocks that there are at least if classes suffice.
BLOCK, LEAST_BLOCKS = 65_536, 16
LEAST_BLOCK = 512
#: Partitions that pairs of blocks are dealt to, at most.
MOST_TASKS = 8192
#: Fingerprints on each side of a tile.
TILE = 512
SEED = 42
#: Bands of numbers of shingles, to each factor of e.
BANDS = 32
#: Shingles whose bits are counted at once, for one lane.
STRETCH = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def _wide(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Hashes of 64 bits for each lane; the first are the hashes themselves."""
    return np.stack([hashes if k == 0 else mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) for k in range(lanes)], axis=1)


def fingerprints(texts: list[str | None], size: int, lanes: int = 1, distinct: bool = False) -> np.ndarray:
    """One row of `lanes` 64-bit words for each text."""
    return _prints((np.array(shingle_hashes(t, size), np.uint64) for t in texts), len(texts), lanes, distinct)[0]


def _prints(hashes: Iterable[np.ndarray], n_texts: int, lanes: int, distinct: bool) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of so many texts from the hashes of their shingles, and how many hashes each counts."""
    out, counted = np.zeros((n_texts, lanes), np.uint64), np.zeros(n_texts, np.int64)
    stretch = max(1, STRETCH // lanes)
    held: list[np.ndarray] = []
    rows: list[int] = []
    total = 0

    def settle() -> None:
        nonlocal held, rows, total
        if held:
            lengths = np.array([len(h) for h in held])
            starts = np.cumsum(lengths) - lengths
            every = np.concatenate(held)
            if len(held) == 1:  # one long text, stretch by stretch of it
                sums = np.zeros((1, lanes * 64), np.int64)
                for a in range(0, len(every), stretch):
                    sums += _sums(every[a : a + stretch], starts[:1], lanes)
            else:
                sums = _sums(every, starts, lanes)
            ones = sums * 2 > lengths[:, None]
            out[rows] = np.packbits(ones, axis=1, bitorder="little").view("<u8").astype(np.uint64)
        held, rows, total = [], [], 0

    for i, h in enumerate(hashes):
        if not len(h):
            continue
        if distinct:
            h = np.unique(h)
        counted[i] = len(h)
        if total + len(h) > stretch:
            settle()
        held.append(h)
        rows.append(i)
        total += len(h)
    settle()
    return out, counted


#: The lowest bit of each byte; so many hashes' bits can be added in bytes.
_LOWEST, _ADDED = np.uint64(0x0101010101010101), 255


def _sums(hashes: np.ndarray, starts: np.ndarray, lanes: int) -> np.ndarray:
    """How many hashes from each start to the next have each bit: eight bits of a hash are counted in one addition, a byte for each."""
    ends = np.append(starts[1:], len(hashes))
    parts = -(-(ends - starts) // _ADDED)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + _ADDED * (np.arange(parts.sum()) - np.repeat(first, parts))
    out = np.empty((len(starts), lanes, 8, 8), np.int64)
    wide = _wide(hashes, lanes)
    for k in range(lanes):
        word = np.ascontiguousarray(wide[:, k])
        for bit in range(8):
            added = np.add.reduceat((word >> np.uint64(bit)) & _LOWEST, cuts)
            out[:, k, :, bit] = np.add.reduceat(added.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return out.reshape(len(starts), lanes * 64)


def fingerprinted(docs: DataFrame, size: int, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id (bigint, the least number for null), fp (big-endian bytes), ones and shingles (how many) of every row."""

    def run(batches):
        for b in pieces(batches):
            fp, n_shingles = _prints((np.array(shingle_hashes(t, size), np.uint64) for t in b.column(1).to_pylist()), b.num_rows, lanes, distinct)
            raw = fp.astype(">u8").tobytes()
            n = 8 * lanes
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids(b.column(0))), pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary()), pa.array(np.bitwise_count(fp).sum(axis=1).astype(np.int32)), pa.array(n_shingles)],
                ["doc_id", "fp", "ones", "shingles"],
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary, ones int, shingles long")


def _plan(counts: dict[int, int], radius: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Blocks as (first ones, last ones, piece, pieces), and for each the last block that it must meet."""
    total = sum(counts.values())
    most = max(LEAST_BLOCK, min(BLOCK, -(-total // LEAST_BLOCKS)))
    blocks: list[tuple[int, int, int, int]] = []
    low, last, size = None, 0, 0
    for ones in sorted(counts):
        if low is not None and size + counts[ones] > most:
            blocks.append((low, last, 0, 1))
            low, size = None, 0
        if counts[ones] > most:
            pieces = -(-counts[ones] // most)
            blocks += [(ones, ones, k, pieces) for k in range(pieces)]
            continue
        low, size, last = ones if low is None else low, size + counts[ones], ones
    if low is not None:
        blocks.append((low, last, 0, 1))
    starts = [b[0] for b in blocks]
    return blocks, [bisect.bisect_right(starts, b[1] + radius) - 1 for b in blocks]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; every label ends as its set's least."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def tile_links(fa: np.ndarray, fb: np.ndarray, radius: int, same: bool, sizes: tuple[np.ndarray, np.ndarray] | None = None, similarity: float = 0.0) -> np.ndarray:
    """For fingerprints fa then fb, the least index that each is joined to. Exact, tile by tile.

    sizes: the numbers of shingles of fa and fb; pairs whose numbers keep them from that similarity aren't joined, and most of them not compared.
    """
    n, m = len(fa), len(fb)
    label = np.arange(n + m if not same else n)

    def order(f: np.ndarray, numbers: np.ndarray | None):
        if numbers is not None:
            by_what = numbers.astype(np.int64)[:, None]
        else:
            by_what = np.bitwise_count(f.view("<u2").reshape(len(f), -1)).astype(np.int16) if f.shape[1] == 1 else np.bitwise_count(f).astype(np.int16)
        by = np.lexsort(by_what.T[::-1])
        q = by_what[by]
        edges = [(k, min(k + TILE, len(f))) for k in range(0, len(f), TILE)]
        return by, np.ascontiguousarray(f[by].T), edges, np.array([q[a:b].min(axis=0) for a, b in edges]), np.array([q[a:b].max(axis=0) for a, b in edges])

    fa = np.ascontiguousarray(fa.astype("<u8"))
    na, nb = sizes or (None, None)
    by_a, cols_a, tiles_a, lo_a, hi_a = order(fa, na)
    by_b, cols_b, tiles_b, lo_b, hi_b = (by_a, cols_a, tiles_a, lo_a, hi_a) if same else order(np.ascontiguousarray(fb.astype("<u8")), nb)
    shift = 0 if same else n
    for t, (a0, a1) in enumerate(tiles_a):
        if sizes is None:
            meets = np.maximum(0, np.maximum(lo_b - hi_a[t], lo_a[t] - hi_b)).sum(axis=1) <= radius
        else:
            meets = (_reaches(hi_a[t], lo_b, similarity) & _reaches(hi_b, lo_a[t], similarity))[:, 0]
        for u in np.flatnonzero(meets):
            if same and u < t:
                continue
            b0, b1 = tiles_b[u]
            i, j = _near(cols_a[:, a0:a1], cols_b[:, b0:b1], radius)
            i, j = by_a[a0 + i], by_b[b0 + j]
            if sizes is not None and len(i):
                x, y = na[i], nb[j]
                keep = _reaches(x, y, similarity) & _reaches(y, x, similarity)
                i, j = i[keep], j[keep]
            if len(i):
                _merge(label, i, j + shift)
    return label


def _reaches(few: np.ndarray, many: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have that Jaccard similarity, as far as the first's being the smaller goes."""
    return few >= similarity * many - 1e-9


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile that differ in `radius` bits at most. x, y: one row for each lane."""
    first = max(1, len(x) // 2)
    while first < len(x) - 1 and radius > 32 * first - 12 * math.sqrt(first):  # of so many bits chance pairs would pass
        first += 1
    apart = np.bitwise_count(x[0][:, None] ^ y[0][None, :])
    for k in range(1, first):
        apart += np.bitwise_count(x[k][:, None] ^ y[k][None, :])
    i, j = np.divmod(np.flatnonzero(apart <= radius), apart.shape[1])  # nonzero of two dimensions takes longer than all before it
    if first < len(x) and len(i):
        rest = apart[i, j].astype(np.int32)
        for k in range(first, len(x)):
            rest += np.bitwise_count(x[k][i] ^ y[k][j])
        keep = rest <= radius
        i, j = i[keep], j[keep]
    return i, j


def linked(classes: DataFrame, radius: int, lanes: int, similarity: float | None = None) -> DataFrame:
    """a, b: links that join the classes (fp, rep, ones, shingles) within the radius; each task sends a forest.

    similarity: only those whose numbers of shingles allow it.
    """
    spark = classes.sparkSession
    if similarity is not None:
        classes = classes.withColumn("ones", F.floor(F.log(F.greatest("shingles", F.lit(1))) * BANDS).cast("int"))  # a band takes the place of the number of bits
    counts = {r["ones"]: r["n"] for r in classes.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # one row for each number of bits or band
    # Bands farther apart than this hold no two numbers that allow the similarity; one more for the logarithm's rounding.
    blocks, reach = _plan(counts, radius if similarity is None else math.ceil(BANDS * math.log(1 / similarity)) + 1)
    if not blocks:
        return spark.createDataFrame([], "a long, b long")
    firsts: dict[int, tuple[int, int]] = {}
    for k, (low, high, piece, pieces) in enumerate(blocks):
        if piece == 0:
            for ones in range(low, high + 1):
                firsts[ones] = (k, pieces)
    where = F.create_map(*[F.lit(x) for ones, (k, _) in firsts.items() for x in (ones, k)])
    split = F.create_map(*[F.lit(x) for ones, (_, p) in firsts.items() for x in (ones, p)])
    block = (F.element_at(where, F.col("ones")) + F.pmod(F.xxhash64("fp"), F.element_at(split, F.col("ones"))).cast("int")).alias("block")

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "fps": pa.array([b"".join(group["fp"].to_pylist())], pa.binary()), **{c: pa.array([group[c].to_numpy().tobytes()], pa.binary()) for c in ("rep", "shingles")}})

    packed = classes.select(block, "fp", "rep", "shingles").groupBy("block").applyInArrow(gather, "block int, fps binary, rep binary, shingles binary")
    # One row for each block comes from the driver; their pairs, which grow with the square, are made where they are used.
    pairs = spark.createDataFrame(list(enumerate(reach)), "one int, reach int").select("one", F.explode(F.sequence("one", "reach")).alias("other"))
    met = pairs.select("one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("block"))
    n = sum(r - i + 1 for i, r in enumerate(reach))
    # A pair's data are small and its work is not: as many partitions as pairs, which adaptive execution leaves alone.
    tasks = met.join(packed, "block").repartition(min(n, MOST_TASKS), "one", "other")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        sides = {r["block"]: (np.frombuffer(r["fps"], ">u8").reshape(-1, lanes), *(np.frombuffer(r[c], np.int64) for c in ("rep", "shingles"))) for r in group.select(["block", "fps", "rep", "shingles"]).to_pylist()}
        one, other = key[0].as_py(), key[1].as_py()
        a, reps, n_a = sides[one]
        b, n_b = a, n_a
        if one != other:
            b, more, n_b = sides[other]
            reps = np.concatenate((reps, more))
        label = tile_links(a, b, radius, one == other, None if similarity is None else (n_a, n_b), similarity or 0.0)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(reps[moved]), "b": pa.array(reps[label[moved]])})

    return tasks.groupBy("one", "other").applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, size: int, radius: int, lanes: int = 1, distinct: bool = False, similarity: float | None = None) -> DataFrame:
    """doc_id, fp and component (the smallest doc_id reachable) of every row.

    similarity: links within the radius only say which classes to compare; what joins is the exact similarity of their shingles.
    """
    spark = docs.sparkSession
    prints = cut(spark, fingerprinted(docs, size, lanes, distinct))
    # A class has the number of shingles of its rep; where rows share that id, the most.
    first = F.min(F.struct("doc_id", (-F.col("shingles")).alias("less")))
    classes = cut(spark, prints.groupBy("fp", "ones").agg(first.alias("first")).select("fp", "ones", F.col("first.doc_id").alias("rep"), (-F.col("first.less")).alias("shingles")), prints.count())
    # Rows that share a doc_id are one document: its fingerprints are linked.
    shared = prints.groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select("doc_id")
    own = prints.join(shared, "doc_id").join(classes.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = linked(classes, radius, lanes, similarity)
    if similarity is not None:
        links = similar(docs, classes, links, size, similarity)
    roots = components(links.unionAll(own))
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return prints.join(named, "fp").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "fp", F.when(F.col("component") != NO_ID, F.col("component")).alias("component"))


def digests(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row."""
    return grouped(docs, size, radius).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Classes, and shingles of them, that one side of an exact comparison has, about.
SIDE, SIDE_SHINGLES = 256, 1 << 20
#: Shingles whose counts are taken at once.
COLUMNS = 4096
#: Tasks that groups are dealt to at least, and bytes of shingles that there is one more for.
LEAST_TASKS, TASK_BYTES = 256, 1 << 20
#: Documents of groups whose ids are broadcast, at most.
SMALL = 1 << 18


def alike(sets: list[np.ndarray], left: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets of hashes whose Jaccard similarity reaches `similarity`; the first of a pair is one of the first `left`."""
    n = np.array([len(s) for s in sets])
    common = np.zeros((left, len(sets)), np.int64)
    code = np.concatenate(sets)
    by = np.argsort(code, kind="stable")
    code, row = code[by], np.repeat(np.arange(len(sets), dtype=np.int32), n)[by]
    del by
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    del code
    times = np.diff(np.append(np.flatnonzero(new), len(new)))
    shared = times > 1  # what one set alone has is in no intersection
    row, many = row[np.repeat(shared, times)], int(shared.sum())
    column = np.repeat(np.arange(many, dtype=np.int32), times[shared])
    for a in range(0, many, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, -(-(many - a) // 64) * 64)), bool)
        x[row[lo:hi], column[lo:hi] - a] = True
        bits = np.packbits(x, axis=1).view(np.uint64)
        for k in range(left):
            common[k] += np.bitwise_count(bits & bits[k]).sum(axis=1, dtype=np.int64)
    i, j = np.nonzero((common > 0) & (common >= similarity * (n[:left, None] + n[None, :] - common) - 1e-9))
    return i[i < j], j[i < j]


def similar(docs: DataFrame, classes: DataFrame, links: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: links that join the classes whose shingles' Jaccard similarity reaches `similarity`, among those that the given links join.

    What the links join is a group; all its classes are compared, sides of some hundred with each other, so that no task has a whole large group.
    """
    spark = docs.sparkSession
    roots = components(links)
    members = cut(spark, classes.join(roots, classes.rep == roots.node).select("fp", "rep", "root"), classes.count())

    def sets(batches):
        for b in pieces(batches):
            found = [np.unique(np.array(shingle_hashes(t, size), np.uint64)) for t in b.column(1).to_pylist()]
            fp = _prints(found, len(found), LANES, False)[0].astype(">u8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes() for f in fp], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["rep", "fp", "shingles"])
        give_back()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rep"), F.col("text").cast("string").alias("text"))
    reps = members.select("rep").distinct()
    reps = F.broadcast(reps) if reps.count() <= SMALL else reps  # so that texts needn't move
    rows = rows.join(reps, "rep", "left_semi").mapInArrow(sets, "rep long, fp binary, shingles binary")
    most = F.max(F.struct(F.octet_length("shingles"), "shingles")).getField("shingles")
    held = cut(spark, members.join(rows.groupBy("rep", "fp").agg(most.alias("shingles")), ["rep", "fp"]))
    sizes = held.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum(F.octet_length("shingles")) / (8 * SIDE_SHINGLES))).cast("int").alias("sides"))
    dealt = held.join(sizes, "root").withColumn("side", F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int"))
    # A class goes to the comparison of its side with each.
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    met = met.select("root", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("other"), (F.col("side") <= F.col("with")).alias("first"), "rep", "shingles")
    tasks = max(LEAST_TASKS, held.agg(F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0)).alias("n")).first()["n"] // TASK_BYTES)
    met = met.withColumn("task", F.pmod(F.xxhash64("root", "one", "other"), F.lit(tasks)))

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        where: dict[tuple, list[int]] = {}
        for k, at in enumerate(zip(*(group[c].to_pylist() for c in ("root", "one", "other")), strict=True)):
            where.setdefault(at, []).append(k)
        first, reps, raw = group["first"].to_pylist(), group["rep"].to_numpy(), group["shingles"].combine_chunks()
        a, b = [], []
        for at in where.values():
            at.sort(key=lambda k: not first[k])
            i, j = alike([np.frombuffer(raw[k].as_py(), np.uint64) for k in at], sum(first[k] for k in at), similarity)
            label = np.arange(len(at))
            _merge(label, i, j)
            moved = np.flatnonzero(label != np.arange(len(at)))
            ids_of = reps[at]
            a.append(ids_of[moved])
            b.append(ids_of[label[moved]])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return met.groupBy("task").applyInArrow(compare, "a long, b long")


#: For a similarity: bits of the fingerprint, and standard deviations that the radius is wider than expected.
LANES, MARGIN = 4, 4.0


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits that two sets of this Jaccard similarity have, and a margin for chance."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


def deduped(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest doc_id of their group.

    Similarity is that of the sets of shingles, exactly; 256 bits of fingerprint say
    which to compare, at a radius that hardly any such pair exceeds.  Groups are what
    links of that similarity join.
    """
    name = free_name(docs.columns, "gone")
    found = grouped(docs, size, radius_for(similarity, 64 * LANES), LANES, distinct=True, similarity=similarity)
    gone = found.where("doc_id <> component or (doc_id is not null and component is null)").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
