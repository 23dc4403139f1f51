"""Vectorised views of text columns as UTF-8 bytes.

Every helper works on one Arrow column at a time, in slices of bounded size, so
that memory follows the slice and not the batch.  A null text is an empty text.
Spans are hashed with polynomial prefix sums over uint64 (wrapping arithmetic):
any span's hash is a subtraction and one multiplication, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is worked on alone.
SLICE_BYTES = (1 << 20) - 64

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of ASCII digits, ASCII letters and all that isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset into them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches, rows: int = 1024):
    """The same rows in batches of at most so many: Python objects are made of a few rows at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows (first, after the last) whose texts have `limit` bytes at most, or are one text."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Start and end of each word, and how many words each row has. No word crosses rows."""
    n = len(offsets) - 1
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(n, np.int64)
    mask = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = _BASE[which]
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 23:
            _powers[which] = got
    return got


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of values times powers of the base; one longer than values."""
    up, _ = _power(which, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Mixed hashes of spans; equal for equal contents wherever they are."""
    _, down = _power(which, len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return data.astype(np.uint64) + np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hash(prefix(byte_values(data), which), starts, ends, which)


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling; len(values) - width + 1 results."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def merge_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of half-open intervals; those that touch are one."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], end[last]
