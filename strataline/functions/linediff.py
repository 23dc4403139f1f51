"""Line differences: the shortest script between two texts, as unified hunks, and hunks applied to a text.

The script is the one that takes common lines off both ends first and then, from the top,
keeps a line whenever both sides have it, and at a difference deletes before it inserts
wherever both lead to a shortest script.  Texts of usual size have a table of their common
lines, a bit for each pair.  Larger ones are compared by Myers' furthest points: they are
searched for from the end, all diagonals of a distance at once, and every `KEEP`-th set of
points is stored; the walk from the top makes the sets between again when it needs them.

Lines end at a newline only; a last line without one is a line of its own kind.
"""

from __future__ import annotations

import re

import numpy as np

CONTEXT = 3

#: Of so many distances' furthest points one set is stored.
KEEP = 64

NO_NEWLINE = "\\ No newline at end of file"

_HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def lines_of(text: str) -> list[str]:
    """Lines with their newlines."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class _Furthest:
    """The furthest points of each distance between a and b, from their end towards their start.

    Of distance d the points are those on the diagonals -d, -d + 2 .. d of both reversed; a
    point counts the lines of a that are behind it.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a[::-1], b[::-1]
        self.n, self.m = len(a), len(b)
        d, v = 0, self._slid(np.zeros(1, np.int64), 0)
        self.stored = {0: v}
        while not self._over(v, d):
            d, v = d + 1, self._next(v, d + 1)
            if d % KEEP == 0:
                self.stored[d] = v
        self.distance = d
        self.block: dict[int, np.ndarray] = {}

    def _over(self, v: np.ndarray, d: int) -> bool:
        k = self.n - self.m
        return abs(k) <= d and (d + k) % 2 == 0 and v[(d + k) // 2] >= self.n

    def _next(self, v: np.ndarray, d: int) -> np.ndarray:
        grown = np.empty(d + 1, np.int64)
        grown[1:], grown[0] = v + 1, -1
        np.maximum(grown[:-1], v, out=grown[:-1])
        return self._slid(grown, d)

    def _slid(self, v: np.ndarray, d: int) -> np.ndarray:
        k = np.arange(-d, d + 1, 2)
        np.minimum(v, np.minimum(self.n, self.m + k), out=v)
        live = np.flatnonzero((v >= 0) & (v < self.n) & (v - k >= 0) & (v - k < self.m))
        while len(live):
            x = v[live]
            live = live[self.a[x] == self.b[x - k[live]]]
            v[live] += 1
            x = v[live]
            live = live[(x < self.n) & (x - k[live] < self.m)]
        return v

    def within(self, i: int, j: int, d: int) -> bool:
        """Whether what follows line i of a and line j of b differs by d at most (and d has its parity)."""
        x, k = self.n - i, (self.n - i) - (self.m - j)
        return abs(k) <= d and self._at(d)[(d + k) // 2] >= x

    def _at(self, d: int) -> np.ndarray:
        if d not in self.block:
            at = d // KEEP * KEEP
            self.block = {at: self.stored[at]}
            for e in range(at + 1, min(at + KEEP, self.distance + 1)):
                self.block[e] = self._next(self.block[e - 1], e)
        return self.block[d]


#: Lines times lines up to which all rows of the table of common lines are kept, a bit for each pair: 32 MB.
TABLE = 1 << 28


def _kept(a: list[int], b: list[int]) -> list[int]:
    """For each line j of b a number whose bit n - 1 - i says that a[i:] and a[i + 1:] have as long a common part with b[j:].

    Rows of the table of longest common subsequences from the ends, as differences: a whole row is
    a few operations on one long integer, whatever the distance.
    """
    n = len(a)
    full = (1 << n) - 1
    where: dict[int, int] = {}
    bit = 1
    for x in reversed(a):
        where[x] = where.get(x, 0) | bit
        bit <<= 1
    v, rows = full, [full] * (len(b) + 1)
    for j in range(len(b) - 1, -1, -1):
        u = v & where.get(b[j], 0)
        v = ((v + u) | (v - u)) & full
        rows[j] = v
    return rows


def _walked(a: list[int], b: list[int], head: int) -> list[tuple[int, int, int, int]]:
    """Changed blocks by the table: at a difference a line of a goes wherever the rest's common part stays as long."""
    rows, n, m = _kept(a, b), len(a), len(b)
    out = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        i1, j1 = i, j
        while (i < n or j < m) and not (i < n and j < m and a[i] == b[j]):
            if i < n and (j == m or rows[j] >> (n - 1 - i) & 1):
                i += 1
            else:
                j += 1
        out.append((head + i1, head + i, head + j1, head + j))
    return out


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    for at in range(0, n, 4096):
        differs = np.flatnonzero(a[at : min(at + 4096, n)] != b[at : min(at + 4096, n)])
        if len(differs):
            return at + int(differs[0])
    return n


def changes(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Changed blocks: lines old[i:i2] become new[j:j2]."""
    number: dict[str, int] = {}
    x = [number.setdefault(line, len(number)) for line in old]
    y = [number.setdefault(line, len(number)) for line in new]
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i] != y[i]), least)
    tail = next((i for i in range(least - head) if x[-1 - i] != y[-1 - i]), least - head)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    out: list[tuple[int, int, int, int]] = []
    if not x or not y:
        return [(head, head + len(x), head, head + len(y))] if x or y else out
    if len(x) * len(y) <= TABLE:
        return _walked(x, y, head)
    a, b = np.array(x, np.int64), np.array(y, np.int64)
    far = _Furthest(a, b)
    i = j = 0
    left = far.distance
    while left:
        same = _equal_ahead(a[i:], b[j:])
        i, j = i + same, j + same
        i1, j1 = i, j
        while left and not (i < len(a) and j < len(b) and a[i] == b[j]):
            left -= 1
            if i < len(a) and (j == len(b) or far.within(i + 1, j, left)):
                i += 1
            else:
                j += 1
        out.append((head + i1, head + i, head + j1, head + j))
    return out


def unified(old: str | None, new: str | None, context: int = CONTEXT) -> str:
    """Hunks that make new of old, with so many lines around; a file that isn't there is empty. Equal texts have none."""
    return compared(old, new, context)[0]


def compared(old: str | None, new: str | None, context: int = CONTEXT) -> tuple[str, int, int]:
    """The hunks, and how many lines are added and removed."""
    a, b = lines_of(old or ""), lines_of(new or "")
    out: list[str] = []
    group: list[tuple[int, int, int, int]] = []

    def put(mark: str, line: str) -> None:
        out.append(mark + line if line.endswith("\n") else f"{mark}{line}\n{NO_NEWLINE}\n")

    def span(start: int, n: int) -> str:
        return f"{start + (n > 0)}" + (f",{n}" if n != 1 else "")

    def flush() -> None:
        i1, j1 = max(0, group[0][0] - context), max(0, group[0][2] - context)
        i2, j2 = min(len(a), group[-1][1] + context), min(len(b), group[-1][3] + context)
        out.append(f"@@ -{span(i1, i2 - i1)} +{span(j1, j2 - j1)} @@\n")
        at = i1
        for x1, x2, y1, y2 in group:
            for line in a[at:x1]:
                put(" ", line)
            for line in a[x1:x2]:
                put("-", line)
            for line in b[y1:y2]:
                put("+", line)
            at = x2
        for line in a[at:i2]:
            put(" ", line)

    added = removed = 0
    for change in changes(a, b):
        removed, added = removed + change[1] - change[0], added + change[3] - change[2]
        if group and change[0] - group[-1][1] > 2 * context:
            flush()
            group = []
        group.append(change)
    if group:
        flush()
    return "".join(out), added, removed


def counts(hunks: str) -> tuple[int, int]:
    """Lines added and removed."""
    added = removed = 0
    for kind, _ in _steps(hunks):
        added += kind == "+"
        removed += kind == "-"
    return added, removed


def _steps(hunks: str):
    """(kind, line) of every line of every hunk, and ('@', line of the old text) where one begins."""
    left = [0, 0]
    held: tuple[str, str] | None = None
    for line in hunks.split("\n"):
        if line == NO_NEWLINE:
            if held is None:
                raise ValueError("a mark of a missing newline without a line")
            held = (held[0], held[1][:-1])
            continue
        if held is not None:
            yield held
            held = None
        if left[0] or left[1]:
            kind = line[:1] or " "
            if kind not in " +-":
                raise ValueError(f"a hunk ends early: {line[:40]}")
            left[0] -= kind in " -"
            left[1] -= kind in " +"
            held = (kind, line[1:] + "\n")
        elif line:
            head = _HEAD.match(line)
            if not head:
                raise ValueError(f"not a hunk: {line[:40]}")
            sizes = [1 if head[k] is None else int(head[k]) for k in (2, 4)]
            left = list(sizes)
            yield "@", str(int(head[1]) - (sizes[0] > 0))
    if held is not None:
        yield held
    if left[0] or left[1]:
        raise ValueError("a hunk ends early")


def applied(old: str | None, hunks: str) -> str:
    """The text that the hunks make of old; ValueError if they weren't made for it."""
    a = lines_of(old or "")
    out: list[str] = []
    at = 0
    for kind, line in _steps(hunks):
        if kind == "@":
            start = int(line)
            if not at <= start <= len(a):
                raise ValueError("a hunk begins outside of the text")
            out += a[at:start]
            at = start
        elif kind == "+":
            out.append(line)
        else:
            if at >= len(a) or a[at] != line:
                raise ValueError(f"line {at + 1} isn't what the hunk says")
            if kind == " ":
                out.append(line)
            at += 1
    return "".join(out + a[at:])
