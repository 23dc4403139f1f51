"""Suffix arrays by linear grouping.

First, suffixes are grouped by their Lyndon prefixes.  Groups are handled from the
largest down; a handled group's suffixes are appended to the prefixes of their
previous smaller suffixes, found by pointers, which move to new groups just above
their old ones.  Then every suffix is put at the next free place of its group as soon
as the suffix that follows its Lyndon prefix has its place.  Nothing is renamed or
sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes | np.ndarray) -> np.ndarray:
    """Starts of all suffixes of bytes or integers, in order; a suffix that is another's beginning comes before it."""
    symbols = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    group, length, members, lower, upper, top = _initial(symbols)
    previous = [-1] * n
    handled = bytearray(n + 1)  # the last one, which -1 names, is never handled
    order: list[int] = []
    new = len(length)
    at = top
    while at >= 0:
        mine = [i for i in members[at] if group[i] == at]
        members[at] = None
        if mine:
            order.append(at)
            if len(mine) == 1:
                i = mine[0]
                handled[i] = 1
                j = i - 1
                while handled[j]:
                    j = previous[j]
                if j >= 0:
                    previous[i] = j
                    old = group[j]
                    group[j] = new
                    length.append(length[old] + length[at])
                    members.append([j])
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    lower[above] = new
                    new += 1
            else:
                mine.sort()
                times: dict[int, int] = {}
                for i in mine:
                    handled[i] = 1
                    j = i - 1
                    while handled[j]:
                        j = previous[j]
                    if j >= 0:
                        previous[i] = j
                        times[j] = times.get(j, 0) + 1
                if times:
                    most = max(times.values())
                    for t in range(most, 0, -1):
                        made: dict[int, int] = {}
                        for j, k in times.items():
                            if k != t:
                                continue
                            old = group[j]
                            g = made.get(old)
                            if g is None:
                                g = made[old] = new
                                length.append(length[old] + t * length[at])
                                members.append([])
                                above = upper[old]
                                lower.append(old)
                                upper.append(above)
                                upper[old] = g
                                lower[above] = g
                                new += 1
                            group[j] = g
                            members[g].append(j)
        at = lower[at]
    return _placed(n, group, length, previous, order)


def _initial(symbols: np.ndarray):
    """One group for each letter, linked from the largest down."""
    letters = np.unique(symbols)
    group = np.searchsorted(letters, symbols).tolist()
    by = np.argsort(symbols, kind="stable")
    cuts = np.searchsorted(symbols[by], letters, "right")
    members = [part.tolist() for part in np.split(by, cuts[:-1])]
    k = len(letters)
    return group, [1] * k, members, list(range(-1, k - 1)), list(range(1, k + 1)), k - 1


def _placed(n: int, group: list[int], length: list[int], previous: list[int], order: list[int]) -> np.ndarray:
    """The groups' members in order, each put where it belongs once the suffix after its prefix is there."""
    ids = np.array(group)
    sizes = np.bincount(ids, minlength=len(length))
    ascending = np.array(order[::-1])
    free = np.zeros(len(length), np.int64)
    free[ascending] = np.cumsum(sizes[ascending]) - sizes[ascending]
    free = free.tolist()
    follows = (np.arange(n) + np.array(length)[ids]).tolist()
    follows.append(-1)  # for -1, after which nothing follows
    out = [0] * n
    j = n - 1
    while follows[j] == n:
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        j = previous[j]
    for s in out:
        j = s - 1
        while follows[j] == s:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = previous[j]
    return np.array(out)
