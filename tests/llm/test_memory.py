"""What one worker needs at once: it shares an executor with a JVM and with other workers."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from strataline.llm import simhash


def peak(run) -> tuple[object, float]:
    """What run gives, and the MB that it had at once beyond what there was."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        return run(), (tracemalloc.get_traced_memory()[1] - before) / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("lanes", [1, 4])
def test_bits_of_many_shingles_are_counted_in_stretches(lanes, monkeypatch):
    """Some 330 000 shingles, in short texts and in a long one; before, 256 bits of each took 170 MB, most of it for counts."""
    rng = random.Random(3)
    word = lambda: str(rng.randrange(10**6))
    texts = [" ".join(word() for _ in range(400)) for _ in range(600)] + ["", None, "one two", " ".join(word() for _ in range(90_000))]
    got, mb = peak(lambda: simhash.fingerprints(texts, 5, lanes, True))
    assert mb < 60
    for i in (0, 599, 600, 601, 602, 603):
        hashes = np.unique(np.array(simhash.shingle_hashes(texts[i], 5), np.uint64))
        ones = [sum(int(w) >> b & 1 for w in column) * 2 > len(hashes) for column in simhash._wide(hashes, lanes).T for b in range(64)] if len(hashes) < 1000 else None
        if ones is not None and len(hashes):
            assert [int(w) >> b & 1 for w in got[i] for b in range(64)] == ones
    monkeypatch.setattr(simhash, "STRETCH", 1 << 22)
    assert (simhash.fingerprints(texts, 5, lanes, True) == got).all()


def test_sides_are_compared_without_copies_of_all_their_shingles():
    """Two sides of a million shingles each; before, 125 MB."""
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 63, 4096).astype(np.uint64) for _ in range(8)]

    def copy(k: int, changed: int) -> np.ndarray:
        b = base[k % 8].copy()
        b[rng.choice(4096, changed, replace=False)] = rng.integers(0, 1 << 63, changed).astype(np.uint64)
        return np.unique(b)

    sets = [copy(k, 100 if k % 3 else 700) for k in range(512)]
    (i, j), mb = peak(lambda: simhash.alike(sets, 256, 0.8))
    assert mb < 90
    some = {(int(a), int(b)) for a, b in zip(i, j, strict=True) if a < 12 and b < 60}
    want = {(a, b) for a in range(12) for b in range(a + 1, 60) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert some == want and want
    assert [len(x) for x in simhash.alike([np.zeros(0, np.uint64)] * 3, 2, 0.8)] == [0, 0]
