"""Properties over texts that nobody would think of."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strataline.llm import bpe, bytesops, decontaminate, fingerprint, htmltext, linededup, simhash, substringdedup
from strataline.llm.queries import tokenizer_path

TEXTS = st.text(st.characters(codec="utf-8"), max_size=300) | st.text("ab c\n<|>endoftxs'", max_size=400)
QUICK = settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return bpe.Transducer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


@QUICK
@given(st.text("abcdefghinorstvxyz'éßæøñ日本語 \t\n.,!?0123456789<|>", max_size=400))
def test_tokens(pair, text):
    coder, library = pair
    assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@QUICK
@given(st.lists(TEXTS | st.none(), max_size=6))
def test_symbols_are_what_splitting_gives(texts):
    data, off = bytesops.column_bytes(pa.array(texts, pa.string()))
    for symbols, split in ((linededup.line_symbols, lambda b: b.split(b"\n") if b else []), (substringdedup.word_symbols, bytes.split)):
        values, counts = symbols(data, off)
        units = [split((t or "").encode()) for t in texts]
        assert counts.tolist() == [len(u) for u in units]
        flat = [x for u in units for x in u]
        assert len({(v, x) for v, x in zip(values.tolist(), flat, strict=True)}) == len(set(flat)) == len(set(values.tolist()))


@QUICK
@given(st.lists(TEXTS, min_size=1, max_size=5), st.integers(1, 5))
def test_simhash_of_many_is_that_of_each(texts, size):
    many = simhash.fingerprints([*texts, None], size)
    for t, f in zip([*texts, None], many, strict=True):
        h = simhash.shingle_hashes(t, size)
        expected = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert int(f[0]) == expected


@QUICK
@given(TEXTS, TEXTS)
def test_likeness_is_symmetric(a, b):
    x, y = fingerprint.fingerprints(pa.array([a, b], pa.large_string()))
    assert fingerprint.likeness(x, y) == fingerprint.likeness(y, x) and 0 <= fingerprint.likeness(x, y) <= 1
    assert fingerprint.fingerprints(pa.array([b, a, b], pa.large_string()))[1] == x  # neighbours don't matter


@QUICK
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4))
def test_scan_finds_every_window(words, items):
    found = decontaminate.automaton([(str(k), " ".join(i)) for k, i in enumerate(items)], 4)
    n, runs, keys = decontaminate.scan(found, " ".join(words))
    hit, owners = set(), set()
    for k, item in enumerate(items):
        width = min(4, len(item))
        windows = {tuple(item[i : i + width]) for i in range(len(item) - width + 1)} if item else set()
        for i in range(len(words) - width + 1 if item else 0):
            if tuple(words[i : i + width]) in windows:
                hit.update(range(i, i + width))
                owners.add(str(k))
    assert n == len(words) and keys == owners
    assert sorted(x for a, b in runs for x in range(a, b)) == sorted(hit)


@QUICK
@given(st.text("<>/pdivarticle ='\"!-&;x\n", max_size=300))
def test_any_page_gives_text(page):
    text = htmltext.main_text(page)
    assert text == text.strip() and hashlib.sha256(text.encode())
