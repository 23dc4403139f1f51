"""Byte-pair encoding as a bounded-lookahead transducer, and the decoder that undoes it.

The merge list is turned into two things: the set of tokens that it builds from
their own letters, and the test whether two neighbours stay apart when their
letters are merged together.  A sequence of tokens is the merge list's result
exactly if all its neighbours pass that test, so each prefix of a word has one
last token.  The transducer reads letter by letter.  Its state is what later
letters may still use: for each place at which a longer token may have begun, the
letters since, the token before, and the tokens on the way there that haven't been
emitted.  Tokens that all of these ways share are stable and go out at once.  No place
is farther back than the longest token (`lookahead`), so a state has a bound, whatever
the word's length.  States and steps are worked out when first met, and remembered.

Decoding feeds token bytes to an incremental UTF-8 machine, so text comes out as
soon as its last byte is known, whatever the tokens' borders.

Around the transducer, texts are cut into words without a Python object for each: a slice
of rows is lower-cased, its bytes are classed by a table, words are the runs between
borders, and Arrow's dictionary of a slice says which words are different.  Each
different word goes through the transducer once; ids are gathered by the dictionary's
codes.  A long text is taken in stretches that end at white space, so that what is
held besides the text is a stretch, and one word at most if that is longer.

What the tokenizer file says about normalising and splitting is read from it; a file
that says what this module can't do is refused.

Null and empty texts encode to no tokens.  Text is never split, capped or sampled.
"""

from __future__ import annotations

import codecs
import functools
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bytesops import pieces
from .common import batch, give_back

#: Pairs of tokens that are remembered (all are forgotten when there are more), and steps of the transducer (the first ones met).
PAIRS, STEPS = 150_000, 150_000
#: Bytes of words and their ids that are remembered between slices of text, with what Python adds to each, and the longest of such words.
WORD_BYTES, SHORT = 32 << 20, 32
#: Letters of text whose words are encoded together, letters that are cut into words at once, and ids decoded at once.
SLICE, CUT, IDS = 1 << 22, 1 << 20, 1 << 16

# The words that this module can find, as a tokenizer file writes them; white space; what an apostrophe takes with it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TAKES_ONE, _TAKES_TWO = b"stmd", (b"re", b"ve", b"ll")
# Code points that came after the version of Unicode by which the library tells letters and numbers (16), in hexadecimal.
_NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
# Capitals that the library lower-cases (Unicode 17) and Python may not know yet; and the first bytes of all of them.
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITALS_BEGIN = b"\xe1\xb2\x89", b"\xea\x9f", b"\xf0\x90\xb5", b"\xf0\x96\xba"
# Marks, in hexadecimal, that the library's composition doesn't know (it is of an older Unicode than that of its letters):
# it neither moves them among other marks nor joins them to a letter. The last of them is no mark, but the second half of a letter.
_LATER = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e "
    "11839-1183a 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef 11930"
)

#: Classes of letters.
SPACE, LETTER, NUMBER, OTHER = range(4)
_AT_SPACE = re.compile(r"[ \t\n\r]")


def _ranges(listed: str) -> list[tuple[int, int]]:
    return [tuple(int(x, 16) for x in (r.split("-") * 2)[:2]) for r in listed.split()]


_AT_LATER = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(_LATER)) + "])")


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where Latin-1 prints it, else the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Added to a letter's byte: it ends its word.
LAST = 256


class State(dict):
    """Ways through the letters so far, each as (letters since, token before, tokens unsent).

    As a dictionary: from a letter to the state after it and the ids that are stable
    then, worked out when first asked for.
    """

    __slots__ = ("coder", "ways")

    def __init__(self, coder: Transducer, ways: tuple):
        self.coder, self.ways = coder, ways

    def __missing__(self, byte: int) -> tuple[State | None, bytes]:
        got = self.coder._step(self.ways, byte)
        if self.coder.steps < STEPS:
            self.coder.steps += 1
            self[byte] = got
        return got


class Transducer:
    """A tokenizer file's merge list as a streaming encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.lowers, self.composes = _normaliser(spec["normalizer"])
        _check(spec)
        #: Tokens that are found in the text as they stand, before anything else.
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self._byte = {c: b for b, c in enumerate(self.letters)}
        self._split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._parts = {a + b: (a, b) for a, b in reversed(self.ranks)}
        self._spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.tokens = {t for t in self.ids if self.merged(self._symbols(t)) == [t]}
        #: Beginnings of longer tokens.
        self.stems = {t[:k] for t in self.tokens for k in range(1, self._size(t))}
        self.let_go()
        self.lookahead = max((len(self._symbols(t)) for t in self.ids), default=1)

    def let_go(self) -> None:
        """Forgets states, words and pairs: a worker that goes on with other work needn't hold them."""
        self._states: dict[tuple, State] = {}
        #: Steps that are remembered. Later ones are worked out again when they are met, which is seldom, as words are remembered too.
        self.steps = 0
        self._start = self._state((("", "", ()),))
        self._known: dict[bytes, bytes] = {}
        self._known_bytes = 0
        self._apart: dict[tuple[str, str], bool] = {}
        gc.collect()  # states lead to each other in circles

    # -- the merge list ---------------------------------------------------

    def _symbols(self, token: str) -> list[str]:
        """The letters that a token is merged from; the word end belongs to the last."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge list applied to a short list of symbols, lowest rank first, leftmost first."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.ranks.get(p, 1 << 60))
            if best not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The token and what it is merged from along one side, each with the rank of the merge that takes it in."""
        key = (token, side)
        got = self._spines.get(key)
        if got is None:
            got, taken = [], 1 << 60
            while token is not None:
                got.append((token, taken))
                parts = self._parts.get(token)
                taken = self.ranks[parts] if parts else 0
                token = parts[side] if parts else None
            self._spines[key] = got
        return got

    def _stays(self, left: str, right: str) -> bool:
        """Whether two neighbouring tokens stay apart when their letters are merged together.

        They don't if some merge over the border comes before the merges that take
        its two sides in; of equal ranks the leftmost comes first.
        """
        key = (left, right)
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            rank = self.ranks.get
            ys = self._spine(right, 0)
            got = self._apart[key] = not any((r := rank((x, y))) is not None and r < tx and r <= ty for x, tx in self._spine(left, 1) for y, ty in ys)
        return got

    # -- encoding ---------------------------------------------------------

    def _size(self, token: str) -> int:
        return len(token) - (len(self.end) if self.end and token.endswith(self.end) and len(token) > len(self.end) else 0)

    def _state(self, ways: tuple) -> State:
        got = self._states.get(ways)
        if got is None:
            got = State(self, ways)
            if self.steps < STEPS:
                self._states[ways] = got
        return got

    def _new(self, ways: tuple, letters: str) -> tuple[str, tuple[int, ...]] | None:
        """The token that these letters end, and the unsent tokens up to it. The longest that fits is the one."""
        for stem, left, unsent in ways:
            token = stem + letters
            if token in self.tokens and (not left or self._stays(left, token)):
                return token, (*unsent, self.ids[token])
        return None

    def _step(self, ways: tuple, byte: int) -> tuple[State | None, bytes]:
        """The state after one more letter, and the ids that are stable now; after the word's end all are."""
        c = self.letters[byte % LAST]
        found = self._new(ways, c if byte < LAST else c + self.end)
        after = [(stem + c, left, unsent) for stem, left, unsent in ways if stem + c in self.stems] if byte < LAST else []
        if found:
            after.append(("", *found))
        if not after:
            raise ValueError("the vocabulary lacks a letter of this word")
        first, shared = after[0][2], min(len(w[2]) for w in after)
        while any(w[2][:shared] != first[:shared] for w in after):
            shared -= 1
        state = self._state(tuple((s, left, u[shared:]) for s, left, u in after)) if byte < LAST else None
        return state, np.array(first[:shared], "<u4").tobytes()

    def word_ids(self, word: bytes) -> Iterator[bytes]:
        """Ids of one word, as little-endian unsigned 32-bit integers, each as soon as no later letter can change it."""
        state = self._start
        for byte in word[:-1]:
            state, ids = state[byte]
            if ids:
                yield ids
        yield state[word[-1] + LAST][1]

    def _cut(self, text: str) -> list[tuple[bytes, bool]]:
        """A text's normalised bytes, and tokens that stand in it as they are, in order."""
        out, at = [], 0
        if self._split is not None and any(t in text for t in self.special):
            for m in self._split.finditer(text):
                out += [(self._normal(text[at : m.start()]), False), (m[0].encode(), True)]
                at = m.end()
        out.append((self._normal(text[at:] if at else text), False))
        return out

    def _normal(self, text: str) -> bytes:
        if self.composes and not text.isascii():
            later = _AT_LATER.search(text) is not None
            text = "".join(unicodedata.normalize("NFC", t) for t in _AT_LATER.split(text)) if later else unicodedata.normalize("NFC", text)
        if self.lowers:  # letter by letter: a sigma at a word's end has no form of its own
            text = text.replace("\u03a3", "\u03c3").lower()
            data = text.encode()
            return text.translate(_CAPITALS).encode() if any(b in data for b in _CAPITALS_BEGIN) else data
        return text.encode()

    def encode_rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, one after another, and each row's offset in them (one more than rows)."""
        held: list[pa.Array] = []
        per_row: list[np.ndarray] = []
        parts: list[bytes] = []
        rows: list[int] = []
        whole: list[tuple[int, int]] = []  # parts that are one token
        at = first = 0

        def cut(after: int) -> None:
            """The words of the rows since the last cut."""
            nonlocal at, first
            starts, body, offsets = _words(np.frombuffer(b"\n".join([*parts, b""]), np.uint8), whole)
            held.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]))
            # A part's words begin before its end.
            ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
            per_part = np.diff(np.searchsorted(starts, ends), prepend=0)
            per_row.append(np.bincount(np.array(rows, np.int64) - first, per_part, after - first).astype(np.int64))
            for x in (parts, rows, whole):
                x.clear()
            at, first = 0, after

        for row, text in enumerate(texts):
            for part, token in self._cut(text) if text else ():
                if token:
                    whole.append((at, at + len(part)))
                parts.append(part)
                rows.append(row)
                at += len(part) + 1
            if at >= CUT:
                cut(row + 1)
        cut(len(texts))
        words = pa.chunked_array(held).dictionary_encode()
        del held
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        different = words.chunk(0).dictionary  # one for all chunks
        special = {t.encode(): np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        _, off, raw = different.buffers()
        off, raw = np.frombuffer(off, np.int64)[: len(different) + 1].tolist(), raw.to_pybytes()
        ids_of = self._ids_of
        found = [ids_of(raw[a:b]) if raw[a:b] not in special else special[raw[a:b]] for a, b in zip(off, off[1:], strict=False)]
        codes = np.concatenate([c.indices.to_numpy() for c in words.chunks])
        n_ids = np.array([len(f) // 4 for f in found], np.int64)
        ends = np.concatenate(([0], np.cumsum(n_ids[codes])))
        ids = np.frombuffer(pa.array(found, pa.large_binary()).take(pa.array(codes)).buffers()[2], "<u4")[: ends[-1]]
        return ids, ends[np.concatenate(([0], np.cumsum(np.concatenate(per_row))))]

    def _ids_of(self, word: bytes) -> bytes:
        """Ids of a word; those of short words are remembered, up to WORD_BYTES."""
        ids = self._known.get(word)
        if ids is None:
            ids = b"".join(self.word_ids(word))
            if len(word) <= SHORT:
                self._known_bytes += len(word) + len(ids) + 200
                if self._known_bytes > WORD_BYTES:
                    self._known.clear()
                    self._known_bytes = 0
                self._known[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of one text."""
        return np.concatenate([np.zeros(0, "<u4"), *(self.encode_rows([s])[0] for s in stretches(text or ""))])

    # -- decoding ---------------------------------------------------------

    @functools.cached_property
    def _spelt(self) -> tuple[pa.Array, pa.Array]:
        """For each id, the bytes that it decodes to: its own spelling after a space, and the bytes that it stands for."""
        joined, plain = [], []
        for i in range(max(self.surface) + 1):
            token = self.surface.get(i)
            if token is None:
                joined.append(None)
                plain.append(None)
                continue
            joined.append(b" " + token.encode())
            ends = self.end and token.endswith(self.end)
            body = token[: -len(self.end)] if ends else token
            plain.append(token.encode() if token in self.special else bytes([self._byte[c] for c in body]) + (b" " if ends else b""))
        return pa.array(joined, pa.large_binary()), pa.array(plain, pa.large_binary())

    def decode(self, ids: Iterable[int], joined: bool = False) -> Iterator[str]:
        """Text of ids, piece by piece.

        joined: the tokens' own spelling, a space between, as the library decodes
        a file without a decoder.  Else the bytes that the tokens stand for, a
        space after each word end.
        """
        machine = Decoder(self, joined)
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        for a in range(0, len(ids), IDS):
            if text := machine.feed(ids[a : a + IDS]):
                yield text
        if text := machine.end():
            yield text


class Decoder:
    """A state machine from ids to text: what it holds between feeds is the beginning of one letter, three bytes at most."""

    def __init__(self, coder: Transducer, joined: bool = False):
        self._bytes = coder._spelt[0 if joined else 1]
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")
        self._skip = int(joined)  # no space before the first

    def feed(self, ids: np.ndarray) -> str:
        """The text that these ids finish."""
        if not len(ids):
            return ""
        got = self._bytes.take(pa.array(ids, pa.int64()))
        if got.null_count:
            raise ValueError("an id that the tokenizer file lacks")
        _, offsets, data = got.buffers()
        off = np.frombuffer(offsets, np.int64)
        text = self._machine.decode(memoryview(data)[off[0] + self._skip : off[len(got)]]) if data is not None else ""
        self._skip = 0
        return text

    def end(self) -> str:
        return self._machine.decode(b"", True)


def _normaliser(spec: dict | None) -> tuple[bool, bool]:
    """Whether a tokenizer file lower-cases and composes."""
    steps = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
    lowers = composes = False
    for step in steps:
        if step["type"] == "Lowercase":
            lowers = True
        elif step["type"] == "NFC" and not lowers:
            composes = True
        # White space is no part of a word, so how much of it there is doesn't matter.
        elif step != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}:
            raise ValueError(f"a normaliser that isn't known here: {step}")
    return lowers, composes


def _check(spec: dict) -> None:
    """Refuses a tokenizer file whose words or merges this module would find otherwise than the file says."""
    split = spec["pre_tokenizer"]
    split = split["pretokenizers"] if split and split["type"] == "Sequence" else [split]
    known = (
        len(split) == 2
        and split[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
        and split[1]["type"] == "ByteLevel"
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
    )
    if not known:
        raise ValueError(f"words that this module can't find: {split}")
    model = spec["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("a model that isn't plain byte-pair encoding")
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions")
    if spec.get("decoder") is not None:
        raise ValueError("a decoder that isn't known here")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, last)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[first + m.start() : first + m.end()] = kind
    for first, last in _ranges(_NEWER):
        table[first : last + 1] = OTHER
    table[[ord(c) for c in _SPACE]] = SPACE
    return table


def _classed(data: np.ndarray) -> np.ndarray:
    """Each byte's class: that of the letter it belongs to."""
    table = classes()
    kind = np.append(table[:128], np.full(128, OTHER, np.uint8))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        a, b, c, d = (more[lead + k] & m for k, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
        two, three = (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c
        code = np.where(a < 0xE0, two, np.where(a < 0xF0, three, (a & 0x07) << 18 | b << 12 | c << 6 | d))
        found = table[code]
        for k, least in enumerate((0xC0, 0xC0, 0xE0, 0xF0)):
            wide = a >= least
            kind[lead[wide] + k] = found[wide]
    return kind


def _words(data: np.ndarray, whole: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start in the bytes, the bytes of all words, and each word's offset in those. whole: spans that are one word."""
    kind = _classed(data)
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    new &= kind != SPACE
    # An apostrophe that is a word takes the letters of a contraction with it; what follows them starts anew.
    quote = np.flatnonzero((data[:-1] == 39) & new[:-1] & (kind[1:] == LETTER)) if len(data) else np.zeros(0, np.int64)
    more = np.append(data, np.zeros(3, np.uint8))
    after = np.append(kind, np.zeros(3, np.uint8))
    one = np.isin(more[quote + 1], np.frombuffer(_TAKES_ONE, np.uint8))
    two = np.zeros(len(quote), bool)
    for pair in _TAKES_TWO:
        two |= (more[quote + 1] == pair[0]) & (more[quote + 2] == pair[1])
    for at, n in ((quote[one], 1), (quote[two], 2)):
        new[at + 1] = False
        rest = at + 1 + n
        new[rest[after[rest] == LETTER]] = True
    inside = kind != SPACE
    for a, b in whole:
        new[a:b], inside[a:b] = False, True
        new[a] = True
    starts = np.flatnonzero(new)
    body = data[inside]
    place = np.cumsum(inside)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    return starts, np.ascontiguousarray(body), np.append(place, len(body)).astype(np.int64)


def stretches(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts that end at white space, of about `size` letters: no word or token goes over their borders."""
    at = 0
    while len(text) - at > size:
        m = _AT_SPACE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """A column's texts, some MB at a time; a longer text is alone."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        text = text.as_py()
        n = len(text or "")
        if held and size + n > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text; other columns are left out.

    Null texts count as empty: no tokens, digests of nothing.  Repeated rows give repeated results.
    """

    def one(coder: Transducer, text: str | None, ids: np.ndarray | None = None) -> tuple[int, str, str]:
        """A row's figures, stretch by stretch."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        machine = Decoder(coder, joined=True)
        for some in (coder.encode_rows([s])[0] for s in stretches(text or "")) if ids is None else [ids]:
            n += len(some)
            ids_hash.update(some)
            for a in range(0, len(some), IDS):
                text_hash.update(machine.feed(some[a : a + IDS]).encode())
        text_hash.update(machine.end().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches):
        coder = transducer(path)
        for b in batches:
            rows = []
            for texts in _slices(b.column(1)):
                if len(texts) == 1:
                    rows.append(one(coder, texts[0]))
                    continue
                ids, off = coder.encode_rows(texts)
                rows += [one(coder, None, ids[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield batch(_DIGEST, b.column(0), *map(list, zip(*rows, strict=True))) if rows else _DIGEST.empty_table().to_batches()[0]
        coder.let_go()
        give_back()

    return df.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Every row and column of df, with an array of token ids and the text decoded from them.

    A column of df that has a new column's name is replaced.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    keep = df.drop(ids, decoded)
    fields = [*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]

    def run(batches):
        coder = transducer(path)
        for b in pieces(batches):
            rows, texts = [], []
            for some in _slices(b.column(b.schema.get_field_index("text"))):
                if len(some) == 1:
                    got, off = coder.encode(some[0]), None
                else:
                    got, off = coder.encode_rows(some)
                off = [0, len(got)] if off is None else off.tolist()
                rows += [got[x:y].astype(np.int32) for x, y in zip(off, off[1:], strict=False)]
                texts += ["".join(coder.decode(got[x:y])) for x, y in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.int32())), pa.array(texts, pa.string())], [*b.schema.names, ids, decoded])
        coder.let_go()
        give_back()

    return keep.withColumn("text", F.col("text").cast("string")).mapInArrow(run, T.StructType(fields))
