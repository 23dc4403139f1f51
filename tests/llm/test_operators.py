"""Each operator against a plain version, on documents with every oddity that a table may hold."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from strataline.llm import bytededup, chat, decontaminate, fingerprint, linededup, simhash, substringdedup, suffixarray, toxicity

PHRASES = ["the quick brown fox jumps over the lazy dog and runs away", "lorem ipsum dolor sit amet", "Straße çà ñandú 日本語 text", "a b c d e f g h i j k l m n o p q r s t u v w x y z"]


def odd_documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(60)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    docs: list[tuple] = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            lines.append(rng.choice([*passages, *PHRASES]) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))))
        docs.append((i * 3, "\n".join(lines)))
    docs += [(1000, None), (1001, ""), (1002, "   \n\t "), (1003, "x" * 950), (1004, "ab" * 400), (1005, docs[3][1]), (1006, docs[3][1]), (1007, docs[7][1] + " and more"), (1008, "\n\n\n\n"), (1009, "word " * 300)]
    docs += [(1010, docs[5][1]), (1010, docs[5][1])]  # a repeated row
    rng.shuffle(docs)
    return docs


def frame(spark, docs, extra: bool = False):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHES:
            df = df.withColumn(name, F.lit(name))
    return df


CLASHES = ("bucket", "data", "kind", "n", "_bucket", "gone", "_gone", "score", "items", "runs", "Spans", "start", "predicted", "held_out", "c", "component")


def same_columns(out, df) -> bool:
    """Whether all columns are there, with their own values."""
    return out.columns == df.columns and all(out.where(f"`{c}` is null or `{c}` <> '{c}'").isEmpty() for c in CLASHES)


def later_starts(units: dict, width: int) -> dict:
    """Covered units of each document, by looking at every window in order."""
    seen: dict = {}
    out = {}
    for doc in sorted(units):
        u = units[doc]
        covered = [False] * len(u)
        for i in range(len(u) - width + 1):
            key = tuple(u[i : i + width])
            if key in seen:
                covered[i : i + width] = [True] * width
            else:
                seen[key] = (doc, i)
        out[doc] = covered
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_array_is_sorted(seed):
    rng = random.Random(seed)
    for k in range(400):
        s = bytes(rng.choice(b"ab" if k % 2 else b"abcd") for _ in range(rng.randrange(60))) * (1 + k % 3)
        assert suffixarray.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    big = np.array([rng.choice([1, 2, 300, 70000]) for _ in range(500)])
    assert suffixarray.suffix_array(big).tolist() == sorted(range(500), key=lambda i: big[i:].tolist())


@pytest.mark.parametrize(("hot", "hot_in_all"), [(None, 160), (1, 160), (64, 2), (2, 3)])
def test_byte_dedup(spark, hot, hot_in_all):
    docs = odd_documents()
    got = {r["doc_id"]: r for r in bytededup.digests(frame(spark, docs), hot, hot_in_all).collect()}
    expected = later_starts({i: (t or "").encode() for i, t in docs}, 100)
    texts = dict(docs)
    for i, covered in expected.items():
        raw = (texts[i] or "").encode()
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()), i


def test_an_anchor_that_no_task_sees_often_is_divided(spark):
    """A passage in few surroundings in each of many tasks, but in many of all."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij") for _ in range(90))
    word = lambda n: "".join(rng.choice("klmnopqrstuvwxyz") for _ in range(n))
    docs = [(i, word(80) + passage + word(80)) for i in range(120)] + [(200 + i, word(30) + passage + " the same end of it" + word(20)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    expected = {i: sum(c) for i, c in later_starts({i: t.encode() for i, t in docs}, 100).items()}
    for hot_in_all in (10, 160):
        assert {r["doc_id"]: r["n_removed"] for r in bytededup.digests(df, None, hot_in_all).collect()} == expected
    assert sum(expected.values()) > 500
    assert bytededup.hot_once(1 << 20) == 64 and bytededup.hot_once(100 << 40) == 1


def test_null_and_repeated_ids(spark):
    """A null id comes first; rows that share an id come in the order of their texts' hashes, and equal rows count once."""
    base = [t for _, t in odd_documents(5, 30)]
    rng = random.Random(2)
    docs = [(rng.choice([None, None, 5, 5, 7, 100 + k]), t) for k, t in enumerate(base)]
    docs += [docs[3], docs[4], (None, base[0]), (5, base[0]), (None, None), (5, "")]
    key = lambda i, t: (-1 if i is None else i, xxhash.xxh32_intdigest((t or "").encode()))
    df = frame(spark, docs)
    units = {key(i, t): (t or "").encode() for i, t in docs}
    rows = lambda found: sorted(found, key=str)
    marked = {k: sum(c) for k, c in later_starts(units, 100).items()}
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in bytededup.digests(df).collect()]
    assert rows(got) == rows((i, len((t or "").encode()), marked[key(i, t)]) for i, t in docs)
    words = {k: re.findall(rb"[^\x20\x09-\x0D]+", t) for k, t in units.items()}
    marked = {k: sum(c) for k, c in later_starts(words, 20).items()}
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substringdedup.digests(df).collect()]
    assert rows(got) == rows((i, len(words[key(i, t)]), marked[key(i, t)]) for i, t in docs)
    # SimHash: rows of one id are one document, so all of a null id are in one component, whose least id is null.
    got = simhash.digests(df).collect()
    assert len(got) == len(docs) and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    for i in (5, 7):
        assert len({r["component_id"] for r in got if r["doc_id"] == i}) <= 1


def test_byte_dedup_keeps_other_columns(spark):
    docs = odd_documents(3, 20)
    df = frame(spark, docs, extra=True)
    out = bytededup.deduped(df)
    assert same_columns(out, df) and out.count() == df.count()
    assert same_columns(substringdedup.deduped(df), df)
    assert same_columns(toxicity.accepted(df, spark.createDataFrame([], "doc_id long, toxic int")), df)


def test_word_window_dedup(spark):
    docs = odd_documents()
    got = {r["doc_id"]: r for r in substringdedup.digests(frame(spark, docs)).collect()}
    units = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i, covered in later_starts(units, 20).items():
        kept = [w for w, c in zip(units[i], covered, strict=True) if not c]
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(units[i]), sum(covered), hashlib.sha256(" ".join(kept).encode()).hexdigest()), i


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 50, 4000).astype(np.uint64)
    symbols[2000:2100] = symbols[100:200]
    counts = np.array([1000, 0, 1500, 1500])
    from strataline.llm.repeats import window_keys

    cells = 1 << 20
    shingle, at = substringdedup.anchors(symbols, counts)
    found = substringdedup.places(shingle, at)
    known = []
    for r in range(substringdedup.ROWS):
        c, times = np.unique(substringdedup.cell(found, r, cells), return_counts=True)
        known.append(c[times > 1])
    k1, k2, _, _ = window_keys(symbols, counts, 20)
    often = substringdedup.estimated_often(shingle, at, known, cells)
    _, where, times = np.unique(np.stack([k1, k2]), axis=1, return_inverse=True, return_counts=True)
    assert often[times[where.ravel()] > 1].all()
    assert (~often).any()


def test_line_dedup(spark):
    docs = odd_documents()
    got = {r["doc_id"]: r for r in linededup.digests(frame(spark, docs)).collect()}
    units = {i: t.split("\n") if t else [] for i, t in docs}
    for i, covered in later_starts(units, 3).items():
        kept = [w for w, c in zip(units[i], covered, strict=True) if not c]
        r = got[i]
        assert (r["n_lines"], r["n_removed"], r["kept_sha256"]) == (len(units[i]), sum(covered), hashlib.sha256("\n".join(kept).encode()).hexdigest()), i
    df = frame(spark, docs, extra=True)
    out = linededup.deduped(df)
    assert same_columns(out, df) and out.count() == len(docs)


def test_rows_of_one_id_are_told_apart(spark):
    a, b = "one\ntwo\nthree\nfour", "five\nsix\nseven\neight"
    rows = {(r["doc_id"], r["n_removed"]) for r in linededup.digests(frame(spark, [(1, a), (1, b), (2, a), (None, b)])).collect()}
    assert rows == {(1, 0), (1, 4), (2, 4), (None, 0)}


@pytest.mark.parametrize("run", [bytededup.digests, substringdedup.digests, linededup.digests, simhash.digests, fingerprint.against_next])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def simhash_plain(text: str | None, size: int) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_plain(prints: dict, radius: int) -> dict:
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [4, 22])
def test_simhash_groups(spark, radius):
    docs = odd_documents(5, 90)
    prints = {i: simhash_plain(t, 4) for i, t in docs}
    expected = components_plain(prints, radius)
    for r in simhash.digests(frame(spark, docs), radius=radius).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", expected[r["doc_id"]])


def test_simhash_tiles_are_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100, dtype=np.uint64))
    f = np.concatenate([base, near])[:, None]
    label = simhash.tile_links(f, f, 3, True)
    expected = components_plain({i: int(x) for i, x in enumerate(f[:, 0])}, 3)
    assert label.tolist() == [expected[i] for i in range(len(f))]
    two = simhash.tile_links(f[:300], f[300:], 3, False)
    assert (two[300:][: len(near)] == np.arange(100)).all()


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    clean = [" ".join(word() for _ in range(120)) for _ in range(30)]
    docs = list(enumerate(clean))
    for k in range(10):
        w = clean[k].split()
        w[60] = "changed"
        docs.append((100 + k, " ".join(w)))
    docs += [(200, None), (201, ""), (202, clean[0])]
    df = frame(spark, docs, extra=True)
    out = simhash.deduped(df)
    assert same_columns(out, df)
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(30), 200]


def test_decontamination(spark):
    item = "One two, three four five six seven eight nine ten eleven twelve"
    items = [(7, item), (8, "short Item"), (9, None), (10, "..."), (70, item.upper())]
    docs = [
        (1, "x " + item.replace(",", " --") + " y"), (2, "one two three four five six seven eight nine"), (3, "a SHORT item! b"), (4, None), (5, ""), (6, "clean text"),
        (6, "clean text"), (11, "shortitem short  \n\titem"), (12, "zero one two three four five six seven eight nine ten"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.digests(frame(spark, docs), bench).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) for i in (1, 2, 3, 4, 11, 12)] == [
        (14, 12, 2, sha("7,70"), True), (9, 0, 0, empty, False), (4, 2, 1, sha("8"), True), (0, 0, 0, empty, False), (3, 2, 1, sha("8"), True), (11, 10, 2, sha("7,70"), True),
    ]
    df = frame(spark, docs, extra=True)
    kept = decontaminate.clean(df, bench)
    assert same_columns(kept, df) and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 6]
    spans = decontaminate.hits(frame(spark, docs), bench).where("doc_id = 3").first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(2, 12)]


def test_decontamination_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 1)
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta")], "item_id long, text string")
    docs = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, "delta x")]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.digests(frame(spark, docs), bench).collect())
    assert got == [(1, 3, 3, 2), (1, 3, 3, 2), (2, 0, 0, 0), (3, 2, 1, 1)]


def test_fingerprints_of_neighbours(spark):
    docs = [(i, t) for i, t in odd_documents(4, 40) if i != 1010]
    got = {r["doc_id"]: r for r in fingerprint.against_next(frame(spark, docs)).collect()}
    ordered = sorted(docs, key=lambda d: -d[0])
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        import pyarrow as pa

        f = fingerprint.fingerprints(pa.array([text, edited, after], pa.large_string()))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f[0], f[1])
        assert r["near_edited"] == fingerprint.likeness(f[0], f[1]) and r["near_next"] == fingerprint.likeness(f[0], f[2])
        assert 0 <= r["near_next"] <= 1


def test_edit_distance():
    rng = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(70))) for _ in range(2))
        assert fingerprint.edit_distance(a, b) == plain(a, b)


def test_fingerprints_follow_edits():
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(800))
    other = " ".join(str(rng.randrange(10**6)) for _ in range(800))
    a, b, c = fingerprint.fingerprints(pa.array([text, text[:3000] + " inserted words " + text[3000:], other]))
    assert fingerprint.likeness(a, a) == 1.0
    assert fingerprint.likeness(a, b) > 0.8 > 0.5 > fingerprint.likeness(a, c)


def cheapest_by_search(roles: list[int]) -> float:
    """The least cost by trying everything."""
    best = {chat.START: 0.0}
    for r in roles:
        after: dict = {}
        for s, c in best.items():
            for price, t, *_ in chat.steps(s, r):
                after[t] = min(after.get(t, 1e9), c + price)
        best = after
    return min(c + chat._END[s][0] for s, c in best.items())


def legal(text: str) -> bool:
    roles = re.findall(r"<\|(system|user|assistant)\|>\n", text)
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return len(roles) > 0 and len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def test_chat_repair(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    names = ["system", "user", "assistant", "Human", "bot", "???", None]
    for conv in range(60):
        turns = [rng.choice(names) for _ in range(rng.randrange(1, 9))]
        rows += [(conv, k, r, f"t{conv}.{k}") for k, r in enumerate(turns)]
        expected[conv] = chat.repair([(r, f"t{conv}.{k}") for k, r in enumerate(turns)])
        assert expected[conv][0] == pytest.approx(cheapest_by_search([chat.role_of(r) for r in turns]))
        assert legal(expected[conv][1]), turns
    rows += [(500, k, rng.choice(names[:3]), f"h{k}") for k in range(3000)]  # one conversation over many partitions
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.repaired(df).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    for conv, (cost, text) in expected.items():
        parts = sorted(by[conv], key=lambda r: r["turn"])
        assert "".join(p["rendered"] for p in parts) == text
        assert sum(p["cost"] for p in parts) == pytest.approx(cost)
    hot = sorted(by[500], key=lambda r: r["turn"])
    cost, text = chat.repair([(r["role"], f"h{r['turn']}") for r in hot])
    assert sum(p["cost"] for p in hot) == pytest.approx(cost) and legal("".join(p["rendered"] for p in hot))
    assert len(got) == len(rows)


def test_chat_oddities(spark):
    rows = [(None, 0, "user", None), (1, None, None, "x"), (1, None, None, "x"), (2, 0, "assistant", "")]
    out = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 4 and {r["conv_id"] for r in out} == {None, 1, 2}
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
