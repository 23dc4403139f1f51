"""What an operator must do whatever the kind of its rows: every language, exact similarities, every range."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strataline.llm import fingerprint, simhash, toxicity

SF01 = "/root/testdata/sf0.1"


def test_toxic_recall_in_every_language(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    test = [(langs[r["doc_id"]], marks[r["doc_id"]], r["predicted"]) for r in toxicity.digests(docs, labels).collect() if r["held_out"] and r["doc_id"] in marks]
    for lang in ("en", "de", "fr", "es"):
        toxic = [p for x, y, p in test if x == lang and y == 1]
        ordinary = [p for x, y, p in test if x == lang and y == 0]
        assert len(toxic) > 5 and sum(toxic) > 0.6 * len(toxic), lang
        assert sum(ordinary) < 0.05 * len(ordinary), lang


@pytest.mark.parametrize("few", [30, 60])
def test_a_rare_language_has_its_marks(few):
    """Marks of a small part of the toxic documents, which ordinary ones hold too, but once."""
    rng = random.Random(9)
    one, two = ([("".join(rng.choice(letters) for _ in range(6))) for _ in range(300)] for letters in ("abcdefgh", "rstuvwxyz"))
    text = lambda pool, *more: " ".join(rng.sample([*rng.choices(pool, k=60), *more], 60 + len(more)))
    toxic = [text(one, "scoundrel") for _ in range(1000)] + [text(two, *["klmnoklmno"] * 5) for _ in range(few)]
    ordinary = [text(one) for _ in range(1000)] + [text(two, *["klmnoklmno"] * (k % 3 == 0)) for k in range(400)]
    assert b"klmno" in toxicity.dictionary(toxic, ordinary) and b"scoundr" in toxicity.dictionary(toxic, ordinary)
    assert b"klmno" not in toxicity.dictionary(ordinary, toxic)


def test_near_copies_are_of_exact_similarity(spark, monkeypatch):
    """Documents around 0.8, alone, in a crowd and in chains, against all pairs' Jaccard similarity."""
    monkeypatch.setattr(simhash, "SIDE", 8)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([40, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(30 if k == 0 else 2):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.uniform(0.01, 0.06)))):
                copy[at] = word()
            texts.append(" ".join(copy))
            base = copy if k % 3 == 0 else base
    texts += ["", None, "one", "one two", texts[5]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = [set(simhash.shingle_hashes(texts[i], 5)) for i in order]
    label = np.arange(len(order))
    pairs = [(i, j) for i in range(len(order)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    simhash._merge(label, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    df = spark.createDataFrame([(d, texts[i]) for d, i in enumerate(order)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduped(df).collect()) == sorted(set(label.tolist()))
    assert simhash.radius_for(0.8, 256) - 256 * 0.1515 > 3 * 5.73


def test_a_null_id_is_in_the_first_of_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "QUANTILES", 2)
    monkeypatch.setattr(fingerprint, "bucket_count", lambda total: 8)
    df = spark.createDataFrame([(i, "x") for i in range(1000, 1100)] + [(None, "y")], "doc_id long, text string")
    bucket = fingerprint._ranges(spark, df)
    got = bucket(np.array([np.iinfo(np.int64).min, *range(1000, 1100)], np.int64))
    assert got[0] == 0 and (np.diff(got) >= 0).all() and got.max() > 4


def test_sizes_keep_classes_from_being_compared(spark, monkeypatch):
    """Numbers of shingles leave out most pairs, and none that allow the similarity, at any edge of bands, blocks and tiles."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (80, simhash.LANES), dtype=np.uint64)
    fp, n = [], []
    for k, f in enumerate(base):
        size = int(np.exp(rng.uniform(3, 8))) if k % 4 else 100
        for part in (1.0, 0.8, 0.79, 0.64, 1.25, 1.26):
            g = f.copy()
            g[rng.integers(0, simhash.LANES)] ^= np.uint64(int(rng.integers(0, 1 << 62)) & 0xFFFFF)
            fp.append(g)
            n.append(max(1, round(size * part)))
    fp, n = np.array(fp), np.array(n)
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    few, many = np.minimum(n[:, None], n[None]), np.maximum(n[:, None], n[None])
    expected = np.arange(len(n))
    simhash._merge(expected, *np.nonzero((apart <= 62) & (few >= 0.8 * many - 1e-9)))
    rows = [(bytearray(f.astype(">u8").tobytes()), i, int(np.bitwise_count(f).sum()), int(s)) for i, (f, s) in enumerate(zip(fp, n, strict=True))]
    classes = spark.createDataFrame(rows, "fp binary, rep long, ones int, shingles long")
    for least in (512, 8):
        monkeypatch.setattr(simhash, "LEAST_BLOCK", least)
        links = simhash.linked(classes, 62, simhash.LANES, 0.8).collect()
        got = np.arange(len(n))
        simhash._merge(got, np.array([r["a"] for r in links]), np.array([r["b"] for r in links]))
        assert (got == expected).all()
    compared, near = [], simhash._near
    monkeypatch.setattr(simhash, "_near", lambda x, y, radius: compared.append(x.shape[1] * y.shape[1]) or near(x, y, radius))
    monkeypatch.setattr(simhash, "TILE", 16)
    assert (simhash.tile_links(fp, fp, 62, True, (n, n), 0.8) == expected).all()
    assert sum(compared) < 0.2 * len(n) ** 2
