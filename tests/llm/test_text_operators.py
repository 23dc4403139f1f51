"""Tokens, toxicity, pages and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from strataline.llm import bpe, htmltext, toxicity
from strataline.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def coder():
    return bpe.Transducer(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def odd_texts() -> list[str]:
    rng = random.Random(4)
    out = ["", " ", "Hello  World's 123 naïve café!!<|endoftext|>x <|STARTOFTEXT|>", "é é \x00 � 😀日本", "İstanbul ß \x1c a\x85b c ᠎ ΑΣ ΟΔΟΣ"]
    out += ["".join(rng.choice("abcdefgh'! éß日1\n<|>") for _ in range(rng.randrange(600))) for _ in range(150)]
    out += ["".join(rng.choice("ainoter") for _ in range(4000)), "a" * 3000, "ab" * 2000, "!?" * 700]
    return out


def test_tokens_equal_the_library(coder, library):
    for text in odd_texts():
        ids = coder.encode(text).tolist()
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, text[:60]
        assert "".join(coder.decode(ids, joined=True)) == library.decode(expected, skip_special_tokens=False)


def test_rows_together_equal_each_alone(coder, monkeypatch):
    texts = [None, *odd_texts(), ""]
    monkeypatch.setattr(bpe, "CUT", 500)
    ids, off = coder.encode_rows(texts)
    assert len(off) == len(texts) + 1 and off[-1] == len(ids)
    for k, text in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == coder.encode(text).tolist()


def test_long_texts_in_stretches(coder, library):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("ainotéß'1") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "\n", "<|endoftext|>", "!"]) for _ in range(4000))
    parts = list(bpe.stretches(text, 300))
    assert "".join(parts) == text and len(parts) > 50
    assert np.concatenate([coder.encode(p) for p in parts]).tolist() == library.encode(text, add_special_tokens=False).ids
    assert list(bpe.stretches("x" * 1000, 300)) == ["x" * 1000] and list(bpe.stretches("", 300)) == [""]


def test_steps_may_be_forgotten(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEPS", 50)
    for text in odd_texts()[:40]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_classes_are_the_library_s(coder, library):
    """A letter between others joins them, white space goes, a number stands alone; a new letter, too, as the library has it."""
    rng = random.Random(6)
    points = [*range(1, 0x3000), *rng.sample(range(0x3000, 0xD800), 3000), *rng.sample(range(0xE000, 0x40000), 20_000), 0x323B0, 0x1E6C0, 0x16EA0, 0x1C89, 0xA7CB]
    for at in range(0, len(points), 50):
        text = " ".join(f"a{chr(p)}b !{chr(p)}!" for p in points[at : at + 50])
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, points[at]


def test_marks_are_composed_as_the_library_does(coder, library):
    """Every pair of marks after a letter, those that its composition doesn't know included; and Hangul and joined letters."""
    import unicodedata

    same = lambda text: re.sub(r"\s+", " ", coder._normal(text).decode()) == library.normalizer.normalize_str(text)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    for m in marks:
        assert same(" ".join(f"a{m}{x}" for x in marks)), hex(ord(m))
    assert coder.encode("x\u073f\u1ac4y").tolist() == library.encode("x\u073f\u1ac4y", add_special_tokens=False).ids
    rng = random.Random(7)
    joined = [c for c in map(chr, range(0x110000)) if unicodedata.decomposition(c)[:1] not in ("", "<")]
    halves = [unicodedata.normalize("NFD", c) for c in joined]
    pool = [*halves, *joined, *marks, "a", "o", "\u1100", "\u1161", "\u11a8", "\uac00"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(12))
        assert same(text), ascii(text)
    assert all(map(same, halves))


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFKC"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": None}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Transducer(str(tmp_path / "t.json"))


def test_tokens_come_before_the_word_ends(coder):
    letters = "".join(random.Random(1).choice("ainoter") for _ in range(5000))
    ids = coder.word_ids(letters.encode())
    widest = max(len(w[0]) for s in coder._states.values() for w in s.ways)
    first = [next(ids) for _ in range(20)]
    assert all(first) and coder.lookahead <= 64 and widest < coder.lookahead
    spelt = "".join(coder.surface[int(i)] for x in [*first, *ids] for i in np.frombuffer(x, "<u4"))
    assert spelt == letters + coder.end
    # What a state holds doesn't grow with the word.
    state, unsent = coder._start, 0
    for byte in letters.encode():
        state, _ = state[byte]
        unsent = max(unsent, *(len(w[2]) for w in state.ways))
    assert unsent < 12


def test_the_decoder_holds_one_letter_s_beginning(coder):
    ids = coder.encode("日本 naïve 😀")
    machine = bpe.Decoder(coder)
    assert "".join([machine.feed(ids[k : k + 1]) for k in range(len(ids))] + [machine.end()]).split() == ["日本", "naïve", "😀"]
    assert machine.end() == "" and machine.feed(ids[:0]) == ""


def test_plain_text_comes_back(coder):
    text = "the quick brown fox, naïve café 日本"
    got = "".join(coder.decode(coder.encode(text)))
    assert got.split() == ["the", "quick", "brown", "fox", ",", "naïve", "café", "日本"]


def test_bpe_digests(spark, library):
    texts = odd_texts()[:40] + [None]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    rows = bpe.digests(df, tokenizer_path()).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        e = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(e) and r["ids_sha256"] == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", "old"), (2, None, None, None)], "doc_id long, text string, memo string, decoded string")
    out = bpe.encoded(df, tokenizer_path())
    assert out.columns == ["doc_id", "text", "memo", "token_ids", "decoded"]
    assert [(r["decoded"], len(r["token_ids"])) for r in out.orderBy("doc_id").collect()] == [("a b ", 2), ("", 0)]
    none = df.where("doc_id > 9")
    assert bpe.encoded(none, tokenizer_path()).count() == 0 and bpe.digests(none, tokenizer_path()).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.digests(docs, labels).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    test = [(marks[i], r["predicted"]) for i, r in got.items() if i in marks and r["held_out"]]
    assert len(test) > 800
    assert np.mean([a == b for a, b in test]) > 0.97 and np.mean([b for a, b in test if a == 1]) > 0.8


def plain_score(model, text):
    """A score worked out letter by letter from the model's dictionaries and weights."""
    import math

    import zstandard

    words = (text or "").lower().split()
    if model.weights is None or not words:
        return 0.0
    head = bytes(range(128, 192))
    lengths = []
    for raw in model.raw:
        settings = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)
        lengths.append([len(c.compress(head + f" {w} ".encode() + bytes(range(192, 200)))) for w in words])
    gain = [b - a for a, b in zip(*lengths, strict=True)]
    most = sorted(gain, reverse=True)[:2]
    over = [sum(max(0, g - k) for g in gain) for k in (1, 2, 4)]
    n = len(gain)
    x = [1, most[0], most[-1], *(s / n**0.5 for s in over), *(math.log(1 + s) for s in over), math.log(n)]
    return 1 / (1 + math.exp(-sum(a / s * w for a, s, w in zip(x, model.scale, model.weights, strict=True))))


def test_scores_are_what_a_plain_version_gives(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    some = docs.where("doc_id % 7 = 0")
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    model_of_all = toxicity.train
    try:
        toxicity.train = lambda *_: model
        got = toxicity.digests(some, labels).collect()
    finally:
        toxicity.train = model_of_all
    assert len(got) == len(texts) > 100
    for r in got:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9)


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    toxic, ordinary = ([f"{w} day {i} and more" for i in range(60)] for w in ("nasty scoundrel", "a fine"))
    model = toxicity.Model(toxic, ordinary)
    texts = [*toxic, *ordinary, "new words", "x" * 100_000, " ".join(str(i) for i in range(5000))]
    before = [model.score(t) for t in texts]
    monkeypatch.setattr(toxicity, "REMEMBERED", 0)
    assert [model.score(t) for t in texts] == before and model.score("scoundrel nasty") > 0.5 > model.score("fine a")


def test_the_training_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    monkeypatch.setattr(toxicity, "Model", lambda toxic, ordinary: seen.extend([toxic, ordinary]))
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (5000 if i % 9 == 0 else 100)) for i in range(300)] * 2 + [(4, "4 other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    for k, texts in enumerate(seen):
        assert 15 < len(texts) <= 20 and sum(map(len, texts)) <= 2000
        ids = [int(t.split()[0]) for t in texts]
        assert len(set(ids)) == len(ids) and all(zlib.crc32(str(i).encode()) % 5 and i % 2 == 1 - k for i in ids)


def test_toxicity_oddities(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (3, "word " * 5000, None), (3, "dup", "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.digests(docs, none).collect()
    assert len(rows) == 5 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    some = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    known = spark.createDataFrame([(i, f"nasty scoundrel here {i}" if i % 2 else f"a fine day {i}") for i in range(60)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.digests(known, some).collect()}
    assert sum(got[i] == i % 2 for i in got) >= 58
    assert toxicity.accepted(docs, none).columns == docs.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy this</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1><span>by X</span></header><p><b>First   para<br>goes on<p>Second <a href="#">with link</a> &eacute;&#233;.</p>
<form><input value="v">Sign up</form><ul><li>One<li>Two</ul><div class="related-posts">See also</div><pre> a
 b </pre><!-- hidden --><div class="comments"><p>Reader says a lot of things here and there</p></div></article>
<aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_pages():
    assert htmltext.main_text(PAGE).split("\n\n") == ["Title & more", "First para goes on", "Second with link éé.", "One", "Two", "a b"]
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav><a>x</a></nav>") == ""
    dense = "<body><div><a href=x>l1</a><a href=y>l2</a></div><div><p>" + "many words are here " * 9 + "</p><p>" + "and here too " * 9 + "</p></div><div class='x'><a href=z>more</a></div></body>"
    assert htmltext.main_text(dense).count("\n\n") == 1 and "l1" not in htmltext.main_text(dense)


def test_names_of_wrappers():
    page = "<body><div class='layout has-sidebar'><article><p>All of it.</p></article><div class='sidebar'>Side</div></div><div id='comments'>Said</div></body>"
    assert htmltext.main_text(page) == "All of it."
    most = "<body><div class='banner'><p>" + "nearly all the text of the page " * 5 + "</p></div><div>x</div></body>"
    assert htmltext.main_text(most).startswith("nearly all")


@pytest.mark.parametrize("broken", ["<p", "<<<>>>", "<a href='x>text", "</p></div>", "<p>" * 3000 + "x", "<div>" * 3000 + "deep", "a < b > c & d", "<![CDATA[x", "<script>never closed", "\x00<p>nul"])
def test_broken_pages(broken):
    assert isinstance(htmltext.main_text(broken), str)


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id long, url string, html string")
    rows = htmltext.extracted(df).collect()
    assert len(rows) == 3 and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_extracted_articles_are_whole(spark):
    if not os.path.exists(DATA):
        pytest.skip("no tables")
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        import html as h

        expected = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert htmltext.main_text(r["html"]).split("\n\n") == [x for x in expected if x]


def test_pipeline(spark, tmp_path):
    """The stages in order on a small table, each against what it must keep."""
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    text = lambda n=80: " ".join(word() for _ in range(n))
    clean = {i: text() for i in range(40)}
    item = text(14)
    shared = [text(6) for _ in range(3)]
    docs = dict(clean)
    toxic = {i: f"{text(30)} horrible vermin {text(20)} vermin" for i in range(100, 160)}
    docs |= toxic
    docs[200] = clean[0]  # a copy
    docs[201] = " ".join(["changed", *clean[1].split()[1:]])  # a near copy
    docs[202] = f"{text(40)} {item} {text(40)}"  # a leak
    docs[203], docs[204] = "\n".join([text(), *shared, text()]), "\n".join([text(30), *shared, text(30)])
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(300, None, None, None, None)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(i, 1, int(i in toxic)) for i in docs], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = set(out)
    assert kept == {*clean, 203, 204, 300}
    assert out[204]["text"].count("\n") == 1 and out[203]["text"].count("\n") == 4
    assert out[5]["decoded"].split() == clean[5].split()
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.drop_toxic(spark, given, str(tmp_path)).columns == given.columns


def plain_densities(page: str) -> dict[str, float]:
    """Composite text density of each element of a well-formed page, by its id, from the definition alone."""
    import math
    import xml.etree.ElementTree as ET

    body = ET.fromstring(page)

    def text(e, links):
        if e.tag == "a":
            links = True
        parts = [(e.text or "", links)] + [x for c in e for x in [*text(c, links), (c.tail or "", links)]]
        return parts

    count = lambda parts, only: sum(len(" ".join(t.split())) for t, a in parts if a or not only)
    whole = text(body, False)
    out = {}
    for e in body.iter():
        mine = text(e, False)
        chars, linked = count(mine, False), count(mine, True)
        if not chars:
            continue
        tags, link_tags = sum(1 for _ in e.iter()) - 1, sum(1 for x in e.iter("a") if x is not e)
        base = math.log(chars / max(1, chars - linked) * linked + count(whole, True) / count(whole, False) * chars + math.e)
        ratio = chars / max(1, linked) * max(1, tags) / max(1, link_tags)
        out[e.get("id")] = chars / max(1, tags) * max(0.0, math.log(ratio) / base)
    return out


WELL_FORMED = """<body id="b"><div id="top"><a id="l1">home page</a><a id="l2">other page</a></div><div id="c"><h1 id="h">A heading of some words</h1>
<p id="p1">Many plain words stand here and go on for quite a while, <a id="l3">with a link</a> in them.</p><p id="p2">A second <b id="bold">bold</b> paragraph that is as long as the one before it, or nearly so.</p></div>
<div id="tail"><p id="p3"><a id="l4">one</a> <a id="l5">two</a> <a id="l6">three</a></p></div></body>"""


def test_densities_are_those_of_the_definition():
    expected = plain_densities(WELL_FORMED)
    import re

    order = re.findall(r'id="(\w+)"', WELL_FORMED)
    body = htmltext._find(htmltext.parse(WELL_FORMED), "body")
    nodes = htmltext.measure(body)
    assert len(nodes) == len(order)
    for node, name in zip(nodes, order, strict=True):
        assert node.density == pytest.approx(expected[name]), name
    # The subtree with the largest sum of children's densities, worked out by hand from those.
    sums = {"b": expected["top"] + expected["c"] + expected["tail"], "c": expected["h"] + expected["p1"] + expected["p2"], "tail": expected["p3"]}
    assert max(sums, key=sums.get) == "c"
    assert htmltext.main_text(WELL_FORMED).split("\n\n")[0] == "A heading of some words" and "home page" not in htmltext.main_text(WELL_FORMED)


def test_an_article_is_found_without_its_name(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        assert htmltext.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])) == htmltext.main_text(r["html"]), r["page_id"]


def test_pages_broken_in_odd_places():
    assert htmltext.main_text("<p><![CDATA[hello world") == "hello world" and htmltext.main_text("<p><![CDATA[a]]> b") == "a b"
    assert htmltext.main_text("<i>" * 30_000 + "x" + "</b>" * 30_000) == "x"
    assert htmltext.main_text("<div>" * 3000 + "deep " * 30 + "</div>" * 3000).startswith("deep deep")


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", "<p>some words</p>", "x"), (1, "u", "<p>some words</p>", "x"), (None, None, None, None), (2, None, "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted([tuple(r) for r in htmltext.extracted(df).collect()], key=str)
    assert got == sorted([(1, "u", "some words", 10), (1, "u", "some words", 10), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert htmltext.extracted(df.where("page_id > 9")).count() == 0
