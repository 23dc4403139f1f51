"""Host rules, periodic runs and keyed upserts against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from strataline.llm import hostrules, periods, queries, upsert

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- host rules ------------------------------------------------------------------------------


def host_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") * rng.randrange(2, 6) + rng.choice(["", "é", "d", "日"]) + "#" * (rng.random() < 0.05)
    rows = []
    for i in range(220):
        words = [word() for _ in range(rng.choice([0, 3, 9, 10, 12, 60, 200]))]
        if rng.random() < 0.4:
            words += words[:7] + [word()] + words[:7]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t \n", "\r\n", "\x0b"]) for w in words)
        if rng.random() < 0.4:
            text += "\none line\n\n \none line\none line"
        rows.append((i, text, rng.choice(["big"] * 5 + ["a", "b", "c", None])))
    rows += [(1000 + i, "too few" if i % 7 else "one two three four five six seven eight nine ten eleven", "bad") for i in range(60)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, " \n\t\x0c", None), (2003, "word " * 3000, "a"), (2003, "word " * 3000, "a"), (None, "a b c d e f g h i j k", "once"), (2004, "short", "small")]
    rows += [(3000 + i, " ".join(word() for _ in range(20)), "fine") for i in range(30)]
    return rows


def host_verdicts(rows: list[tuple], measures: list[tuple]) -> dict:
    """Hosts' verdicts by the formulas of the module's docstring."""
    fails: dict = {}
    for (_, _, host), (n, chars, symbols, lines, copies, repeats) in zip(rows, measures, strict=True):
        if host is not None:
            fails.setdefault(host, []).append((n < 10, 100 * repeats > 20 * n, 10 * symbols > n, 10 * copies > 3 * lines, n > 0 and not 3 * n <= chars <= 10 * n))
    verdict = dict.fromkeys(fails, True)
    for rule in range(5):
        x = {h: sum(f[rule] for f in v) for h, v in fails.items()}
        n = {h: len(v) for h, v in fails.items()}
        total, k = sum(n.values()), len(n)
        m = sum(x.values()) / total
        spread = total - sum(v * v for v in n.values()) / total
        between = (sum(n[h] * (x[h] / n[h] - m) ** 2 for h in n) - (k - 1) * m * (1 - m)) / spread if spread else -1
        for h in n:
            rate = m
            if between > 1e-15 and m * (1 - m) > 0:
                strength = max(0, m * (1 - m) / between - 1)
                rate = (x[h] + m * strength) / (n[h] + strength)
            if rate > 0.5:
                verdict[h] = False
    return verdict


def plain_measures(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows: dict = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(repeated)


def test_host_rules(spark):
    rows = host_rows()
    measures = [plain_measures(t) for _, t, _ in rows]
    verdict = host_verdicts(rows, measures)
    assert not verdict["bad"] and verdict["fine"]
    want = []
    for (i, _, host), (n, chars, symbols, _, copies, repeats) in zip(rows, measures, strict=True):
        failed = n < 10 or 100 * repeats > 20 * n
        want.append((i, n, chars, symbols, copies, repeats, failed, not failed and verdict.get(host, True), verdict.get(host, True)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in hostrules.digests(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    assert sorted((tuple(None if v is pd.NA else v for v in r) for r in con.execute(hostrules.ORACLE).fetchall()), key=str) == sorted(want, key=str)


def test_host_rules_keep_rows_whole(spark, monkeypatch):
    """All columns of the rows that stay, whatever their names; verdicts met by a shuffle as well."""
    rows = host_rows(4)
    names = ("host", "n_words", "_words", "own", "Text_", "kept", "prior", "_t", "n_lines", "host_kept")
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(2)
    want = sorted((str(r["doc_id"]) for r in hostrules.judged(df).where("kept").collect()))
    for size in (8 << 20, -1):
        monkeypatch.setattr(hostrules, "BROADCAST_BYTES", size)
        out = hostrules.filtered(df)
        got = out.collect()
        assert out.columns == df.columns and all(tuple(r)[3:] == names for r in got)
        assert sorted(str(r["doc_id"]) for r in got) == want
    empty = df.limit(0)
    assert hostrules.digests(empty).collect() == [] and hostrules.filtered(empty).collect() == []
    assert hostrules.digests(df.where("source is null")).where("NOT host_kept").isEmpty()
    one = hostrules.digests(df.where("source = 'bad'"))  # one host has no other to be shrunk towards
    assert {r["host_kept"] for r in one.collect()} == {False}


def test_a_small_host_is_shrunk(spark):
    """One short document doesn't condemn a host among good ones; many do."""
    good = " ".join(f"word{k}" for k in range(30))
    rows = [(i, good, f"host{i % 20}") for i in range(400)] + [(500, "short", "lone")] + [(600 + i, "short", "junk") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["host"]: r["host_kept"] for r in hostrules.judged(df).collect()}
    assert got["junk"] is False and got["host3"] is True
    mixed = rows[:400] + [(700 + i, "short" if i % 3 else good, f"part{i // 3 % 8}") for i in range(48)] + [(500, "short", "lone")]
    rates = {r["host"]: r["rates"]["few_words"] for r in hostrules.hosts(hostrules.measured(spark.createDataFrame(mixed, df.schema))).collect()}
    assert 0 < rates["lone"] < 1 and 0 <= rates["host1"] < 0.1


# --- periodic runs ---------------------------------------------------------------------------


def plain_runs(words: list[str]) -> list[tuple]:
    """(start, length, period) of every run, found place by place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def contract_words(doc_id: int | None, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def run_row(doc_id: int | None, text: str | None) -> tuple:
    words = contract_words(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def periodic_rows() -> list[tuple]:
    rng = random.Random(12)
    rows = []
    for i in range(160):
        words: list[str] = []
        for _ in range(rng.randrange(1, 6)):
            period = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            words += (period * 8)[: rng.randrange(1, len(period) * 7)] if rng.random() < 0.7 else [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", "\t \r\n"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x"), (1004, "x " * 6), (1005, "x " * 5), (1006, "é ü " * 4), (None, "a b " * 9), (None, None), (1007, rows[5][1]), (1007, rows[5][1])]
    rows += [(1008, "a\xa0b c " * 5), (1009, "x " * 300), (1010, ("p q r s t " * 40) + "u " + "p q " * 20)]
    return rows


@pytest.mark.parametrize("lags", [2048, 3, 1])
def test_periodic_runs(spark, monkeypatch, lags):
    monkeypatch.setattr(periods, "LAGS", lags)
    rows = periodic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((run_row(*r) for r in rows), key=str)
    got = sorted((tuple(r) for r in periods.digests(df).collect()), key=str)
    assert got == want


def test_periodic_runs_at_any_block(monkeypatch):
    rng = random.Random(1)
    for block in (1, 7, 1 << 18):
        monkeypatch.setattr(periods, "BLOCK", block)
        for _ in range(150):
            words = [rng.choice("ab") for _ in range(rng.randrange(40))] * rng.randrange(1, 3)
            ids = periods.word_numbers([w.encode() for w in words])
            assert [tuple(r) for r in periods.runs_of(periods.stretches(ids, 1, len(ids))).tolist()] == plain_runs(words)


def test_collapsed_keeps_rows_and_columns(spark):
    names = ("n_words", "runs", "collapsed", "key", "found", "low", "ids")
    rows = periodic_rows()
    long = " ".join(f"w{k % 5000}" for k in range(21_000))  # 5250 lags: three ranges
    df = spark.createDataFrame([(*r, *names) for r in [*rows, (5000, long), (5000, long)]], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    out = periods.collapsed(df)
    got = out.collect()
    assert out.columns == df.columns and len(got) == len(rows) + 2 and all(tuple(r)[2:] == names for r in got)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[5000] == " ".join(f"w{k}" for k in range(5000)) and texts[1000] is None and texts[1005] == "x " * 5 and texts[1004] == "x"
    assert periods.collapsed(df.limit(0)).collect() == [] and periods.digests(df.limit(0)).collect() == []
    described = {r["doc_id"]: r for r in periods.periodic_runs(df).collect()}
    assert [tuple(r) for r in described[5000]["runs"]] == [(0, 21_000, 5000)] and described[1001]["collapsed"] == ""


def test_periodic_query_on_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(WORD.findall(r[1] or "")) < 900]
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert all(got[r[0]] == run_row(*r) for r in rows) and len(rows) > 100


# --- keyed upserts ---------------------------------------------------------------------------


def plain_upsert(clients: pd.DataFrame, changes: pd.DataFrame) -> list[tuple]:
    crc = lambda x: zlib.crc32(str(x).encode())
    m = 1 + len(clients) // 1000
    clients = clients[clients["client_id"].notna()]
    rows = sorted((r for r in clients.to_dict("records") if crc(int(r["client_id"])) % 7 > 3), key=lambda r: r["client_id"])
    starting = [rows[i : i + m] for i in range(0, len(rows), m)]
    last: dict = {}
    for c in changes[changes["client_id"].notna()].to_dict("records"):
        k = (c["seq"], c["change_id"])
        if c["client_id"] not in last or k > last[c["client_id"]][0]:
            last[c["client_id"]] = (k, c)
    files = [{int(r["client_id"]): r for r in f} for f in starting]
    firsts = [min(f) for f in files]
    for key, (_, c) in last.items():
        home = max((i for i, f in enumerate(firsts) if f <= key), default=0)
        h = crc(firsts[home]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or crc(int(c["change_id"])) % 8 < h:
            files[home].pop(int(key), None)
        else:
            row = files[home].setdefault(int(key), dict.fromkeys(clients.columns) | {"client_id": int(key)})
            files[home][int(key)] = row | {x: c[x] for x in ("source", "segment", "city", "balance")}
    null = lambda v: v is None or v != v
    same = lambda a, b: all((null(x) and null(y)) or x == y for x, y in zip(a.values(), b.values(), strict=True))
    out: list[tuple[list, bool]] = []
    for before, now in zip(starting, files, strict=True):
        old = {int(r["client_id"]): r for r in before}
        if old.keys() == now.keys() and all(same(old[k], now[k]) for k in old):
            out.append((before, False))
            continue
        now = [now[k] for k in sorted(now)]
        k = math.ceil(len(now) / m)
        for i in range(k):
            size, more = divmod(len(now), k)
            at = i * size + min(i, more)
            part = now[at : at + size + (i < more)]
            if i == 0 and out and out[-1][1] and len(out[-1][0]) + len(part) <= m:
                out[-1] = (out[-1][0] + part, True)
            else:
                out.append((part, True))
    rows = []
    for part, new in out:
        cents = sum(0 if null(r["balance"]) else math.floor(100 * r["balance"] + 0.5) for r in part)
        sums = sum(zlib.crc32("|".join("" if null(r[c]) else r[c] for c in ("source", "segment", "city")).encode()) for r in part)
        ids = ",".join(str(int(r["client_id"])) for r in part)
        rows.append((int(part[0]["client_id"]), len(part), cents, sums, hashlib.sha256(ids.encode()).hexdigest(), ",".join(clients.columns), new))
    return sorted(rows)


def shown(df) -> list[tuple]:
    return sorted((*tuple(r)[:6], r["rewritten"]) for r in df.collect())


def test_upsert_on_given_tables(spark):
    clients, changes = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("clients", "client_changes"))
    got = queries.QUERIES["op13_upsert"](spark, SF)
    assert shown(got) == plain_upsert(clients, changes)
    folder = os.path.dirname(got.first()["path"].removeprefix("file:").replace("//", "/"))
    assert sorted(f for f in os.listdir(folder) if not f.endswith(".crc") and f != "_SUCCESS") == sorted(os.path.basename(r["path"]) for r in got.collect())


def shop(seed: int, n: int, n_changes: int, wide: int = 1):
    """Clients with gaps between ids (wide times as far), changes with ties, nulls, repeats, and keys below and above all."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    ids = rng.sample(range(10, 10 + 2 * n), n)
    clients = pd.DataFrame({"extra": [f"e{i}" for i in range(n)], "client_id": ids, "source": [pick("a", "b", None) for _ in ids], "name": [pick("N", None) for _ in ids], "segment": [pick("s", "t") for _ in ids], "city": [pick("Zürich", None) for _ in ids], "balance": [pick(1.005, -2.5, None, 7.0) for _ in ids], "home": ["h"] * n})
    rows = []
    for i in range(n_changes):
        c = clients.iloc[rng.randrange(n)]
        key = pick(int(c["client_id"]), rng.randrange(0, 2 * n * wide), rng.randrange(2 * n, 2 * n + 300), 5, 5)
        rows.append((i // 2 if i % 9 == 0 else i, key, rng.randrange(3), pick("U", "I", "D", "U"), pick(c["source"], "a"), c["segment"], c["city"], pick(c["balance"], 3.0)))
    changes = pd.DataFrame(rows, columns=["change_id", "client_id", "seq", "op", "source", "segment", "city", "balance"])
    changes = changes.drop_duplicates(["client_id", "seq", "change_id"])
    return clients, pd.concat([changes, changes.iloc[:5]])


def spark_frame(spark, df: pd.DataFrame, kinds: str):
    names = [k.split()[0] for k in kinds.split(", ")]
    return spark.createDataFrame([tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in df[names].itertuples(index=False)], kinds)


CLIENTS = "extra string, client_id long, source string, name string, segment string, city string, balance double, home string"
CHANGES = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double"


@pytest.mark.parametrize(("n", "n_changes", "wide", "ranges"), [(2600, 900, 1, 1000), (2600, 4000, 3, 5), (40, 30, 1, 2)])
def test_upsert(spark, monkeypatch, n, n_changes, wide, ranges):
    monkeypatch.setattr(upsert, "RANGES", ranges)
    clients, changes = shop(n + n_changes, n, n_changes, wide)
    df = spark_frame(spark, clients, CLIENTS).unionByName(spark.createDataFrame([(None, None, "x", None, None, None, 1.0, None)], CLIENTS)).repartition(3)
    new = spark_frame(spark, changes, CHANGES).unionByName(spark.createDataFrame([(9, None, 1, "U", "x", None, None, 1.0)], CHANGES)).repartition(3)
    both = pd.concat([clients, pd.DataFrame([{"client_id": None}])])[list(clients.columns)]  # a row without a key counts for the size of files only
    want = plain_upsert(both.astype(object).where(both.notna(), None), changes)
    assert shown(upsert.digests(df, new)) == want
    assert len({r[-1] for r in want}) == 2


def test_upsert_without_rows(spark):
    clients, changes = shop(1, 200, 50)
    df, new = spark_frame(spark, clients, CLIENTS), spark_frame(spark, changes, CHANGES)
    assert upsert.digests(df.limit(0), new).collect() == []
    assert {r["rewritten"] for r in upsert.digests(df, new.limit(0)).collect()} == {False}


def test_filters_lose_no_key_and_deny_most_others(spark, tmp_path):
    df = spark.range(0, 40_000, 2)
    folder = str(tmp_path / "t")
    upsert.create(df, folder, "id", 500)
    homes = upsert.ranked(upsert.files(spark, folder, "id"), ["first"])
    assert sorted(r["n_rows"] for r in homes.collect()) == [500] * 40
    placed = upsert.with_homes(spark.range(40_000), homes, "id")
    ours = upsert._present_by_filter(placed, folder, "id", 500).collect()
    even = [r for r in ours if r["id"] % 2 == 0]
    assert len(even) == 20_000 and all(r["home"]["number"] == r["id"] // 1000 for r in even)
    assert len(ours) - len(even) < 0.05 * 20_000


def test_a_commit_that_breaks_off_is_ended(spark, tmp_path, monkeypatch):
    """New files come and old ones go, however often recovery starts; without a journal nothing has happened."""
    folder = str(tmp_path / "t")
    upsert.create(spark.range(100), folder, "id", 10)
    old = sorted(os.listdir(folder))
    spark.range(5).coalesce(1).write.parquet(f"{folder}/_staged-1")
    gone = [f"{folder}/{f}" for f in old if f.endswith(".parquet")][:9]
    assert upsert.recover(spark, folder) is False and spark.read.parquet(folder).count() == 100
    real = upsert.recover
    monkeypatch.setattr(upsert, "recover", lambda *a: None)  # the driver is lost after the journal
    upsert._commit(spark, folder, f"{folder}/_staged-1", gone)
    with pytest.raises(Exception, match="broken off"):
        upsert._commit(spark, folder, None, [])
    monkeypatch.setattr(upsert, "recover", real)
    os.remove(gone[0])  # lost again in the midst of it
    assert upsert.recover(spark, folder) is True and upsert.recover(spark, folder) is False
    assert spark.read.parquet(folder).count() == 15
    assert all(pq.read_metadata(f"{folder}/{f}").num_rows for f in os.listdir(folder) if f.endswith(".parquet"))
