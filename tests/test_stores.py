"""Stores when writers are lost or meet."""

from __future__ import annotations

import os
import threading

import pytest

from strataline.sources import stores


def df(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, v string")


def table(spark, path):
    return sorted(tuple(r) for r in stores.read(spark, path).collect())


def test_a_writer_lost_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    stores.put(df(spark, (1, "a"), (2, "b")), path, ["id"])
    before = table(spark, path)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # after the data are written
        m.setattr(stores, "_take", lost)
        with pytest.raises(KeyboardInterrupt):
            stores.put(df(spark, (2, "c")), path, ["id"])
    assert table(spark, path) == before and len(stores.orphans(spark, path)) == 1
    with monkeypatch.context() as m:  # while the version's file is put in place
        m.setattr(os, "link", lost)
        with pytest.raises(KeyboardInterrupt):
            stores.put(df(spark, (2, "d")), path, ["id"])
    assert table(spark, path) == before and stores.versions(spark, path) == [1]
    with monkeypatch.context() as m:  # while older data are dropped
        m.setattr(stores, "_forget", lost)
        with pytest.raises(KeyboardInterrupt):
            stores.put(df(spark, (2, "e")), path, ["id"])
    assert table(spark, path) == [(1, "a"), (2, "e")]
    stores.put(df(spark, (3, "f")), path, ["id"])
    assert table(spark, path) == [(1, "a"), (2, "e"), (3, "f")]


def test_two_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    stores.put(df(spark, (0, "first")), path, ["id"])
    real, both = stores._take, threading.Barrier(2)
    waited = threading.local()

    def meet(*a):
        if not getattr(waited, "done", False):  # each has read the same version by now
            waited.done = True
            both.wait(60)
        return real(*a)

    monkeypatch.setattr(stores, "_take", meet)
    errors = []

    def write(k):
        try:
            stores.put(df(spark, (k, f"w{k}"), (9, f"w{k}")), path, ["id"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    got = dict(table(spark, path))
    assert not errors and got.keys() == {0, 1, 2, 9} and got[9] in ("w1", "w2") and stores.versions(spark, path) == [1, 2, 3]
    assert stores.orphans(spark, path) == []


def test_adding_doesn_t_write_again_what_is_there(spark, tmp_path):
    path = str(tmp_path / "v")
    row = lambda k: spark.createDataFrame([(k, [1.0, 2.0])], "k long, embedding array<double>")
    for k in range(3):
        stores.append_vectors(row(k), path)
    folders = [f for f in os.listdir(path) if f.startswith("data-")]
    assert len(folders) == 3 and sorted(r["k"] for r in stores.read(spark, path).collect()) == [0, 1, 2]


def test_old_versions_stay_for_a_while(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(7):
        stores.replace(df(spark, (k, "x")), path)
    assert stores.versions(spark, path) == [4, 5, 6, 7]
    assert stores.read(spark, path, version=5).first()["id"] == 4 and table(spark, path) == [(6, "x")]
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 4
    with pytest.raises(FileNotFoundError):
        stores.read(spark, str(tmp_path / "none"))
    assert stores.read(spark, str(tmp_path / "none"), "id long").count() == 0
