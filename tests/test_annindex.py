"""The approximate index: what it finds, what it scores, and what it does with odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from strataline.operators import annindex, vector

KINDS = "vec_id long, embedding array<double>"


def frame(spark, m):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], KINDS).repartition(4)


def recall(index, rows, queries, **how) -> float:
    exact = {(r["query_id"], r["vec_id"]) for r in vector.nearest_many(rows, queries, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in index.search(queries, 10, **how).collect()}
    return len(exact & found) / len(exact)


def test_cells_prune_where_vectors_cluster(spark):
    """Rows around some centres: few cells and few scored rows are enough, after saving and loading as well."""
    rng = np.random.default_rng(3)
    heart = rng.standard_normal((40, 24))
    m = heart[rng.integers(0, 40, 3000)] + 0.35 * rng.standard_normal((3000, 24))
    rows = frame(spark, m)
    queries = rows.where("vec_id % 50 = 0")
    index = annindex.CodedIndex.fit(rows, cells=40)
    assert recall(index, rows, queries, probes=4, refine=60) >= 0.95
    scored = index.candidates(queries, 4, 60)
    assert scored.count() <= 60 * 60 and scored.where("query_id = vec_id").isEmpty()


def test_the_index_survives_its_session(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = frame(spark, rng.standard_normal((400, 9)))
    index = annindex.CodedIndex.fit(rows, cells=8)
    index.save(str(tmp_path / "i"))
    again = annindex.CodedIndex.load(spark, str(tmp_path / "i"), rows)
    queries = rows.where("vec_id % 50 = 0")
    want = [tuple(r) for r in index.search(queries, 5, 3, 40).orderBy("query_id", "rank").collect()]
    assert want == [tuple(r) for r in again.search(queries, 5, 3, 40).orderBy("query_id", "rank").collect()] and len(want) == 40


def test_a_hot_cell_is_many_blocks(spark, monkeypatch):
    """A third of the rows is one vector; nulls, other lengths and numbers that aren't finite are left out."""
    monkeypatch.setattr(annindex, "CODE_BLOCK", 50)
    monkeypatch.setattr(annindex, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    m = rng.standard_normal((600, 8))
    m[:200] = m[0]
    odd = spark.createDataFrame([(1000, None), (1001, [1.0]), (1002, [float("nan")] * 8), (1003, [0.0] * 8), (1004, [None] * 8), (None, [1.0] * 8)], KINDS)
    rows = frame(spark, m).unionAll(odd)
    index = annindex.CodedIndex.fit(rows, cells=6)
    sizes = [(r["cell"], len(r["ids"]) // 8) for r in index.blocks.collect()]
    assert max(n for _, n in sizes) <= 150 and sum(n for _, n in sizes) == 2 * 601
    queries = rows.where("vec_id BETWEEN 210 AND 260 OR vec_id = 1000")
    assert recall(index, rows, queries, probes=6, refine=600) == 1.0


def test_no_rows(spark):
    none = spark.createDataFrame([], KINDS)
    index = annindex.CodedIndex.fit(none, cells=4)
    assert index.search(none, 3, 2, 5).collect() == [] and vector.nearest_many(none, none, 3).collect() == []


@pytest.mark.parametrize("dimension", [1, 2, 7, 64])
def test_codes_are_close(dimension):
    m = annindex.unit(np.random.default_rng(dimension).standard_normal((50, dimension)))
    turn = annindex.rotation(dimension)
    assert np.allclose(turn @ turn.T, np.eye(dimension))
    back = annindex.decode(annindex.encode(m), dimension)
    step = 2 * annindex.SPAN / np.sqrt(dimension) / annindex.STEPS
    inside = np.abs(m) < annindex.SPAN / np.sqrt(dimension)
    assert back.shape == m.shape and (np.abs(back - m)[inside] <= step / 2 + 1e-6).all()


def test_exact_search_with_many_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = frame(spark, rng.standard_normal((300, 5)))
    want = [tuple(r) for r in vector.nearest_many(rows, rows, 4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(vector, "QUERY_BLOCK", 20)
    for size in (16 << 20, 0):
        monkeypatch.setattr(vector, "BROADCAST_BYTES", size)
        assert [tuple(r) for r in vector.nearest_many(rows, rows, 4).orderBy("query_id", "rank").collect()] == want


def test_blocks_are_bounded_and_met_one_by_one(spark, monkeypatch):
    """However many rows a batch has, blocks of rows stay small, and no more than one pair of blocks is compared at once."""
    import pyarrow as pa

    from strataline.operators import annindex, vector

    assert [b.num_rows for b in annindex.cut_up([pa.record_batch({"x": list(range(5))})], 2)] == [2, 2, 1]
    assert vector.ROW_BLOCK * vector.ROWS_AT_ONCE * 8 <= 8 << 20 and 2 * annindex.CODE_BLOCK * annindex.QUERIES_AT_ONCE * 8 <= 8 << 20
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.standard_normal(8)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    whole = sorted(map(tuple, vector.nearest_many(df, df.where("vec_id % 50 = 0"), 5).collect()))
    monkeypatch.setattr(vector, "ROW_BLOCK", 7)
    assert sorted(map(tuple, vector.nearest_many(df, df.where("vec_id % 50 = 0"), 5).collect())) == whole
