"""Vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as tx
from ..operators import annindex, vector
from ..operators.relational import small, top_per
from .registry import Tables, query

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS sim FROM embeddings, q)"


def _first(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()[0]]


@query("vec_topk_cosine", "V1 T1 F40 P7", f"WITH {_Q} SELECT vec_id, sim FROM s WHERE vec_id <> 0 ORDER BY sim DESC, vec_id LIMIT 10")
def topk(t):
    return vector.nearest(t.embeddings, _first(t), 10, "vec_id", F.col("vec_id") != 0).select("vec_id", "sim")


@query("vec_topk_filtered", "V3 P3 P4 P5", f"WITH {_Q} SELECT vec_id, label, sim FROM s WHERE vec_id <> 0 AND label IN (1, 3, 5) ORDER BY sim DESC, vec_id LIMIT 10")
def filtered(t):
    return vector.nearest(t.embeddings, _first(t), 10, "vec_id", (F.col("vec_id") != 0) & F.col("label").isin(1, 3, 5)).select("vec_id", "label", "sim")


@query("vec_threshold_join_docs", "V2 V4 J1 P6", f"WITH {_Q} SELECT vec_id, sim, lang, source FROM s JOIN documents ON doc_id = vec_id WHERE vec_id <> 0 AND sim > 0.1")
def threshold(t):
    hits = vector.similar(t.embeddings, _first(t)).where("vec_id <> 0 AND sim > 0.1")
    return hits.join(t.documents, F.col("vec_id") == F.col("doc_id")).select("vec_id", "sim", "lang", "source")


_BATCH = """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, a.vec_id, round(list_cosine_similarity(a.e, q.e), 6) AS sim FROM a, a AS q WHERE q.vec_id % 50 = 0 AND a.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)"""


@query("vec_batch_topk", "V1 V6 P25 W1", f"{_BATCH} SELECT query_id, vec_id, sim, rank::INT AS rank FROM r WHERE rank <= 5")
def batch(t):
    return vector.nearest_many(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), 5)


@query("vec_best_per_group", "V5 A23", f"{_BATCH}, k AS (SELECT r.*, label FROM r JOIN embeddings USING (vec_id) WHERE rank <= 10) SELECT label, max(sim) AS best_sim, min(vec_id) FILTER (sim = m) AS best_key FROM (SELECT *, max(sim) OVER (PARTITION BY label) AS m FROM k) GROUP BY label")
def best(t):
    hits = vector.nearest_many(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), 10).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return vector.best_per_group(hits, "label", "vec_id")


@query("vec_stats", "A26 V8", "SELECT count(*) AS n, count(*) > 0 AS has_index, max(len(embedding))::INT AS dimension FROM embeddings")
def stats(t):
    return vector.stats(t.embeddings)


@query("vec_sim_conversions", "F41", f"WITH {_Q}, d AS (SELECT vec_id, round(1 - sim, 6) AS distance FROM s) SELECT vec_id, distance, round(1 - distance, 9) AS plain, round(1 - distance / 2, 9) AS half, round(1 - least(distance, 2.0::DOUBLE) / 2, 9) AS capped FROM d")
def conversions(t):
    d = vector.similar(t.embeddings, _first(t)).select("vec_id", F.round(1 - F.col("sim"), 6).alias("distance"))
    return d.select("vec_id", "distance", F.round(scores.similarity_plain("distance"), 9).alias("plain"), F.round(scores.similarity_half("distance"), 9).alias("half"), F.round(scores.similarity_capped("distance"), 9).alias("capped"))


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'block' ELSE 'module' END"


@query(
    "vec_rerank_keyword",
    "F42 T7 V1",
    f"""WITH {_Q}, c AS (SELECT vec_id, sim, lower(text) AS content, {_KIND} AS kind FROM s JOIN documents ON doc_id = vec_id WHERE vec_id <> 0 ORDER BY sim DESC, vec_id LIMIT 10),
h AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT unnest(['the', 'and', 'of', 'license']) AS w) WHERE contains(content, w)) AS hits FROM c)
SELECT vec_id, kind, round((1 - least(round(1 - sim, 6), 2.0) / 2) * 0.6 + least(hits / 4.0::DOUBLE, 1.0) * 0.3 + CASE kind WHEN 'function' THEN 1.0 WHEN 'class' THEN 0.8 WHEN 'block' THEN 0.6 ELSE 0.5 END::DOUBLE * 0.1, 6) AS score FROM h ORDER BY score DESC, vec_id LIMIT 5""",
)
def rerank(t):
    kind = F.element_at(F.array(F.lit("function"), F.lit("class"), F.lit("block"), F.lit("module")), (F.col("doc_id") % 4 + 1).cast("int"))
    there = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"))
    rows = vector.nearest(there, _first(t), 10, "vec_id", F.col("vec_id") != 0).withColumn("kind", kind)
    words = F.split(F.lit("the and of license"), " ")
    return rows.select("vec_id", "kind", F.round(scores.rerank_score(F.round(1 - F.col("sim"), 6), "text", words, "kind"), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(5)


def _index(t):
    """What an index of 64 spilled cells finds of the exact ten nearest, for all queries whose id is divisible by 50."""
    queries = t.embeddings.where("vec_id % 50 = 0")
    exact = vector.nearest_many(t.embeddings, queries, 10).select("query_id", "vec_id")
    index = annindex.CodedIndex.fit(t.embeddings, cells=64)
    hits = index.search(queries, 10, probes=28, refine=80).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return queries, index, exact.join(hits, ["query_id", "vec_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), F.count("*").alias("wanted"))


@query("vec_ann_recall", "V7")
def ann(t):
    """Recall of the index against the exact search."""
    return _index(t)[2]


@query(
    "vec_index_pruned",
    "V7",
    """SELECT count(*) AS wanted, TRUE AS found_nine_of_ten, TRUE AS scored_at_most_a_quarter FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id
ORDER BY list_cosine_similarity(q.embedding, v.embedding) DESC) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10""",
)
def pruned(t):
    """Recall at 10, and the share of (query, row) pairs that are scored, held to 0.9 and a quarter."""
    queries, index, recall = _index(t)
    pairs = F.lit(queries.count()) * (F.col("rows") - 1)
    share = index.candidates(queries, probes=28, refine=80).agg(F.count("*").alias("scored")).join(t.embeddings.agg(F.count("*").alias("rows")))
    return recall.join(share).select("wanted", (F.col("recall") >= 0.9).alias("found_nine_of_ten"), (4 * F.col("scored") <= pairs).alias("scored_at_most_a_quarter"))


@query(
    "vec_delete_files",
    "V9",
    "WITH gone AS (SELECT DISTINCT label FROM embeddings WHERE label IN (2, 4)) SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (SELECT label FROM gone) GROUP BY label",
)
def delete(t):
    return vector.delete_files(t.embeddings, t.embeddings.where("label IN (2, 4)"), "label").groupBy("label").agg(F.count("*").alias("n"))


@query("vec_hashed_embedding", "V8", None)
def hashed(t):
    rows = t.benchmark.select("item_id", vector.hashed_embedding(F.col("text"), 32).alias("embedding"))
    return rows.select("item_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length2"))


@query(
    "vec_module_overview",
    "V5 T8 P26",
    f"{_BATCH}, f AS (SELECT vec_id, max(sim) AS score FROM r WHERE rank <= 10 GROUP BY vec_id), u AS (SELECT vec_id, score FROM f UNION ALL SELECT vec_id, 0.5 FROM embeddings WHERE label = 0 AND vec_id NOT IN (SELECT vec_id FROM f)) SELECT vec_id, score FROM u ORDER BY score DESC, vec_id LIMIT 20",
)
def overview(t):
    found = vector.nearest_many(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), 10).groupBy("vec_id").agg(F.max("sim").alias("score"))
    rest = t.embeddings.where("label = 0").select("vec_id").join(found, "vec_id", "left_anti").withColumn("score", F.lit(0.5))
    return found.unionByName(rest).orderBy(F.desc("score"), "vec_id").limit(20)


@query("vec_clamped_k", "T10", "SELECT least(greatest(label * 7, 1), 20) AS n, count(*) AS rows FROM embeddings GROUP BY 1")
def clamped(t):
    return t.embeddings.select(F.least(F.greatest(F.col("label") * 7, F.lit(1)), F.lit(20)).alias("n")).groupBy("n").agg(F.count("*").alias("rows"))


@query(
    "vec_label_top3",
    "W1 T12 P1 P2",
    "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM embeddings) SELECT label, vec_id, rank::INT AS rank FROM r WHERE rank <= 3",
)
def label_top(t):
    return top_per(t.embeddings.select("label", "vec_id"), ["label"], [F.desc("vec_id")], 3)


@query(
    "vec_context_query",
    "F21",
    "SELECT doc_id, concat_ws(' | ', 'document: ' || source, 'Parameters: ' || lang || ', ' || source, 'Returns: ' || lang, left(text, 300)) AS q FROM documents",
)
def element_query(t):
    d = t.documents
    return d.select("doc_id", tx.element_query(F.lit("document"), F.col("source"), F.array("lang", "source"), F.col("lang"), F.col("text")).alias("q"))


@query("vec_small_dimension", "", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def dimension(t):
    c = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name").agg(F.count("*").alias("n"))
