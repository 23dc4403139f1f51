"""Retrieval and what is made of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as tx
from ..functions.fixed import STOPWORDS
from ..operators import rag, vector
from ..operators.relational import within_budget
from .q_vector import _BATCH, _first
from .registry import query


@query(
    "rag_sources_confidence",
    "A22 J9 X1",
    f"""{_BATCH}, h AS (SELECT query_id, vec_id, round_even(sim, 4) AS relevance FROM r WHERE rank <= 10) SELECT query_id, vec_id, relevance, source, round(avg(relevance) OVER (PARTITION BY query_id), 6) AS confidence FROM h LEFT JOIN documents ON doc_id = vec_id""",
)
def sources(t):
    hits = rag.sources(vector.nearest_many(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), 10)).drop("confidence")
    mean = hits.groupBy("query_id").agg(F.round(F.avg("relevance"), 6).alias("confidence"))
    return hits.join(mean, "query_id").join(t.documents, F.col("vec_id") == F.col("doc_id"), "left").select("query_id", "vec_id", "relevance", "source", "confidence")


_ANSWER = "text || ' see (server/app' || (conv_id % 5) || '.py:' || turn || '-' || (turn + 9) || ') and (web/x.ts:7)' || chr(10) || 'Confidence: 0.' || (conv_id % 90 + 10)"


@query(
    "rag_citations",
    "F15 F68 U6",
    f"""SELECT conv_id, turn, 'server/app' || (conv_id % 5) || '.py:' || turn || '-' || (turn + 9) || ',web/x.ts:7-7' AS cited, ('0.' || (conv_id % 90 + 10))::DOUBLE AS confidence, md5(trim(coalesce(text, '') || ' see (server/app' || (conv_id % 5) || '.py:' || turn || '-' || (turn + 9) || ') and (web/x.ts:7)')) AS answer FROM conversations""",
)
def citations(t):
    a = t.conversations.select("conv_id", "turn", F.expr(_ANSWER).alias("a"))
    c = F.array_join(F.transform(tx.citations("a"), lambda x: F.concat(x["path"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return a.select("conv_id", "turn", c.alias("cited"), tx.confidence("a").alias("confidence"), F.md5(tx.answer_text("a").cast("binary")).alias("answer"))


@query(
    "rag_cited_union",
    "U6 J9",
    """WITH f AS (SELECT conv_id, 'web/x' || turn || '.ts' AS path FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, 'web/x' || (turn + 1) || '.ts' AS path FROM conversations) SELECT conv_id, path FROM f UNION SELECT conv_id, path FROM c""",
)
def cited_union(t):
    c = t.conversations
    found = c.where("role = 'user'").select("conv_id", F.concat(F.lit("web/x"), F.col("turn").cast("string"), F.lit(".ts")).alias("path")).distinct()
    cited = c.select("conv_id", F.concat(F.lit("web/x"), (F.col("turn") + 1).cast("string"), F.lit(".ts")).alias("path"), F.col("turn").alias("seq"))
    return rag.with_cited(found, cited, ["conv_id"])


_CONTEXT = """c AS (SELECT source AS directory, 'Documents of ' || source || ' in ' || min(lang) AS description, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source)"""


def _contexts(t):
    g = t.documents.groupBy("source").agg(F.min("lang").alias("l"), F.collect_list(F.when(F.col("lang").isin("en", "fr"), F.struct(F.concat(F.lit("f_"), "lang").alias("name"), F.concat(F.lit("text "), "lang").alias("purpose")))).alias("files"))
    return g.select(F.col("source").alias("directory"), F.concat(F.lit("Documents of "), "source", F.lit(" in "), "l").alias("description"), "files", F.lit(None).cast("string").alias("error"))


@query("rag_context_search", "F64 T9", f"WITH {_CONTEXT} SELECT directory, (CASE WHEN contains(description, 'fr') THEN 2.0 ELSE 0.0 END + 2.5 * fr)::DOUBLE AS score FROM c WHERE contains(description, 'fr') OR fr > 0 ORDER BY score DESC, directory LIMIT 5")
def context_search(t):
    return rag.context_search(_contexts(t), "FR").select("directory", "score")


@query("rag_sections", "F65", "SELECT source, sum(CASE WHEN lang = 'en' THEN 1.0 + 1.5 ELSE 0.5 END)::DOUBLE AS score FROM documents GROUP BY source")
def sections(t):
    s = rag.section_score(["en", "text"], F.col("lang"), F.when(F.col("lang") == "en", "none").otherwise("some text"), F.array(F.concat(F.col("lang"), F.lit("_api"))))
    one = F.when(F.col("lang") == "en", rag.section_score(["en"], F.col("lang"), F.lit("x"), F.array(F.lit("open")))).otherwise(s)
    return t.documents.groupBy("source").agg(F.sum(one).alias("score"))


@query("rag_context_validate", "A33", f"WITH {_CONTEXT} SELECT count(*) AS total, count(*) FILTER (directory <> 'src0') AS valid, count(*) FILTER (directory = 'src0') AS invalid FROM c")
def validate(t):
    return rag.validated(_contexts(t).withColumn("error", F.when(F.col("directory") == "src0", "broken")))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


@query("rag_keywords", "F5", rf"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '' AND length(w) > 2 AND NOT list_contains({_STOP}, w))[1:5], ' ') AS keywords FROM conversations")
def keywords(t):
    return t.conversations.select("conv_id", "turn", F.array_join(tx.keywords(F.coalesce("text", F.lit(""))), " ").alias("keywords"))


@query(
    "rag_enhance_question",
    "F6 W7 X1",
    r"""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations), w AS (SELECT conv_id, turn, role, text, unnest(regexp_split_to_array(text, '\s+')) AS w, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS i FROM r WHERE k <= 3 AND role = 'user'),
t AS (SELECT conv_id, list(w ORDER BY turn, role, text, i) FILTER (contains(w, '_') OR regexp_matches(w, '^\p{Lu}')) AS t FROM w WHERE w <> '' GROUP BY conv_id), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, 'how is it done' || CASE WHEN len(t) > 0 THEN ' ' || array_to_string(t[1:5], ' ') ELSE '' END AS question FROM c LEFT JOIN t USING (conv_id)""",
)
def enhance(t):
    from ..operators.maintenance import keep_last

    last = keep_last(t.conversations, 3, [F.desc("turn"), F.asc("role"), F.asc("text")], ["conv_id"])
    # Three messages of each conversation at most are gathered.
    terms = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "role", "text")))), lambda m: tx.code_terms(m["text"])))
    return last.groupBy("conv_id").agg(terms.alias("t")).select("conv_id", tx.enhanced_question(F.lit("how is it done"), F.col("t")).alias("question"))


@query("rag_decision_exclude", "P26 U5", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS sim FROM embeddings, q) (SELECT vec_id, 'graph' AS via FROM embeddings WHERE label = 3) UNION ALL (SELECT vec_id, 'semantic' FROM s WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3) ORDER BY sim DESC, vec_id LIMIT 3)")
def exclude(t):
    seen = t.embeddings.where("label = 3").select("vec_id")
    more = rag.excluding(vector.similar(t.embeddings, _first(t)), seen, "vec_id", [F.desc("sim"), F.asc("vec_id")])
    return seen.withColumn("via", F.lit("graph")).unionByName(more.select("vec_id", F.lit("semantic").alias("via")))


@query("rag_budget_prefix", "T13", "SELECT source, doc_id, total::BIGINT AS total FROM (SELECT source, doc_id, sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 3000")
def budget(t):
    return within_budget(t.documents, ["source"], [F.col("doc_id")], F.length(F.coalesce("text", F.lit(""))), 3000).select("source", "doc_id", "total")


@query(
    "decision_file_match",
    "P9",
    """WITH r AS (SELECT sha, file || CASE sha % 4 WHEN 0 THEN '' WHEN 1 THEN ':12' WHEN 2 THEN '#L3' ELSE 'x' END AS ref, file FROM commits) SELECT sha, ref = file OR starts_with(ref, file || ':') OR starts_with(ref, file || '#') AS hit, contains(ref, '/m3/') AS segment FROM r""",
    views="commits",
)
def file_match(t):
    tail = F.element_at(F.array(F.lit(""), F.lit(":12"), F.lit("#L3"), F.lit("x")), (F.col("sha") % 4 + 1).cast("int"))
    r = t.commits.select("sha", F.concat("file", tail).alias("ref"), "file")
    return r.select("sha", tx.mentions_path("ref", "file").alias("hit"), tx.mentions_path("ref", F.lit("m3")).alias("segment"))


_SAID = """CASE sha % 4 WHEN 0 THEN 'we changed ' || file || ' because of load.' WHEN 1 THEN 'see f' || (sha % 50) || '.pyc and x' || replace(file, 'src/', '') WHEN 2 THEN 'rewrote f' || (sha % 30) || '.ts, f7.py' ELSE '' END"""


@query(
    "decision_affects_theta",
    "J6",
    f"""WITH f AS (SELECT DISTINCT file FROM commits), d AS (SELECT DISTINCT sha % 200 AS id, {_SAID} AS text FROM commits)
SELECT DISTINCT id, file AS path FROM d JOIN f ON strpos(text, file) > 0 OR strpos(text, regexp_extract(file, '[^/]*$')) > 0""",
    views="commits",
)
def affects(t):
    files = t.commits.select(F.col("file").alias("path")).distinct()
    d = t.commits.select((F.col("sha") % 200).alias("id"), F.expr(_SAID).alias("text")).distinct()
    return rag.affected_by_text(files, d)


_IMPORTED = """CASE sha % 3 WHEN 0 THEN 'f' || (sha % 40) WHEN 1 THEN 'm' || (sha % 10) || '.f' || (sha % 7) ELSE 'nothing' || (sha % 5) END"""


@query(
    "import_loose_link",
    "J17",
    f"""WITH n AS (SELECT file AS id, regexp_extract(file, '[^/]*$') AS name, row_number() OVER (ORDER BY length(file), file) AS place FROM (SELECT DISTINCT file FROM commits)),
i AS (SELECT DISTINCT file AS source, {_IMPORTED} AS target FROM commits),
m AS (SELECT source, target, id, row_number() OVER (PARTITION BY source, target ORDER BY place) AS k FROM i JOIN n ON target = split_part(name, '.', 1) OR strpos(id, replace(target, '.', '/')) > 0)
SELECT DISTINCT source, id AS target FROM m WHERE k = 1 AND source <> id""",
    views="commits",
)
def loose_link(t):
    files = t.commits.select(F.col("file").alias("id")).distinct()
    nodes = files.select("id", tx.basename("id").alias("name"), F.struct(F.length("id"), "id").alias("place"))
    return rag.loose_imports(t.commits.select(F.col("file").alias("source"), F.expr(_IMPORTED).alias("name")), nodes)


@query("impact_narrative", "X8 A32", "SELECT p_brand AS file, count(*) AS total, count(*) FILTER (p_size > 45) AS high, CASE WHEN count(*) FILTER (p_size > 45) > 0 THEN 'Changing this file affects ' || count(*) || ' file(s), ' || count(*) FILTER (p_size > 45) || ' of them at high risk. Review these first.' ELSE 'Changing this file affects ' || count(*) || ' file(s), none of them at high risk.' END AS narrative FROM part GROUP BY p_brand")
def narrative(t):
    g = t.part.groupBy(F.col("p_brand").alias("file")).agg(F.count("*").alias("total"), F.sum(F.when(F.col("p_size") > 45, 1).otherwise(0)).alias("high"))
    return rag.narrative(g)


@query("confidence_fallback", "F68", "SELECT vec_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN label = 0 THEN 0.25::DOUBLE ELSE label / 5.0::DOUBLE END)) AS confidence FROM embeddings")
def fallback(t):
    return t.embeddings.select("vec_id", scores.clamp01(F.when(F.col("label") == 0, 0.25).otherwise(F.col("label") / 5.0)).alias("confidence"))
