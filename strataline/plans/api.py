"""One object with the engine's capabilities, over tables that a caller provides.

Language models and embedding models are hooks: without them answers consist of what
was retrieved, and every result is reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, parsing, scores
from ..functions import text as tx
from ..operators import chunking, errors, git, graph, maintenance, rag, resolve, rules, vector
from ..session import ship
from ..sources import exports, files, stores


class Engine:
    """Index, search, graph, history, rules and documentation of one project, kept under `store`."""

    def __init__(self, spark: SparkSession, store: str, project: str = "default", embed: Callable[[list[str]], list[list[float]]] | None = None, answer: Callable[[str], str] | None = None):
        self.spark, self.store, self.project = ship(spark), store.rstrip("/"), project
        self.embed, self.answer = embed, answer

    # -- index ----------------------------------------------------------------

    def chunks(self, sources: DataFrame) -> DataFrame:
        """Chunks of files (path, text): id, file_path, chunk_index, lines, type, language, text."""
        rows = parsing.flat(sources, parsing.chunks, parsing.CHUNK, "path", "text", "path").withColumnRenamed("path", "file_path")
        rows = chunking.numbered(rows, "file_path", [F.col("start_line"), F.col("end_line"), F.col("chunk_type")])
        rows = rows.withColumn("language", tx.language_of("file_path"))
        return rows.select(tx.stable_id(F.lit(self.project), "file_path", "chunk_index").alias("id"), "file_path", "chunk_index", "start_line", "end_line", "chunk_type", "language", F.col("text").alias("chunk_text"))

    def embedded(self, chunks: DataFrame) -> DataFrame:
        if self.embed is None:
            return chunks.withColumn("embedding", vector.hashed_embedding(F.col("chunk_text")))
        from ..streaming.streams import batches_of

        return batches_of(chunks, 32, self.embed, "chunk_text", "embedding", "array<double>")

    def index(self, root: str, extensions: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
        """Reads a tree, and replaces the project's chunks and graph."""
        texts = files.texts(files.source_files(self.spark, root, extensions, folders)).persist()  # read once for chunks and graph
        stores.replace(self.embedded(self.chunks(texts.select("path", "text"))), f"{self.store}/chunks")
        nodes, edges = self.project_graph(texts)
        stores.write_graph(nodes, edges, f"{self.store}/graph")
        texts.unpersist()
        return self.index_check()

    def update(self, root: str, changes: DataFrame) -> DataFrame:
        """Brings the chunks up to date with a diff (kind, path, old_path)."""
        texts = files.texts(files.source_files(self.spark, root))
        come = changes.where("kind <> 'deleted'").select("path").distinct()
        fresh = self.embedded(self.chunks(texts.join(come, "path", "left_semi").select("path", "text")))
        path = f"{self.store}/chunks"
        old = lambda v: stores.read(self.spark, path, version=v)
        stores.change(self.spark, path, lambda v: maintenance.reindexed(old(v), changes, fresh.select(old(v).columns)))
        return self.index_check()

    def index_check(self) -> DataFrame:
        return vector.stats(stores.read(self.spark, f"{self.store}/chunks"))

    def delete_index(self) -> None:
        chunks = stores.read(self.spark, f"{self.store}/chunks")
        stores.replace(chunks.limit(0), f"{self.store}/chunks")

    def estimate(self, root: str) -> DataFrame:
        texts = files.texts(files.source_files(self.spark, root))
        return maintenance.estimate(texts.select("path", F.col("lines").alias("lines")))

    def index_history(self, entry: DataFrame | None = None) -> DataFrame:
        path = f"{self.store}/history"
        if entry is not None:
            stores.append_history(entry, path, "date")
        return stores.read(self.spark, path).orderBy(F.desc("date"))

    # -- questions ------------------------------------------------------------

    def search(self, query: list[float], k: int = 10, filters: dict | None = None) -> DataFrame:
        from ..operators.relational import select

        rows = select(stores.read(self.spark, f"{self.store}/chunks"), filters=filters)
        return vector.nearest(rows, query, max(1, min(20, k)))

    def ask(self, query: list[float], k: int = 10) -> DataFrame:
        """Sources with relevance and base confidence, each with its file's neighbours in the graph."""
        hits = rag.sources(self.search(query, k).withColumn("query_id", F.lit(0)))
        _, edges = stores.read_graph(self.spark, f"{self.store}/graph")
        around = graph.neighbours(edges, 5).withColumnRenamed("node", "file_path")
        return hits.join(around, "file_path", "left").select("file_path", "start_line", "end_line", "relevance", "confidence", "imports", "imported_by").orderBy(F.desc("relevance"), "file_path")

    def context_search(self, root: str, query: str, n: int = 5) -> DataFrame:
        return rag.context_search(files.contexts(self.spark, root).where("error is null"), query, n)

    def context_validate(self, root: str) -> DataFrame:
        return rag.validated(files.contexts(self.spark, root))

    # -- graph ------------------------------------------------------------------

    def project_graph(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes (id, type, name) and edges (src, dst, type): files, modules, symbols, imports."""
        rows = texts.select("path", "text")
        found = parsing.flat(rows, parsing.imports, parsing.IMPORT, "path", "text", "path")
        imports = resolve.resolved(found.withColumnRenamed("path", "file"), rows.select("path")).where("resolved is not null and resolved <> file")
        last = graph.collapsed(imports.select(F.col("file").alias("src"), F.col("resolved").alias("dst"), F.lit("imports").alias("type"), "line"), "line").select("src", "dst", "type")
        symbols = parsing.flat(rows, parsing.symbols, parsing.SYMBOL, "path", "text", "path")
        fid = F.concat_ws(":", F.lit("fn"), "path", "name", F.col("start_line").cast("string"))
        module = F.concat(F.lit("mod:"), tx.module_of("path"))
        nodes = rows.select(F.col("path").alias("id"), F.lit("file").alias("type"), tx.basename("path").alias("name"))
        nodes = nodes.unionAll(symbols.select(fid, F.lit("function"), "name")).unionAll(rows.select(module, F.lit("module"), tx.module_of("path")).distinct())
        edges = last.unionAll(symbols.select("path", fid, F.lit("contains"))).unionAll(rows.select("path", module, F.lit("belongs_to")))
        return nodes, edges

    def with_owners(self, nodes: DataFrame, edges: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The graph with an author node and an `owns` edge for each owned file (file, owner)."""
        known = owners.join(nodes.where("type = 'file'").select(F.col("id").alias("file")), "file", "left_semi")
        author = F.concat(F.lit("author:"), tx.stable_id(F.col("owner"), short=True))
        return nodes.unionByName(known.select(author.alias("id"), F.lit("author").alias("type"), F.col("owner").cast("string").alias("name")).distinct()), edges.unionByName(known.select(author.alias("src"), F.col("file").alias("dst"), F.lit("owns").alias("type")))

    def with_decisions(self, nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The graph with a node for each decision (id, text) and edges to the files that its text names."""
        hit = rag.affected_by_text(nodes.where("type = 'file'").select(F.col("id").alias("path")), decisions)
        did = lambda c: F.concat(F.lit("dec:"), F.col(c).cast("string"))
        return nodes.unionByName(decisions.select(did("id").alias("id"), F.lit("decision").alias("type"), F.substring("text", 1, 80).alias("name"))), edges.unionByName(hit.select(did("id").alias("src"), F.col("path").alias("dst"), F.lit("affects").alias("type")))

    def impact(self, edges: DataFrame, file, commits: DataFrame | None = None, now=None, depth: int = 4) -> DataFrame:
        """Files that depend on one, with distance, risk, level and reason."""
        rank = graph.pagerank(edges)
        most = rank.agg(F.max("rank").alias("most"))
        rows = graph.distances(edges, file, depth, reverse=True).join(rank, "node").crossJoin(F.broadcast(most))
        known = commits is not None
        if known:
            recent = commits.where(F.col("date") >= now - F.expr("INTERVAL 30 DAYS")).groupBy(F.col("file").alias("node")).agg(F.count("*").alias("commits"))
            rows = rows.join(recent, "node", "left")
        rows = rows.withColumn("churn", scores.churn_factor("commits", True) if known else F.lit(1.0)).withColumn("share", F.col("rank") / F.col("most"))
        rows = rows.withColumn("risk", scores.risk("distance", "rank", "most", "churn"))
        return rows.select("node", "distance", "risk", scores.risk_level("risk").alias("level"), scores.risk_reason("distance", "share", "churn", known).alias("reason")).orderBy(F.desc("risk"), "node")

    def impact_report(self, edges: DataFrame, file, **kw) -> DataFrame:
        """The radius in numbers and words."""
        hit = self.impact(edges, file, **kw)
        n = lambda level: F.coalesce(F.sum((F.col("level") == level).cast("int")), F.lit(0)).alias(level)
        return rag.narrative(hit.agg(F.count("*").alias("total"), n("high"), n("medium"), n("low")))

    def save_impact(self, report: DataFrame) -> None:
        stores.put(report, f"{self.store}/impact", ["file"])

    def saved_impact(self, file: str) -> DataFrame:
        return stores.read(self.spark, f"{self.store}/impact").where(F.col("file") == file)

    def breaking_changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """What changed between two versions of files (path, text)."""
        side = lambda df: parsing.flat(df, parsing.signatures, parsing.SIGNATURE, "path", "text", "path")
        return resolve.api_changes(side(old), side(new), ["path"])

    # -- history ------------------------------------------------------------------

    def experts(self, blame: DataFrame, commits: DataFrame, now) -> DataFrame:
        return git.experts(git.owner_scores(blame, commits, now - F.expr("INTERVAL 90 DAYS")), 2)

    def file_history(self, commits: DataFrame, file: str, n: int = 20) -> DataFrame:
        return git.recent(commits, n, file)

    def review_status(self, staged: DataFrame, unstaged: DataFrame) -> DataFrame:
        return git.totals(git.merged_status(staged, unstaged))

    def review(self, diff: DataFrame) -> DataFrame:
        """Findings in the added lines of diffs (id, text), the worst first."""
        added = parsing.flat(diff, parsing.added_lines, parsing.ADDED, "id", "text").select(F.struct("file", "line").alias("at"), "content")
        found = rules.multi_scan(added, fixed.REVIEW_PATTERNS, key="at", text="content").drop("line").select("*", "at.file", "at.line")
        return rules.ranked(rules.deduped(found.select("file", "category", "message", "severity", "line", "matched"), [F.col("matched")], ["file"]), [F.col("file"), F.col("line")])

    # -- rules ----------------------------------------------------------------------

    def scan_snippet(self, snippets: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        return rules.multi_scan(snippets, fixed.SNIPPET_PATTERNS, key, text)

    def scan_project(self, texts: DataFrame) -> DataFrame:
        """Rules on every line of files (path, text)."""
        return rules.line_scan(texts, fixed.RULES, "path", "text")

    def scan_syntax(self, texts: DataFrame) -> DataFrame:
        return parsing.flat(texts, parsing.syntax_findings, parsing.FINDING, "path", "text")

    def compliance_report(self, findings: DataFrame) -> DataFrame:
        report = rules.histogram(findings).withColumn("project", F.lit(self.project))
        stores.put(report, f"{self.store}/compliance", ["project"])
        return stores.read(self.spark, f"{self.store}/compliance").where(F.col("project") == self.project)

    def checks(self) -> DataFrame:
        return rules.checks_table(self.spark)

    # -- metrics and documentation ------------------------------------------------------

    def health(self, texts: DataFrame, commits: DataFrame) -> DataFrame:
        """Health of files by average complexity and commits."""
        found = parsing.flat(texts, parsing.elements, parsing.ELEMENT, "path", "text", "path").where("kind <> 'class'")
        cc = found.groupBy("path").agg(F.avg("complexity").alias("cc"), F.max("complexity").alias("worst"))
        n = commits.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("commits"))
        rows = texts.select("path").join(cc, "path", "left").join(n, "path", "left").fillna(0, ["cc", "commits"])
        return rows.select("path", F.round("cc", 2).alias("average"), "worst", scores.complexity_rank("cc").alias("rank"), scores.route_health("cc", "commits").alias("health"), scores.is_route_hotspot("cc", "commits").alias("hotspot"))

    def structure(self, texts: DataFrame, has_git: bool) -> DataFrame:
        folder = tx.dirname("path")
        row = texts.agg(F.count("*").alias("total"), F.coalesce(F.sum((folder == "").cast("int")), F.lit(0)).alias("root"), F.count_distinct(F.when(folder != "", folder)).alias("folders"))
        return row.withColumn("score", scores.structure_v2(F.lit(has_git), "folders", "total", "root")).withColumn("legacy_score", scores.structure_v1(F.lit(has_git), "total", "root"))

    def doc_gaps(self, texts: DataFrame) -> DataFrame:
        """Documentation quality of functions, methods and classes."""
        found = parsing.flat(texts, parsing.elements, parsing.ELEMENT, "path", "text", "path").withColumn("id", F.concat_ws(":", "path", "kind", "name", F.col("line").cast("string")))
        parts = parsing.flat(found, parsing.docstring, parsing.DOCSTRING, "id", "doc").withColumnRenamed("params", "documented").withColumnRenamed("returns", "said")
        rows = found.join(parts, "id")
        quality = scores.doc_quality("has_doc", F.length("description"), F.size("documented"), F.size("params"), "kind", F.col("said").isNotNull(), F.lower("returns").isin("none", "void", "null"), "has_examples")
        return rows.select("path", "name", "kind", "line", quality.alias("quality")).withColumn("gap", F.col("quality") < 70)

    def export(self, elements: DataFrame, path: str, html: bool = False) -> None:
        exports.write_pages(exports.html(elements) if html else exports.markdown(elements), path)

    def runtime(self, paths: DataFrame, stats: DataFrame) -> DataFrame:
        rows = resolve.nearest_runtime(paths, stats).withColumn("alert_level", scores.alert_level("error_rate", "p99_latency_ms"))
        return rows.withColumn("summary", F.when(F.col("key").isNotNull(), scores.runtime_summary("alert_level", "error_rate", "avg_latency_ms", "last_error")).otherwise("No runtime data available for this file"))

    def onboard(self, queries: DataFrame, budget: int = 3000) -> DataFrame:
        """Files to read first: the best chunk of each over several queries, as far as a budget of characters goes."""
        from ..operators.relational import within_budget

        chunks = stores.read(self.spark, f"{self.store}/chunks").withColumn("vec_id", F.xxhash64("id"))
        hits = vector.nearest_many(chunks, queries, 10).join(chunks.select("vec_id", "file_path", "chunk_text"), "vec_id")
        best = hits.groupBy("file_path").agg(F.max("sim").alias("score"), F.max_by("chunk_text", "sim").alias("snippet")).orderBy(F.desc("score"), "file_path").limit(20)
        return within_budget(best.withColumn("_k", F.lit(1)), ["_k"], [F.desc("score"), F.asc("file_path")], F.length("snippet"), budget).drop("_k")

    def errors(self, rows: DataFrame) -> DataFrame:
        return errors.classified(rows)

    def sessions(self) -> stores.Sessions:
        return stores.Sessions(self.spark, f"{self.store}/sessions")

    def dashboard(self, commits: DataFrame) -> dict[str, DataFrame]:
        """Counts of the graph, the newest commits, and the least healthy files."""
        nodes, edges = stores.read_graph(self.spark, f"{self.store}/graph")
        return {"graph": graph.stats(nodes, edges), "commits": git.recent(commits, 10), "sessions": self.sessions().recent(5)}
