"""Source trees walked and read by tasks: no folder is listed and no file read on the driver.

The walk goes in rounds.  In each, tasks list the folders that are known, go down into what
they find as long as they have seen fewer than `BUDGET` entries, and hand the rest back as
folders for the next round; so a small tree is one round and a large one spreads over tasks.
Empty files and names that begin with an underscore or a dot are entries like any other.
What can't be listed or read is a row with an error.
"""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut

#: Entries that a task lists before it hands folders back.
BUDGET = 20_000

#: Bytes of files that are in one batch, about.
BATCH_BYTES = 16 << 20

ENTRY = "path string, type string, size long, modified timestamp, error string"
FILE = "path string, size long, modified timestamp, content binary, error string"


def store(uri: str):
    """pyarrow's file system of a root and the root's path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/") or "/"
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
    found, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return found, path.rstrip("/")


def skipped(name: str) -> bool:
    """Whether a folder of this name isn't gone into."""
    return name in fixed.SKIPPED_FOLDERS or name.startswith(".")


def _leads(folder: str, wanted: list[str]) -> bool:
    """Whether paths in or below the folder may begin with one of the wanted beginnings."""
    inside = f"{folder}/" if folder else ""
    return any(inside.startswith(w) or w.startswith(inside) for w in wanted)


def _rows(entries: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
    columns = list(zip(*entries, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "type", "size", "modified", "error"])


def entries(spark: SparkSession, root: str, prune: bool = True, beginnings: list[str] | None = None) -> DataFrame:
    """path (below root), type (file, directory), size, modified and error of all entries below a root.

    prune: skipped and dotted folders aren't gone into. beginnings: only paths that begin with
    one of these; other folders aren't listed.
    """
    budget = BUDGET

    def run(batches):
        from pyarrow import fs

        files, base = store(root)
        for b in batches:
            todo, seen, out = b.column(0).to_pylist(), 0, []
            while todo:
                folder = todo.pop()
                if seen >= budget:
                    out.append((folder, "unlisted", None, None, None))
                    continue
                try:
                    found = files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=False))
                except OSError as e:
                    out.append((folder, "directory", None, None, str(e)[:200]))
                    continue
                seen += 1 + len(found)
                for f in found:
                    path = f"{folder}/{f.base_name}" if folder else f.base_name
                    at = f.mtime.astimezone(datetime.UTC) if f.mtime else None
                    if f.type == fs.FileType.Directory:
                        if prune and skipped(f.base_name) or beginnings is not None and not _leads(path, beginnings):
                            continue
                        todo.append(path)
                        if beginnings is None or any(path.startswith(w) for w in beginnings):
                            out.append((path, "directory", None, at, None))
                    elif f.type == fs.FileType.File and (beginnings is None or any(path.startswith(w) for w in beginnings)):
                        out.append((path, "file", f.size, at, None))
                if len(out) >= 5000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    known, frontier = None, spark.createDataFrame([("",)], "path string")
    while True:
        found = cut(frontier.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, ENTRY))
        known = found if known is None else known.unionAll(found)
        frontier = found.where("type = 'unlisted'").select("path")
        if frontier.isEmpty():
            return known.where("type <> 'unlisted'")


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """path, size, modified, content and error of these files (path, size, modified); a file that can't be read has no content."""

    def run(batches):
        where, base = store(root)
        for b in batches:
            out, held = [], 0
            for k, path in enumerate(b.column(0).to_pylist()):
                try:
                    with where.open_input_stream(f"{base}/{path}") as f:
                        data, error = f.readall() if hasattr(f, "readall") else f.read(), None
                except OSError as e:
                    data, error = None, str(e)[:200]
                out.append((k, data, error))
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield _contents(b, out)
                    out, held = [], 0
            if out:
                yield _contents(b, out)

    spread = files.select("path", "size", "modified").repartition(max(1, spark.sparkContext.defaultParallelism) * 4, "path")
    return spread.mapInArrow(run, FILE)


def _contents(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    own = b.take(pa.array([k for k, _, _ in rows]))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array([d for _, d, _ in rows], pa.binary()), pa.array([e for _, _, e in rows], pa.string())], ["path", "size", "modified", "content", "error"])


def with_folders(files: DataFrame) -> DataFrame:
    """path, name, type and size of entries, each folder once."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "type", "size")


def write(rows: DataFrame, root: str) -> int:
    """Writes rows (path, content binary) as files below a root, each in the task that has it; returns how many."""

    def run(batches):
        files, base = store(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(f"{base}/{path}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
