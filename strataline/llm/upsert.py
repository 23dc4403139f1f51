"""Copy-on-write keyed upsert of a folder of sorted Parquet files.

The table is one folder of Parquet files, sorted by a key of whole numbers, of `rows` rows at
most each, whose key ranges don't overlap.  A key's home is the last file that begins at or
below it, else the first.  An upsert touches the homes of the changes that change something:

1. Fences (first and last key, rows) come from the files' footers, read in tasks.  Every
   change meets its home by ranges: fences and keys are dealt by some thousand bounds taken
   from the fences, and the last fence before each key is carried along within a range.
2. Deletes of absent keys are pruned: those outside the home's fences, then those that the
   home's Bloom filter denies.  A file's filter is blocked: rows of (path, block, 64 bits), so
   filters are built by an aggregate, stored beside the folder, and met by an equal join.
3. What is left meets the homes' rows in an exact join; changes that change nothing go.
4. The homes of the surviving differences are read, merged and written again as the fewest
   files of equal sizes (larger first); neighbours that fit into one file become one.

Ranks within files come from a range sort and its partitions' counts, so no file's rows and no
run of inserts go through one task before they are dealt into files; one task writes each file,
streaming.  New files are staged in the folder under a name that readers pass over; a journal
then names what comes and what goes, and `recover` ends a commit that was broken off.

Null keys: rows of the table or of the changes without a key are left out.  Rows of a changes
table that share a key: `latest` keeps one, ties broken by all of its columns.  Extra columns
of the table are kept (null in inserted rows); of the changes only the set columns are used.
An empty table has no homes, so nothing can be put into it; empty changes rewrite nothing.
Columns may have any name: own columns travel in one struct.  The store must be one that
pyarrow opens too (footers).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpoint_dir, cut, shuffle_partitions

#: Ranges into which fences and keys are dealt to meet.
RANGES = 1000

#: Keys for each block of 64 bits of a Bloom filter, and bits set for each key: about one absent key in 50 passes.
BLOCK_KEYS = 6
BITS = 4

#: Rows of (partition, group) counts that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

FILE = "path string, first long, last long, n_rows long"


# --- the store -------------------------------------------------------------------------------


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _open(path: str):
    """pyarrow's file system and the path in it; for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """path of every data file in the folder, listed by Spark; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select(F.col("_metadata.file_path").alias("path"))


def files(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """path, first, last and n_rows of every file of the folder, from the footers' statistics."""

    def run(batches):
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                store, at = _open(path)
                with store.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                column = meta.schema.to_arrow_schema().get_field_index(key)
                stats = [s for g in range(meta.num_row_groups) if meta.row_group(g).num_rows and (s := meta.row_group(g).column(column).statistics)]
                if meta.num_rows:
                    out.append((path, min(s.min for s in stats), max(s.max for s in stats), meta.num_rows))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "first", "last", "n_rows"])

    return paths(spark, folder).mapInArrow(run, FILE)


def read(spark: SparkSession, where: str | list[str], schema: T.StructType) -> DataFrame:
    """own (a struct of the table's columns) and path of the rows of a folder or of some files."""
    where = [where] if isinstance(where, str) else where
    if not where:
        return spark.createDataFrame([], T.StructType([T.StructField("own", schema), T.StructField("path", T.StringType())]))
    rows = spark.read.schema(schema).parquet(*where)
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("own"), F.col("_metadata.file_path").alias("path"))


# --- ranks without one task for all ----------------------------------------------------------


def ranked(df: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """df with rank (from 0, by order) and total of each group; a group's rows must follow each other by order.

    A range sort is stored; a row's rank is its place in its partition, less its group's first
    place there, and what partitions before hold of the group.
    """
    spark = df.sparkSession
    group_by = [group] if group else []
    df = cut(spark, df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))
    df = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = df.groupBy("_part", *group_by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    every = Window.partitionBy(*group_by or [F.lit(0)])
    before = F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("_n").over(every)).drop("_n")
    counts = cut(spark, counts)
    small = counts.count() <= BROADCAST_ROWS
    joined = df.join(F.broadcast(counts) if small else counts, ["_part", *group_by])
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


# --- writing ---------------------------------------------------------------------------------


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK_KEYS))


def _block(key: Column, rows: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_blocks(rows)))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def filters(folder: str) -> str:
    """Where the Bloom filters of a folder's files lie."""
    return f"{folder.rstrip('/')}-bloom"


def _add_filters(spark: SparkSession, folder: str, new: list[str] | str, schema: T.StructType, key: str, rows: int) -> None:
    """Stores the filters of these files: of each block of each file the bits of its keys."""
    k = F.col("own").getField(key)
    bits = read(spark, new, schema).groupBy("path", _block(k, rows).alias("block")).agg(F.bit_or(_mask(k)).alias("bits"))
    bits.write.mode("append").parquet(filters(folder))


def _write(rows: DataFrame, key: str, n_files: int, folder: str) -> None:
    """Writes the rows (own, file) as one file for each number of file, sorted by key."""
    out = rows.repartitionById(n_files, F.col("file").cast("int")).sortWithinPartitions(F.col("own").getField(key))
    out.select("own.*").write.parquet(folder)


def create(df: DataFrame, folder: str, key: str, rows: int) -> None:
    """Writes df as a new table: files of `rows` rows, the last has the rest."""
    spark, schema = df.sparkSession, df.schema
    own = df.where(F.col(f"`{key}`").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"))
    placed = ranked(own.withColumn("key", F.col("own").getField(key)), ["key"])
    total = placed.agg(F.max("total").alias("n")).first()["n"]
    if not total:
        fs, at = _filesystem(spark, folder)
        fs.mkdirs(at(folder))
        fs.mkdirs(at(filters(folder)))
        return
    _write(placed.withColumn("file", F.expr(f"rank DIV {rows}")), key, -(-total // rows), folder)
    _add_filters(spark, folder, folder, schema, key, rows)


def _commit(spark: SparkSession, folder: str, staged: str | None, gone: list[str]) -> list[str]:
    """Puts the staged files into the folder and takes others out; a journal makes it repeatable. Returns the new paths."""
    fs, at = _filesystem(spark, folder)
    new = [s.getPath().getName() for s in fs.listStatus(at(staged)) if s.getPath().getName().endswith(".parquet")] if staged else []
    journal = at(f"{folder}/_commit.json")
    draft = at(f"{folder}/_commit-{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"staged": staged, "new": new, "gone": gone}).encode()))
    out.close()
    if not fs.rename(draft, journal):
        raise RuntimeError(f"{folder} has a commit that was broken off, or another writer; recover() ends it")
    recover(spark, folder)
    return [f"{folder}/{n}" for n in new]


def recover(spark: SparkSession, folder: str) -> bool:
    """Ends a commit that was broken off, if there is one: new files come in, replaced ones go. Safe to repeat."""
    fs, at = _filesystem(spark, folder)
    journal = at(f"{folder}/_commit.json")
    if not fs.exists(journal):
        return False
    stream = fs.open(journal)
    say = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    stream.close()
    for name in say["new"]:
        if fs.exists(at(f"{say['staged']}/{name}")):
            fs.rename(at(f"{say['staged']}/{name}"), at(f"{folder}/{name}"))
    for path in say["gone"]:
        fs.delete(at(path), False)
    if say["staged"]:
        fs.delete(at(say["staged"]), True)
    fs.delete(journal, False)
    return True


# --- the upsert ------------------------------------------------------------------------------


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's changes the one that is highest by order (then by its other columns); summed in tasks first."""
    rest = [c for c in changes.columns if c not in (key, *order)]
    last = F.max(F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])).alias("last")
    out = changes.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(last)
    return out.select(F.col("key").alias(key), *[F.col("last").getField(c).alias(c) for c in (*order, *rest)])


def with_homes(changes: DataFrame, homes: DataFrame, key: str) -> DataFrame:
    """changes with home: number, path, first and last of the file that is their key's home. homes: files, numbered by rank."""
    probabilities = [k / RANGES for k in range(RANGES)]
    bounds = homes.agg(F.percentile_approx("first", probabilities, 10 * RANGES).alias("b")).first()["b"]
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def span(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), "right").astype(np.int32))

    home = F.struct(F.col("rank").alias("number"), "path", "first", "last")
    fence = homes.select(F.col("first").cast("long").alias("k"), home.alias("home"))
    rows = changes.select(F.col(f"`{key}`").cast("long").alias("k"), F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("change"))
    both = fence.unionByName(rows, allowMissingColumns=True).withColumn("span", span("k"))
    # A span begins with a fence, so the last fence at or below a key is in the key's own span; below all fences the first counts.
    order = Window.partitionBy("span").orderBy("k", F.col("change").isNotNull())
    found = both.withColumn("home", F.last("home", ignorenulls=True).over(order)).where("change IS NOT NULL")
    lowest = fence.where("home.number = 0").agg(F.first("home").alias("home")).scalar()
    return found.select("change.*", F.coalesce("home", lowest).alias("home"))


def _present_by_filter(deletes: DataFrame, folder: str, key: str, rows: int) -> DataFrame:
    """The deletes whose key the home's fences and Bloom filter don't deny."""
    spark, k = deletes.sparkSession, F.col(f"`{key}`")
    inside = deletes.where(k.between(F.col("home.first"), F.col("home.last")))
    bits = spark.read.schema("path string, block long, bits long").parquet(filters(folder)).select(F.col("path").alias("_path"), F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    # Both sides grow with the input, so neither may be broadcast.
    met = inside.hint("merge").join(bits, (F.col("home.path") == F.col("_path")) & (_block(k, rows) == F.col("_block")))
    return met.where(F.col("_bits").bitwiseAND(_mask(k)) == _mask(k)).drop("_path", "_block", "_bits")


def _greedy(rows: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        """Each file joins its left neighbour, as grown, if both fit into one."""
        pieces = pieces.sort_values(["home", "piece"])
        into, size, at = [], 0, (0, 0)
        for home, piece, n in zip(pieces["home"], pieces["piece"], pieces["n"], strict=True):
            if into and size + n <= rows:
                size += n
            else:
                size, at = n, (home, piece)
            into.append(at)
        out = pieces[["home", "piece"]].copy()
        out["to_home"], out["to_piece"] = [x[0] for x in into], [x[1] for x in into]
        return out

    return run


def upsert(spark: SparkSession, folder: str, schema: T.StructType, changes: DataFrame, key: str, columns: list[str], rows: int, decide: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Applies changes (one for each key) to the folder; returns the paths of the new files.

    decide gets the changes with a column home (number, path, first, last of the home file) and
    returns those to apply, with a boolean column deletes; the others set `columns`.
    """
    recover(spark, folder)
    homes = ranked(files(spark, folder, key), ["first"])
    k = F.col(f"`{key}`")
    wanted = cut(spark, decide(with_homes(changes, homes, key)).select(key, "home", F.col("deletes").alias("deletes"), F.struct(*columns).alias("set")))
    maybe = _present_by_filter(wanted.where("deletes"), folder, key, rows)
    left = cut(spark, wanted.where("NOT deletes").unionByName(maybe))

    # The exact join: only the set columns of the homes that are left are read.
    some = [r["path"] for r in left.select(F.col("home.path").alias("path")).distinct().collect()]
    narrow = read(spark, some, schema).select(F.col("own").getField(key).alias("_key"), *[F.col("own").getField(c).alias(f"_own_{i}") for i, c in enumerate(columns)])
    met = left.hint("merge").join(narrow, k == F.col("_key"), "left")
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & F.col("set").getField(c).eqNullSafe(F.col(f"_own_{i}"))
    absent = F.col("_key").isNull()
    differs = F.when(F.col("deletes"), ~absent).otherwise(absent | ~same)
    differences = cut(spark, met.where(differs).select(key, "home", "deletes", "set"))

    touched = cut(spark, differences.groupBy(F.col("home.number").alias("home")).agg(F.first("home.path").alias("path")))
    gone = [r["path"] for r in touched.select("path").collect()]
    if not gone:
        return []
    base = read(spark, gone, schema).join(touched, "path").select(F.col("own").getField(key).alias("key"), F.col("own").alias("old"), F.col("home").alias("old_home"))
    new = differences.select(k.alias("key"), "deletes", "set", F.col("home.number").alias("new_home"))
    met = base.join(new, "key", "full")
    replaced = {key: F.col("key"), **{c: F.when(F.col("set").isNotNull(), F.col("set").getField(c)).otherwise(F.col("old").getField(c)) for c in columns}}
    fields = [replaced.get(f.name, F.col("old").getField(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    merged = met.where(~F.coalesce("deletes", F.lit(False))).select("key", F.coalesce("old_home", "new_home").alias("home"), F.struct(*fields).alias("own"))

    # n rows of a home become k = ceil(n / rows) files: the first n % k have one row more.
    placed = ranked(merged, ["key"], "home").withColumn("k", F.expr(f"(total + {rows - 1}) DIV {rows}"))
    placed = placed.withColumn("size", F.expr("total DIV k")).withColumn("more", F.expr("total % k"))
    piece = F.expr("IF(rank < more * (size + 1), rank DIV (size + 1), more + (rank - more * (size + 1)) DIV size)")
    placed = cut(spark, placed.withColumn("piece", piece).select("home", "piece", "own"))
    pieces = placed.groupBy("home", "piece").agg(F.count("*").alias("n"))
    # Neighbours: homes without a gap in their numbers, those that have become empty included.
    islands = ranked(touched.select("home"), ["home"]).select("home", (F.col("home") - F.col("rank")).alias("island"))
    joined = pieces.join(islands, "home").groupBy("island").applyInPandas(_greedy(rows), "home long, piece long, to_home long, to_piece long")
    joined = cut(spark, joined)
    targets = ranked(joined.select("to_home", "to_piece").distinct(), ["to_home", "to_piece"])
    names = targets.select("to_home", "to_piece", F.col("rank").alias("file"))
    staged, n = None, targets.count()
    if n:
        staged = f"{folder}/_staged-{uuid.uuid4().hex}"
        _write(placed.join(joined.join(names, ["to_home", "to_piece"]), ["home", "piece"]).select("own", "file"), key, n, staged)
    added = _commit(spark, folder, staged, gone)
    if added:
        _add_filters(spark, folder, added, schema, key, rows)
    return added


# --- the query -------------------------------------------------------------------------------

KEY, SET = "client_id", ["source", "segment", "city", "balance"]


def _decided(changes: DataFrame) -> DataFrame:
    """The contract's rule, by the checksum of the home's first key."""
    text = lambda c: F.crc32(F.col(c).cast("string"))
    df = changes.withColumn("h", text("home.first") % 16).where("h <= 7")
    return df.withColumn("deletes", F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(text("change_id") % 8 < F.col("h"), F.lit(False)))


def described(found: DataFrame) -> DataFrame:
    """The contract's columns of files with the columns path, rewritten; each file is read by one task, in stretches."""

    def run(batches):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for b in batches:
            for path, rewritten in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = _open(path)
                first, n, cents, sums, ids = None, 0, 0, 0, hashlib.sha256()
                with store.open_input_file(at) as f:
                    source = pq.ParquetFile(f)
                    names = source.schema_arrow.names
                    for rows in source.iter_batches(65_536, columns=[KEY, *SET[:3], "balance"]):
                        keys = rows[KEY].to_pylist()
                        if not keys:
                            continue
                        first = keys[0] if first is None else min(first, min(keys))
                        ids.update(("," * (n > 0) + ",".join(map(str, keys))).encode())
                        n += len(keys)
                        cents += int(np.floor(100 * pc.fill_null(rows["balance"], 0.0).to_numpy() + 0.5).astype(np.int64).sum())
                        parts = [pc.fill_null(rows[c], "") for c in ("source", "segment", "city")]
                        sums += sum(zlib.crc32(x.encode()) for x in pc.binary_join_element_wise(*parts, "|").to_pylist())
                one = [first, n, cents, sums, ids.hexdigest(), ",".join(names), path, rewritten]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, [pa.int64()] * 4 + [pa.string()] * 3 + [pa.bool_()], strict=True)], names=_DIGEST)

    _DIGEST = ["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", "rewritten"]
    return found.mapInArrow(run, "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean")


def digests(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Writes the contract's starting files into a new folder, upserts the changes, and describes every file that is there then."""
    spark = clients.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/clients-{uuid.uuid4().hex}"
    rows = 1 + clients.count() // 1000
    create(clients.where(F.crc32(F.col(KEY).cast("string")) % 7 > 3), folder, KEY, rows)
    before = cut(spark, paths(spark, folder))
    last = latest(changes.select("change_id", KEY, "seq", "op", *SET), KEY, ["seq", "change_id"])
    upsert(spark, folder, clients.schema, last, KEY, SET, rows, _decided)
    after = paths(spark, folder).join(before.withColumn("old", F.lit(True)), "path", "left")
    return described(after.select("path", F.col("old").isNull().alias("rewritten")).repartition(shuffle_partitions(spark), "path"))
