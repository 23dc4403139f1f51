"""Filters, joins, upserts and set operations over any tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a dimension up to which it is broadcast; more are left to the optimizer.
SMALL_ROWS = 10_000


#: Rows that one task sorts or groups; some 100 MB.
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Into how many parts so many rows are dealt by their keys; none if the session's number of parts will do."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt_by(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows of equal keys together, in so many tasks: groups, windows and joins by these keys move no row again."""
    return df if tasks is None else df.repartition(tasks, *keys)


def select(df: DataFrame, columns: list[str] | None = None, filters: dict | None = None, limit: int | None = None) -> DataFrame:
    """Columns of the rows that equal every filter, some of them if limited. A filter by None holds for nulls."""
    for key, value in (filters or {}).items():
        df = df.where(F.col(key).isNull() if value is None else F.col(key).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(key) == F.lit(value))
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit is not None else df


def select_one(df: DataFrame, columns: list[str] | None = None, filters: dict | None = None) -> DataFrame:
    return select(df, columns, filters, 1)


def optional_filter(df: DataFrame, column: str, value) -> DataFrame:
    """All rows if there is no value, else those that equal it."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A table to broadcast, if a count of at most that many rows proves it small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key. new is unique by key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the last in order. Aggregated before it is shuffled, so no key is hot."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def full_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side by key; the columns that both have come as structs l and r."""
    a = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("l"))
    b = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("r"))
    return a.join(b, keys, "full_outer")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each key in order, as long as their sizes add up to the budget at most; the first overflow ends it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= budget)


def delete(df: DataFrame, filters: dict) -> DataFrame:
    """The rows that don't equal all filters."""
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items()])
    return df.where(~test)


def update(df: DataFrame, values: dict, filters: dict) -> DataFrame:
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items()])
    return df.withColumns({k: F.when(test, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the keys that go."""
    ids = gone.select(key)
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def stamped(df: DataFrame, status: str, at: Column) -> DataFrame:
    """Rows with a new status, and when they started or were completed by it."""
    return df.withColumns(
        {
            "status": F.lit(status),
            "started_at": F.when(F.lit(status == "in_progress"), at).otherwise(F.col("started_at")),
            "completed_at": F.when(F.lit(status in ("completed", "failed")), at).otherwise(F.col("completed_at")),
        }
    )


#: Letters by which a name is looked for: all of it up to so many, so that a text meets no name but those in it.
WHOLE = 32

#: First letters of names that are broadcast, to drop all other places of texts where they are read; GRAM letters, or as few as keeps to that number.
GRAM = 6
GRAMS_SENT = 200_000


def containing(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts (key, text) and names (target, name) to key, target: which text contains which name, anywhere, as it stands.

    What `candidates` finds is whole for names of up to WHOLE letters; a longer one's texts are met
    once more by their keys for the exact test.  An empty name, or null, is in no text; rows
    without a key are left out.
    """
    maybe = candidates(texts, names)
    exact = maybe.where(F.length("name") <= WHOLE).select("key", "target")
    if not names.where(F.length("name") > WHOLE).isEmpty():
        apart = maybe.where(F.length("name") > WHOLE).distinct()
        exact = exact.unionByName(texts.join(apart, "key").where(F.contains("text", F.col("name"))).select("key", "target"))
    return exact.distinct()


def candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """key, target, name of the texts that may contain a name: those that do, if it has WHOLE letters at most.

    A name of up to WHOLE letters is met by all of its letters, so pairs come up only where the
    text holds the name, however alike the names are.  A longer one is met by the WHOLE letters of
    it that the fewest names share.  Of a text only those places travel whose first letters begin
    a name (or a longer one's letters), and only in the lengths that such names have.
    """
    known = names.select("target", "name").where("name <> ''").distinct()
    short = known.where(F.length("name") <= WHOLE).select("target", "name", F.col("name").alias("gram"))
    long = known.where(F.length("name") > WHOLE)
    if not long.isEmpty():
        held = long.select("target", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - WHOLE + 1), lambda i: F.substring("name", i, F.lit(WHOLE))))).alias("gram"))
        shared = held.groupBy("gram").agg(F.count_distinct("name").alias("n"))
        rarest = held.join(shared, "gram").groupBy("target", "name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        known = short.unionByName(rarest)
    else:
        known = short
    # Which lengths the names have that begin with some letters: a row for each beginning, with as many letters as may be sent.
    for n in range(GRAM, 0, -1):
        begun = known.select(F.substring("gram", 1, n).alias("begin"), F.length("gram").alias("n")).groupBy("begin").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
        sent = begun.limit(GRAMS_SENT + 1).count()
        if sent <= GRAMS_SENT:
            break
    if not sent:
        return texts.select("key").join(known.select("target", "name"), F.lit(False))
    texts = texts.select("key", "text").where("key IS NOT NULL AND text IS NOT NULL")
    most = known.agg(F.max(F.length("gram"))).first()[0]
    # Every place's letters, by a look ahead that takes none of them: one pass, whatever the length.
    places = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{most}}}))"), F.lit(1)))).alias("ahead"))
    begins = F.broadcast(begun) if sent <= GRAMS_SENT else begun
    # Names shorter than the beginnings have beginnings of their own length.
    sizes = sorted(r["n"] for r in begun.select(F.length("begin").alias("n")).distinct().collect())
    tried = F.array_distinct(F.array(*[F.substring("ahead", 1, k) for k in sizes]))
    found = places.select("key", "ahead", F.explode(tried).alias("begin")).join(begins, "begin")
    grams = found.select("key", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("ahead")), lambda n: F.substring(F.col("ahead"), F.lit(1), n))).alias("gram")).distinct()
    return grams.join(known, "gram").select("key", "target", "name")
