"""From import specifiers to files, and from two sets of signatures to what broke."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# What is tried after a specifier, in this order.
ENDINGS = ["", ".py", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]


def _normal(path):
    """A path without `.` parts, and with `..` parts taken back."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.array_join(
        F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when((p == "..") & (F.size(out) > 0), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))),
        "/",
    )


def candidates(imports: DataFrame, file: str = "file", specifier: str = "specifier"):
    """Each import with the paths that it may mean, by priority. Python's dots climb; JavaScript's `./` and `../` are paths."""
    spec, folder = F.col(specifier), tx.dirname(file)
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.regexp_replace(spec, r"^\.+", "")
    climbed = F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.lit(0), F.size(F.split(folder, "/")) - dots + 1)), "/")
    python = F.concat_ws("/", F.when(climbed != "", climbed), F.when(rest != "", F.replace(rest, F.lit("."), F.lit("/"))))
    base = F.when(rest.startswith("/") | (spec == "."), _normal(F.concat_ws("/", F.when(folder != "", folder), spec))).otherwise(python)
    relative = F.transform(F.array(*[F.lit(e) for e in ENDINGS]), lambda e, i: F.struct(i.alias("priority"), F.regexp_replace(F.concat(base, e), "^/+", "").alias("candidate")))
    dotted = F.replace(spec, F.lit("."), F.lit("/"))
    absolute = F.array(F.struct(F.lit(0).alias("priority"), F.concat(dotted, F.lit(".py")).alias("candidate")), F.struct(F.lit(1).alias("priority"), F.concat(dotted, F.lit("/__init__.py")).alias("candidate")))
    return imports.withColumn("_c", F.explode(F.when(spec.startswith("."), relative).otherwise(absolute))).select("*", "_c.*").drop("_c")


def resolved(imports: DataFrame, files: DataFrame, file: str = "file", specifier: str = "specifier", path: str = "path") -> DataFrame:
    """imports with the file that each means, or null.

    Exact candidates come first, then for absolute names the smallest file whose path
    ends with the name's parts: an equi-join over the files' path endings.
    """
    rows = imports.withColumn("_id", F.xxhash64(file, specifier))
    exact = candidates(rows, file, specifier).join(files.select(F.col(path).alias("candidate")), "candidate").select("_id", "priority", F.col("candidate").alias("target"))
    parts = F.split(F.regexp_replace(F.col(path), r"\.[^./]+$", ""), "/")
    tails = files.select(F.col(path).alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("tail"))
    loose = rows.where(~F.col(specifier).startswith(".")).join(tails, F.col(specifier) == F.col("tail")).select("_id", F.lit(100).alias("priority"), "target")
    best = exact.unionAll(loose).groupBy("_id").agg(F.min_by("target", F.struct("priority", "target")).alias("resolved"))
    return rows.join(best, "_id", "left").drop("_id")


def api_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """symbol, change_type, severity and description of what changed between two tables of signatures."""
    o = old.select(*keys, "symbol", F.struct("params", "required", "has_varargs", "returns", "signature").alias("o"))
    n = new.select(*keys, "symbol", F.struct("params", "required", "has_varargs", "returns", "signature").alias("n"))
    both = o.join(n, [*keys, "symbol"], "full_outer")
    tick = lambda names: F.array_join(F.transform(F.array_sort(names), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    name = F.concat(F.lit("`"), F.col("symbol"), F.lit("`"))
    added, removed = F.array_except("n.required", "o.required"), F.array_except("o.params", "n.params")
    row = lambda kind, severity, text: F.struct(F.lit(kind).alias("change_type"), F.lit(severity).alias("severity"), text.alias("description"))
    here = F.col("o").isNotNull() & F.col("n").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), row("removed_function", "breaking", F.concat(name, F.lit(" was removed.")))),
            F.when(F.col("o").isNull(), row("added_function", "non-breaking", F.concat(name, F.lit(" was added.")))),
            F.when(here & (F.size(added) > 0) & ~F.col("n.has_varargs"), row("added_required_param", "breaking", F.concat(name, F.lit(" gained required parameter(s): "), tick(added), F.lit(".")))),
            F.when(here & (F.size(removed) > 0) & ~F.col("o.has_varargs"), row("removed_param", "breaking", F.concat(name, F.lit(" removed parameter(s): "), tick(removed), F.lit(".")))),
            F.when(
                here & (F.col("o.returns") != "") & (F.col("n.returns") != "") & (F.col("o.returns") != F.col("n.returns")),
                row("changed_return_type", "breaking", F.concat(name, F.lit(" return type changed from `"), F.col("o.returns"), F.lit("` to `"), F.col("n.returns"), F.lit("`."))),
            ),
        )
    )
    return both.select(*keys, "symbol", F.explode(found).alias("c")).select(*keys, "symbol", "c.*")


def linked_names(dependencies: DataFrame, elements: DataFrame) -> DataFrame:
    """Dependencies (source, target name) with the first element of that name, in order of elements."""
    first = elements.groupBy("name").agg(F.min_by("id", "seq").alias("target_id"))
    return dependencies.join(first, dependencies.target == first.name).select("source", "target_id").where("source <> target_id").distinct()


def children(bases: DataFrame) -> DataFrame:
    """Each class with the classes that extend it."""
    return bases.groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("children"))


def nearest_runtime(files: DataFrame, stats: DataFrame, path: str = "path", key: str = "key") -> DataFrame:
    """Each file's runtime statistics: of its exact path, else of the first key that ends it or that it ends.

    A path's or key's endings are exploded, so that both directions are equi-joins.
    """
    p = files.select(F.col(path), tx.runtime_path(path).alias("_p")).distinct()
    k = stats.select(F.col(key)).distinct()

    def tails(df, name, whole):
        parts = F.length(whole)
        return df.select(F.col(name), whole.alias("_w"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), lambda i: F.substring(whole, i, 1 << 20))).alias("_tail"))

    by_key = tails(p, path, F.col("_p")).join(k.withColumnRenamed(key, "_k"), F.col("_tail") == F.col("_k")).select(path, F.col("_k").alias(key), (F.col("_w") != F.col("_k")).cast("int").alias("_r"))
    by_path = tails(k, key, F.col(key)).join(p, F.col("_tail") == F.col("_p")).select(path, key, (F.col("_w") != F.col("_p")).cast("int").alias("_r"))
    w = Window.partitionBy(path).orderBy("_r", key)
    best = by_key.unionAll(by_path).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(path, key)
    return files.join(best, path, "left").join(stats, key, "left")
