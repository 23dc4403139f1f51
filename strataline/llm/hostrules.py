"""Quality rules by host: rule failures of a host's documents, shrunk towards all hosts, decide on the host.

Every text is measured in its own row, by array functions, without a shuffle.  The
failures of each rule are summed by host (a hot host is summed in every task first).
Rates of small hosts say little, so they are shrunk: hosts' rates are taken to come from
a beta distribution whose mean and spread are estimated from all hosts by moments, for
each rule, and a host's rate becomes (failures + mean * strength) / (documents + strength).
A host goes if one of its shrunk rates exceeds `limit`; its verdict is joined back to its
documents, and those that fail a base rule go whatever their host.

A null text has no words and fails.  A null host is no host: its rows have the base
rules only.  Repeated rows count as often as they occur.  Empty tables give empty results.
No other column of the input is looked at, whatever its name.  A row's arrays are some
twenty times its text, which is what the memory of a task must hold of the longest text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words, windows and the base limits are fixed by the query's contract.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10

#: The rules, as failures of one document. The first two are base rules: a document that fails one goes by itself.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "copied_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}
BASE = ("few_words", "repeated_words")

#: A host goes if more than this share of its documents fails one rule, after shrinking.
LIMIT = 0.5

#: Bytes of host verdicts that may be broadcast; more are joined by a shuffle, whose hot hosts adaptive execution splits.
BROADCAST_BYTES = 8 << 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in windows that occur twice or more in the row's array of words.

    Windows' hashes tell which rows have none; in the others the windows themselves are
    sorted, so that equal ones are neighbours, and compared.
    """
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    df = df.withColumn("_h", F.when(n > WINDOW, hashes))
    pair = F.zip_with("_h", F.slice("_h", 2, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_pair", pair)
    four = F.zip_with("_pair", F.slice("_pair", 3, n), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, F.slice("_h", 5, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_w", F.slice(five, 1, n - WINDOW + 1)).drop("_h", "_pair")
    window = lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("x"), i.alias("i"))
    found = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), window))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), found)).drop("_w")
    same = F.zip_with("_s", F.slice("_s", 2, n), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False)))
    df = df.withColumn("_e", same)
    either = F.zip_with("_e", F.concat(F.array(F.lit(False)), F.slice("_e", 1, F.size("_e") - 1)), lambda a, b: a | b)
    at = F.array_compact(F.zip_with("_s", either, lambda s, e: F.when(e, s["i"])))
    state = lambda end, count: F.struct(end.cast("int").alias("end"), count.cast("long").alias("n"))
    step = lambda s, i: state(i + WINDOW, s["n"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"]))
    covered = F.aggregate(F.sort_array(at), state(F.lit(0), F.lit(0)), step, lambda s: s["n"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0))).drop("_s", "_e")


def measured(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, host, and MEASURES of each row's text, in columns of these names; other columns of docs go."""
    df = docs.select(*keep, F.col(host).cast("string").alias("_host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = df.withColumn("_words", F.array_remove(F.split("_t", f"[{SPACE}]+"), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.withColumn("_lines", lines)
    df = _repeated(df, "_words", "n_repeat_words")
    return df.select(
        *keep,
        F.col("_host").alias("host"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return reduce(or_, [F.expr(RULES[r]) for r in BASE])


def hosts(measures: DataFrame, limit: float = LIMIT) -> DataFrame:
    """host, documents, rates (of each rule, shrunk) and host_kept of each host in the table of measured rows."""
    fails = [F.sum(F.expr(rule).cast("long")).cast("double").alias(name) for name, rule in RULES.items()]
    sums = measures.where("host IS NOT NULL").groupBy("host").agg(F.count("*").cast("double").alias("documents"), *fails)
    n = F.col("documents")
    # Sums over hosts from which each rule's mean and its variance between hosts follow.
    moments = [F.struct(F.sum(F.col(r)).alias("x"), F.sum(F.col(r) * F.col(r) / n).alias("xx")).alias(r) for r in RULES]
    prior = sums.agg(F.struct(F.count("*").cast("double").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *moments).alias("prior"))
    df = sums.withColumn("prior", prior.scalar())
    rates = []
    for r in RULES:
        x, xx, total, nn, k = (F.col(f"prior.{c}") for c in (f"{r}.x", f"{r}.xx", "n", "nn", "k"))
        mean = x / total
        noise = mean * (1 - mean)
        spread = total - nn / total
        # What hosts differ beyond chance; where they don't, every host has the mean.
        between = F.when(spread > 0, (xx - total * mean * mean - (k - 1) * noise) / spread)
        strength = F.greatest(noise / between - 1, F.lit(0.0))
        shrunk = F.when((between > 0) & (noise > 0), (F.col(r) + mean * strength) / (n + strength)).otherwise(mean)
        rates.append(F.when(k > 1, shrunk).otherwise(F.col(r) / n).alias(r))
    df = df.select("host", n.cast("long").alias("documents"), F.struct(*rates).alias("rates"))
    return df.withColumn("host_kept", F.greatest(*[F.col(f"rates.{r}") for r in RULES]) <= limit)


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows with host_kept of their host; true where there is no host."""
    verdicts = cut(rows.sparkSession, verdicts.select("host", "host_kept"))
    bytes_ = verdicts.agg(F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0)).alias("b")).first()["b"]
    side = F.broadcast(verdicts) if bytes_ <= BROADCAST_BYTES else verdicts
    return rows.join(side, "host", "left").withColumn("host_kept", F.coalesce("host_kept", F.lit(True)))


def judged(docs: DataFrame, host: str = "source", limit: float = LIMIT) -> DataFrame:
    """doc_id, host, MEASURES, base_failed, host_kept and kept of every row."""
    rows = cut(docs.sparkSession, measured(docs, host))
    out = with_verdicts(rows, hosts(rows, limit)).withColumn("base_failed", base_failed())
    return out.select("doc_id", "host", *MEASURES, "base_failed", "host_kept", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def filtered(docs: DataFrame, host: str = "source", limit: float = LIMIT) -> DataFrame:
    """The rows of docs, with their own columns, that pass the base rules and come from hosts that are kept."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{host}`").alias("host"), F.col("text").alias("text"))
    verdicts = hosts(cut(docs.sparkSession, measured(packed, "host", ())), limit)
    rows = with_verdicts(measured(packed, "host", ("own",)), verdicts)
    return rows.where(~base_failed() & F.col("host_kept")).select("own.*")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of every row, and the host's verdict."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_kept")


def _oracle(limit: float = LIMIT) -> str:
    fails = ", ".join(f"sum(({rule})::INT)::DOUBLE AS {name}" for name, rule in RULES.items())
    moments = ", ".join(f"sum({r}) AS {r}_x, sum({r} * {r} / documents) AS {r}_xx" for r in RULES)
    steps, rates = [], []
    for r in RULES:
        steps.append(f"{r}_x / n AS {r}_m, ({r}_xx - n * ({r}_x / n) ** 2 - (k - 1) * ({r}_x / n) * (1 - {r}_x / n)) / nullif(n - nn / n, 0) AS {r}_b")
        strength = f"greatest({r}_m * (1 - {r}_m) / nullif({r}_b, 0) - 1, 0)"
        rates.append(f"CASE WHEN k <= 1 THEN {r} / documents WHEN {r}_b > 0 AND {r}_m * (1 - {r}_m) > 0 THEN ({r} + {r}_m * {strength}) / (documents + {strength}) ELSE {r}_m END")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
five AS (SELECT row, i, words[i:i + 4] AS x FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 4)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, x) AS c FROM five) WHERE c > 1),
repeated AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY row),
m AS (SELECT doc_id, host, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated USING (row)),
h AS (SELECT host, count(*)::DOUBLE AS documents, {fails} FROM m WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT count(*)::DOUBLE AS k, sum(documents) AS n, sum(documents * documents) AS nn, {moments} FROM h),
p AS (SELECT *, {", ".join(steps)} FROM s),
v AS (SELECT host, greatest({", ".join(rates)}) <= {limit} AS host_kept FROM h CROSS JOIN p),
b AS (SELECT *, ({RULES["few_words"]}) OR ({RULES["repeated_words"]}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept, coalesce(host_kept, true) AS host_kept
FROM b LEFT JOIN v USING (host)
"""


#: The same rows in DuckDB SQL.
ORACLE = _oracle()
