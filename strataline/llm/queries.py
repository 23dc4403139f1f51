"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bytededup, chat, decontaminate, fingerprint, hostrules, htmltext, linededup, periods, simhash, substringdedup, toxicity, upsert
from .common import table

#: The tokenizer file that op5 encodes with; a name in the public_tokenizers package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytededup.digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substringdedup.digests(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.digests(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(table(spark, sf_dir, "documents"))


def op13_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.digests(table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprint": op7_fingerprint,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_text": op9_html_text,
    "op10_chat": op10_chat,
    "op11_host_rules": op11_host_rules,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_upsert": op13_upsert,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_substring_dedup": substringdedup.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
    "op11_host_rules": hostrules.ORACLE,
}
