"""One query per operator over its whole table, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opporta.llm import context_tree, decontaminate, language, lines, merkle, mixing, neighbours, page_text, pieces, simhash, suffixes, token_files, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op4_decontamination", decontaminate.ORACLE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(_table(spark, sf_dir, "documents"))


@_query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


@_query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(_table(spark, sf_dir, "documents"))


@_query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


@_query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


@_query("line_dedup_whole_lines", lines.LINES_SQL)
def whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"), "lines")


@_query("line_dedup_sentences", lines.SENTENCES_SQL)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"), "sentences")


@_query("op1_page_text", page_text.ORACLE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.report(_table(spark, sf_dir, "pages"))


@_query("op10_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(_table(spark, sf_dir, "embeddings"))


@_query("op7_context_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.report(_table(spark, sf_dir, "documents"))


@_query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


@_query("op11_merkle", merkle.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


@_query("op12_pieces")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(_table(spark, sf_dir, "documents"))


@_query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"))
