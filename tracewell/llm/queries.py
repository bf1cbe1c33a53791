"""Queries of the text problems, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import handwritten, leaks, pieces, replies, sources, tokens
from tracewell.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sources.parsed_sources(table(spark, d, "code_files")).where("not ok").select("file_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return sources.broken_rates(sources.parsed_sources(table(spark, d, "code_files")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return replies.defective_pairs(table(spark, d, "llm_replies"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judged_files(table(spark, d, "code_files"), table(spark, d, "repo_specs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("size(reasons) > 0").select("file_id")


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """Every source file with the kind of its class and what speaks against its being hand-written."""
    return _judged(spark, d).select("file_id", "repo", "n_files", "kind", F.array_join("reasons", ",").alias("reasons"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(table(spark, d, "documents"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_rates, p5_found, p7_found, p7_files, p8_ids, p9_found, p10_found, p10_pieces)}
SQL: dict[str, str] = {}
