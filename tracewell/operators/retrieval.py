"""Lexical retrieval baselines: token scores, top-k, truncated passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import spread


def tokens(name: Column, keep_underscore: bool = False) -> Column:
    """Distinct lower-case tokens of an entity name; of a path only the stem counts."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[A-Za-z]+$", "")
    base = F.when(F.contains(name, F.lit("/")), F.regexp_replace(stem, "[_-]", " ")).otherwise(name)
    pattern = "[^A-Za-z0-9_]+" if keep_underscore else "[^A-Za-z0-9]+"
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(base), pattern), lambda t: t != "")))


def occurrences(text: Column, token: Column) -> Column:
    """Times that the token occurs in the text, without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token))


def scores(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """query, id, score > 0: the sum over a query's distinct tokens of their occurrences in each text.

    queries: query, name; texts: id, text. Each distinct token scans the texts once, whatever the number of
    queries that have it; the tokens are a vocabulary, which stays small beside the texts.
    """
    asked = queries.select("query", F.explode(tokens(F.col("name"))).alias("token")).distinct()
    vocabulary = asked.select("token").distinct()
    low = spread(texts.select("id", F.lower("text").alias("text")))
    hits = low.join(vocabulary, F.contains(F.col("text"), F.col("token"))).select("id", "token", occurrences(F.col("text"), F.col("token")).alias("n"))
    return asked.join(hits, "token").groupBy("query", "id").agg(F.sum("n").alias("score"))


def top(scored: DataFrame, k: int | str) -> DataFrame:
    """The best k of each query by score, then id; k is a number or the name of a column."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def passages(scored: DataFrame, texts: DataFrame, k: int = 4, chars: int = 900) -> DataFrame:
    """query, id, rank, passage: the first characters of the best texts."""
    return top(scored, k).join(texts, "id").select("query", "id", "rank", F.substring("text", 1, chars).alias("passage"))


def ends(rows: DataFrame, order: str, k: int = 60) -> DataFrame:
    """The first and the last k rows by ``order``."""
    first = rows.orderBy(F.asc(order)).limit(k)
    return first.union(rows.orderBy(F.desc(order)).limit(k)).distinct()
