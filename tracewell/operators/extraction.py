"""Validation of what a model extracted: node and edge types, safe names, endpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.paths import is_safe_symbol

#: Fixed values.
LABELS = ("Requirement", "Policy", "Table", "Column", "File", "Function", "Class", "Method")
RELATIONS = ("GOVERNS", "ENFORCES", "IMPLEMENTED_BY", "APPLIES_TO", "USES_TABLE", "REFERENCES_COLUMN")


def unpacked(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, id, label) and edges (doc, src, rel, dst) of JSON extractions (doc, payload)."""
    v = F.try_parse_json("payload")
    nodes = F.explode(F.try_variant_get(v, "$.nodes", "array<struct<id:string,type:string>>"))
    edges = F.explode(F.try_variant_get(v, "$.edges", "array<struct<source:string,type:string,target:string>>"))
    n = extractions.select("doc", nodes.alias("n")).select("doc", "n.id", F.col("n.type").alias("label"))
    e = extractions.select("doc", edges.alias("e")).select("doc", F.col("e.source").alias("src"), F.col("e.type").alias("rel"), F.col("e.target").alias("dst"))
    return n, e


def problems(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc, item, problem: what is wrong with extracted nodes and edges; known: id of stored nodes.

    An empty result means that everything may be applied; otherwise a caller refuses all of a document or leaves
    the named items out.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    row = lambda df, cond, item, text: df.where(cond).select("doc", item.alias("item"), F.lit(text).alias("problem"))
    name: Column = F.concat_ws(" ", "src", "rel", "dst")
    ids = nodes.select("doc", "id").distinct()
    missing = lambda side: edges.join(ids.withColumnRenamed("id", side), ["doc", side], "left_anti")
    if known is not None:
        base = missing
        missing = lambda side: base(side).join(known.select(F.col("id").alias(side)).distinct(), side, "left_anti")
    parts = [
        row(nodes, blank(F.col("id")), F.coalesce("id", F.lit("")), "no id"),
        row(nodes, ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), F.coalesce("id", F.lit("")), "unknown label"),
        row(nodes, ~is_safe_symbol(F.coalesce("label", F.lit(""))), F.coalesce("id", F.lit("")), "unsafe label"),
        row(edges, ~F.coalesce(F.col("rel").isin(*RELATIONS), F.lit(False)), name, "unknown relation"),
        row(missing("src"), F.lit(True), name, "no source"),
        row(missing("dst"), F.lit(True), name, "no target"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def sanitized(c: Column, longest: int = 128) -> Column:
    """A list of numbers that is long enough to be an embedding becomes null."""
    return F.when(F.size(c) < longest, c)
