"""Changes of node and edge tables as pure functions from the old table and the change to the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import repo_path


def upsert_nodes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows by key; a null property of the new row keeps the old value."""
    rest = [c for c in old.columns if c not in key]
    a, b = old.alias("a"), new.dropDuplicates(key).alias("b")
    joined = a.join(b, key, "full")
    return joined.select(*key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in rest])


def upsert_edges(old: DataFrame, new: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) united; a new edge without one of its nodes is passed over. Nodes: id."""
    ok = new.join(src_nodes.select(F.col("id").alias("src")), "src", "left_semi").join(dst_nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return old.select("src", "dst").union(ok.select("src", "dst")).distinct()


def replace_by_key(old: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the changed keys give way to the new ones."""
    return old.join(changed.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(changed.select(old.columns))


def prune_missing(old: DataFrame, scope: DataFrame, keep: DataFrame, scope_key: list[str], key: list[str]) -> DataFrame:
    """Within the scope only rows whose key is kept stay; others are not touched."""
    inside = old.join(scope.select(*scope_key).distinct(), scope_key, "left_semi")
    outside = old.join(scope.select(*scope_key).distinct(), scope_key, "left_anti")
    return outside.unionByName(inside.join(keep.select(*key).distinct(), key, "left_semi").select(old.columns))


def clear_outgoing(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Without the edges that begin at the sources (id); incoming ones stay."""
    return edges.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select(edges.columns)


def delete_cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) without those in ``gone`` and edges (src, dst) without any that touch them."""
    ids = gone.select("id").distinct()
    left = nodes.join(ids, "id", "left_anti")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, e.select(edges.columns)


def prune_stale(rows: DataFrame, live: DataFrame, column: str) -> DataFrame:
    """Only rows whose table (``column``) is live; an empty live list changes nothing."""
    names = live.select(F.col("name").alias(column)).distinct()
    return rows if names.isEmpty() else rows.join(names, column, "left_semi").select(rows.columns)


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Only nodes (id) that an edge points at."""
    return nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def upsert_with_stubs(policies: DataFrame, requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges policy -> requirement of policies (id, enforces list), and requirements with stubs for unknown ids."""
    edges = policies.select(F.col("id").alias("src"), F.explode("enforces").alias("dst")).where("dst is not null and trim(dst) <> ''").distinct()
    stubs = edges.select(F.col("dst").alias("id")).distinct().join(requirements.select("id"), "id", "left_anti")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in requirements.schema if f.name != "id"]
    return edges, requirements.unionByName(stubs.select("id", *rest))


def check_updates(updates: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, problem for node updates (id, label): two labels for one id, here or against the stored nodes (id, label)."""
    seen = updates.select("id", "label").union(nodes.join(updates.select("id").distinct(), "id", "left_semi").select("id", "label"))
    return seen.groupBy("id").agg(F.countDistinct("label").alias("n")).where("n > 1").select("id", F.lit("label conflict").alias("problem"))


def latest_changes(events: DataFrame) -> DataFrame:
    """path, kind, content: the last event of each path; events: path, kind, content, ts, seq."""
    return (
        events.withColumn("path", repo_path(F.col("path")))
        .groupBy("path")
        .agg(F.max_by(F.struct("kind", "content"), F.struct("ts", "seq")).alias("e"))
        .select("path", "e.kind", "e.content")
    )
