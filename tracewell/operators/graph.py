"""Traversal of edge tables: bounded reachability from many sources at once, degrees, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import Scratch


def reachability(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, include_seeds: bool = False) -> DataFrame:
    """seed, node: what each seed's start nodes reach along src -> dst.

    seeds: seed, node (a seed may have several start nodes). A start node itself counts only where it is reached
    again, as on a loop, or with ``include_seeds``. The loop runs one round a level, each on the new nodes alone,
    and ends when there are none or at ``max_depth``. Every round is written, so lineage and retries stay short;
    the number of rounds is the depth of the graph, never the number of seeds.
    """
    scratch = Scratch(edges.sparkSession)
    hop = scratch.write(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    start = scratch.write(seeds.select("seed", "node").where("node is not null").distinct(), "start")
    front, seen, depth = start, None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(hop, front["node"] == hop["src"]).select("seed", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, ["seed", "node"], "left_anti")
        front = scratch.write(step, f"front{depth}")
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
        if depth % 8 == 0:
            seen = scratch.write(seen, f"seen{depth}")
    found = start.limit(0) if seen is None else seen
    return found.unionByName(start).distinct() if include_seeds else found


def closure(edges: DataFrame, max_depth: int) -> DataFrame:
    """src, dst, dist: all pairs up to ``max_depth`` links apart with their shortest distance, by doubling.

    Round k joins the pairs that are exactly 2^k apart with all known ones, so each shortest path is found at one
    point only, and log2(max_depth) rounds are written. A node is paired with itself only where a loop leads back.
    For starts that are few beside the graph ``reachability`` does less.
    """
    scratch = Scratch(edges.sparkSession)
    known = scratch.write(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("dist", F.lit(1)), "pairs1")
    k = 1
    while k < max_depth:
        far = known.where(F.col("dist") == k)
        if far.isEmpty():
            break
        step = far.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.lit(k) + F.col("b.dist")).alias("dist"))
        k *= 2
        known = scratch.write(known.unionByName(step).groupBy("src", "dst").agg(F.min("dist").alias("dist")), f"pairs{k}")
        scratch.drop(f"pairs{k // 2}")
    return known.where(F.col("dist") <= max_depth)


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n: the number of distinct sources that point at each node, 0 included."""
    counted = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return nodes.select("node").distinct().join(counted, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def counts(labelled: dict[str, DataFrame]) -> DataFrame:
    """label, n for tables by label, with a row for their total."""
    parts = None
    for label, df in labelled.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("label").agg(F.sum("n").alias("n")).unionByName(parts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("label"), "n"))
