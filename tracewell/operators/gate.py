"""The plan gate: declared against actual sets, and single-use tokens replayed from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.paths import gate_path


def _set(c: Column, f=lambda x: F.trim(x)) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), f), lambda x: x.isNotNull() & (x != ""))))


def evaluate(plans: DataFrame, strict: bool = True) -> DataFrame:
    """Plans with missed_files, silent_requirements and decision.

    plans: plan_id, rbac_allowed, declared_files, actual_files, declared_requirements, violated_requirements,
    enforced_policies (lists; null is empty). A plan that is not authorized is blocked; one that misses files or
    requirements is blocked if ``strict``, else warned about.
    """
    out = plans.select(
        "plan_id",
        "rbac_allowed",
        _set(F.col("declared_files"), gate_path).alias("declared_files"),
        _set(F.col("actual_files"), gate_path).alias("actual_files"),
        _set(F.col("declared_requirements")).alias("declared_requirements"),
        _set(F.col("violated_requirements")).alias("violated_requirements"),
        _set(F.col("enforced_policies")).alias("enforced_policies"),
    )
    out = out.withColumn("missed_files", F.array_except("actual_files", "declared_files")).withColumn("silent_requirements", F.array_except("violated_requirements", "declared_requirements"))
    short = (F.size("missed_files") > 0) | (F.size("silent_requirements") > 0)
    decision = F.when(~F.coalesce(F.col("rbac_allowed"), F.lit(False)), "block").when(short, "block" if strict else "warn").otherwise("allow")
    return out.withColumn("decision", decision)


def replay_tokens(events: DataFrame, ttl: float = 900.0) -> DataFrame:
    """event_id, ok, error for every consume event, in the order of time and event_id.

    events: event_id, token, kind (issue or consume), operation, files (list, of issue), path (of consume), ts
    (epoch seconds). A token lives ``max(ttl, 1)`` seconds from its issue, covers each of its files once for its
    operation, and ends when all are used. error is missing, operation, path or used. One token's events are in
    one window partition: they are as many as its uses.
    """
    life = max(float(ttl), 1.0)
    issued = events.where("kind = 'issue'").groupBy("token").agg(F.min_by(F.struct("operation", "files", "ts"), F.struct("ts", "event_id")).alias("i"))
    files = _set(F.col("i.files"), gate_path)
    asked = (
        events.where("kind = 'consume'")
        .select("event_id", "token", F.col("operation").alias("op"), gate_path(F.col("path")).alias("p"), "ts")
        .join(issued, "token", "left")
        .withColumn("files", files)
    )
    live = F.col("i").isNotNull() & (F.col("ts") >= F.col("i.ts")) & (F.col("ts") < F.col("i.ts") + life)
    fits = live & (F.col("op") == F.col("i.operation")) & F.array_contains("files", F.col("p"))
    order = Window.partitionBy("token", "p", "fits").orderBy("ts", "event_id")
    asked = asked.withColumn("live", F.coalesce(live, F.lit(False))).withColumn("fits", F.coalesce(fits, F.lit(False)))
    asked = asked.withColumn("first", F.col("fits") & (F.row_number().over(order) == 1))
    before = Window.partitionBy("token").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("spent", F.coalesce(F.sum(F.col("first").cast("int")).over(before), F.lit(0)) >= F.size("files"))
    error = (
        F.when(~F.col("live") | F.col("spent"), "missing")
        .when(F.col("op") != F.col("i.operation"), "operation")
        .when(~F.array_contains("files", F.col("p")), "path")
        .when(~F.col("first"), "used")
        .otherwise("")
    )
    return asked.select("event_id", (error == "").alias("ok"), error.alias("error"))
