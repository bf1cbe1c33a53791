"""Deeply nested JSON records as flat related tables, by higher-order projections and one inline per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VARIANTS = "array<variant>"


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", _VARIANTS)


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _unpacked(v: Column) -> Column:
    """A member that was written as JSON inside a string becomes what that JSON says."""
    inside = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    plain = _as_array(v).isNull() & ~_is_object(v)
    return F.when(plain & (_as_array(inside).isNotNull() | _is_object(inside)), inside).otherwise(v)


def _items(v: Column) -> Column:
    """The elements of a list, also of one that an object with its count holds as ``items``; a single object or text is
    a list of one, null and nothing an empty one."""
    scalar = F.try_variant_get(v, "$", "string").isNotNull()
    held = F.coalesce(_as_array(v), F.try_variant_get(v, "$.items", _VARIANTS))
    return F.when(held.isNotNull(), held).when(_is_object(v) | scalar, F.array(v)).otherwise(F.array().cast(_VARIANTS))


def parsed(records: DataFrame) -> DataFrame:
    """record_id, doc: one row per id whose payload is a complete JSON object; of repeated ids the last ingested."""
    late = [F.col(c) for c in ("ingested_at", "recorded_at") if c in records.columns]
    one = records.groupBy(F.col("record_id").cast("long").alias("record_id")).agg(
        F.max_by("payload", F.struct(*late, F.col("payload"))).alias("payload")
    )
    whole = F.when(F.rtrim(F.regexp_replace("payload", r"\s+$", "")).endswith("}"), F.try_parse_json("payload"))
    doc = F.col("doc")
    inner = F.try_variant_get(doc, "$.result", "variant")
    wrapped = F.when(_is_object(inner) & F.try_variant_get(doc, "$.scenario_id", "string").isNull(), inner).otherwise(doc)
    return one.select("record_id", whole.alias("doc")).select("record_id", wrapped.alias("doc")).where(_is_object(F.col("doc")))


def flattened(records: DataFrame) -> DataFrame:
    """One row per record with its scenario columns and nested lists that already carry all ancestor keys.

    Shapes: a list may be written as a single object, as an object that holds it as ``items``, as JSON within a
    string, be null or lack; policies may be objects or bare ids; rbac may be an object or the bare reason. Null elements hold their place in the count
    of positions. The whole may be wrapped in ``result``. Missing and null texts become ''. A payload that is
    null, empty or no complete JSON object gives no row; nothing else is dropped.
    """
    doc = F.col("doc")
    rbac = _unpacked(F.try_variant_get(doc, "$.rbac", "variant"))
    reason = F.when(_is_object(rbac), _text(rbac, "$.reason")).otherwise(F.coalesce(F.try_variant_get(rbac, "$", "string"), F.lit("")))
    one = parsed(records).select(
        "record_id",
        doc,
        reason.alias("reason"),
        _items(_unpacked(F.try_variant_get(doc, "$.violations", "variant"))).alias("raw"),
    )
    numbered = F.filter(F.transform("raw", lambda v, i: F.struct(i.cast("int").alias("pos"), v.alias("v"))), lambda x: _is_object(x["v"]))

    def violation(x: Column) -> Column:
        enforced = _items(_unpacked(F.try_variant_get(x["v"], "$.enforced_by", "variant")))
        policy = lambda p, j: F.struct(
            j.cast("int").alias("policy_pos"),
            F.when(_is_object(p), _text(p, "$.policy_id")).otherwise(F.try_variant_get(p, "$", "string")).alias("policy_id"),
            F.when(_is_object(p), _text(p, "$.policy_title")).otherwise(F.lit("")).alias("policy_title"),
            F.when(_is_object(p), _text(p, "$.policy_text")).otherwise(F.lit("")).alias("policy_text"),
            F.when(_is_object(p), _text(p, "$.trace_path")).otherwise(F.lit("")).alias("policy_trace_path"),
        )
        return F.struct(
            x["pos"].alias("violation_pos"),
            _text(x["v"], "$.requirement_id").alias("requirement_id"),
            _text(x["v"], "$.requirement_title").alias("requirement_title"),
            _text(x["v"], "$.trace_path").alias("trace_path"),
            F.filter(F.transform(enforced, policy), lambda p: p["policy_id"].isNotNull()).alias("policies"),
        )

    return one.select("record_id", "doc", "reason", F.transform(numbered, violation).alias("violations"))


def scenarios(records: DataFrame) -> DataFrame:
    """The parent table: one row per record."""
    doc = F.col("doc")
    names = ("repo", "scenario_id", "task", "entity_type", "entity_name", "decision")
    return flattened(records).select(
        "record_id",
        *[_text(doc, f"$.{n}").alias(n) for n in names],
        "reason",
        F.size("violations").alias("n_violations"),
    )


def violations(records: DataFrame) -> DataFrame:
    """One row per violation, with the key of its record and its position."""
    rows = F.transform(
        "violations",
        lambda v: F.struct(
            F.col("record_id"), v["violation_pos"], v["requirement_id"], v["requirement_title"], v["trace_path"], F.size(v["policies"]).alias("n_policies")
        ),
    )
    names = ["record_id", "violation_pos", "requirement_id", "requirement_title", "trace_path", "n_policies"]
    return flattened(records).select(F.inline(rows).alias(*names))


def policies(records: DataFrame) -> DataFrame:
    """One row per policy that enforces a violation, with the keys of both ancestors."""
    rows = F.flatten(
        F.transform("violations", lambda v: F.transform(v["policies"], lambda p: F.struct(F.col("record_id"), v["violation_pos"], *[p[n] for n in ("policy_pos", "policy_id", "policy_title", "policy_text", "policy_trace_path")])))
    )
    return flattened(records).select(F.inline(rows).alias("record_id", "violation_pos", "policy_pos", "policy_id", "policy_title", "policy_text", "policy_trace_path"))


def links(records: DataFrame) -> DataFrame:
    """record_id, violation_pos, policy_pos, requirement_id, trace_path, policy_id, reason: scenario to violation to policy.

    A violation without policies has one row with policy_pos -1; a record without violations one with both -1.
    """
    names = ["record_id", "violation_pos", "policy_pos", "requirement_id", "trace_path", "policy_id", "reason"]

    def row(v: Column, pos: Column, policy_pos: Column, policy: Column) -> Column:
        values = [F.col("record_id"), pos, policy_pos, v["requirement_id"], v["trace_path"], policy, F.col("reason")]
        return F.struct(*[x.alias(n) for x, n in zip(values, names)])

    minus, blank = F.lit(-1), F.lit("")

    def of(v: Column) -> Column:
        each = F.transform(v["policies"], lambda p: row(v, v["violation_pos"], p["policy_pos"], p["policy_id"]))
        return F.when(F.size(v["policies"]) == 0, F.array(row(v, v["violation_pos"], minus, blank))).otherwise(each)

    nothing = [F.col("record_id"), minus, minus, blank, blank, blank, F.col("reason")]
    none = F.array(F.struct(*[x.alias(n) for x, n in zip(nothing, names)]))
    rows = F.when(F.size("violations") == 0, none).otherwise(F.flatten(F.transform("violations", of)))
    return flattened(records).select(F.inline(rows).alias(*names))
