"""Queries on access rules: validation, deduplication, decisions over all paths, roles and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import paths
from tracewell.functions.text import repo_path
from tracewell.operators import rules
from tracewell.session import table


def _rules(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "authority_rules")
    last = rules.last_by_id(raw.select("rule_id", "operation", "path_pattern", "effect", "min_role", "source_priority", "policy_id", F.struct("recorded_at", "record_id").alias("at")), "at")
    return rules.valid_rules(last)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Every code path with every role, a role that is unknown, and the operations write and delete."""
    code = table(spark, d, "code_files").select("file_id", repo_path(F.col("path")).alias("path")).distinct()
    asks = code.select("*", F.explode(F.array(*map(F.lit, ["viewer", "editor", "admin", "guest"]))).alias("role"))
    asks = asks.select("*", F.explode(F.array(F.lit("write"), F.lit("delete"))).alias("operation"))
    return asks.select(F.concat_ws("|", "file_id", "role", "operation").alias("request_id"), "operation", "path", "role")


def a20_last_rules(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "authority_rules").select("rule_id", "operation", "effect", F.struct("recorded_at", "record_id").alias("at"))
    return rules.last_by_id(raw, "at").select("rule_id", "operation", "effect")


def c5_valid_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).select("rule_id", "operation", "path_pattern", "effect", "min_role", "min_role_rank", "source_priority")


def c6_model_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules as a model may propose them: write, delete or any operation, and relative patterns only."""
    raw = table(spark, d, "authority_rules")
    return rules.valid_rules(raw, ("write", "delete", "*"), relative=True).select("rule_id", "operation", "path_pattern", "effect").distinct()


def c4_decisions(spark: SparkSession, d: str) -> DataFrame:
    got = rules.decide(_requests(spark, d), _rules(spark, d))
    return got.select("request_id", "allowed", "reason", F.coalesce("matched_rule_id", F.lit("")).alias("matched_rule_id"))


def j23_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many rules apply to each request, by outcome."""
    return rules.match_counts(_requests(spark, d), _rules(spark, d))


def q15_authorize(spark: SparkSession, d: str) -> DataFrame:
    """Per repo, role and operation: whether all its paths are authorized, and how many are not."""
    code = table(spark, d, "code_files").select(F.col("file_id").cast("string").alias("f"), "repo").distinct()
    got = rules.decide(_requests(spark, d), _rules(spark, d)).select(F.split("request_id", r"\|").alias("r"), "allowed")
    rows = got.select(F.col("r")[0].alias("f"), F.col("r")[1].alias("role"), F.col("r")[2].alias("operation"), "allowed").join(code, "f")
    return rows.groupBy("repo", "role", "operation").agg(F.bool_and("allowed").alias("authorized"), F.sum((~F.col("allowed")).cast("int")).alias("denied"))


def a14_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Breach, block and false-deny counts of three guards against the rules: none, role only, and the rules."""
    got = rules.decide(_requests(spark, d), _rules(spark, d)).select("request_id", "allowed")
    guards = F.array(F.struct(F.lit("none").alias("system"), F.lit(True).alias("said")), F.struct(F.lit("role").alias("system"), F.contains("request_id", F.lit("|admin|")).alias("said")), F.struct(F.lit("rules").alias("system"), F.col("allowed").alias("said")))
    rows = got.select("allowed", F.inline(guards))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ok, said = F.col("allowed"), F.col("said")
    out = rows.groupBy("system").agg(one(~ok).alias("denied"), one(ok).alias("allowed"), one(~ok & said).alias("breach"), one(~ok & ~said).alias("blocked"), one(ok & ~said).alias("false_deny"))
    return out.withColumn("breach_rate", F.round(F.when(F.col("denied") == 0, 0.0).otherwise(F.col("breach") / F.col("denied")), 6))


def w1_specificity(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "authority_rules").select("path_pattern").distinct()
    return got.select("path_pattern", *[s.alias(n) for s, n in zip(paths.specificity(F.col("path_pattern")), ("literal", "segments", "wildcards", "length"))])


def w6_highest_role(spark: SparkSession, d: str) -> DataFrame:
    """The highest role that any rule of each policy asks for."""
    r = table(spark, d, "authority_rules").where("policy_id is not null").select(F.upper(F.trim("policy_id")).alias("policy"), F.lower(F.trim("min_role")).alias("role"), rules.role_rank(F.col("min_role")).alias("rank"))
    return r.where("policy <> '' and rank is not null").groupBy("policy").agg(F.max_by("role", "rank").alias("role"))


def path_groups(spark: SparkSession, d: str) -> DataFrame:
    """Request paths as governance, backend or other."""
    code = table(spark, d, "code_files").select("file_id", repo_path(F.col("path")).alias("path")).distinct()
    group = F.when(F.col("path").startswith("governance/"), "governance").when(paths.is_backend(F.col("path")), "backend").otherwise("other")
    return code.groupBy(group.alias("path_group")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (a20_last_rules, c5_valid_rules, c6_model_rules, c4_decisions, j23_matches, q15_authorize, a14_breaches, w1_specificity, w6_highest_role, path_groups)}

_ROLE = "CASE lower(trim({0})) WHEN 'viewer' THEN 1 WHEN 'editor' THEN 2 WHEN 'admin' THEN 3 END"
_MATCH = r"lower(regexp_replace(replace({0}, '\', '/'), '^/+|/+$', '', 'g'))"
_NORM = r"regexp_replace(regexp_replace(trim(replace({0}, '\', '/')), '^(\./)+', ''), '^/+|/+$', '', 'g')"
_REL = r"replace(trim(path_pattern), '\', '/')"
_RULES = rf"""
last AS (SELECT rule_id, arg_max(struct_pack(operation := operation, path_pattern := path_pattern, effect := effect, min_role := min_role, source_priority := source_priority), (recorded_at, record_id)) AS r FROM authority_rules GROUP BY rule_id),
r0 AS (SELECT trim(rule_id) AS rule_id, lower(trim(r.operation)) AS operation, trim(r.path_pattern) AS path_pattern, lower(trim(r.effect)) AS effect, lower(trim(r.min_role)) AS min_role, {_ROLE.format('r.min_role')} AS min_role_rank, coalesce(r.source_priority, 0) AS source_priority FROM last),
rr AS (SELECT * FROM r0 WHERE rule_id <> '' AND operation IN ('read', 'write', 'delete', '*') AND effect IN ('allow', 'deny') AND min_role_rank IS NOT NULL AND {_MATCH.format('path_pattern')} <> ''),
rx AS (SELECT *, {_MATCH.format('path_pattern')} AS pat, regexp_replace(regexp_replace(path_pattern, '\\', '/', 'g'), '^/+|/+$', '', 'g') AS sp FROM rr),
ry AS (SELECT * FROM rx)"""
_REQ = rf"""req AS (SELECT file_id || '|' || role || '|' || operation AS request_id, operation, path, role, repo, CASE role WHEN 'viewer' THEN 1 WHEN 'editor' THEN 2 WHEN 'admin' THEN 3 END AS rank
  FROM (SELECT DISTINCT file_id, repo, {_NORM.format('path')} AS path FROM code_files), (SELECT unnest(['viewer', 'editor', 'admin', 'guest']) AS role), (SELECT unnest(['write', 'delete']) AS operation))"""
_DECIDE = rf"""pm AS (SELECT p, pat FROM (SELECT DISTINCT {_MATCH.format('path')} AS p FROM req) JOIN (SELECT DISTINCT pat FROM ry) ON p GLOB pat),
mat0 AS (SELECT request_id, rule_id, min_role, sp, source_priority, CASE WHEN effect = 'allow' AND rank >= min_role_rank THEN 'allow' WHEN effect = 'deny' AND rank < min_role_rank THEN 'deny' END AS outcome
  FROM req JOIN pm ON pm.p = {_MATCH.format('req.path')} JOIN ry ON ry.pat = pm.pat AND (ry.operation = req.operation OR ry.operation = '*') WHERE rank IS NOT NULL),
mat AS (SELECT * FROM mat0 WHERE outcome IS NOT NULL),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY outcome DESC, length(sp) - length(regexp_replace(sp, '[^*?\[\]]', '', 'g')) DESC, length(regexp_replace(sp, '[^/]', '', 'g')) DESC,
  length(regexp_replace(sp, '[^*?\[\]]', '', 'g')), length(sp) DESC, source_priority DESC, rule_id) AS rn FROM mat) WHERE rn = 1),
dec AS (SELECT req.request_id, repo, role, operation, CASE WHEN rank IS NULL THEN false WHEN rule_id IS NULL THEN false ELSE outcome = 'allow' END AS allowed,
  CASE WHEN rank IS NULL THEN 'Missing or invalid role claim.' WHEN rule_id IS NULL THEN 'No matching authority rule (deny-by-default).'
       ELSE CASE outcome WHEN 'allow' THEN 'Authorized' ELSE 'Denied' END || ' by rule ''' || rule_id || ''' (requires role>=' || min_role || ').' END AS reason, coalesce(rule_id, '') AS matched_rule_id FROM req LEFT JOIN win USING (request_id))
"""
_ALL = ",".join([_RULES, _REQ, _DECIDE])
SQL = {
    "a20_last_rules": "SELECT rule_id, arg_max(operation, (recorded_at, record_id)) AS operation, arg_max(effect, (recorded_at, record_id)) AS effect FROM authority_rules GROUP BY rule_id",
    "c5_valid_rules": f"WITH {_ALL} SELECT rule_id, operation, path_pattern, effect, min_role, min_role_rank, source_priority FROM rr",
    "c6_model_rules": rf"SELECT DISTINCT trim(rule_id) AS rule_id, lower(trim(operation)) AS operation, trim(path_pattern) AS path_pattern, lower(trim(effect)) AS effect FROM authority_rules WHERE trim(rule_id) <> '' AND lower(trim(operation)) IN ('write', 'delete', '*') AND lower(trim(effect)) IN ('allow', 'deny') AND {_ROLE.format('min_role')} IS NOT NULL AND {_REL} <> '' AND NOT starts_with({_REL}, '/') AND NOT regexp_matches({_REL}, '(^|/)\.\.(/|$)') AND NOT regexp_matches({_REL}, '^[A-Za-z]:')",
    "c4_decisions": f"WITH {_ALL} SELECT request_id, allowed, reason, matched_rule_id FROM dec",
    "j23_matches": f"WITH {_ALL} SELECT request_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'deny') AS denies FROM mat GROUP BY request_id",
    "q15_authorize": f"WITH {_ALL} SELECT repo, role, operation, bool_and(allowed) AS authorized, count(*) FILTER (WHERE NOT allowed) AS denied FROM dec GROUP BY ALL",
    "a14_breaches": f"""WITH {_ALL}, g AS (SELECT allowed, 'none' AS system, true AS said FROM dec UNION ALL SELECT allowed, 'role', role = 'admin' FROM dec UNION ALL SELECT allowed, 'rules', allowed FROM dec),
c AS (SELECT system, count(*) FILTER (WHERE NOT allowed) AS denied, count(*) FILTER (WHERE allowed) AS ok, count(*) FILTER (WHERE NOT allowed AND said) AS breach, count(*) FILTER (WHERE NOT allowed AND NOT said) AS blocked, count(*) FILTER (WHERE allowed AND NOT said) AS false_deny FROM g GROUP BY system)
SELECT system, denied, ok AS allowed, breach, blocked, false_deny, round(CASE WHEN denied = 0 THEN 0.0 ELSE breach / denied END, 6) AS breach_rate FROM c""",
    "w1_specificity": r"WITH p AS (SELECT DISTINCT path_pattern, regexp_replace(replace(path_pattern, '\', '/'), '^/+|/+$', '', 'g') AS sp FROM authority_rules) SELECT path_pattern, length(sp) - length(regexp_replace(sp, '[^*?\[\]]', '', 'g')) AS literal, length(regexp_replace(sp, '[^/]', '', 'g')) + (sp <> '')::INT AS segments, -length(regexp_replace(sp, '[^*?\[\]]', '', 'g')) AS wildcards, length(sp) AS length FROM p",
    "w6_highest_role": f"SELECT upper(trim(policy_id)) AS policy, arg_max(lower(trim(min_role)), {_ROLE.format('min_role')}) AS role FROM authority_rules WHERE trim(policy_id) <> '' AND {_ROLE.format('min_role')} IS NOT NULL GROUP BY 1",
    "path_groups": rf"WITH c AS (SELECT DISTINCT file_id, {_NORM.format('path')} AS path FROM code_files) SELECT CASE WHEN starts_with(path, 'governance/') THEN 'governance' WHEN len(list_intersect(string_split(lower(path), '/'), ['ui','views','components'])) = 0 AND len(list_intersect(string_split(lower(path), '/'), ['server','api','db','trpc','inngest'])) > 0 THEN 'backend' ELSE 'other' END AS path_group, count(*) AS n FROM c GROUP BY 1",
}
