"""Queries of the general data problems, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import hierarchy, nested, packed, references
from tracewell.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    pol, req, rul = (table(spark, d, n) for n in ("policy_records", "requirement_records", "authority_rules"))
    refs = pol.select(F.lit("policy_records").alias("source_table"), "record_id", F.lit("requirement").alias("target"), F.explode("requirement_ids").alias("ref"), "recorded_at")
    refs = refs.union(rul.select(F.lit("authority_rules"), "record_id", F.lit("policy"), "policy_id", "recorded_at"))
    parents = req.select(F.lit("requirement").alias("target"), F.col("req_id").alias("key"), "record_id", "status", "recorded_at")
    parents = parents.union(pol.select(F.lit("policy"), "policy_id", "record_id", "status", "recorded_at"))
    return references.orphan_references(refs, parents)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def _sets(spark: SparkSession, d: str, paths: bool = False) -> DataFrame:
    return hierarchy.nested_sets(hierarchy.resolve_links(table(spark, d, "import_graph"), table(spark, d, "repo_specs")), paths)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).select("node_id", "root_id", "depth")


def p2_sets(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its nested-set range, path from the top and whether it lies on a loop."""
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path")
    return _sets(spark, d, paths=True).select("node_id", "parent_id", "root_id", "depth", "size", "lo", "hi", "top_id", "on_loop", path)


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with all nodes below it."""
    return hierarchy.descendants(_sets(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.links(table(spark, d, "scenario_records"))


def p4_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return nested.scenarios(table(spark, d, "scenario_records"))


def p4_violations(spark: SparkSession, d: str) -> DataFrame:
    return nested.violations(table(spark, d, "scenario_records"))


def p4_policies(spark: SparkSession, d: str) -> DataFrame:
    return nested.policies(table(spark, d, "scenario_records"))


_PACKED = ["predicted_files", "oracle_files", "predicted_requirements"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.packed_values(table(spark, d, "scenario_predictions"), "prediction_id", _PACKED, ["provider", "model"])


def p6_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The scores by which the delimiters of each source are inferred."""
    values = packed.long_values(table(spark, d, "scenario_predictions"), "prediction_id", _PACKED, ["provider", "model"])
    scored = packed.score_delimiters(values)
    return scored.select("writer", "field", "name", "pieces", F.round("consistency", 6).alias("consistency"), F.round("regularity", 6).alias("regularity"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_sets, p2_descendants, p4_found, p4_scenarios, p4_violations, p4_policies, p6_found, p6_delimiters)}

_KEY = r"upper(regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"

_P1 = f"""
refs AS (
  SELECT DISTINCT 'policy_records' AS source_table, 'requirement' AS target, record_id, {_KEY.format('r')} AS ref_key, recorded_at AS t
  FROM (SELECT record_id, recorded_at, unnest(requirement_ids) AS r FROM policy_records)
  UNION SELECT 'authority_rules', 'policy', record_id, {_KEY.format('policy_id')}, recorded_at FROM authority_rules),
parents AS (
  SELECT 'requirement' AS target, {_KEY.format('req_id')} AS k, recorded_at AS t, status FROM requirement_records
  UNION SELECT 'policy', {_KEY.format('policy_id')}, recorded_at, status FROM policy_records),
judged AS (
  SELECT source_table, record_id, ref_key, r.t,
         CASE WHEN count(p.k) = 0 THEN 'missing'
              WHEN count(p.k) FILTER (WHERE p.t <= r.t) = 0 THEN 'late'
              WHEN arg_max(p.status, p.t) FILTER (WHERE p.t <= r.t) = 'deleted' THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.k = r.ref_key
  WHERE ref_key <> '' GROUP BY ALL),
found AS (SELECT source_table, record_id, ref_key, reason, strftime(t, '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL)
"""

_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '/'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^(\./)+', ''), '^/+|/+$', '', 'g')"

_P2 = f"""
rows_ AS (SELECT node_id, repo, {_NORM.format('file_path')} AS path, imports, imported_by FROM import_graph),
files AS (SELECT repo, path, min(node_id) AS file FROM rows_ WHERE path <> '' GROUP BY ALL),
bare AS (SELECT *, regexp_replace(path, '\\.[^./]+$', '') AS stem FROM files),
names AS (SELECT repo, path AS target, 0 AS rank, path, file FROM bare
          UNION ALL SELECT repo, stem, 1, path, file FROM bare WHERE stem <> path
          UNION ALL SELECT repo, regexp_replace(stem, '/index$', ''), 2, path, file FROM bare WHERE stem LIKE '%/index'),
lookup AS (SELECT repo, target, arg_min(file, (rank, path, file)) AS found FROM names GROUP BY ALL),
ends AS (SELECT DISTINCT node_id, repo, true AS up, {_NORM.format('imported_by')} AS raw FROM rows_
         UNION SELECT node_id, repo, false, {_NORM.format('i')} FROM (SELECT node_id, repo, unnest(imports) AS i FROM rows_)),
entries AS (SELECT name AS repo, unnest(map_entries(alias_map)) AS e FROM repo_specs),
hits AS (SELECT ends.*, arg_max(e.value || substr(raw, length(e.key) + 1), length(e.key)) AS replaced
         FROM ends LEFT JOIN entries ON entries.repo = ends.repo AND starts_with(raw, e.key) WHERE raw <> '' GROUP BY ALL),
targets AS (SELECT node_id, repo, up, CASE WHEN replaced IS NULL THEN raw ELSE {_NORM.format('replaced')} END AS target FROM hits),
pairs AS (SELECT CASE WHEN up THEN node_id ELSE found END AS node_id, CASE WHEN up THEN found ELSE node_id END AS parent_id
          FROM targets JOIN lookup USING (repo, target)),
links AS (SELECT node_id, min(parent_id) AS parent_id FROM (SELECT node_id, NULL AS parent_id FROM rows_ UNION ALL SELECT * FROM pairs) GROUP BY node_id),
tree AS (SELECT node_id, node_id AS root_id, 0 AS depth FROM links WHERE parent_id IS NULL
         UNION ALL SELECT l.node_id, t.root_id, t.depth + 1 FROM links l JOIN tree t ON l.parent_id = t.node_id),
up AS (SELECT node_id, parent_id AS above FROM links WHERE node_id NOT IN (SELECT node_id FROM tree)
       UNION SELECT u.node_id, l.parent_id FROM up u JOIN links l ON l.node_id = u.above),
on_loop AS (SELECT node_id FROM up WHERE node_id = above),
looped AS (SELECT node_id, min(above) AS root_id, -1 AS depth FROM up WHERE above IN (SELECT node_id FROM on_loop) GROUP BY node_id)
"""

_P4J = r"""r AS (SELECT record_id, arg_max(payload, (ingested_at, recorded_at, payload)) AS p FROM scenario_records GROUP BY record_id),
j0 AS (SELECT record_id, CASE WHEN json_valid(p) THEN p::JSON END AS d FROM r),
j AS (SELECT record_id, CASE WHEN json_type(d -> 'result') = 'OBJECT' AND (d ->> 'scenario_id') IS NULL THEN d -> 'result' ELSE d END AS d FROM j0 WHERE json_type(d) = 'OBJECT')"""
_P4Q = "WITH " + _P4J + r""",
k AS (SELECT record_id, coalesce(CASE json_type(d -> 'rbac') WHEN 'OBJECT' THEN d ->> '$.rbac.reason' WHEN 'VARCHAR' THEN d ->> 'rbac' END, '') AS reason,
        CASE WHEN json_type(d -> 'violations') = 'VARCHAR' AND json_valid(d ->> 'violations') THEN (d ->> 'violations')::JSON ELSE d -> 'violations' END AS v FROM j),
l AS (SELECT record_id, reason, CASE WHEN json_type(v) = 'ARRAY' THEN v::JSON[] WHEN json_type(v -> 'items') = 'ARRAY' THEN (v -> 'items')::JSON[] WHEN json_type(v) = 'OBJECT' THEN [v] ELSE [] END AS vs FROM k),
m AS (SELECT record_id, reason, list_filter(list_transform(vs, lambda x, i: {'pos': i - 1, 'v': x}), lambda y: json_type(y.v) = 'OBJECT') AS vs FROM l),
n AS (SELECT record_id, reason, unnest(vs) AS y FROM m),
o AS (SELECT record_id, reason, y.pos AS violation_pos, coalesce(y.v ->> 'requirement_id', '') AS requirement_id, coalesce(y.v ->> 'trace_path', '') AS trace_path, coalesce(y.v ->> 'requirement_title', '') AS requirement_title,
        CASE json_type(y.v -> 'enforced_by') WHEN 'ARRAY' THEN (y.v -> 'enforced_by')::JSON[] WHEN 'OBJECT' THEN [y.v -> 'enforced_by'] WHEN 'VARCHAR' THEN [y.v -> 'enforced_by'] ELSE [] END AS es FROM n),
q AS (SELECT * EXCLUDE es, list_filter(list_transform(es, lambda x, i: {'pos': i - 1, 'p': CASE json_type(x) WHEN 'OBJECT' THEN coalesce(x ->> 'policy_id', '') WHEN 'VARCHAR' THEN x ->> '$' END, 'title': coalesce(CASE json_type(x) WHEN 'OBJECT' THEN x ->> 'policy_title' END, ''), 'said': coalesce(CASE json_type(x) WHEN 'OBJECT' THEN x ->> 'policy_text' END, ''), 'trace': coalesce(CASE json_type(x) WHEN 'OBJECT' THEN x ->> 'trace_path' END, '')}), lambda y: y.p IS NOT NULL) AS es FROM o)"""
_P4 = _P4Q + r"""
SELECT record_id, violation_pos::INT AS violation_pos, e.pos::INT AS policy_pos, requirement_id, trace_path, e.p AS policy_id, reason FROM (SELECT *, unnest(es) AS e FROM q)
UNION ALL SELECT record_id, violation_pos::INT, -1, requirement_id, trace_path, '', reason FROM q WHERE len(es) = 0
UNION ALL SELECT record_id, -1, -1, '', '', '', reason FROM m WHERE len(vs) = 0"""

SQL = {
    "p4_found": _P4,
    "p4_scenarios": _P4Q + " SELECT j.record_id, " + ", ".join(f"coalesce(d ->> '{n}', '') AS {n}" for n in ("repo", "scenario_id", "task", "entity_type", "entity_name", "decision")) + ", reason, len(vs)::INT AS n_violations FROM j JOIN m USING (record_id)",
    "p4_violations": _P4Q + " SELECT record_id, violation_pos::INT AS violation_pos, requirement_id, requirement_title, trace_path, len(es)::INT AS n_policies FROM q",
    "p4_policies": _P4Q + " SELECT record_id, violation_pos::INT AS violation_pos, e.pos::INT AS policy_pos, e.p AS policy_id, e.title AS policy_title, e.said AS policy_text, e.trace AS policy_trace_path FROM (SELECT *, unnest(es) AS e FROM q)",
    "p1_found": f"WITH {_P1} SELECT * FROM found",
    "p1_report": f"WITH {_P1} SELECT source_table, period, reason, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY ALL",
    "p2_descendants": f"""WITH RECURSIVE {_P2}, below AS (SELECT parent_id AS node_id, node_id AS descendant_id FROM links WHERE parent_id IS NOT NULL AND node_id NOT IN (SELECT node_id FROM on_loop)
 UNION ALL SELECT b.node_id, l.node_id FROM below b JOIN links l ON l.parent_id = b.descendant_id WHERE l.node_id NOT IN (SELECT node_id FROM on_loop)) SELECT node_id, descendant_id FROM below""",
    "p2_found": f"WITH RECURSIVE {_P2} SELECT node_id, root_id, depth::INTEGER AS depth FROM tree UNION ALL SELECT node_id, root_id, depth::INTEGER FROM looped",
}
