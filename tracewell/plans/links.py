"""Further links of the governance graph, their ablations, generated scenarios and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.paths import has_wildcards, is_backend, is_relative_pattern, is_safe_symbol
from tracewell.functions.text import key, repo_path
from tracewell.operators import governance, graph, privacy, retrieval, rules
from tracewell.operators.parsers import parse_schemas
from tracewell.plans.governance import _BACK, _EVERY, _IMPACT, _pick, _sql
from tracewell.plans.rules import _ALL, _RULES, _requests, _rules
from tracewell.session import table
from tracewell.streaming.changes import dispatch

G = governance.build


def _implemented(spark: SparkSession, d: str) -> DataFrame:
    """Requirements that a source file names in its text."""
    code = table(spark, d, "code_files").select(F.concat_ws("/", "repo", repo_path(F.col("path"))).alias("file"), "content").distinct()
    return code.select("file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(RQ-\d+)"), F.lit(1)))).alias("req"))


def f7_word_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a table name as a whole word, without letter case."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    return docs.join(G(spark, d).tables, "name").groupBy("name").agg(F.count("*").alias("n"))


def f12_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "authority_rules").select("path_pattern").distinct()
    return p.select("path_pattern", is_relative_pattern(F.col("path_pattern")).alias("relative"), has_wildcards(F.col("path_pattern")).alias("wild"))


def f13_safe_symbols(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "scenario_predictions").select(F.explode(F.split("entity_name", "[./]")).alias("symbol")).distinct()
    return t.select("symbol", is_safe_symbol(F.col("symbol")).alias("safe"))


def f15_gated_tables(spark: SparkSession, d: str) -> DataFrame:
    """Files may use tables only if they import the schema module, or if none of their imports was resolved."""
    g = G(spark, d)
    code = table(spark, d, "code_files").select(F.concat_ws("/", "repo", repo_path(F.col("path"))).alias("file"), F.contains("content", F.lit('"@/db/schema"')).alias("schema")).distinct()
    code = code.groupBy("file").agg(F.bool_or("schema").alias("schema"))
    resolved = g.imports.select(F.col("src").alias("file")).distinct().withColumn("resolved", F.lit(True))
    ok = code.join(resolved, "file", "left").where("schema or resolved is null").select("file")
    return g.uses_table.join(ok, "file", "left_semi")


def j4_requirement_policies(spark: SparkSession, d: str) -> DataFrame:
    return G(spark, d).enforces.groupBy("req").agg(F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies"))


def j5_column_tables(spark: SparkSession, d: str) -> DataFrame:
    return G(spark, d).columns.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("tbl")), ",").alias("tables"))


def j6_table_functions(spark: SparkSession, d: str) -> DataFrame:
    """Files of each table with their functions; files without functions stay."""
    g = G(spark, d)
    return g.uses_table.join(g.functions.select("file", F.col("name").alias("fn")), "file", "left").groupBy("tbl").agg(F.countDistinct("file").alias("files"), F.count("fn").alias("functions"))


def j11_implemented_by(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return _implemented(spark, d).join(g.requirements.select(F.col("id").alias("req")), "req", "left_semi").select("req", "file")


def j12_applies_to(spark: SparkSession, d: str) -> DataFrame:
    """Files that a policy applies to: at or below the literal paths of its rules."""
    g = G(spark, d)
    r = table(spark, d, "authority_rules").select(key(F.col("policy_id")).alias("policy"), repo_path(F.col("path_pattern")).alias("prefix")).where(~has_wildcards(F.col("prefix")) & (F.col("policy") != "")).distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return g.files.select("file", F.explode(prefixes).alias("prefix")).join(r, "prefix").select("policy", "file").distinct()


def j19_rule_policies(spark: SparkSession, d: str) -> DataFrame:
    """Rules with the rank of their role and their policy, where that is known."""
    g = G(spark, d)
    r = _rules(spark, d).select("rule_id", "min_role_rank", key(F.col("policy_id")).alias("id"))
    return r.join(g.policies.select("id", F.lit(True).alias("known")), "id", "left").select("rule_id", "min_role_rank", F.when(F.col("known"), F.col("id")).otherwise("").alias("policy"))


def j20_filter_in_join(spark: SparkSession, d: str) -> DataFrame:
    """A condition on the optional side restricts what is joined, not the rules."""
    g = G(spark, d)
    r = _rules(spark, d).select("rule_id", key(F.col("policy_id")).alias("id"), "operation")
    p = g.policies.select(F.col("id").alias("pid"))
    out = r.join(p, (F.col("id") == F.col("pid")) & (F.col("operation") == "write"), "left")
    return out.groupBy("operation").agg(F.count("*").alias("rules"), F.count("pid").alias("with_policy"))


def j22_probe_grid(spark: SparkSession, d: str) -> DataFrame:
    """Probes by role, operation and path group."""
    q = _requests(spark, d).withColumn("path_group", F.when(is_backend(F.col("path")), "backend").otherwise("other"))
    return q.groupBy("role", "operation", "path_group").agg(F.count("*").alias("n"))


def j25_policies_hit(spark: SparkSession, d: str) -> DataFrame:
    """Policies that enforce a requirement which governs a table."""
    g = G(spark, d)
    return g.enforces.join(g.governs_table.select("req").distinct(), "req", "left_semi").select("policy").distinct()


def g8_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Mean files per entity type: direct, and with the closure over every importer."""
    g = G(spark, d, every_importer=True)
    col = F.concat_ws(".", "tbl", "name")
    entities = g.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity")).union(g.columns.select(F.lit("column"), col)).distinct()
    per = governance.impact(g, entities)
    return per.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("direct_files").alias("direct"), F.sum("affected_files").alias("with_closure"))


def a1_collect(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of each table as a sorted set."""
    return G(spark, d).governs_table.groupBy("tbl").agg(F.array_join(F.array_sort(F.collect_set("req")), ",").alias("reqs"))


def a5_functions_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Functions in the files that use each table."""
    g = G(spark, d)
    return g.functions.join(g.uses_table, "file").groupBy("tbl").agg(F.countDistinct("file", "name").alias("functions"))


def t2k_requirements(spark: SparkSession, d: str) -> DataFrame:
    """The best four requirements of each table or column by lexical score."""
    g = G(spark, d)
    q = table(spark, d, "scenario_predictions").where("entity_type <> 'file'").select(F.col("entity_name").alias("query"), F.col("entity_name").alias("name")).distinct()
    t = g.requirements.select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))).alias("text"))
    return retrieval.top(retrieval.scores(q, t), 4).select("query", "id", "score", "rank")


def u5_missing_from_changeset(spark: SparkSession, d: str) -> DataFrame:
    """Importers of a repo's api files that are no api files themselves."""
    g = G(spark, d)
    sets = g.files.where("path like 'src/api/%'").select("repo", "file")
    hit = sets.join(g.imports.select(F.col("dst").alias("file"), F.col("src").alias("other")), "file").select("repo", F.col("other").alias("file")).distinct()
    return hit.join(sets, ["repo", "file"], "left_anti")


def e10_probes(spark: SparkSession, d: str) -> DataFrame:
    """A guard that allows all admins and gives no valid answer for guests, scored against the rules; invalid is a breach."""
    got = rules.decide(_requests(spark, d), _rules(spark, d)).select("request_id", "allowed")
    said = F.when(F.contains("request_id", F.lit("|guest|")), F.lit(None).cast("boolean")).otherwise(F.contains("request_id", F.lit("|admin|")))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = got.withColumn("said", said)
    return s.agg(one(~F.col("allowed")).alias("denied"), one(~F.col("allowed") & F.coalesce("said", F.lit(True))).alias("breach"), one(F.col("allowed") & ~F.coalesce("said", F.lit(True))).alias("false_deny"), one(F.col("said").isNull()).alias("invalid"))


def e12_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Generated scenarios: every table, the first two columns of each, and the six most imported files of each repo."""
    g = G(spark, d)
    first = g.columns.withColumn("n", F.row_number().over(Window.partitionBy("tbl").orderBy("name"))).where("n <= 2")
    degree = graph.in_degree(g.files.select(F.col("file").alias("node")), g.imports).join(g.files.select(F.col("file").alias("node"), "repo"), "node")
    top = degree.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "node"))).where("k <= 6")
    return g.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity")).union(first.select(F.lit("column"), F.concat_ws(".", "tbl", "name"))).union(top.select(F.lit("file"), "node"))


def e13_governance_oracle(spark: SparkSession, d: str) -> DataFrame:
    """Policies hit by a table: those that enforce any requirement which names the table or one of its columns."""
    g = G(spark, d)
    reqs = g.governs_table.select("tbl", "req").union(g.governs_column.select("tbl", "req")).distinct()
    return reqs.join(g.enforces, "req").select("tbl", "policy").distinct().groupBy("tbl").agg(F.count("*").alias("policies"))


def e14_tables_with_columns(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of a table with and without those of its columns."""
    g = G(spark, d)
    both = g.governs_table.select("tbl", "req", F.lit(1).alias("own")).union(g.governs_column.select("tbl", "req", F.lit(0)))
    per = both.groupBy("tbl", "req").agg(F.max("own").alias("own"))
    return per.groupBy("tbl").agg(F.count("*").alias("with_columns"), F.sum("own").alias("own"))


def k10_classified_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns of parsed CREATE TABLE texts with their class."""
    files = table(spark, d, "code_files").where("lower(path) like '%.sql'").select(F.col("file_id").alias("id"), F.col("content").alias("text")).distinct()
    cols = parse_schemas(files).where("dialect = 'sql' and col <> ''").select("tbl", F.col("col").alias("name")).distinct()
    return privacy.classify(cols).select("tbl", "name", "category", "sensitivity")


def l1_naive(spark: SparkSession, d: str) -> DataFrame:
    """The naive edit names the file itself, or nothing: its files and hits per entity type."""
    p = table(spark, d, "scenario_predictions").select("prediction_id", "entity_type", "entity_name", F.coalesce("oracle_files", F.lit("")).alias("o")).distinct()
    said = F.col("entity_type") == "file"
    return p.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum(said.cast("int")).alias("named"), F.sum((said & F.contains("o", "entity_name")).cast("int")).alias("hits"))


def r1_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Change events by the group of their path."""
    e = table(spark, d, "import_graph").select(repo_path(F.col("file_path")).alias("path"))
    return e.select(dispatch(F.col("path"), {"schema": ["src/db"], "code": ["src", "app", "packages"], "script": ["scripts"]}).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def a13_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of replies with a parse error by provider and model."""
    r = table(spark, d, "llm_replies").select("reply_id", "provider", "model", "parse_error").distinct()
    return r.groupBy("provider", "model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("parse_error").isNotNull().cast("int")), 6).alias("rate"))


_NAMES = "f7_word_match f12_patterns f13_safe_symbols f15_gated_tables j4_requirement_policies j5_column_tables j6_table_functions j11_implemented_by j12_applies_to j19_rule_policies j20_filter_in_join j22_probe_grid j25_policies_hit g8_ablation a1_collect a5_functions_of_files t2k_requirements u5_missing_from_changeset e10_probes e12_scenarios e13_governance_oracle e14_tables_with_columns k10_classified_schema l1_naive r1_dispatch a13_rates"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '/'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^(\./)+', ''), '^/+|/+$', '', 'g')"
_K = r"upper(regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_POLRULE = f"rul AS (SELECT rule_id, min_role_rank, operation, {_K.format('pid')} AS id FROM rr JOIN (SELECT trim(rule_id) AS rule_id, arg_max(policy_id, (recorded_at, record_id)) AS pid FROM (SELECT * REPLACE (coalesce(policy_id, '') AS policy_id) FROM authority_rules) GROUP BY 1) USING (rule_id))"
SQL = {
    "f7_word_match": _sql(r"SELECT name, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\w+'))) AS name FROM documents) JOIN g_tables USING (name) GROUP BY name"),
    "f12_patterns": r"WITH p AS (SELECT DISTINCT path_pattern, replace(trim(path_pattern), '\', '/') AS q FROM authority_rules) SELECT path_pattern, q <> '' AND NOT starts_with(q, '/') AND NOT regexp_matches(q, '(^|/)\.\.(/|$)') AND NOT regexp_matches(q, '^[A-Za-z]:') AS relative, regexp_matches(path_pattern, '[*?\[]') AS wild FROM p",
    "f13_safe_symbols": r"SELECT DISTINCT symbol, regexp_matches(symbol, '^[\p{L}_][\p{L}\p{N}_]*$') AS safe FROM (SELECT unnest(regexp_split_to_array(entity_name, '[./]')) AS symbol FROM scenario_predictions)",
    "f15_gated_tables": _sql("SELECT file, tbl FROM g_uses WHERE file IN (SELECT repo || '/' || path FROM code0 GROUP BY 1 HAVING bool_or(contains(content, '\"@/db/schema\"'))) OR file NOT IN (SELECT src FROM g_imports)"),
    "j4_requirement_policies": _sql("SELECT req, string_agg(policy, ',' ORDER BY policy) AS policies FROM g_enforces GROUP BY req"),
    "j5_column_tables": _sql("SELECT name, string_agg(tbl, ',' ORDER BY tbl) AS tables FROM g_columns GROUP BY name"),
    "j6_table_functions": _sql("SELECT tbl, count(DISTINCT u.file) AS files, count(f.name) AS functions FROM g_uses u LEFT JOIN g_functions f ON f.file = u.file GROUP BY tbl"),
    "j11_implemented_by": _sql(r"SELECT req, file FROM (SELECT DISTINCT repo || '/' || path AS file, unnest(regexp_extract_all(content, 'RQ-\d+')) AS req FROM code0) WHERE req IN (SELECT id FROM g_reqs)"),
    "j12_applies_to": _sql(rf"SELECT DISTINCT policy, file FROM (SELECT {_K.format('policy_id')} AS policy, {_NORM.format('path_pattern')} AS prefix FROM authority_rules) JOIN g_files ON path = prefix OR starts_with(path, prefix || '/') WHERE NOT regexp_matches(prefix, '[*?\[]') AND policy <> '' AND prefix <> ''"),
    "j19_rule_policies": _sql("SELECT rule_id, min_role_rank, CASE WHEN id IN (SELECT id FROM g_pols) THEN id ELSE '' END AS policy FROM rul", _RULES, _POLRULE),
    "j20_filter_in_join": _sql("SELECT operation, count(*) AS rules, count(p.id) AS with_policy FROM rul LEFT JOIN g_pols p ON p.id = rul.id AND operation = 'write' GROUP BY operation", _RULES, _POLRULE),
    "j22_probe_grid": f"WITH {_ALL} SELECT role, operation, CASE WHEN {_BACK.format('path')} THEN 'backend' ELSE 'other' END AS path_group, count(*) AS n FROM req GROUP BY ALL",
    "j25_policies_hit": _sql("SELECT DISTINCT policy FROM g_enforces WHERE req IN (SELECT req FROM g_gt)"),
    "g8_ablation": _sql("SELECT entity_type, count(*) AS n, sum(direct_files)::BIGINT AS direct, sum(affected_files)::BIGINT AS with_closure FROM impact WHERE entity_type <> 'file' GROUP BY entity_type", _IMPACT, base=_EVERY),
    "a1_collect": _sql("SELECT tbl, string_agg(DISTINCT req, ',' ORDER BY req) AS reqs FROM g_gt GROUP BY tbl"),
    "a5_functions_of_files": _sql("SELECT tbl, count(*) AS functions FROM g_functions JOIN g_uses USING (file) GROUP BY tbl"),
    "t2k_requirements": _sql(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc) WHERE rank <= 4",
        "tok AS (SELECT DISTINCT entity_name AS query, unnest(list_filter(regexp_split_to_array(lower(entity_name), '[^A-Za-z0-9]+'), lambda x: x <> '')) AS token FROM scenario_predictions WHERE entity_type <> 'file')",
        "txt AS (SELECT id, lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''))) AS text FROM g_reqs)",
        "sc AS (SELECT query, id, sum((length(text) - length(replace(text, token, ''))) // length(token))::BIGINT AS score FROM tok JOIN txt ON contains(text, token) GROUP BY ALL)",
    ),
    "u5_missing_from_changeset": _sql("SELECT DISTINCT f.repo, i.src AS file FROM g_files f JOIN g_imports i ON i.dst = f.file LEFT JOIN g_files o ON o.file = i.src AND o.path LIKE 'src/api/%' WHERE f.path LIKE 'src/api/%' AND o.file IS NULL"),
    "e10_probes": f"WITH {_ALL}, s AS (SELECT allowed, CASE role WHEN 'guest' THEN NULL ELSE role = 'admin' END AS said FROM dec) SELECT count(*) FILTER (WHERE NOT allowed) AS denied, count(*) FILTER (WHERE NOT allowed AND coalesce(said, true)) AS breach, count(*) FILTER (WHERE allowed AND NOT coalesce(said, true)) AS false_deny, count(*) FILTER (WHERE said IS NULL) AS invalid FROM s",
    "e12_scenarios": _sql(
        "SELECT 'table' AS entity_type, name AS entity FROM g_tables UNION ALL SELECT 'column', tbl || '.' || name FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY name) AS n FROM g_columns) WHERE n <= 2 UNION ALL SELECT 'file', file FROM (SELECT file, row_number() OVER (PARTITION BY repo ORDER BY n DESC, file) AS k FROM deg) WHERE k <= 6",
        "deg AS (SELECT f.repo, f.file, count(DISTINCT src) AS n FROM g_files f LEFT JOIN g_imports ON dst = f.file GROUP BY ALL)",
    ),
    "e13_governance_oracle": _sql("SELECT tbl, count(DISTINCT policy) AS policies FROM (SELECT tbl, req FROM g_gt UNION SELECT tbl, req FROM g_gc) JOIN g_enforces USING (req) GROUP BY tbl"),
    "e14_tables_with_columns": _sql("SELECT tbl, count(DISTINCT req) AS with_columns, count(DISTINCT CASE WHEN own = 1 THEN req END) AS own FROM (SELECT tbl, req, 1 AS own FROM g_gt UNION ALL SELECT tbl, req, 0 FROM g_gc) GROUP BY tbl"),
    "k10_classified_schema": rf"""WITH c AS (SELECT DISTINCT content FROM code_files WHERE lower(path) LIKE '%.sql'), t AS (SELECT DISTINCT regexp_extract(content, 'CREATE TABLE (\w+) \(', 1) AS tbl, unnest(regexp_extract_all(regexp_extract(content, '(?s)CREATE TABLE \w+ \((.*?)\);', 1), '(?m)^  (\w+) ', 1)) AS name FROM c) SELECT tbl, name, {_pick(1, 'non_personal')} AS category, {_pick(2, 'none')} AS sensitivity FROM t WHERE tbl <> ''""",
    "l1_naive": "WITH p AS (SELECT DISTINCT prediction_id, entity_type, entity_name, coalesce(oracle_files, '') AS o FROM scenario_predictions) SELECT entity_type, count(*) AS n, sum((entity_type = 'file')::INT)::BIGINT AS named, sum((entity_type = 'file' AND contains(o, entity_name))::INT)::BIGINT AS hits FROM p GROUP BY entity_type",
    "r1_dispatch": f"WITH e AS (SELECT {_NORM.format('file_path')} AS p FROM import_graph) SELECT CASE WHEN p = 'src/db' OR starts_with(p, 'src/db/') THEN 'schema' WHEN p IN ('src', 'app', 'packages') OR starts_with(p, 'src/') OR starts_with(p, 'app/') OR starts_with(p, 'packages/') THEN 'code' WHEN p = 'scripts' OR starts_with(p, 'scripts/') THEN 'script' ELSE 'other' END AS kind, count(*) AS n FROM e GROUP BY 1",
    "a13_rates": "SELECT provider, model, count(*) AS n, round(avg((parse_error IS NOT NULL)::INT), 6) AS rate FROM (SELECT DISTINCT reply_id, provider, model, parse_error FROM llm_replies) GROUP BY ALL",
}
