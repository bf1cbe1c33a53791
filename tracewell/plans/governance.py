"""Queries on the governance graph: scans, joins, traversal, impact, traces, reports, privacy, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.paths import LANGUAGES, is_backend, language
from tracewell.functions.text import is_ignored, repo_path
from tracewell.operators import detect, governance, graph, nested, privacy, risk, rules
from tracewell.plans.general import _KEY, _NORM, _P2, _P4J
from tracewell.plans.rules import _DECIDE, _RULES, _rules
from tracewell.session import table

G = governance.build


# scans and predicates


def s1_code_scan(spark: SparkSession, d: str) -> DataFrame:
    """Source files of each repo without ignored paths."""
    specs = table(spark, d, "repo_specs").select(F.col("name").alias("repo"), "ignore")
    code = table(spark, d, "code_files").select("file_id", "repo", "path").distinct().join(specs, "repo", "left")
    return code.where(language(F.col("path")).isNotNull() & ~is_ignored(F.col("path"), F.col("ignore"))).select("file_id", "repo")


def s2_languages(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "code_files").select("file_id", F.coalesce(language(F.col("path")), F.lit("none")).alias("language")).distinct()
    return code.groupBy("language").agg(F.count("*").alias("n"))


def s10_label_scan(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return g.tables.select(F.lit("Table").alias("label"), "name").union(g.columns.select(F.lit("Column"), F.concat_ws(".", "tbl", "name")))


def s11_context(spark: SparkSession, d: str) -> DataFrame:
    """At most 200 names of each label in order, as the context of a prompt."""
    g = G(spark, d)
    top = lambda df, label, c: df.select(F.lit(label).alias("label"), F.col(c).alias("name")).distinct().orderBy("name").limit(200)
    return top(g.tables, "Table", "name").union(top(g.files, "File", "file")).union(top(g.requirements, "Requirement", "id")).union(top(g.policies, "Policy", "id"))


def p3_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Code files at or below the literal part of each rule's path, by exploding prefixes instead of trying pairs."""
    g = G(spark, d)
    rules = table(spark, d, "authority_rules").select(F.regexp_replace(repo_path(F.col("path_pattern")), r"/[^/]*[*?\[].*$", "").alias("prefix")).where("prefix <> '' and not prefix rlike '[*?\\\\[]'").distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return g.files.select("file", F.explode(prefixes).alias("prefix")).join(rules, "prefix").groupBy("prefix").agg(F.count("*").alias("n"))


def p6_backend(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    wide = ("ui", "views", "components", "public", "styles", "assets", "css", "scss")
    return g.files.select("repo", is_backend(F.col("path")).alias("b"), is_backend(F.col("path"), front=wide).alias("w"), is_backend(F.col("path"), ["src/modules", "packages"]).alias("c")).groupBy("repo").agg(
        F.sum(F.col("b").cast("int")).alias("backend"), F.sum(F.col("w").cast("int")).alias("evaluator"), F.sum(F.col("c").cast("int")).alias("configured")
    )


def p11_search(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive text over several columns."""
    r = G(spark, d).requirements
    q = "ledger"
    hit = F.contains(F.lower("id"), F.lit(q)) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q)) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(q))
    return r.where(hit).select("id")


# joins


def j1_table_files(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return governance.direct_files(g).where("entity_type = 'table'").groupBy("entity").agg(F.count("*").alias("files"))


def j2_column_files(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    files = governance.direct_files(g).where("entity_type = 'column'").groupBy("entity").agg(F.count("*").alias("files"))
    return g.columns.select(F.concat_ws(".", "tbl", "name").alias("entity")).join(files, "entity", "left").na.fill(0)


def j3_requirements(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return governance.governed(g)


def j7_table_policies(spark: SparkSession, d: str) -> DataFrame:
    """Table to requirement to policy; requirements without a policy stay."""
    g = G(spark, d)
    return g.governs_table.join(g.enforces, "req", "left").select("tbl", "req", F.coalesce("policy", F.lit("")).alias("policy"))


def j8_file_policies(spark: SparkSession, d: str) -> DataFrame:
    return governance.file_burden(G(spark, d))


def j9_governs(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return g.governs_table.select("req", "tbl", F.lit("").alias("name")).union(g.governs_column)


def j10_uses_table(spark: SparkSession, d: str) -> DataFrame:
    return G(spark, d).uses_table


def j13_local_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls from a declared function to one that the same file declares."""
    return G(spark, d).calls.where("file = dst").select("file", "caller", "callee")


def j14_cross_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls from a declared function to one that a directly imported file declares."""
    return G(spark, d).calls.where("file <> dst").select("file", "caller", "dst", "callee")


def j15_linked_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each file over all files at once: how many, and to how many files."""
    return G(spark, d).calls.groupBy("file").agg(F.count("*").alias("calls"), F.countDistinct("dst").alias("files"))


def j16_resolve(spark: SparkSession, d: str) -> DataFrame:
    return G(spark, d).imports


def j21_personal_files(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    f = privacy.find_personal(g.columns, g.uses_table)
    return f.select("tbl", "name", "category", "sensitivity", "subject", F.size("files").alias("files"))


def j26_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Requirements that no policy enforces."""
    g = G(spark, d)
    return g.requirements.join(g.enforces.select(F.col("req").alias("id")), "id", "left_anti").select("id")


# traversal


def g1_reverse_closure(spark: SparkSession, d: str) -> DataFrame:
    """For every file the number of files that import it, directly or not, within 25 links."""
    return graph.closure(governance.importers(G(spark, d)), 25).groupBy(F.col("src").alias("seed")).agg(F.count("*").alias("n"))


def g2_call_chain(spark: SparkSession, d: str) -> DataFrame:
    """For every file the files with a function that calls one of its functions within three calls."""
    return G(spark, d).calling_files


def g3_closure_from_one(spark: SparkSession, d: str) -> DataFrame:
    """What the first importing file of each repo imports, directly or not, itself included, without a bound."""
    g = G(spark, d)
    first = g.imports.groupBy(F.substring_index("src", "/", 1).alias("repo")).agg(F.min("src").alias("seed"))
    return graph.reachability(g.imports, first.select("seed", F.col("seed").alias("node")), None, include_seeds=True)


def g5_in_degree(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return graph.in_degree(g.files.select(F.col("file").alias("node")), g.imports).groupBy("n").agg(F.count("*").alias("files"))


def g7_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    entities = g.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity"))
    return governance.blast_radius(g, entities).select("entity", "file", "how")


def g0_region_radius(spark: SparkSession, d: str) -> DataFrame:
    """What depends on each region along the foreign keys, and the risk of its change."""
    t = lambda n: table(spark, d, n)
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edges = (
        t("nation").select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("dst"))
        .union(t("customer").select(node("nation", "c_nationkey"), node("customer", "c_custkey")))
        .union(t("supplier").select(node("nation", "s_nationkey"), node("supplier", "s_suppkey")))
        .union(t("orders").select(node("customer", "o_custkey"), node("order", "o_orderkey")))
    )
    seeds = t("region").select(node("region", "r_regionkey").alias("seed"), node("region", "r_regionkey").alias("node"))
    reach = graph.reachability(edges, seeds, 25)
    kind = F.substring_index("node", ":", 1)
    one = lambda k: F.sum(F.when(kind == k, 1).otherwise(0))
    out = reach.groupBy("seed").agg(F.count("*").alias("reached"), one("order").alias("orders"), one("customer").alias("customers"), one("supplier").alias("suppliers"))
    points = risk.score(F.col("orders"), F.col("customers"), F.col("suppliers"), F.lit(0))
    return out.withColumn("risk_score", points).withColumn("risk_severity", risk.severity(F.col("risk_score")))


# tools


def q1_impact(spark: SparkSession, d: str) -> DataFrame:
    """The impact of every table, column and file."""
    g = G(spark, d)
    col = F.concat_ws(".", "tbl", "name")
    entities = g.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity")).union(g.columns.select(F.lit("column"), col)).union(g.files.select(F.lit("file"), "file")).distinct()
    return governance.impact(g, entities)


def q1_files(spark: SparkSession, d: str) -> DataFrame:
    """The lists of the impact of every table and column: its direct, transitive and calling files, over every importer."""
    g = G(spark, d, every_importer=True)
    entities = g.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity")).union(g.columns.select(F.lit("column"), F.concat_ws(".", "tbl", "name"))).distinct()
    return governance.blast_radius(g, entities).withColumn("backend", is_backend(F.col("file")))


def q2_traces(spark: SparkSession, d: str) -> DataFrame:
    return governance.traces(G(spark, d))


def q2_explain(spark: SparkSession, d: str) -> DataFrame:
    return governance.explain(G(spark, d))


def q3_violations(spark: SparkSession, d: str) -> DataFrame:
    """For each table its violated requirements with title and the policies that enforce them."""
    g = G(spark, d)
    titles = g.requirements.select(F.col("id").alias("req"), F.coalesce("title", F.lit("")).alias("title"))
    pols = g.enforces.groupBy("req").agg(F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies"))
    return g.governs_table.join(titles, "req").join(pols, "req", "left").select("tbl", "req", "title", F.coalesce("policies", F.lit("")).alias("policies"))


def q12_function_counts(spark: SparkSession, d: str) -> DataFrame:
    f = G(spark, d).functions
    agg = f.groupBy("file").agg(F.countDistinct("name").alias("function_count"), F.countDistinct(F.when(F.col("is_method"), F.col("name"))).alias("method_count"))
    return agg.withColumn("non_method_count", F.greatest(F.col("function_count") - F.col("method_count"), F.lit(0)))


def q13_identifier_usage(spark: SparkSession, d: str) -> DataFrame:
    """For every table name the files that say it, in order."""
    g = G(spark, d)
    return g.identifiers.join(g.tables, "name").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("file")), "\n").alias("files"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")


def q14_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return detect.candidates(_texts(spark, d), g.tables, g.columns, g.files.select(F.col("path").alias("file")).distinct()).select("id", "entity_type", "entity_name", "score", "rank")


def q4_detect(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    plain = g.files.select(F.col("path").alias("file")).distinct()
    return detect.best_entity(_texts(spark, d), g.tables, g.columns, plain)


def q7_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Detected entity of each document with its impact and what to do about it; a file is one of the document's repo.

    The impact is over every importer.
    """
    g = G(spark, d, every_importer=True)
    found = detect.best_entity(_texts(spark, d), g.tables, g.columns, g.files.select(F.col("path").alias("file")).distinct())
    repo = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "repo")
    found = found.join(repo, "id").withColumn("entity", F.when(F.col("entity_type") == "file", F.concat(F.col("repo"), F.lit("/"), F.col("entity_name"))).otherwise(F.col("entity_name"))).drop("repo")
    found = g._scratch.write(found, "detected")
    entities = found.where("entity_type <> 'unknown' and entity is not null").select("entity_type", "entity").distinct()
    scored = governance.impact(g, entities).select("entity_type", "entity", "risk_score", "requirements")
    out = found.join(scored, ["entity_type", "entity"], "left").drop("entity").na.fill(0)
    say = F.when(F.col("requirements") > 0, "resolve").when(F.col("risk_score") >= 20, "review").when(F.col("risk_score") >= 8, "check").otherwise("proceed")
    return out.withColumn("recommendation", say)


def q16_propose(spark: SparkSession, d: str) -> DataFrame:
    """The gate over all plans of the scenario log, as an editor who writes and declares no requirements.

    One row per plan: the access decision on every declared file, what of the blast radius it misses, what it violates
    in silence, the policies behind that, and a token where it is allowed.
    """
    g = G(spark, d)
    doc, text = F.col("doc"), lambda p: F.try_variant_get("doc", p, "string")
    plans = nested.parsed(table(spark, d, "scenario_records")).select(
        F.col("record_id").alias("plan_id"), text("$.repo").alias("repo"), text("$.entity_type").alias("entity_type"), text("$.entity_name").alias("entity"), F.try_variant_get(doc, "$.declared_files", "array<string>").alias("declared"), F.array().cast("array<string>").alias("requirements"),
    )
    return governance.propose(g, plans, _rules(spark, d), "editor", "write")


def q19_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    n = graph.counts(g.nodes()).select(F.lit("node").alias("kind"), "label", "n")
    return n.unionByName(graph.counts(g.edges()).select(F.lit("edge").alias("kind"), "label", "n"))


def q20_change_report(spark: SparkSession, d: str) -> DataFrame:
    """One changeset per repo, its api and db files, which an editor writes."""
    g = G(spark, d)
    sets = g.files.where("path like 'src/api/%' or path like 'src/db/%'").select(F.col("repo").alias("change_id"), "file", "path")
    asked = sets.select(F.col("path").alias("request_id"), F.lit("write").alias("operation"), "path", F.lit("editor").alias("role")).distinct()
    allowed = sets.join(rules.decide(asked, _rules(spark, d)).select(F.col("request_id").alias("path"), "allowed"), "path").groupBy("change_id").agg(F.bool_and("allowed").alias("authorized"))
    decisions = g.files.select(F.col("repo").alias("change_id")).distinct().join(allowed, "change_id", "left").select("change_id", F.coalesce("authorized", F.lit(True)).alias("authorized"))
    return governance.change_report(g, sets.select("change_id", "file"), decisions)


def q21_summary(spark: SparkSession, d: str) -> DataFrame:
    return privacy.summary(G(spark, d).columns)


def q22_erasure(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    every = privacy.erasure(g.columns, g.uses_table).withColumn("subject", F.lit("all"))
    some = privacy.erasure(g.columns, g.uses_table, "customer").withColumn("subject", F.lit("customer"))
    return every.unionByName(some).unionByName(privacy.erasure(g.columns, g.uses_table, "customer", compat=True).withColumn("subject", F.lit("customer, compat")))


def q23_purpose(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return privacy.personal(g.columns).select("tbl", "name", "category", "sensitivity", F.array_join("articles", ",").alias("articles"))


_NAMES = "s1_code_scan s2_languages s10_label_scan s11_context p3_prefix p6_backend p11_search j1_table_files j2_column_files j3_requirements j7_table_policies j8_file_policies j9_governs j10_uses_table j13_local_calls j14_cross_calls j15_linked_calls j16_resolve j21_personal_files j26_orphans g0_region_radius g1_reverse_closure g2_call_chain g3_closure_from_one g5_in_degree g7_blast_radius q1_impact q1_files q2_traces q2_explain q3_violations q4_detect q7_preflight q12_function_counts q13_identifier_usage q14_candidates q16_propose q19_graph_stats q20_change_report q21_summary q22_erasure q23_purpose"
_RENAMED = {"p3_prefix": "path_prefix", "p6_backend": "path_backend", "p11_search": "path_search"}
QUERIES = {_RENAMED.get(n, n): globals()[n] for n in _NAMES.split()}

_EXT = "|".join(sorted(e[1:] for e in LANGUAGES))
_LANG = "CASE " + " ".join(f"WHEN ext = '{e[1:]}' THEN '{k}'" for e, k in LANGUAGES.items()) + " END"
_BACK = "(len(list_intersect(string_split(lower({0}), '/'), ['ui','views','components'])) = 0 AND len(list_intersect(string_split(lower({0}), '/'), ['server','api','db','trpc','inngest'])) > 0)"
_WORDS = r"unnest(list_distinct(regexp_extract_all({0}, '\w+')))"

_FN = r"(?:function|def|func)\s+(?:\([^)]*\)\s*)?(\w+)\s*\("
_QUIET = r"""'//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`(?:[^`\\]|\\.)*`'"""
_GOV = rf"""{_P2},
code0 AS (SELECT DISTINCT file_id, repo, {_NORM.format('path')} AS path, content FROM code_files),
code AS (SELECT *, repo || '/' || path AS file FROM code0 WHERE regexp_matches(lower(path), '\.({_EXT})$')),
node0 AS (SELECT DISTINCT node_id, repo, path, repo || '/' || path AS file FROM rows_),
g_files AS (SELECT DISTINCT file, repo, path FROM code UNION SELECT file, repo, path FROM node0),
g_imports AS (SELECT DISTINCT p.file AS src, c.file AS dst FROM links l JOIN node0 c USING (node_id) JOIN node0 p ON p.node_id = l.parent_id),
g_columns AS (SELECT DISTINCT split_part(entity_name, '.', 1) AS tbl, split_part(entity_name, '.', -1) AS name FROM scenario_predictions WHERE entity_type = 'column'),
g_tables AS (SELECT entity_name AS name FROM scenario_predictions WHERE entity_type = 'table' UNION SELECT tbl FROM g_columns),
said AS (SELECT DISTINCT file, word FROM (SELECT file, {_WORDS.format('content')} AS word FROM code)),
g_uses AS (SELECT file, name AS tbl FROM said JOIN g_tables ON word = name),
g_refs AS (SELECT file, tbl, name FROM said JOIN g_columns ON word = name),
fn0 AS (SELECT file, content, unnest(list_distinct(regexp_extract_all(content, '(?:function|def|func)\s+(?:\([^)]*\)\s*)?(\w+)\s*\(', 1))) AS name FROM code),
g_functions AS (SELECT file, name, bool_or(list_contains(regexp_extract_all(content, 'def (\w+)\(self', 1), name)) AS is_method FROM fn0 GROUP BY ALL),
req0 AS (SELECT {_KEY.format('req_id')} AS id, arg_max(struct_pack(title := title, description := description, status := status), recorded_at) AS v FROM requirement_records GROUP BY 1),
g_reqs AS (SELECT id, v.title AS title, v.description AS description FROM req0 WHERE id <> '' AND coalesce(v.status, '') <> 'deleted'),
pol0 AS (SELECT {_KEY.format('policy_id')} AS id, arg_max(struct_pack(ids := requirement_ids, status := status), recorded_at) AS v FROM policy_records GROUP BY 1),
g_pols AS (SELECT id, v.ids AS ids FROM pol0 WHERE id <> '' AND coalesce(v.status, '') <> 'deleted'),
g_enforces AS (SELECT DISTINCT policy, req FROM (SELECT id AS policy, {_KEY.format('r')} AS req FROM (SELECT id, unnest(ids) AS r FROM g_pols)) WHERE req IN (SELECT id FROM g_reqs)),
told AS (SELECT id AS req, {_WORDS.format("concat_ws(' ', coalesce(title, ''), coalesce(description, ''))")} AS word FROM g_reqs),
g_gt AS (SELECT req, name AS tbl FROM told JOIN g_tables ON word = name),
g_gc AS (SELECT req, tbl, name FROM told JOIN g_columns ON word = name),
g_idents AS (SELECT file, word AS name FROM said WHERE regexp_matches(word, '^[A-Za-z_]')),
g_direct AS (SELECT 'table' AS entity_type, tbl AS entity, file FROM g_uses UNION SELECT 'table', tbl, file FROM g_refs
             UNION SELECT 'column', tbl || '.' || name, file FROM g_refs UNION SELECT 'file', dst, src FROM g_imports),
g_violated AS (SELECT 'table' AS entity_type, tbl AS entity, req FROM g_gt UNION SELECT 'column', tbl || '.' || name, req FROM g_gc
               UNION SELECT 'file', file, req FROM g_uses JOIN g_gt USING (tbl) UNION SELECT 'file', file, req FROM g_refs JOIN g_gc USING (tbl, name)),
climb AS (SELECT dst AS seed, src AS node, 1 AS depth FROM g_imports
          UNION ALL SELECT c.seed, i.src, c.depth + 1 FROM climb c JOIN g_imports i ON i.dst = c.node WHERE c.depth < 25),
g_reach AS (SELECT DISTINCT seed, node FROM climb),
seg AS (SELECT file, unnest(regexp_extract_all(content, '{_FN}', 1)) AS caller, unnest(regexp_split_to_array(content, '{_FN}')[2:]) AS body FROM (SELECT DISTINCT file, content FROM code WHERE lower(path) LIKE '%.py') WHERE regexp_matches(content, '{_FN}')),
quiet AS (SELECT DISTINCT file, regexp_replace(content, {_QUIET}, ' ', 'g') AS q FROM code WHERE lower(path) NOT LIKE '%.py'),
call_tok AS (SELECT file, unnest(generate_series(1, len(t))) AS ord, unnest(t) AS tk FROM (SELECT file, regexp_extract_all(q, '{_FN}|\w+\s*\(|[{{}}]') AS t FROM quiet)),
dep AS (SELECT *, sum(CASE tk WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ord) AS depth, regexp_full_match(tk, '{_FN}') AS is_decl FROM call_tok),
decl AS (SELECT d.file, regexp_extract(d.tk, '{_FN}', 1) AS caller, d.ord, min(e.ord) AS until FROM dep d JOIN dep e ON e.file = d.file AND e.ord > d.ord AND e.tk = '}}' AND e.depth = d.depth WHERE d.is_decl GROUP BY ALL),
said_calls AS (SELECT DISTINCT file, caller, unnest(regexp_extract_all(regexp_extract(body, '^[^\n]*(?:\n(?:[ \t}})\]][^\n]*)?)*'), '(\w+)\s*\(', 1)) AS callee FROM seg
  UNION SELECT d.file, caller, regexp_extract(c.tk, '\w+') FROM decl d JOIN dep c ON c.file = d.file AND c.ord > d.ord AND c.ord < d.until AND NOT c.is_decl AND c.tk NOT IN ('{{', '}}')),
g_calls AS (SELECT DISTINCT s.file, caller, f.file AS dst, callee FROM said_calls s JOIN (SELECT file, file AS dst FROM g_functions UNION SELECT src, dst FROM g_imports) i ON i.file = s.file JOIN g_functions f ON f.file = i.dst AND f.name = callee
            WHERE EXISTS (SELECT 1 FROM g_functions o WHERE o.file = s.file AND o.name = caller)),
up2 AS (SELECT DISTINCT file, caller, dst, callee FROM g_calls UNION SELECT a.file, a.caller, b.dst, b.callee FROM g_calls a JOIN g_calls b ON b.file = a.dst AND b.caller = a.callee),
up3 AS (SELECT DISTINCT file, caller, dst, callee FROM up2 UNION SELECT a.file, a.caller, b.dst, b.callee FROM g_calls a JOIN up2 b ON b.file = a.dst AND b.caller = a.callee),
g_calling AS (SELECT DISTINCT dst AS file, file AS caller_file FROM up3),
g_blast AS (SELECT entity_type, entity, file, 'direct' AS how FROM g_direct
            UNION SELECT entity_type, entity, node, 'transitive' FROM g_direct JOIN g_reach ON seed = file
            UNION SELECT entity_type, entity, caller_file, 'calls' FROM g_direct JOIN g_calling USING (file))
"""


#: With every importer of a file, where many paths lead to a file: those of one length count once.
_EVERY = _GOV.replace("FROM links l JOIN node0 c", "FROM pairs l JOIN node0 c").replace("UNION ALL SELECT c.seed, i.src", "UNION SELECT c.seed, i.src")


def _sql(body: str, *ctes: str, base: str = _GOV) -> str:
    return "WITH RECURSIVE " + ",\n".join([base, *ctes]) + "\n" + body


def _pick(k: int, other: str) -> str:
    values = [",".join(x[k]) if isinstance(x[k], list) else x[k] for x in privacy.CATALOG]
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p[0]}') THEN '{v}'" for p, v in zip(privacy.CATALOG, values)) + f" ELSE '{other}' END"


_PII = f"""g_pii0 AS (SELECT tbl, name, {_pick(1, 'non_personal')} AS category, {_pick(2, 'none')} AS sensitivity, {_pick(3, '')} AS articles, {_pick(4, 'unknown')} AS subject FROM g_columns),
g_pii AS (SELECT * FROM g_pii0 WHERE category <> 'non_personal')"""
_SEV = "CASE WHEN {0} >= 20 THEN 'high' WHEN {0} >= 8 THEN 'moderate' ELSE 'low' END"
_ENT = "g_ent AS (SELECT 'table' AS entity_type, name AS entity FROM g_tables UNION SELECT 'column', tbl || '.' || name FROM g_columns UNION SELECT 'file', file FROM g_files)"
_EXPLAIN = f"""ex_used AS (SELECT * FROM g_uses WHERE {_BACK.format('file')}),
ex_f AS (SELECT tbl, count(DISTINCT u.file) AS files, count(f.name) AS functions FROM ex_used u LEFT JOIN g_functions f ON f.file = u.file GROUP BY tbl),
ex_r AS (SELECT entity_type, entity, count(DISTINCT req) AS requirements, count(DISTINCT policy) AS policies FROM g_violated LEFT JOIN g_enforces USING (req) WHERE entity_type <> 'file' GROUP BY ALL),
ex_e AS (SELECT 'table' AS entity_type, name AS entity FROM g_tables UNION SELECT 'column', tbl || '.' || name FROM g_columns),
ex1 AS (SELECT entity_type, entity, coalesce(files, 0) AS files, coalesce(functions, 0) AS functions, coalesce(requirements, 0) AS requirements, coalesce(policies, 0) AS policies FROM ex_e LEFT JOIN ex_f ON entity_type = 'table' AND tbl = entity LEFT JOIN ex_r USING (entity_type, entity)),
ex2 AS (SELECT *, 2 * files + functions + 4 * requirements + 3 * policies AS risk_score FROM ex1)"""
_IMPACT = f"""{_ENT}, {_EXPLAIN},
imp_f0 AS (SELECT entity_type, entity, file, count(*) FILTER (WHERE how = 'direct') AS direct, count(*) FILTER (WHERE how = 'transitive') AS transitive, count(*) FILTER (WHERE how = 'calls') AS calling FROM g_blast GROUP BY ALL),
imp_f AS (SELECT entity_type, entity, sum(direct)::BIGINT AS direct_files, sum(transitive)::BIGINT AS transitive_files, sum(calling)::BIGINT AS calling_files, count(*) AS affected_files, sum({_BACK.format('file')}::INT)::BIGINT AS backend_files FROM imp_f0 GROUP BY ALL),
imp_r AS (SELECT entity_type, entity, count(*) AS requirements FROM g_violated WHERE entity_type <> 'file' GROUP BY ALL),
imp0 AS (SELECT entity_type, entity, coalesce(direct_files, 0) AS direct_files, coalesce(transitive_files, 0) AS transitive_files, coalesce(calling_files, 0) AS calling_files, coalesce(functions, 0) AS functions, coalesce(policies, 0) AS policies, coalesce(affected_files, 0) AS affected_files, coalesce(backend_files, 0) AS backend_files, coalesce(requirements, 0) AS requirements
         FROM g_ent LEFT JOIN imp_f USING (entity_type, entity) LEFT JOIN imp_r USING (entity_type, entity) LEFT JOIN (SELECT entity_type, entity, functions, policies FROM ex1) USING (entity_type, entity)),
impact AS (SELECT *, 2 * (CASE WHEN entity_type = 'file' THEN affected_files ELSE backend_files END) + 4 * requirements AS risk_score FROM imp0)"""
_COUNTS = r"""texts AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL),
wc AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '\w+')) AS word FROM texts) GROUP BY ALL),
wt AS (SELECT id, name AS tbl, n AS nt FROM wc JOIN g_tables ON word = lower(name)),
wcol AS (SELECT id, tbl, name, n AS nc FROM wc JOIN g_columns ON word = lower(name))"""
_BEST = """best AS (SELECT id, arg_min(struct_pack(t := entity_type, e := entity_name), (p, a, b)) AS e FROM (
  SELECT id, 0 AS p, tbl AS a, name AS b, 'column' AS entity_type, tbl || '.' || name AS entity_name FROM wt JOIN wcol USING (id, tbl)
  UNION ALL SELECT id, 1, tbl, '', 'table', tbl FROM wt UNION ALL SELECT id, 2, name, tbl, 'column', tbl || '.' || name FROM wcol {0}) GROUP BY id)"""
_PATHS = r"""UNION ALL SELECT id, 3, path, '', 'file', path FROM (SELECT DISTINCT id, f.path FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_@.~\-]+(?:/[a-z0-9_@.()\[\]~\-]*[a-z0-9_)\]])+'))) AS p FROM texts) JOIN (SELECT DISTINCT path FROM g_files) f ON lower(f.path) = p)"""
_FILE_TRACE = "SELECT DISTINCT 'file' AS entity_type, file AS entity, 'File(' || file || ') -> {0} -> Requirement(' || req || ')' || coalesce(' -> Policy(' || policy || ')', '') AS trace FROM (SELECT DISTINCT file, req FROM {1}) LEFT JOIN g_enforces USING (req)"

SQL = {
    "s1_code_scan": _sql("SELECT DISTINCT file_id, c.repo FROM code c LEFT JOIN repo_specs s ON s.name = c.repo WHERE NOT coalesce(len(list_filter(s.ignore, lambda t: contains('/' || path || '/', '/' || t || '/'))) > 0, false)"),
    "s2_languages": f"WITH c AS (SELECT DISTINCT file_id, regexp_extract(lower(path), '\\.([^./]+)$', 1) AS ext FROM code_files) SELECT coalesce({_LANG}, 'none') AS language, count(*) AS n FROM c GROUP BY 1",
    "s10_label_scan": _sql("SELECT 'Table' AS label, name FROM g_tables UNION ALL SELECT 'Column', tbl || '.' || name FROM g_columns"),
    "s11_context": _sql("(SELECT 'Table' AS label, name FROM g_tables ORDER BY name LIMIT 200) UNION ALL (SELECT 'File', file FROM (SELECT DISTINCT file FROM g_files) ORDER BY file LIMIT 200) UNION ALL (SELECT 'Requirement', id FROM g_reqs ORDER BY id LIMIT 200) UNION ALL (SELECT 'Policy', id FROM g_pols ORDER BY id LIMIT 200)"),
    "path_prefix": _sql("SELECT prefix, count(*) AS n FROM pre JOIN g_files f ON f.path = prefix OR starts_with(f.path, prefix || '/') GROUP BY ALL", rf"pre AS (SELECT DISTINCT prefix FROM (SELECT regexp_replace({_NORM.format('path_pattern')}, '/[^/]*[*?\[].*$', '') AS prefix FROM authority_rules) WHERE prefix <> '' AND NOT regexp_matches(prefix, '[*?\[]'))"),
    "path_backend": _sql(f"SELECT repo, sum({_BACK.format('path')}::INT)::BIGINT AS backend, sum(({_BACK.format('path')} AND len(list_intersect(string_split(lower(path), '/'), ['public','styles','assets','css','scss'])) = 0)::INT)::BIGINT AS evaluator, sum((starts_with(lower(path), 'src/modules/') OR starts_with(lower(path), 'packages/') OR lower(path) IN ('src/modules', 'packages'))::INT)::BIGINT AS configured FROM g_files GROUP BY repo"),
    "path_search": _sql("SELECT id FROM g_reqs WHERE contains(lower(id), 'ledger') OR contains(lower(coalesce(title, '')), 'ledger') OR contains(lower(coalesce(description, '')), 'ledger')"),
    "j1_table_files": _sql("SELECT entity, count(*) AS files FROM g_direct WHERE entity_type = 'table' GROUP BY ALL"),
    "j2_column_files": _sql("SELECT tbl || '.' || c.name AS entity, count(r.file) AS files FROM g_columns c LEFT JOIN g_refs r USING (tbl, name) GROUP BY ALL"),
    "j3_requirements": _sql("SELECT entity_type, entity, req FROM g_violated WHERE entity_type <> 'file'"),
    "j7_table_policies": _sql("SELECT tbl, req, coalesce(policy, '') AS policy FROM g_gt LEFT JOIN g_enforces USING (req)"),
    "j8_file_policies": _sql("SELECT entity AS file, count(DISTINCT req) AS requirements, count(DISTINCT policy) AS policies FROM g_violated LEFT JOIN g_enforces USING (req) WHERE entity_type = 'file' GROUP BY ALL"),
    "j9_governs": _sql("SELECT req, tbl, '' AS name FROM g_gt UNION ALL SELECT req, tbl, name FROM g_gc"),
    "j10_uses_table": _sql("SELECT file, tbl FROM g_uses"),
    "j13_local_calls": _sql("SELECT file, caller, callee FROM g_calls WHERE file = dst"),
    "j15_linked_calls": _sql("SELECT file, count(*) AS calls, count(DISTINCT dst) AS files FROM g_calls GROUP BY file"),
    "j14_cross_calls": _sql("SELECT file, caller, dst, callee FROM g_calls WHERE file <> dst"),
    "j16_resolve": _sql("SELECT src, dst FROM g_imports"),
    "j21_personal_files": _sql("SELECT p.tbl, p.name, category, sensitivity, subject, count(DISTINCT file) AS files FROM g_pii p LEFT JOIN g_uses u ON u.tbl = p.tbl GROUP BY ALL", _PII),
    "j26_orphans": _sql("SELECT id FROM g_reqs WHERE id NOT IN (SELECT req FROM g_enforces)"),
    "g0_region_radius": """WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders),
r AS (SELECT 'region:' || r_regionkey AS seed, dst AS node FROM region JOIN e ON src = 'region:' || r_regionkey UNION SELECT seed, dst FROM r JOIN e ON src = node),
c AS (SELECT seed, count(*) AS reached, count(*) FILTER (WHERE node LIKE 'order:%') AS orders, count(*) FILTER (WHERE node LIKE 'customer:%') AS customers, count(*) FILTER (WHERE node LIKE 'supplier:%') AS suppliers FROM r GROUP BY seed)
SELECT *, 2 * orders + customers + 4 * suppliers AS risk_score, CASE WHEN 2 * orders + customers + 4 * suppliers >= 20 THEN 'high' WHEN 2 * orders + customers + 4 * suppliers >= 8 THEN 'moderate' ELSE 'low' END AS risk_severity FROM c""",
    "g1_reverse_closure": _sql("SELECT seed, count(*) AS n FROM g_reach GROUP BY seed"),
    "g2_call_chain": _sql("SELECT file, caller_file FROM g_calling"),
    "g3_closure_from_one": _sql("SELECT seed, node FROM r3", "first3 AS (SELECT min(src) AS seed FROM g_imports GROUP BY split_part(src, '/', 1)), r3 AS (SELECT seed, seed AS node FROM first3 UNION SELECT seed, dst FROM r3 JOIN g_imports ON src = node)"),
    "g5_in_degree": _sql("SELECT n, count(*) AS files FROM (SELECT file, count(DISTINCT src) AS n FROM (SELECT DISTINCT file FROM g_files) LEFT JOIN g_imports ON dst = file GROUP BY file) GROUP BY n"),
    "g7_blast_radius": _sql("SELECT entity, file, how FROM g_blast WHERE entity_type = 'table'"),
    "q1_impact": _sql(f"SELECT *, {_SEV.format('risk_score')} AS risk_severity FROM impact", _IMPACT),
    "q1_files": _sql(f"SELECT entity_type, entity, file, how, {_BACK.format('file')} AS backend FROM g_blast WHERE entity_type <> 'file'", base=_EVERY),
    "q2_traces": _sql(
        f"""SELECT 'table' AS entity_type, tbl AS entity, 'Table(' || tbl || ') -> File(' || u.file || ')' || coalesce(' -> Function(' || f.name || ')', '') AS trace FROM g_uses u LEFT JOIN g_functions f ON f.file = u.file WHERE {_BACK.format('u.file')}
UNION SELECT 'table', tbl, 'Table(' || tbl || ') -> Requirement(' || req || ')' || coalesce(' -> Policy(' || policy || ')', '') FROM g_gt LEFT JOIN g_enforces USING (req)
UNION SELECT 'column', tbl || '.' || name, 'Column(' || name || ') -> Table(' || tbl || ')' FROM g_columns
UNION SELECT 'column', tbl || '.' || name, 'Column(' || name || ') -> Requirement(' || req || ')' || coalesce(' -> Policy(' || policy || ')', '') FROM g_gc LEFT JOIN g_enforces USING (req)
UNION {_FILE_TRACE.format('USES_TABLE', 'g_uses JOIN g_gt USING (tbl)')} UNION {_FILE_TRACE.format('REFERENCES_COLUMN', 'g_refs JOIN g_gc USING (tbl, name)')}
UNION SELECT 'requirement', req, 'Requirement(' || req || ') -> Policy(' || policy || ')' FROM g_enforces
UNION SELECT 'policy', policy, 'Policy(' || policy || ') -> Requirement(' || req || ')' FROM g_enforces"""
    ),
    "q2_explain": _sql(
        f"SELECT *, {_SEV.format('risk_score')} AS risk_severity, entity_type || ' ' || entity || ' affects ' || files || ' files, ' || functions || ' functions, violates ' || requirements || ' requirements, and enforces ' || policies || ' policies.' AS summary FROM ex2",
        _EXPLAIN,
    ),
    "q3_violations": _sql("SELECT tbl, req, coalesce(title, '') AS title, coalesce(policies, '') AS policies FROM g_gt JOIN g_reqs r ON r.id = req LEFT JOIN (SELECT req, string_agg(policy, ',' ORDER BY policy) AS policies FROM g_enforces GROUP BY req) USING (req)"),
    "q4_detect": _sql("SELECT t.id, coalesce(e.t, 'unknown') AS entity_type, coalesce(e.e, '') AS entity_name FROM texts t LEFT JOIN best b ON b.id = t.id", _COUNTS, _BEST.format(_PATHS)),
    "q7_preflight": _sql(
        "SELECT id, entity_type, entity_name, risk_score, requirements, CASE WHEN requirements > 0 THEN 'resolve' WHEN risk_score >= 20 THEN 'review' WHEN risk_score >= 8 THEN 'check' ELSE 'proceed' END AS recommendation FROM (SELECT t.id, coalesce(e.t, 'unknown') AS entity_type, coalesce(e.e, '') AS entity_name, coalesce(risk_score, 0) AS risk_score, coalesce(requirements, 0) AS requirements FROM texts t LEFT JOIN best b ON b.id = t.id JOIN documents dc ON dc.doc_id = t.id LEFT JOIN impact i ON i.entity_type = e.t AND i.entity = CASE WHEN e.t = 'file' THEN dc.repo || '/' || e.e ELSE e.e END)",
        _COUNTS, _BEST.format(_PATHS), _IMPACT, base=_EVERY,
    ),
    "q12_function_counts": _sql("SELECT file, count(DISTINCT name) AS function_count, count(DISTINCT CASE WHEN is_method THEN name END) AS method_count, greatest(count(DISTINCT name) - count(DISTINCT CASE WHEN is_method THEN name END), 0) AS non_method_count FROM g_functions GROUP BY file"),
    "q13_identifier_usage": _sql("SELECT name, string_agg(DISTINCT file, chr(10) ORDER BY file) AS files FROM g_idents JOIN g_tables USING (name) GROUP BY name"),
    "q14_candidates": _sql(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, entity_type, entity_name)::INT AS rank FROM cand) WHERE rank <= 10",
        _COUNTS,
        r"fl AS (SELECT DISTINCT path, lower(path) AS low, regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\.[^.]*$', '') AS stem FROM g_files), fh AS (SELECT id, path, CASE WHEN contains(lower(text), low) THEN 8 WHEN length(stem) > 3 AND contains(lower(text), stem) THEN 3 END AS score FROM texts, fl)",
        "cand AS (SELECT c.id, 'column' AS entity_type, c.tbl || '.' || c.name AS entity_name, CASE WHEN nt IS NULL THEN 15 * nc ELSE 10 * nt + 20 * nc END AS score FROM wcol c LEFT JOIN wt t ON t.id = c.id AND t.tbl = c.tbl UNION ALL SELECT id, 'table', tbl, 10 * nt FROM wt UNION ALL SELECT id, 'file', path, score FROM fh WHERE score IS NOT NULL)",
    ),
    "q16_propose": _sql(
        """SELECT plan_id, decision, rbac_allowed, CASE WHEN rbac_allowed THEN 'Authorized.' ELSE said END AS rbac_reason, declared, actual, missed, violated, violated AS silent, policies,
 CASE WHEN decision = 'allow' THEN sha256(concat_ws(chr(10), 'write', paths)) ELSE '' END AS token
 FROM (SELECT *, CASE WHEN NOT rbac_allowed OR missed > 0 OR violated > 0 THEN 'block' ELSE 'allow' END AS decision FROM pr)""",
        f"""{_P4J}, pl AS (SELECT record_id AS plan_id, d ->> 'repo' AS repo, d ->> 'entity_type' AS entity_type, CASE WHEN d ->> 'entity_type' = 'file' THEN concat_ws('/', d ->> 'repo', {_NORM.format("(d ->> 'entity_name')")}) ELSE d ->> 'entity_name' END AS entity, (d -> 'declared_files')::VARCHAR[] AS files FROM j),
ed AS (SELECT plan_id, repo, entity_type, entity, path, min(pos) AS pos FROM (SELECT *, regexp_replace(trim(replace(files[pos], '\\', '/')), '^/+|/+$', '', 'g') AS path FROM (SELECT *, unnest(generate_series(1, len(files))) AS pos FROM pl)) WHERE path <> '' GROUP BY ALL),
{_RULES}, req AS (SELECT DISTINCT path AS request_id, 'write' AS operation, path, 'editor' AS role, '' AS repo, 2 AS rank FROM ed), {_DECIDE},
ac AS (SELECT plan_id, count(*) AS declared, bool_and(allowed) AS rbac_allowed, string_agg(reason, '; ' ORDER BY pos) FILTER (WHERE NOT allowed) AS said, string_agg(path, chr(10) ORDER BY path) AS paths FROM ed JOIN dec ON dec.request_id = path GROUP BY plan_id),
af AS (SELECT DISTINCT entity_type, entity, f.repo, f.path FROM g_blast b JOIN g_files f USING (file)),
pr AS (SELECT plan_id, coalesce(rbac_allowed, true) AS rbac_allowed, said, coalesce(declared, 0) AS declared, paths, coalesce(n, 0) AS actual, coalesce(n, 0) - (SELECT count(*) FROM ed JOIN af USING (entity_type, entity, repo, path) WHERE ed.plan_id = pl.plan_id) AS missed,
  (SELECT count(*) FROM g_violated v WHERE v.entity_type = pl.entity_type AND v.entity = pl.entity) AS violated, (SELECT count(DISTINCT policy) FROM g_violated v JOIN g_enforces USING (req) WHERE v.entity_type = pl.entity_type AND v.entity = pl.entity) AS policies
  FROM pl LEFT JOIN ac USING (plan_id) LEFT JOIN (SELECT entity_type, entity, repo, count(*) AS n FROM af GROUP BY ALL) USING (entity_type, entity, repo))""",
    ),
    "q19_graph_stats": _sql(
        "SELECT kind, label, n FROM st UNION ALL SELECT kind, 'total', sum(n)::BIGINT FROM st GROUP BY kind",
        """st AS (SELECT 'node' AS kind, 'File' AS label, count(*) AS n FROM g_files UNION ALL SELECT 'node', 'Table', count(*) FROM g_tables UNION ALL SELECT 'node', 'Column', count(*) FROM g_columns UNION ALL SELECT 'node', 'Function', count(*) FROM g_functions
 UNION ALL SELECT 'node', 'Method', count(*) FROM g_functions WHERE is_method UNION ALL SELECT 'node', 'Requirement', count(*) FROM g_reqs UNION ALL SELECT 'node', 'Policy', count(*) FROM g_pols UNION ALL SELECT 'node', 'Identifier', count(DISTINCT name) FROM g_idents
 UNION ALL SELECT 'edge', 'IMPORTS', count(*) FROM g_imports UNION ALL SELECT 'edge', 'USES_TABLE', count(*) FROM g_uses UNION ALL SELECT 'edge', 'REFERENCES_COLUMN', count(*) FROM g_refs UNION ALL SELECT 'edge', 'HAS_COLUMN', count(*) FROM g_columns
 UNION ALL SELECT 'edge', 'ENFORCES', count(*) FROM g_enforces UNION ALL SELECT 'edge', 'GOVERNS', (SELECT count(*) FROM g_gt) + (SELECT count(*) FROM g_gc) UNION ALL SELECT 'edge', 'CALLS', count(*) FROM g_calls UNION ALL SELECT 'edge', 'DECLARES_FUNCTION', count(*) FROM g_functions UNION ALL SELECT 'edge', 'USES_IDENTIFIER', count(*) FROM g_idents)""",
    ),
    "q20_change_report": _sql(
        "SELECT *, CASE WHEN NOT authorized OR requirements > 0 THEN 'block' WHEN missing_files > 0 OR max_risk >= 8 THEN 'warn' ELSE 'pass' END AS verdict FROM rep",
        f"""cs AS (SELECT repo AS change_id, file, path FROM g_files WHERE path LIKE 'src/api/%' OR path LIKE 'src/db/%'),
{_RULES}, req AS (SELECT DISTINCT path AS request_id, 'write' AS operation, path, 'editor' AS role, '' AS repo, 2 AS rank FROM cs), {_DECIDE},
aff AS (SELECT DISTINCT entity AS file, file AS affected FROM g_blast WHERE entity_type = 'file'),
own AS (SELECT DISTINCT change_id, affected FROM cs JOIN aff USING (file)),
mis AS (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.change_id = o.change_id AND cs.file = o.affected)),
rq AS (SELECT change_id, file, req FROM cs JOIN (SELECT entity AS file, req FROM g_violated WHERE entity_type = 'file') USING (file)),
sc AS (SELECT change_id, 2 * ((SELECT count(*) FROM aff a WHERE a.file = cs.file AND {_BACK.format('a.affected')}) + {_BACK.format('cs.file')}::INT) + 4 * (SELECT count(DISTINCT req) FROM rq WHERE rq.file = cs.file) + 3 * (SELECT count(DISTINCT policy) FROM rq JOIN g_enforces USING (req) WHERE rq.file = cs.file) AS score FROM cs),
rep AS (SELECT change_id, coalesce((SELECT bool_and(allowed) FROM cs JOIN dec ON dec.request_id = cs.path WHERE cs.change_id = x.change_id), true) AS authorized,
  (SELECT count(*) FROM own WHERE own.change_id = x.change_id) AS affected_files, (SELECT count(*) FROM mis WHERE mis.change_id = x.change_id) AS missing_files,
  (SELECT count(DISTINCT req) FROM rq WHERE rq.change_id = x.change_id) AS requirements, (SELECT count(DISTINCT policy) FROM rq JOIN g_enforces USING (req) WHERE rq.change_id = x.change_id) AS policies,
  coalesce((SELECT max(score) FROM sc WHERE sc.change_id = x.change_id), 0) AS max_risk FROM (SELECT DISTINCT repo AS change_id FROM g_files) x)""",
    ),
    "q21_summary": _sql("SELECT count(*) AS total, count(*) FILTER (WHERE sensitivity = 'high') AS high, count(*) FILTER (WHERE sensitivity = 'medium') AS medium, count(*) FILTER (WHERE sensitivity = 'low') AS low, (SELECT string_agg(DISTINCT a, ',' ORDER BY a) FROM (SELECT unnest(string_split(articles, ',')) AS a FROM g_pii)) AS articles, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM g_pii", _PII),
    "q22_erasure": _sql(
        "SELECT 'all' AS subject, (SELECT count(*) FROM g_pii) AS total_columns, (SELECT count(DISTINCT file) FROM g_uses WHERE tbl IN (SELECT tbl FROM g_pii)) AS total_files UNION ALL SELECT 'customer', (SELECT count(*) FROM g_pii WHERE subject = 'customer'), (SELECT count(DISTINCT file) FROM g_uses WHERE tbl IN (SELECT tbl FROM g_pii WHERE subject = 'customer')) UNION ALL SELECT 'customer, compat', (SELECT count(*) FROM g_pii), (SELECT count(DISTINCT file) FROM g_uses WHERE tbl IN (SELECT tbl FROM g_pii WHERE subject = 'customer'))",
        _PII,
    ),
    "q23_purpose": _sql("SELECT tbl, name, category, sensitivity, articles FROM g_pii", _PII),
}
