"""Queries that turn texts into rows: schema dialects, code structure, governance documents, agent replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.paths import language
from tracewell.operators import parsers
from tracewell.session import table


_IMPORT = r"""\b(?:from|import|require)\b\s*\(?\s*["']([^"'\n]+)["']"""


def _docs(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "documents").where((F.col("doc_kind") == kind) & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text")


def d2_sql_tables(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "code_files").where("lower(path) like '%.sql'").select(F.col("file_id").alias("id"), F.col("content").alias("text")).distinct()
    return parsers.parse_schemas(files).where("dialect = 'sql'").select("tbl", "col").distinct()


def d7_merged_schema(spark: SparkSession, d: str) -> DataFrame:
    """Tables of all dialects over all code files, united by name."""
    files = table(spark, d, "code_files").select(F.col("file_id").alias("id"), F.col("content").alias("text")).distinct()
    return parsers.merged_schema(parsers.parse_schemas(files)).select("tbl", F.array_join("columns", ",").alias("columns"))


def d8_code_structure(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "code_files").select(F.col("file_id").alias("id"), language(F.col("path")).alias("language"), F.col("content").alias("text")).distinct()
    return parsers.parse_code(files).groupBy("kind", "name").agg(F.countDistinct("id").alias("files"))


def d9_python_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports of script files by their text, without a parser: from, import and require, in either quotes."""
    t = table(spark, d, "code_files").where("lower(path) rlike '\\\\.(ts|tsx|js|jsx)$'").select("file_id", "content").distinct()
    found = F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(1))
    return t.select("file_id", F.explode(F.array_distinct(found)).alias("specifier"))


def d12_front_matter(spark: SparkSession, d: str) -> DataFrame:
    return parsers.front_matter(_docs(spark, d, "requirement")).where("key in ('id', 'title', 'priority', 'tags')")


def d13_rule_blocks(spark: SparkSession, d: str) -> DataFrame:
    return parsers.rule_blocks(_docs(spark, d, "rbac"))


def d14_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and doc_kind in ('requirement', 'policy', 'rbac')").select("doc_id", "text")
    return docs.select("doc_id", *parsers.document_metadata(F.col("text")))


def d15_reply_ids(spark: SparkSession, d: str) -> DataFrame:
    """Requirement ids and paths that each reply names anywhere."""
    r = table(spark, d, "llm_replies").where("raw_response is not null").select(F.col("reply_id").alias("id"), F.col("raw_response").alias("text")).distinct()
    got = parsers.decode_replies(r)
    return got.select("id", F.array_join("requirements", ",").alias("requirements"), F.size("files").alias("n_files"), F.col("parsed").isNotNull().alias("decoded"))


def j27_literal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of requirements that replies name, by id."""
    named = table(spark, d, "llm_replies").select(F.explode(F.regexp_extract_all("raw_response", F.lit(r"(RQ-\d+)"), F.lit(1))).alias("id")).distinct()
    r = table(spark, d, "requirement_records").select(F.upper(F.trim("req_id")).alias("id"), F.length(F.coalesce("description", F.lit(""))).alias("n"))
    return r.groupBy("id").agg(F.max("n").alias("chars")).join(named, "id", "left_semi")


QUERIES = {f.__name__: f for f in (d2_sql_tables, d7_merged_schema, d8_code_structure, d9_python_imports, d12_front_matter, d13_rule_blocks, d14_metadata, d15_reply_ids, j27_literal_texts)}

_LINES = r"lines AS (SELECT id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id AS id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents WHERE doc_kind = '{0}' AND text IS NOT NULL))"
_PICK = r"nullif(regexp_extract(text, '(?im)^(?:{0}):[ \t]*(.+?)[ \t\r]*$', 1), '')"
_RK = r"^\s*(?:-\s*)?(rule_id|operation|path_pattern|min_role|effect|source_priority):[ \t]*(.*?)\s*$"
SQL = {
    "d2_sql_tables": r"WITH c AS (SELECT DISTINCT content FROM code_files WHERE lower(path) LIKE '%.sql'), t AS (SELECT regexp_extract(content, 'CREATE TABLE (\w+) \(', 1) AS tbl, unnest(regexp_extract_all(regexp_extract(content, '(?s)CREATE TABLE \w+ \((.*?)\);', 1), '(?m)^  (\w+) ', 1)) AS col FROM c) SELECT DISTINCT tbl, col FROM t WHERE tbl <> ''",
    "d9_python_imports": r"SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '{_X}', 1)) AS specifier FROM code_files WHERE regexp_matches(lower(path), '\.(ts|tsx|js|jsx)$')".replace("{_X}", _IMPORT.replace("'", "''")),
    "d12_front_matter": f"WITH {_LINES.format('requirement')}, p AS (SELECT id, pos, lower(trim(split_part(line, ':', 1))) AS key, trim(substr(line, instr(line, ':') + 1)) AS value FROM lines WHERE regexp_matches(line, '^[A-Za-z][\\w \\-]*:')) SELECT id, key, arg_max(value, pos) AS value FROM p WHERE key IN ('id', 'title', 'priority', 'tags') GROUP BY ALL",
    "d13_rule_blocks": rf"""WITH {_LINES.format('rbac')}, b AS (SELECT *, sum(regexp_matches(line, '^\s*-\s*rule_id:')::INT) OVER (PARTITION BY id ORDER BY pos) AS block FROM lines),
p AS (SELECT id, block, pos, regexp_extract(line, '{_RK}', 1) AS k, regexp_extract(line, '{_RK}', 2) AS v FROM b WHERE block > 0),
pol AS (SELECT doc_id AS id, regexp_extract(text, '(?im)^Policy ID:[ \t]*(\S+)', 1) AS policy_id FROM documents)
SELECT id, policy_id, {", ".join(f"arg_max(v, pos) FILTER (WHERE k = '{c}') AS {c}" for c in ("rule_id", "operation", "path_pattern", "min_role", "effect"))}, try_cast(arg_max(v, pos) FILTER (WHERE k = 'source_priority') AS INTEGER) AS source_priority FROM p JOIN pol USING (id) WHERE k <> '' GROUP BY id, block, policy_id""".replace("GROUP BY id, block, policy_id", "GROUP BY id, block, policy_id"),
    "d14_metadata": f"SELECT doc_id, {_PICK.format('id|policy id|document id')} AS doc_ref, {_PICK.format('owner')} AS owner, {_PICK.format('effective date|review date')} AS effective_date FROM documents WHERE text IS NOT NULL AND doc_kind IN ('requirement', 'policy', 'rbac')",
    "j27_literal_texts": r"WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(raw_response, 'RQ-\d+')) AS id FROM llm_replies) SELECT upper(trim(req_id)) AS id, max(length(coalesce(description, '')))::INT AS chars FROM requirement_records WHERE upper(trim(req_id)) IN (SELECT id FROM n) GROUP BY 1",
}
