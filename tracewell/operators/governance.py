"""The governance graph as node and edge tables, and change impact for many entities at once.

Text is linked with names by equality of words: both sides are words, so no pattern is tried on any text.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.paths import gate_path, is_backend, language
from tracewell.functions.text import key, repo_path
from tracewell.operators import risk
from tracewell.operators.calls import call_edges, calling_files
from tracewell.operators.graph import closure
from tracewell.operators.hierarchy import every_link, resolve_links
from tracewell.operators.meet import placed, shared
from tracewell.operators.parsers import parse_code
from tracewell.operators.rules import decide
from tracewell.session import Scratch, table

_FUNCTION = r"(?:function|def|func)\s+(?:\([^)]*\)\s*)?(\w+)\s*\("
_METHOD = r"def (\w+)\(self"


def words(text: Column) -> Column:
    """Distinct words: runs of ASCII letters, digits and underscores, as \\w is without flags."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\w+)"), F.lit(1)))


class Graph:
    """The graph of the test tables. Every frame is made when it is first asked for; what comes from the text of the
    files or from resolved links is written once and then read by all that need it.

    files(file, repo, path, language), tables(name), columns(tbl, name), functions(file, name, is_method),
    requirements(id, title, description, category), policies(id, description), identifiers(file, name);
    edges imports(src, dst), calls(file, caller, dst, callee), uses_table(file, tbl), references_column(file, tbl, name),
    enforces(policy, req), governs_table(req, tbl), governs_column(req, tbl, name). Of the importers of a file all count
    with ``every_importer``, else the one with the least node_id, as in the SQL of the queries that do without it.
    """

    def __init__(self, spark: SparkSession, folder: str, every_importer: bool = False):
        self.spark, self.folder, self.every_importer = spark, folder, every_importer

    @cached_property
    def _scratch(self) -> Scratch:
        return Scratch(self.spark)

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def _code(self) -> DataFrame:
        """The source files, where a row may be repeated, for what is made distinct later than in whole texts."""
        raw = self._table("code_files").select("file_id", "repo", repo_path(F.col("path")).alias("path"), "content")
        return raw.withColumn("language", language(F.col("path"))).where("language is not null").withColumn("file", F.concat_ws("/", "repo", "path"))

    @cached_property
    def code(self) -> DataFrame:
        """file, repo, path, language, content of the source files."""
        return self._code.distinct()

    @cached_property
    def _nodes(self) -> DataFrame:
        return self._table("import_graph").select("node_id", "repo", repo_path(F.col("file_path")).alias("path")).distinct().withColumn("file", F.concat_ws("/", "repo", "path"))

    @cached_property
    def files(self) -> DataFrame:
        return self._code.select("file", "repo", "path").union(self._nodes.select("file", "repo", "path")).distinct().withColumn("language", language(F.col("path")))

    @cached_property
    def imports(self) -> DataFrame:
        resolve = every_link if self.every_importer else resolve_links
        links = resolve(self._table("import_graph"), self._table("repo_specs")).where("parent_id is not null")
        ids = self._nodes.select("node_id", "file")
        pairs = links.join(ids, "node_id").withColumnRenamed("file", "dst").join(ids.select(F.col("node_id").alias("parent_id"), F.col("file").alias("src")), "parent_id")
        return self._scratch.write(pairs.select("src", "dst").distinct(), "imports")

    @cached_property
    def _numbers(self) -> DataFrame:
        """file, id: a number for each file, as pairs of numbers take less room than pairs of paths."""
        return self._scratch.write(self.files.select("file").distinct().withColumn("id", F.monotonically_increasing_id()), "numbers")

    @cached_property
    def _named(self) -> DataFrame:
        return self._table("scenario_predictions").select("entity_type", "entity_name").distinct()

    @cached_property
    def columns(self) -> DataFrame:
        return self._named.where("entity_type = 'column'").select(F.substring_index("entity_name", ".", 1).alias("tbl"), F.substring_index("entity_name", ".", -1).alias("name")).distinct()

    @cached_property
    def tables(self) -> DataFrame:
        return self._named.where("entity_type = 'table'").select(F.col("entity_name").alias("name")).union(self.columns.select("tbl")).distinct()

    @cached_property
    def _words(self) -> DataFrame:
        return self._code.select("file", F.explode(words(F.col("content"))).alias("word"))

    @cached_property
    def _said(self) -> DataFrame:
        return self._words.distinct()

    @cached_property
    def _mentions(self) -> DataFrame:
        """file, word: the words of the files that are names of tables or columns."""
        names = self.tables.select(F.col("name").alias("word")).union(self.columns.select("name")).distinct()
        return self._scratch.write(self._words.join(names, "word", "left_semi").select("file", "word").distinct(), "mentions")

    @cached_property
    def uses_table(self) -> DataFrame:
        return self._mentions.join(self.tables, self._mentions["word"] == self.tables["name"]).select("file", F.col("name").alias("tbl"))

    @cached_property
    def references_column(self) -> DataFrame:
        return self._mentions.join(self.columns, self._mentions["word"] == self.columns["name"]).select("file", "tbl", "name")

    @cached_property
    def identifiers(self) -> DataFrame:
        return self._said.where(F.col("word").rlike("^[A-Za-z_]")).select("file", F.col("word").alias("name"))

    @cached_property
    def functions(self) -> DataFrame:
        pick = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
        found = self._code.select("file", F.explode(F.array_distinct(pick(_FUNCTION))).alias("name"), F.array_distinct(pick(_METHOD)).alias("m"))
        return self._scratch.write(found.groupBy("file", "name").agg(F.bool_or(F.array_contains("m", F.col("name"))).alias("is_method")), "functions")

    @cached_property
    def calls(self) -> DataFrame:
        parsed = parse_code(self.code.select(F.col("file").alias("id"), "language", F.col("content").alias("text"))).where("kind = 'call'")
        said = parsed.select(F.col("id").alias("file"), F.col("within").alias("caller"), F.col("name").alias("callee"))
        return self._scratch.write(call_edges(said, self.functions, self.imports), "calls")

    @cached_property
    def calling_files(self) -> DataFrame:
        return self._scratch.write(calling_files(self.calls), "calling")

    @cached_property
    def requirements(self) -> DataFrame:
        return latest(self._table("requirement_records").select("req_id", "title", "description", "category", "status", "recorded_at", "record_id"), "req_id").drop("status")

    @cached_property
    def _policies(self) -> DataFrame:
        return latest(self._table("policy_records").select("policy_id", "description", "requirement_ids", "status", "recorded_at", "record_id"), "policy_id").drop("status")

    @cached_property
    def policies(self) -> DataFrame:
        return self._policies.drop("requirement_ids")

    @cached_property
    def enforces(self) -> DataFrame:
        named = self._policies.select(F.col("id").alias("policy"), F.explode("requirement_ids").alias("r")).select("policy", key(F.col("r")).alias("req")).where("req <> ''").distinct()
        return named.join(self.requirements.select(F.col("id").alias("req")), "req", "left_semi").select("policy", "req")

    @cached_property
    def _told(self) -> DataFrame:
        return self.requirements.select(F.col("id").alias("req"), F.explode(words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))).alias("word"))

    @cached_property
    def _spelled(self) -> DataFrame:
        """entity_type, entity, word: the names that stand for a table, which are its own and its columns', or a column."""
        t = self.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity"), F.col("name").alias("word"))
        ct = self.columns.select(F.lit("table"), "tbl", "name")
        c = self.columns.select(F.lit("column"), F.concat_ws(".", "tbl", "name"), "name")
        return self._scratch.write(t.union(ct).union(c).distinct(), "spelled")

    @cached_property
    def _ruled(self) -> DataFrame:
        """req, word: the names of tables or columns that each requirement says."""
        names = self.tables.select(F.col("name").alias("word")).union(self.columns.select("name")).distinct()
        return self._scratch.write(self._told.join(names, "word", "left_semi").select("req", "word").distinct(), "ruled")

    @cached_property
    def _enforced(self) -> DataFrame:
        """policy, word: the names that the requirements say which each policy enforces."""
        return self._ruled.join(self.enforces, "req").select("policy", "word").distinct()

    @cached_property
    def governs_table(self) -> DataFrame:
        return self._told.join(self.tables, self._told["word"] == self.tables["name"]).select("req", F.col("name").alias("tbl"))

    @cached_property
    def governs_column(self) -> DataFrame:
        return self._told.join(self.columns, self._told["word"] == self.columns["name"]).select("req", "tbl", "name")

    def nodes(self) -> dict[str, DataFrame]:
        return {"File": self.files, "Table": self.tables, "Column": self.columns, "Function": self.functions, "Method": self.functions.where("is_method"), "Requirement": self.requirements, "Policy": self.policies, "Identifier": self.identifiers.select("name").distinct()}

    def edges(self) -> dict[str, DataFrame]:
        return {
            "IMPORTS": self.imports, "USES_TABLE": self.uses_table, "REFERENCES_COLUMN": self.references_column, "HAS_COLUMN": self.columns,
            "ENFORCES": self.enforces, "GOVERNS": self.governs_table.select("req", "tbl", F.lit("").alias("name")).unionByName(self.governs_column),
            "DECLARES_FUNCTION": self.functions, "USES_IDENTIFIER": self.identifiers, "CALLS": self.calls,
        }


def latest(rows: DataFrame, name: str) -> DataFrame:
    """The last recorded version of each key, where it is not deleted."""
    names = [c for c in rows.columns if c not in (name, "recorded_at", "record_id", "ingested_at")]
    last = rows.where(key(F.col(name)) != "").groupBy(key(F.col(name)).alias("id")).agg(F.max_by(F.struct(*names), F.struct("recorded_at", "record_id")).alias("v"))
    return last.select("id", "v.*").where("coalesce(status, '') <> 'deleted'")


def build(spark: SparkSession, d: str, every_importer: bool = False) -> Graph:
    """The graph of the test tables in a folder."""
    return Graph(spark, d, every_importer)


def direct_files(g: Graph) -> DataFrame:
    """entity_type, entity, file: what uses each table or references each column; of a file its importers."""
    by_file = g.imports.select(F.lit("file").alias("entity_type"), F.col("dst").alias("entity"), F.col("src").alias("file"))
    return shared(placed(g._mentions, "file"), placed(g._spelled, "entity_type", "entity")).select("entity_type", "entity", "file").unionByName(by_file)


def importers(g: Graph) -> DataFrame:
    """Edges from a file to the files that import it, for reverse reachability."""
    return g.imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _spread(g: Graph, max_depth: int, call_seed: str, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """how, word, file of the names, and how, entity, file of the files: what they reach, before names become entities.

    Of the files those of ``entities`` (entity_type, entity), or all.
    """
    number = lambda df, c, to: df.join(g._numbers.select(F.col("file").alias(c), F.col("id").alias(to)), c).drop(c)
    links = number(number(importers(g), "src", "id"), "dst", "other")
    reach = closure(links.select(F.col("id").alias("src"), F.col("other").alias("dst")), max_depth).select(F.col("src").alias("id"), F.col("dst").alias("other"))
    callers = number(number(g.calling_files, "file", "id"), "caller_file", "other")

    def grown(direct: DataFrame, c: str) -> DataFrame:
        start = number(direct, "file", "id")
        further = start.join(reach, "id").select(c, F.col("other").alias("id")).distinct()
        seeds = start if call_seed == "direct" else start.unionByName(further).distinct()
        calling = seeds.join(callers, "id").select(c, F.col("other").alias("id")).distinct()
        more = reduce(DataFrame.unionByName, [df.select(F.lit(how).alias("how"), c, "id") for how, df in (("transitive", further), ("calls", calling))])
        return direct.select(F.lit("direct").alias("how"), c, "file").unionByName(more.join(g._numbers, "id").select("how", c, "file"))

    by_word = grown(g._mentions.select("word", "file"), "word")
    of = g.imports.select(F.col("dst").alias("entity"), F.col("src").alias("file"))
    if entities is not None:
        of = of.join(entities.where("entity_type = 'file'").select("entity"), "entity", "left_semi")
    by_file = grown(of, "entity")
    return g._scratch.write(by_word, "words_reached"), g._scratch.write(by_file, "files_reached")


def blast_radius(g: Graph, entities: DataFrame, max_depth: int = 25, call_seed: str = "direct") -> DataFrame:
    """entity_type, entity, file, how: direct, transitive and calling files of the entities (entity_type, entity).

    transitive are those that import a direct file within ``max_depth`` links, calls those with a function that calls
    one of a direct file within three; with ``call_seed`` closure, of a direct or transitive file. What the tables and
    columns reach is found once for each name, as one name stands for the columns of many tables, and becomes rows of
    the entities in the last step, where no pair has to be made distinct.
    """
    by_word, by_file = _spread(g, max_depth, call_seed, entities)
    out = [_entities_of(g, by_word.where(F.col("how") == how), entities).select("entity_type", "entity", "file", F.lit(how).alias("how")) for how in ("direct", "transitive", "calls")]
    files = by_file.select(F.lit("file").alias("entity_type"), "entity", "file", "how")
    return reduce(DataFrame.unionByName, [*out, files])


def _entities_of(g: Graph, reached: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_type, entity and the column file of ``reached`` (word, file), each pair once, for tables and columns."""
    spelled = g._spelled.join(entities, ["entity_type", "entity"], "left_semi")
    return shared(placed(reached, "file"), placed(spelled, "entity_type", "entity")).select("entity_type", "entity", "file")


def governed(g: Graph) -> DataFrame:
    """entity_type, entity, req: requirements that govern a table or column."""
    t = g.governs_table.select(F.lit("table").alias("entity_type"), F.col("tbl").alias("entity"), "req")
    c = g.governs_column.select(F.lit("column").alias("entity_type"), F.concat_ws(".", "tbl", "name").alias("entity"), "req")
    return t.union(c).distinct()


def file_burden(g: Graph, files: DataFrame | None = None) -> DataFrame:
    """file, requirements, policies: how many requirements govern what each file uses, and how many policies enforce
    one of them; of ``files`` (column file) or of all, where there is any requirement."""
    said = g._mentions if files is None else g._mentions.join(files.select("file"), "file", "left_semi")
    count = lambda right, c, n: shared(placed(said, "file"), placed(right, c)).groupBy("file").agg(F.count("*").alias(n))
    return count(g._ruled, "req", "requirements").join(count(g._enforced, "policy", "policies"), "file", "left").na.fill(0, ["policies"])


def impact(g: Graph, entities: DataFrame, max_depth: int = 25) -> DataFrame:
    """One row per entity: direct, transitive, calling, all and backend files, requirements, risk and severity, and
    what ``explain`` adds: functions and policies.

    entities: entity_type, entity. Entities without any file or requirement have zeros. The lists that the counts are
    of are the rows of ``blast_radius`` and ``governed``.
    """
    by_word, by_file = _spread(g, max_depth, "direct", entities)
    keys = ["entity_type", "entity"]
    back = is_backend(F.col("file")).cast("int")
    hows = {"direct": "direct_files", "transitive": "transitive_files", "calls": "calling_files"}
    each = [_entities_of(g, by_word.where(F.col("how") == how), entities).select(*keys, F.lit(how).alias("how"), F.lit(None).cast("int").alias("backend")) for how in hows]
    each.append(_entities_of(g, by_word.select("word", "file").distinct(), entities).select(*keys, F.lit("any").alias("how"), back.alias("backend")))
    own = by_file.select(F.lit("file").alias("entity_type"), "entity", "file", "how")
    each.append(own.select(*keys, "how", F.lit(None).cast("int").alias("backend")))
    each.append(own.select(*keys, "file").distinct().select(*keys, F.lit("any").alias("how"), back.alias("backend")))
    number = lambda how: F.count(F.when(F.col("how") == how, 1))
    f = reduce(DataFrame.unionByName, each).groupBy(*keys).agg(*[number(how).alias(n) for how, n in hows.items()], number("any").alias("affected_files"), F.sum("backend").alias("backend_files"))
    r = governed(g).groupBy("entity_type", "entity").agg(F.count("*").alias("requirements"))
    more = explain(g).select("entity_type", "entity", "functions", "policies")
    out = entities.join(f, keys, "left").join(r, keys, "left").join(more, keys, "left").na.fill(0)
    counted = F.when(F.col("entity_type") == "file", F.col("affected_files")).otherwise(F.col("backend_files"))
    points = risk.score(counted, F.lit(0), F.col("requirements"), F.lit(0))
    return out.withColumn("risk_score", points).withColumn("risk_severity", risk.severity(F.col("risk_score")))


def traces(g: Graph, backend_only: bool = True) -> DataFrame:
    """entity_type, entity, trace: the chains by which each entity reaches files, functions, requirements, policies.

    A requirement that a policy enforces appears with its policies only, for tables and columns.
    """
    ok = (lambda df, c: df.where(is_backend(F.col(c)))) if backend_only else (lambda df, c: df)
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]) for p in parts])
    row = lambda df, kind, entity, trace: df.select(F.lit(kind).alias("entity_type"), entity.alias("entity"), trace.alias("trace"))
    col = F.concat_ws(".", "tbl", "name")
    used = ok(g.uses_table, "file")
    fns = used.join(g.functions.select("file", F.col("name").alias("fn")), "file")
    gt = g.governs_table.join(g.enforces, "req", "left")
    gc = g.governs_column.join(g.enforces, "req", "left")
    tables, names = g.tables.select(F.col("name").alias("word")), g.columns.select(F.col("name").alias("word")).distinct()
    of = lambda df, c, kind: placed(df.join(kind, "word", "left_semi"), c)
    ft, fc = (shared(of(g._mentions, "file", k), of(g._ruled, "req", k).join(g.enforces, "req", "left")) for k in (tables, names))
    by_file = lambda df, link: row(df, "file", F.col("file"), F.concat(s("File(", "$file", f") -> {link} -> Requirement(", "$req", ")"), F.coalesce(s(" -> Policy(", "$policy", ")"), F.lit(""))))
    plain = lambda df: df.where("policy is null")
    with_p = lambda df: df.where("policy is not null")
    no_fn = used.join(g.functions.select("file").distinct(), "file", "left_anti")
    parts = [
        row(no_fn, "table", F.col("tbl"), s("Table(", "$tbl", ") -> File(", "$file", ")")),
        row(fns, "table", F.col("tbl"), s("Table(", "$tbl", ") -> File(", "$file", ") -> Function(", "$fn", ")")),
        row(plain(gt), "table", F.col("tbl"), s("Table(", "$tbl", ") -> Requirement(", "$req", ")")),
        row(with_p(gt), "table", F.col("tbl"), s("Table(", "$tbl", ") -> Requirement(", "$req", ") -> Policy(", "$policy", ")")),
        row(g.columns, "column", col, s("Column(", "$name", ") -> Table(", "$tbl", ")")),
        row(plain(gc), "column", col, s("Column(", "$name", ") -> Requirement(", "$req", ")")),
        row(with_p(gc), "column", col, s("Column(", "$name", ") -> Requirement(", "$req", ") -> Policy(", "$policy", ")")),
        row(g.enforces, "requirement", F.col("req"), s("Requirement(", "$req", ") -> Policy(", "$policy", ")")),
        row(g.enforces, "policy", F.col("policy"), s("Policy(", "$policy", ") -> Requirement(", "$req", ")")),
    ]
    # ids are in capitals and the file is in its own column, so no two rows of files are the same
    return reduce(DataFrame.unionByName, [reduce(DataFrame.unionByName, parts).distinct(), by_file(ft, "USES_TABLE"), by_file(fc, "REFERENCES_COLUMN")])


def explain(g: Graph) -> DataFrame:
    """One row per table or column: counts of backend files, functions, requirements and policies with the risk.

    Of a table, files that use it count with their functions; of a column only requirements and policies.
    """
    col = F.concat_ws(".", "tbl", "name")
    entities = g.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity")).union(g.columns.select(F.lit("column"), col)).distinct()
    used = g.uses_table.where(is_backend(F.col("file")))
    files = used.groupBy("tbl").agg(F.count("*").alias("files"))
    fns = used.join(g.functions, "file").groupBy("tbl").agg(F.count("*").alias("functions"))
    by_table = files.join(fns, "tbl", "left").select(F.lit("table").alias("entity_type"), F.col("tbl").alias("entity"), "files", F.coalesce("functions", F.lit(0)).alias("functions"))
    hit = governed(g)
    reqs = hit.groupBy("entity_type", "entity").agg(F.count("*").alias("requirements"))
    pols = hit.join(g.enforces, "req").select("entity_type", "entity", "policy").distinct().groupBy("entity_type", "entity").agg(F.count("*").alias("policies"))
    out = reduce(lambda a, b: a.join(b, ["entity_type", "entity"], "left"), [by_table, reqs, pols], entities).na.fill(0)
    points = risk.score(F.col("files"), F.col("functions"), F.col("requirements"), F.col("policies"))
    out = out.withColumn("risk_score", points).withColumn("risk_severity", risk.severity(F.col("risk_score")))
    said = F.format_string("%s %s affects %d files, %d functions, violates %d requirements, and enforces %d policies.", "entity_type", "entity", "files", "functions", "requirements", "policies")
    return out.withColumn("summary", said)


def propose(g: Graph, plans: DataFrame, access: DataFrame, role: str, operation: str, strict: bool = True) -> DataFrame:
    """One row per plan: plan_id, decision, rbac_allowed, rbac_reason, declared, actual, missed, violated, silent, policies, token.

    plans: plan_id, repo, entity_type, entity, declared (paths in the repo), requirements (declared ids); access: valid
    rules. actual counts the blast radius of the entity within the repo, missed what of it is not declared, violated the
    requirements of the entity, silent those not declared, policies what enforces them. A plan is blocked where one of
    its files may not be changed; where it misses files or requirements it is blocked, or warned about if not
    ``strict``. The token stands for the operation on the declared files and is there only where the plan is allowed.
    A plan without files is authorized. Access is decided once per path and impact once per entity; of both lists only
    what a plan declares is joined with it, so no plan is multiplied by its blast radius.
    """
    keys = ["entity_type", "entity"]
    name = F.when(F.col("entity_type") == "file", F.concat_ws("/", "repo", repo_path(F.col("entity")))).otherwise(F.col("entity"))
    plans = plans.withColumn("entity", name)
    each = plans.select("plan_id", "repo", *keys, F.posexplode("declared").alias("pos", "path")).withColumn("path", gate_path(F.col("path"))).where("path <> ''")
    each = each.groupBy("plan_id", "repo", *keys, "path").agg(F.min("pos").alias("pos"))
    asked = each.select(F.col("path").alias("request_id"), F.lit(operation).alias("operation"), "path", F.lit(role).alias("role")).distinct()
    judged = each.join(decide(asked, access).select(F.col("request_id").alias("path"), "allowed", "reason"), "path")
    said = F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.struct("pos", "reason"))))  # as many as one plan declares
    allowed = judged.groupBy("plan_id").agg(F.count("*").alias("declared"), F.bool_and("allowed").alias("rbac_allowed"), F.array_join(F.transform(said, lambda x: x["reason"]), "; ").alias("rbac_reason"), F.sha2(F.concat_ws("\n", F.lit(operation), F.array_sort(F.collect_list("path"))), 256).alias("token"))

    entities = plans.select(*keys).where("entity is not null").distinct()
    by_word, by_file = _spread(g, 25, "direct")
    places = g.files.select("file", "repo", gate_path(F.col("path")).alias("path"))
    said = g._scratch.write(by_word.select("word", "file").distinct().join(places, "file").select("word", "repo", "path").distinct(), "words_actual")
    own = by_file.select(F.lit("file").alias("entity_type"), "entity", "file").join(entities, keys, "left_semi").join(places, "file")
    own = g._scratch.write(own.select(*keys, "repo", "path").distinct(), "files_actual")
    spelled = g._spelled.join(entities, keys, "left_semi")
    actual = shared(placed(said, "repo", "path"), placed(spelled, *keys)).select(*keys, "repo").unionByName(own.select(*keys, "repo")).groupBy(*keys, "repo").agg(F.count("*").alias("actual"))
    hit = each.join(said, ["repo", "path"]).join(spelled, [*keys, "word"], "left_semi").select(*each.columns).unionByName(each.join(own, [*keys, "repo", "path"], "left_semi").select(*each.columns))
    met = hit.distinct().groupBy("plan_id").agg(F.count("*").alias("met"))
    mine = entities.where("entity_type = 'file'").select(F.col("entity").alias("file"))
    broken = shared(placed(g._mentions.join(mine, "file", "left_semi"), "file"), placed(g._ruled, "req")).select(F.lit("file").alias("entity_type"), F.col("file").alias("entity"), "req")
    broken = g._scratch.write(governed(g).join(entities, keys, "left_semi").unionByName(broken), "broken")
    reqs = broken.groupBy(*keys).agg(F.count("*").alias("violated"))
    pols = broken.join(g.enforces, "req").groupBy(*keys).agg(F.countDistinct("policy").alias("policies"))
    told = plans.select("plan_id", *keys, F.explode("requirements").alias("r")).select("plan_id", *keys, key(F.col("r")).alias("req")).distinct()
    known = told.join(broken, [*keys, "req"], "left_semi").groupBy("plan_id").agg(F.count("*").alias("known"))

    out = plans.select("plan_id", "repo", *keys).join(actual, [*keys, "repo"], "left").join(reqs, keys, "left").join(pols, keys, "left")
    for more in (allowed, met, known):
        out = out.join(more, "plan_id", "left")
    out = out.na.fill(0, ["declared", "actual", "met", "violated", "policies", "known"]).na.fill(True, ["rbac_allowed"])
    out = out.withColumn("missed", F.col("actual") - F.col("met")).withColumn("silent", F.col("violated") - F.col("known"))
    decision = F.when(~F.col("rbac_allowed"), "block").when((F.col("missed") > 0) | (F.col("silent") > 0), "block" if strict else "warn").otherwise("allow")
    out = out.withColumn("decision", decision).withColumn("rbac_reason", F.when(F.col("rbac_allowed"), "Authorized.").otherwise(F.col("rbac_reason")))
    none = F.sha2(F.lit(operation), 256)
    token = F.when(F.col("decision") == "allow", F.coalesce("token", none)).otherwise("")
    return out.select("plan_id", "decision", "rbac_allowed", "rbac_reason", "declared", "actual", "missed", "violated", "silent", "policies", token.alias("token"))


def change_report(g: Graph, changesets: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per changeset: totals, missing files, worst risk and verdict.

    changesets: change_id, file; decisions: change_id, authorized. Every file's impact is computed once for all
    changesets that hold it.
    """
    entities = changesets.select(F.lit("file").alias("entity_type"), F.col("file").alias("entity")).distinct()
    affected = blast_radius(g, entities).select(F.col("entity").alias("file"), F.col("file").alias("affected")).distinct()
    own = changesets.join(affected, "file").select("change_id", "affected").distinct()
    missing = own.join(changesets.select("change_id", F.col("file").alias("affected")), ["change_id", "affected"], "left_anti")
    said = g._scratch.write(changesets.join(g._mentions, "file").select("change_id", "word").distinct(), "changed_words")
    reqs, pols = (shared(placed(said, "change_id"), placed(df, c)) for df, c in ((g._ruled, "req"), (g._enforced, "policy")))
    per_file = affected.where(is_backend(F.col("affected"))).groupBy("file").agg(F.count("*").alias("f"))
    held = file_burden(g, changesets).select("file", F.col("requirements").alias("r"), F.col("policies").alias("p"))
    self_backend = is_backend(F.col("file")).cast("long")
    scored = changesets.join(per_file, "file", "left").join(held, "file", "left").na.fill(0, ["f", "r", "p"])
    scored = scored.withColumn("score", risk.score(F.col("f") + self_backend, F.lit(0), F.col("r"), F.col("p")))
    count = lambda df, c, n: df.groupBy("change_id").agg(F.countDistinct(c).alias(n))
    out = reduce(
        lambda a, b: a.join(b, "change_id", "left"),
        [count(own, "affected", "affected_files"), count(missing, "affected", "missing_files"), count(reqs, "req", "requirements"), count(pols, "policy", "policies"), scored.groupBy("change_id").agg(F.max("score").alias("max_risk"))],
        decisions.select("change_id", "authorized"),
    ).na.fill(0)
    return out.withColumn("verdict", risk.report_verdict(F.col("authorized"), F.col("requirements"), F.col("missing_files"), F.col("max_risk")))
