"""Queries on table changes, change events and tokens: the batch side of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import key
from tracewell.operators import dml, gate
from tracewell.session import table
from tracewell.streaming import changes as stream

_CUT = "2025-01-01"


def _versions(spark: SparkSession, d: str, after: bool) -> DataFrame:
    """The last version of each requirement before or after a fixed day."""
    r = table(spark, d, "requirement_records").where(key(F.col("req_id")) != "")
    cut = F.lit(_CUT).cast("timestamp_ntz")
    r = r.where(F.col("recorded_at") >= cut if after else F.col("recorded_at") < cut)
    one = r.groupBy(key(F.col("req_id")).alias("id")).agg(F.max_by(F.struct("title", F.nullif("description", F.lit("")).alias("description"), "category", "status"), F.struct("recorded_at", "record_id")).alias("v"))
    return one.select("id", "v.*")


def k1_upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    return dml.upsert_nodes(_versions(spark, d, False), _versions(spark, d, True), ["id"])


def _edges(spark: SparkSession, d: str, late: bool | None = None) -> DataFrame:
    """References of all policy records, or of those recorded before or after the cut."""
    p = table(spark, d, "policy_records")
    if late is not None:
        p = p.where((F.col("recorded_at") >= F.lit(_CUT).cast("timestamp_ntz")) == F.lit(late))
    p = p.select(key(F.col("policy_id")).alias("src"), F.explode("requirement_ids").alias("r"))
    return p.select("src", key(F.col("r")).alias("dst")).where("src <> '' and dst <> ''").distinct()


def k2_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """References recorded after the cut are merged into those before it where both ends are known."""
    new = _edges(spark, d, True)
    return dml.upsert_edges(_edges(spark, d, False), new, new.select(F.col("src").alias("id")).distinct(), _versions(spark, d, False))


def k3_replace(spark: SparkSession, d: str) -> DataFrame:
    """Order lines of the orders that have a returned line give way to those lines alone."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")  # noqa: E741
    return dml.replace_by_key(l, l.where("l_returnflag = 'R'"), ["l_orderkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


def k4_prune_missing(spark: SparkSession, d: str) -> DataFrame:
    """Of customers in nations of region 1 only those with an order stay."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").where("n_regionkey = 1")
    kept = dml.prune_missing(c.select("c_custkey", "c_nationkey"), n.select(F.col("n_nationkey").alias("c_nationkey")), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_nationkey"], ["c_custkey"])
    return kept.groupBy("c_nationkey").agg(F.count("*").alias("n"))


def k5_clear_outgoing(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "policy_records").where("status = 'deleted'").select(key(F.col("policy_id")).alias("id"))
    return dml.clear_outgoing(_edges(spark, d), gone)


def k6_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Deleted requirements go with all references to them: what is left of nodes and of edges."""
    nodes = _versions(spark, d, True).select("id", "status")
    left, edges = dml.delete_cascade(nodes.select("id"), _edges(spark, d), nodes.where("status = 'deleted'").select("id"))
    return edges.select(F.lit("edge").alias("kind"), "src", "dst").unionByName(left.select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.lit("").alias("dst")))


def k7_prune_stale(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "scenario_predictions")
    cols = named.where("entity_type = 'column'").select(F.substring_index("entity_name", ".", 1).alias("tbl"), F.substring_index("entity_name", ".", -1).alias("name")).distinct()
    live = named.where("entity_type = 'table' and provider = 'hosted'").select(F.col("entity_name").alias("name"))
    return dml.prune_stale(cols, live, "tbl")


def k8_drop_orphans(spark: SparkSession, d: str) -> DataFrame:
    return dml.drop_orphans(_versions(spark, d, False).select("id"), _edges(spark, d))


def k13_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Requirements with stubs for the ids that policies name and nobody recorded."""
    p = table(spark, d, "policy_records").select(key(F.col("policy_id")).alias("id"), F.transform("requirement_ids", key).alias("enforces"))
    return dml.upsert_with_stubs(p, _versions(spark, d, False).select("id", "title"))[1]


def k14_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Ids that would get two labels."""
    new = table(spark, d, "scenario_predictions").select(F.substring_index("entity_name", ".", -1).alias("id"), F.initcap("entity_type").alias("label")).distinct()
    return dml.check_updates(new.where("label <> 'File'"), new.where("label = 'File'"))


def r2_latest_changes(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each path; the events are the rows of the import graph in their order."""
    g = table(spark, d, "import_graph")
    e = g.select(F.concat_ws("/", "repo", "file_path").alias("path"), F.when(F.col("node_id") % 7 == 0, "deleted").otherwise("modified").alias("kind"), F.col("imported_by").alias("content"), F.col("recorded_at").alias("ts"), F.coalesce(F.size("imports"), F.lit(0)).alias("seq"))
    return dml.latest_changes(e).groupBy("kind").agg(F.count("*").alias("n"))


def r3_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each user's events: one row where no further event follows within ten minutes."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return stream.bursts(e, "10 minutes").select("key", "n")


def r5_token_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events replayed as tokens: a user's first sign-up of a kind issues one, later events consume it."""
    e = table(spark, d, "events")
    ev = e.select(
        "event_id", F.concat_ws("-", (F.col("user_id") % 400).cast("string"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400).cast("string")).alias("token"),
        F.when(F.col("event_type") == "signup", "issue").otherwise("consume").alias("kind"), F.lit("write").alias("operation"),
        F.array(F.lit("click"), F.lit("view"), F.lit("/purchase/")).alias("files"), F.col("event_type").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
    )
    return gate.replay_tokens(ev, 43_200.0).groupBy("error").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (k1_upsert_nodes, k2_upsert_edges, k3_replace, k4_prune_missing, k5_clear_outgoing, k6_delete_cascade, k7_prune_stale, k8_drop_orphans, k13_stubs, k14_conflicts, r2_latest_changes, r3_debounce, r5_token_replay)}

_K = r"upper(regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_V = f"""
v AS (SELECT {_K.format('req_id')} AS id, recorded_at >= TIMESTAMP '{_CUT}' AS late, arg_max(struct_pack(title := title, description := nullif(description, ''), category := category, status := status), (recorded_at, record_id)) AS x FROM requirement_records GROUP BY ALL),
old AS (SELECT id, x.* FROM v WHERE NOT late AND id <> ''), new AS (SELECT id, x.* FROM v WHERE late AND id <> ''),
e0 AS (SELECT {_K.format('policy_id')} AS src, {_K.format('r')} AS dst, t FROM (SELECT policy_id, recorded_at AS t, unnest(requirement_ids) AS r FROM policy_records)),
e AS (SELECT DISTINCT src, dst FROM e0 WHERE src <> '' AND dst <> '')"""
SQL = {
    "k1_upsert_nodes": f"WITH {_V} SELECT id, coalesce(new.title, old.title) AS title, coalesce(new.description, old.description) AS description, coalesce(new.category, old.category) AS category, coalesce(new.status, old.status) AS status FROM old FULL JOIN new USING (id)",
    "k2_upsert_edges": f"WITH {_V} SELECT src, dst FROM (SELECT DISTINCT src, dst, t FROM e0 WHERE src <> '' AND dst <> '') WHERE t < TIMESTAMP '{_CUT}' OR t >= TIMESTAMP '{_CUT}' AND dst IN (SELECT id FROM old) GROUP BY ALL",
    "k3_replace": "SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem WHERE l_returnflag = 'R' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "k4_prune_missing": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "k5_clear_outgoing": f"WITH {_V} SELECT src, dst FROM e WHERE src NOT IN (SELECT {_K.format('policy_id')} FROM policy_records WHERE status = 'deleted')",
    "k6_delete_cascade": f"WITH {_V}, g AS (SELECT id FROM new WHERE status = 'deleted') SELECT 'edge' AS kind, src, dst FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) UNION ALL SELECT 'node', id, '' FROM new WHERE id NOT IN (SELECT id FROM g)",
    "k7_prune_stale": "SELECT DISTINCT split_part(entity_name, '.', 1) AS tbl, split_part(entity_name, '.', -1) AS name FROM scenario_predictions WHERE entity_type = 'column' AND split_part(entity_name, '.', 1) IN (SELECT entity_name FROM scenario_predictions WHERE entity_type = 'table' AND provider = 'hosted')",
    "k8_drop_orphans": f"WITH {_V} SELECT id FROM old WHERE id IN (SELECT dst FROM e)",
    "k13_stubs": f"WITH {_V} SELECT id, title FROM old UNION ALL SELECT DISTINCT dst, NULL FROM e WHERE dst NOT IN (SELECT id FROM old)",
    "k14_conflicts": "SELECT id, 'label conflict' AS problem FROM (SELECT DISTINCT split_part(entity_name, '.', -1) AS id, entity_type AS label FROM scenario_predictions) GROUP BY id HAVING count(*) > 1 AND count(*) FILTER (WHERE label <> 'file') > 0",
    "r2_latest_changes": r"WITH e AS (SELECT regexp_replace(regexp_replace(trim(replace(repo || '/' || file_path, '\', '/')), '^(\./)+', ''), '^/+|/+$', '', 'g') AS path, CASE WHEN node_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS kind, recorded_at, coalesce(len(imports), 0) AS seq FROM import_graph) SELECT kind, count(*) AS n FROM (SELECT path, arg_max(kind, (recorded_at, seq)) AS kind FROM e GROUP BY path) GROUP BY kind",
    "r3_debounce": "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS first FROM events), b AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s) SELECT user_id::VARCHAR AS key, count(*) AS n FROM b GROUP BY user_id, burst",
}
