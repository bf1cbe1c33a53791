"""Queries on predictions and replies: set metrics, averages, ranks, paired statistics, top-k, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators import evaluate as ev
from tracewell.operators import retrieval
from tracewell.session import table


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scenario_predictions").dropDuplicates(["prediction_id"])


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("prediction_id", F.explode(F.from_json("oracle_requirements", "array<string>")).alias("item")).distinct()


def _said(spark: SparkSession, d: str) -> DataFrame:
    ids = F.regexp_extract_all("predicted_requirements", F.lit(r"(RQ-\d+)"), F.lit(1))
    return _predictions(spark, d).select("prediction_id", F.explode(ids).alias("item")).distinct()


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row per prediction, also where both sets are empty."""
    key = ["prediction_id"]
    found = ev.set_metrics(_truth(spark, d), _said(spark, d), key)
    rows = _predictions(spark, d).select("prediction_id", "repo", "scenario_id", "entity_type", "provider", "model", "latency_ms")
    return rows.join(found, key, "left").na.fill(0, ["tp", "fp", "fn", "precision", "recall", "f1"])


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


RATIOS = ("precision", "recall", "f1")


def u3_set_counts(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("prediction_id", "tp", "fp", "fn")


def e1_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _r(_metrics(spark, d).select("prediction_id", *RATIOS), *RATIOS)


def a8_micro(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.micro(_metrics(spark, d), ["model"]), *RATIOS)


def a9_macro(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.macro(_metrics(spark, d), ["repo"]), *RATIOS)


def a10_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.macro(_metrics(spark, d), ["entity_type", "model"]), *RATIOS)


def a11_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per repo and over all: scenarios, share with a miss, mean misses, upper median of misses."""
    m = _metrics(spark, d)
    agg = m.rollup("repo").agg(F.count("*").alias("n"), F.avg((F.col("fn") > 0).cast("int")).alias("miss_rate"), F.avg("fn").alias("mean_missed"), ev.upper_median("fn").alias("median_missed"))
    return _r(agg.select(F.coalesce("repo", F.lit("all")).alias("repo"), "n", "miss_rate", "mean_missed", "median_missed"), "miss_rate", "mean_missed")


def a15_caught(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    out = m.groupBy("model").agg(F.sum("tp").alias("caught"), F.sum("fn").alias("missed"), F.sum("fp").alias("false_alarms"))
    return _r(out.withColumn("miss_rate", ev.ratio(F.col("missed"), F.col("caught") + F.col("missed"))), "miss_rate")


def a16_caught_any(spark: SparkSession, d: str) -> DataFrame:
    """Over predictions with a truth: share that catches something, share that misses all."""
    m = _metrics(spark, d).where("tp + fn > 0")
    return _r(m.groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("tp") > 0).cast("int")).alias("caught_any"), F.avg((F.col("tp") == 0).cast("int")).alias("missed_all")), "caught_any", "missed_all")


def a17_changesets(spark: SparkSession, d: str) -> DataFrame:
    """Per scenario the union of oracle policies over its predictions and the worst count."""
    p = _predictions(spark, d).select("scenario_id", F.from_json("oracle_policies", "array<string>").alias("x"))
    return p.groupBy("scenario_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("x")))).alias("policies"), F.max(F.size(F.coalesce("x", F.array().cast("array<string>")))).alias("worst"))


def a18_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate fires where an oracle item is not declared: catch rate over scenarios with an issue, and precision."""
    m = _metrics(spark, d).select("model", (F.col("fn") > 0).alias("fires"), (F.col("tp") + F.col("fn") > 0).alias("issue"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    f, i = F.col("fires"), F.col("issue")
    out = m.groupBy("model").agg(one(f & i).alias("caught"), one(i).alias("issues"), one(f).alias("fired"))
    return _r(out.withColumn("catch_rate", ev.ratio(F.col("caught"), F.col("issues"))).withColumn("gate_precision", ev.ratio(F.col("caught"), F.col("fired"))), "catch_rate", "gate_precision")


def a19_lift(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall by provider side by side, and the difference."""
    p = _metrics(spark, d).groupBy("entity_type").pivot("provider", ["hosted", "local"]).agg(F.avg("recall"))
    return _r(p.withColumn("lift", F.col("hosted") - F.col("local")), "hosted", "local", "lift")


def a22_latency(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("latency_ms").cast("decimal(18,3)")
    return _predictions(spark, d).groupBy("provider", "model").agg(F.count("*").alias("n"), F.sum(ms).cast("double").alias("total_ms"), F.round(F.avg("latency_ms"), 2).alias("mean_ms"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios with both models: mean F1 and whether anything was caught by each."""
    m = _metrics(spark, d).where("model in ('model-a', 'model-b')").groupBy("entity_type", "scenario_id").pivot("model", ["model-a", "model-b"]).agg(F.round(F.avg("f1"), 6).alias("f1"), F.max((F.col("tp") > 0).cast("int")).alias("any"))
    m = m.select("entity_type", "scenario_id", F.col("model-a_f1").alias("a"), F.col("model-b_f1").alias("b"), (F.col("model-a_any") > 0).alias("hit_a"), (F.col("model-b_any") > 0).alias("hit_b"))
    return m.where("a is not null and b is not null")


def j24_paired(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("entity_type", "scenario_id", "a", "b")


def e4_cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    s = p.select("entity_type", F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("value")), F.struct(F.lit("b").alias("side"), F.col("b").alias("value")))))
    return _r(ev.cliffs_delta(s, ["entity_type"]), "delta")


def e5_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return ev.wilcoxon(_pairs(spark, d), ["entity_type"]).select("entity_type", "n", F.round("w", 2).alias("w"))


def e6_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("entity_type", F.col("hit_a").alias("a"), F.col("hit_b").alias("b"))
    return _r(ev.mcnemar(p, ["entity_type"]), "p").withColumnRenamed("both", "hits_both")


def e7_spearman(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).select("model", F.col("latency_ms").alias("a"), (F.col("tp") + F.col("fp")).alias("b"))
    return _r(ev.spearman(m, ["model"]), "rho")


def e8_mae(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return _r(m.groupBy("model").agg(F.avg(F.abs(F.col("fp") - F.col("fn"))).alias("mae")), "mae")


def e9_differences(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("x", F.col("a") - F.col("b"))
    return _r(p.groupBy("entity_type").agg(F.percentile("x", F.lit(0.5)).alias("median"), F.avg("x").alias("mean")), "median", "mean")


def e3_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.bootstrap(_metrics(spark, d).select("model", "prediction_id", "tp", "fp", "fn"), ["model"], rounds=200), "f1", "low", "high")


def w2_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of customers by nation within their market segment, ties sharing their mean."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return ev.average_rank(c, "c_nationkey", ["c_mktsegment"], "rank").select("c_custkey", "rank")


def w4_first_columns(spark: SparkSession, d: str) -> DataFrame:
    """The first two columns of each table by name."""
    c = table(spark, d, "scenario_predictions").where("entity_type = 'column'").select(F.substring_index("entity_name", ".", 1).alias("tbl"), F.substring_index("entity_name", ".", -1).alias("name")).distinct()
    return c.withColumn("n", F.row_number().over(Window.partitionBy("tbl").orderBy("name"))).where("n <= 2").select("tbl", "name")


def w5_first_match(spark: SparkSession, d: str) -> DataFrame:
    """For each order its first line that was returned, else its first line."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("p"), "l_partkey")  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.min_by(F.struct("l_linenumber", "l_partkey"), F.struct("p", "l_linenumber", "l_partkey")).alias("m")).select("l_orderkey", "m.l_linenumber", "m.l_partkey")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "scenario_predictions").where("entity_type <> 'file'").select(F.col("entity_name").alias("query"), F.col("entity_name").alias("name")).distinct()
    t = table(spark, d, "code_files").select(F.col("file_id").alias("id"), F.col("content").alias("text")).distinct()
    return retrieval.scores(q, t)


def l2_lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("query").agg(F.count("*").alias("files"), F.sum("score").alias("score"))


def t1k_top_files(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(_scores(spark, d), 5).select("query", "id", "score", "rank")


def t7k_passages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "code_files").select(F.col("file_id").alias("id"), F.col("content").alias("text")).distinct()
    return retrieval.passages(_scores(spark, d), t).select("query", "id", "rank", F.length("passage").alias("chars"))


def t3k_top_degree(spark: SparkSession, d: str) -> DataFrame:
    """The six parts with most order lines."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(6)


def t5k_text_order(spark: SparkSession, d: str) -> DataFrame:
    """Rules by effect and role in descending text order, the first hundred."""
    r = table(spark, d, "authority_rules").select("record_id", "min_role", "rule_id").distinct()
    w = Window.orderBy(F.desc("min_role"), "rule_id", "record_id")
    return r.orderBy(F.desc("min_role"), "rule_id", "record_id").limit(100).withColumn("n", F.row_number().over(w)).select("n", "rule_id", "min_role")


def t6k_ends(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last sixty suppliers by name."""
    return retrieval.ends(table(spark, d, "supplier").select("s_name"), "s_name")


def u1_union(spark: SparkSession, d: str) -> DataFrame:
    return _truth(spark, d).union(_said(spark, d)).distinct().groupBy("prediction_id").agg(F.count("*").alias("n"))


def u2_difference(spark: SparkSession, d: str) -> DataFrame:
    key = ["prediction_id", "item"]
    return _truth(spark, d).join(_said(spark, d), key, "left_anti")


def u4_subset(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d).select("prediction_id", F.coalesce(F.from_json("oracle_requirements", "array<string>"), F.array().cast("array<string>")).alias("t"), F.coalesce(F.regexp_extract_all("predicted_requirements", F.lit(r"(RQ-\d+)"), F.lit(1)), F.array().cast("array<string>")).alias("q"))
    return p.select("prediction_id", (F.size(F.array_except("t", "q")) == 0).alias("covered"))


def u6_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Event types of each user in the order of their first occurrence."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


QUERIES = {
    f.__name__: f
    for f in (
        u3_set_counts, e1_metrics, a8_micro, a9_macro, a10_by_type, a11_rollup, a15_caught, a16_caught_any, a17_changesets, a18_gate, a19_lift, a22_latency, j24_paired, e4_cliffs_delta, e5_wilcoxon, e6_mcnemar, e7_spearman, e8_mae,
        e9_differences, e3_bootstrap, w2_average_ranks, w4_first_columns, w5_first_match, l2_lexical_scores, t1k_top_files, t7k_passages, t3k_top_degree, t5k_text_order, t6k_ends, u1_union, u2_difference, u4_subset, u6_first_occurrence,
    )
}

_M = """
p AS (SELECT DISTINCT ON (prediction_id) * FROM scenario_predictions),
t AS (SELECT DISTINCT prediction_id, unnest(from_json(oracle_requirements, '["VARCHAR"]')) AS item FROM p WHERE json_valid(oracle_requirements)),
q AS (SELECT DISTINCT prediction_id, unnest(regexp_extract_all(predicted_requirements, 'RQ-[0-9]+')) AS item FROM p),
c AS (SELECT coalesce(t.prediction_id, q.prediction_id) AS prediction_id, count(*) FILTER (WHERE t.item IS NOT NULL AND q.item IS NOT NULL) AS tp, count(*) FILTER (WHERE t.item IS NULL) AS fp, count(*) FILTER (WHERE q.item IS NULL) AS fn
      FROM t FULL JOIN q ON t.prediction_id = q.prediction_id AND t.item = q.item GROUP BY 1),
m0 AS (SELECT p.prediction_id, repo, scenario_id, entity_type, provider, model, latency_ms, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM p LEFT JOIN c USING (prediction_id)),
m AS (SELECT *, {pr} FROM m0)
"""
_PR = "CASE WHEN {tp} + {fp} = 0 THEN 0 ELSE {tp} / ({tp} + {fp}) END AS precision, CASE WHEN {tp} + {fn} = 0 THEN 0 ELSE {tp} / ({tp} + {fn}) END AS recall, CASE WHEN {tp} = 0 THEN 0 ELSE 2 * {tp} / (2 * {tp} + {fp} + {fn}) END AS f1"
_ROWS = _PR.format(tp="tp", fp="fp", fn="fn")
_M = _M.replace("{pr}", _ROWS)
_R6 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_AVG = "round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1"
_PAIRS = f"""{_M}, s AS (SELECT entity_type, scenario_id, model, round(avg(f1), 6) AS f1, max((tp > 0)::INT) > 0 AS hit FROM m WHERE model IN ('model-a', 'model-b') GROUP BY ALL),
pairs AS (SELECT x.entity_type, x.scenario_id, x.f1 AS a, y.f1 AS b, x.hit AS hit_a, y.hit AS hit_b FROM s x JOIN s y ON x.entity_type = y.entity_type AND x.scenario_id = y.scenario_id AND x.model = 'model-a' AND y.model = 'model-b')"""
_SCORES = r"""
tok AS (SELECT DISTINCT entity_name AS query, unnest(list_filter(regexp_split_to_array(lower(entity_name), '[^A-Za-z0-9]+'), lambda x: x <> '')) AS token FROM scenario_predictions WHERE entity_type <> 'file'),
txt AS (SELECT DISTINCT file_id AS id, lower(content) AS text FROM code_files),
hit AS (SELECT id, token, (length(text) - length(replace(text, token, ''))) // length(token) AS n FROM txt JOIN (SELECT DISTINCT token FROM tok) ON contains(text, token)),
sc AS (SELECT query, id, sum(n)::BIGINT AS score FROM tok JOIN hit USING (token) GROUP BY ALL)"""
SQL = {
    "u3_set_counts": f"WITH {_M} SELECT prediction_id, tp, fp, fn FROM m",
    "e1_metrics": f"WITH {_M} SELECT prediction_id, {_R6} FROM m",
    "a8_micro": f"WITH {_M}, g AS (SELECT model, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m GROUP BY model), h AS (SELECT *, {_ROWS} FROM g) SELECT model, tp, fp, fn, {_R6} FROM h",
    "a9_macro": f"WITH {_M} SELECT repo, {_AVG} FROM m GROUP BY repo",
    "a10_by_type": f"WITH {_M} SELECT entity_type, model, {_AVG} FROM m GROUP BY ALL",
    "a11_rollup": f"WITH {_M} SELECT coalesce(repo, 'all') AS repo, count(*) AS n, round(avg((fn > 0)::INT), 6) AS miss_rate, round(avg(fn), 6) AS mean_missed, list_sort(list(fn))[count(*) // 2 + 1] AS median_missed FROM m GROUP BY ROLLUP (repo)",
    "a15_caught": f"WITH {_M} SELECT model, sum(tp)::BIGINT AS caught, sum(fn)::BIGINT AS missed, sum(fp)::BIGINT AS false_alarms, round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 0 ELSE sum(fn) / (sum(tp) + sum(fn)) END, 6) AS miss_rate FROM m GROUP BY model",
    "a16_caught_any": f"WITH {_M} SELECT model, count(*) AS n, round(avg((tp > 0)::INT), 6) AS caught_any, round(avg((tp = 0)::INT), 6) AS missed_all FROM m WHERE tp + fn > 0 GROUP BY model",
    "a17_changesets": "WITH p AS (SELECT DISTINCT ON (prediction_id) scenario_id, from_json(oracle_policies, '[\"VARCHAR\"]') AS x FROM scenario_predictions) SELECT scenario_id, len(list_distinct(flatten(list(x))))::INT AS policies, max(len(coalesce(x, [])))::INT AS worst FROM p GROUP BY scenario_id",
    "a18_gate": f"WITH {_M}, g AS (SELECT model, count(*) FILTER (WHERE fn > 0) AS caught, count(*) FILTER (WHERE tp + fn > 0) AS issues, count(*) FILTER (WHERE fn > 0) AS fired FROM m GROUP BY model) SELECT *, round(CASE WHEN issues = 0 THEN 0 ELSE caught / issues END, 6) AS catch_rate, round(CASE WHEN fired = 0 THEN 0 ELSE caught / fired END, 6) AS gate_precision FROM g",
    "a19_lift": f"WITH {_M} SELECT entity_type, round(avg(recall) FILTER (WHERE provider = 'hosted'), 6) AS hosted, round(avg(recall) FILTER (WHERE provider = 'local'), 6) AS local, round(avg(recall) FILTER (WHERE provider = 'hosted') - avg(recall) FILTER (WHERE provider = 'local'), 6) AS lift FROM m GROUP BY entity_type",
    "a22_latency": "WITH p AS (SELECT DISTINCT ON (prediction_id) * FROM scenario_predictions) SELECT provider, model, count(*) AS n, sum(latency_ms::DECIMAL(18,3))::DOUBLE AS total_ms, round(avg(latency_ms), 2) AS mean_ms FROM p GROUP BY ALL",
    "j24_paired": f"WITH {_PAIRS} SELECT entity_type, scenario_id, a, b FROM pairs",
    "e4_cliffs_delta": f"WITH {_PAIRS} SELECT x.entity_type, round(avg(sign(x.a - y.b)), 6) AS delta FROM pairs x JOIN pairs y ON x.entity_type = y.entity_type GROUP BY ALL",
    "e5_wilcoxon": f"WITH {_PAIRS}, df AS (SELECT entity_type, a - b AS x FROM pairs WHERE a <> b), rk AS (SELECT entity_type, x, rank() OVER (PARTITION BY entity_type ORDER BY abs(x)) + (count(*) OVER (PARTITION BY entity_type, abs(x)) - 1) / 2 AS r FROM df) SELECT entity_type, count(*) AS n, round(least(coalesce(sum(r) FILTER (WHERE x > 0), 0), coalesce(sum(r) FILTER (WHERE x < 0), 0)), 2) AS w FROM rk GROUP BY entity_type",
    "e6_mcnemar": f"WITH RECURSIVE {_PAIRS}, k AS (SELECT entity_type, count(*) FILTER (WHERE hit_a AND hit_b) AS hits_both, count(*) FILTER (WHERE hit_a AND NOT hit_b) AS a_only, count(*) FILTER (WHERE NOT hit_a AND hit_b) AS b_only, count(*) FILTER (WHERE NOT hit_a AND NOT hit_b) AS neither FROM pairs GROUP BY ALL), z AS (SELECT *, a_only + b_only AS n, least(a_only, b_only) AS lo FROM k) SELECT entity_type, hits_both, a_only, b_only, neither, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, lo + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 6) AS p FROM z",
    "e7_spearman": f"WITH {_M}, v AS (SELECT model, latency_ms AS a, tp + fp AS b FROM m WHERE latency_ms IS NOT NULL), r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY a) + (count(*) OVER (PARTITION BY model, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY model ORDER BY b) + (count(*) OVER (PARTITION BY model, b) - 1) / 2 AS rb FROM v) SELECT model, round(coalesce(corr(ra, rb), 0), 6) AS rho FROM r GROUP BY model",
    "e8_mae": f"WITH {_M} SELECT model, round(avg(abs(fp - fn)), 6) AS mae FROM m GROUP BY model",
    "e9_differences": f"WITH {_PAIRS} SELECT entity_type, round(quantile_cont(a - b, 0.5), 6) AS median, round(avg(a - b), 6) AS mean FROM pairs GROUP BY entity_type",
    "w2_average_ranks": "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS rank FROM customer",
    "w4_first_columns": "WITH c AS (SELECT DISTINCT split_part(entity_name, '.', 1) AS tbl, split_part(entity_name, '.', -1) AS name FROM scenario_predictions WHERE entity_type = 'column') SELECT tbl, name FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY name) AS n FROM c) WHERE n <= 2",
    "w5_first_match": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1",
    "l2_lexical_scores": f"WITH {_SCORES} SELECT query, count(*) AS files, sum(score)::BIGINT AS score FROM sc GROUP BY query",
    "t1k_top_files": f"WITH {_SCORES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc) WHERE rank <= 5",
    "t7k_passages": f"WITH {_SCORES}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc) WHERE rank <= 4) SELECT query, id, rank, least(length(content), 900)::INT AS chars FROM k JOIN (SELECT DISTINCT file_id AS id, content FROM code_files) USING (id)",
    "t3k_top_degree": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 6",
    "t5k_text_order": "SELECT row_number() OVER (ORDER BY min_role DESC, rule_id, record_id)::INT AS n, rule_id, min_role FROM (SELECT DISTINCT record_id, min_role, rule_id FROM authority_rules) ORDER BY n LIMIT 100",
    "t6k_ends": "SELECT DISTINCT s_name FROM ((SELECT s_name FROM supplier ORDER BY s_name LIMIT 60) UNION ALL (SELECT s_name FROM supplier ORDER BY s_name DESC LIMIT 60))",
    "u1_union": f"WITH {_M} SELECT prediction_id, count(*) AS n FROM (SELECT * FROM t UNION SELECT * FROM q) GROUP BY 1",
    "u2_difference": f"WITH {_M} SELECT prediction_id, item FROM t EXCEPT SELECT prediction_id, item FROM q",
    "u4_subset": f"WITH {_M} SELECT prediction_id, NOT EXISTS (SELECT 1 FROM t WHERE t.prediction_id = p.prediction_id AND t.item NOT IN (SELECT item FROM q WHERE q.prediction_id = p.prediction_id)) AS covered FROM p",
    "u6_first_occurrence": "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY user_id",
}
