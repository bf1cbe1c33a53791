from pyspark.sql import functions as F

from tracewell.operators import rules


def test_counts_of_rules_are_those_of_their_pairs(spark, small):
    from tracewell.plans.rules import _requests, _rules

    q, r = _requests(spark, small), _rules(spark, small)
    want = rules.matches(q, r).groupBy("request_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("outcome") == "deny", 1).otherwise(0)).alias("denies"))
    assert sorted(map(tuple, rules.match_counts(q, r).collect())) == sorted(map(tuple, want.collect()))


def test_many_rules_with_one_pattern_are_counted_without_pairs(spark):
    """4000 requests under 5000 rules are 20 million pairs; none is made."""
    q = spark.range(4000).select(F.col("id").cast("string").alias("request_id"), F.lit("write").alias("operation"), F.lit("src/a.py").alias("path"), F.lit("editor").alias("role"))
    r = spark.range(5000).select(F.col("id").cast("string").alias("rule_id"), F.when(F.col("id") % 2 == 0, "write").otherwise("*").alias("operation"), F.lit("src/**").alias("path_pattern"), F.when(F.col("id") < 1000, "deny").otherwise("allow").alias("effect"), F.lit("admin").alias("min_role"), F.lit(3).alias("min_role_rank"), F.lit(0).alias("source_priority"), F.lit("P").alias("policy_id"))
    got = rules.match_counts(q, r).groupBy("n", "denies").count().collect()
    assert [tuple(x) for x in got] == [(1000, 1000, 4000)]
