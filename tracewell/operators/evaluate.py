"""Agreement of predictions with a ground truth: set metrics, averages, paired and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def set_metrics(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """key, tp, fp, fn, precision, recall, f1 of the item sets; truth and predicted: key columns and item.

    A key without truth keeps its false positives. Repeated items count once.
    """
    t = truth.select(*key, "item").distinct().withColumn("t", F.lit(1))
    p = predicted.select(*key, "item").distinct().withColumn("p", F.lit(1))
    joined = t.join(p, [*key, "item"], "full")
    agg = joined.groupBy(*key).agg(
        F.sum(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("t").isNull(), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", f1(tp, fp, fn))


def micro(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Sums first, then ratios."""
    agg = metrics.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", f1(tp, fp, fn))


def macro(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of the ratios; nulls are skipped."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks from 1 in which ties share their mean.

    Ranks come from counts of distinct values, not from a sort of all rows: a value's rank is what lies before it.
    """
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn(name, F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranked, [*by, value])


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, rho of pairs (by, a, b); 0 where it is not defined."""
    ranked = average_rank(average_rank(pairs.where("a is not null and b is not null"), "a", by, "ra"), "b", by, "rb")
    spread = F.stddev_pop("ra") * F.stddev_pop("rb")
    return ranked.groupBy(*by).agg(F.coalesce(F.try_divide(F.covar_pop("ra", "rb"), spread), F.lit(0.0)).alias("rho"))


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w: the signed-rank statistic of a - b without zeros; w is the lesser of both rank sums."""
    diff = pairs.withColumn("d", F.col("a") - F.col("b")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = average_rank(diff, "size", by, "r")
    plus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0))
    minus = F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.least(plus, minus).alias("w"))


def cliffs_delta(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, delta of samples (by, side in a/b, value): how much more often a is above b than below.

    Counted from the cumulated counts of distinct values instead of all pairs.
    """
    n = samples.groupBy(*by, "value").agg(F.sum(F.when(F.col("side") == "a", 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("side") == "b", 1).otherwise(0)).alias("nb"))
    before = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("nb").over(before), F.lit(0))
    rows = n.withColumn("below", below)
    agg = rows.groupBy(*by).agg(F.sum(F.col("na") * F.col("below")).alias("gt"), F.sum(F.col("na") * F.col("nb")).alias("eq"), F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    total = F.col("sa") * F.col("sb")
    return agg.select(*by, ratio(F.col("gt") - (total - F.col("gt") - F.col("eq")), total).alias("delta"))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, both, a_only, b_only, neither, p of boolean pairs (a, b); p is the exact two-sided binomial value."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("a"), F.col("b")
    agg = pairs.where("a is not null and b is not null").groupBy(*by).agg(one(a & b).alias("both"), one(a & ~b).alias("a_only"), one(~a & b).alias("b_only"), one(~a & ~b).alias("neither"))
    n, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    # sum of C(n, i) / 2^n for i up to k, each term from the one before, in logs
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log(((n - i + 1) / i).cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.aggregate(steps, start, step)["s"]
    return agg.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def upper_median(name: str) -> Column:
    """Aggregate: the element at half of the sorted values of a column, rounded up; from counts of distinct values."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{name}` desc)")


def bootstrap(metrics: DataFrame, by: list[str], rounds: int = 1000, seed: int = 20260603, level: float = 0.95) -> DataFrame:
    """by, f1, low, high: percentile interval of the micro F1 over resamples of rows with replacement.

    Every row draws its weight in a round by a hash of (seed, round, row), as a Poisson(1) count, so a resample
    is a weighted sum: no row is copied or moved, and the same data give the same interval anywhere.
    """
    rows = metrics.select(*by, F.col("tp"), F.col("fp"), F.col("fn"), F.xxhash64(*metrics.columns).alias("row"))
    # equal rows need different draws
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*by, "row").orderBy("row")))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", "row", "copy"), F.lit(2**40)) + 0.5) / 2**40
    p, total, weight = 0.36787944117144233, 0.0, F.lit(0)
    for k in range(12):
        total += p
        weight = weight + F.when(u > total, 1).otherwise(0)
        p /= k + 1
    sums = drawn.withColumn("w", weight).groupBy(*by, "b").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "fn")])
    each = sums.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    tail = (1 - level) / 2
    bounds = each.groupBy(*by).agg(F.percentile("f1", F.lit(tail)).alias("low"), F.percentile("f1", F.lit(1 - tail)).alias("high"))
    return micro(metrics, by).select(*by, "f1").join(bounds, by)
