"""Pairs that have a word in common, each once and without a shuffle of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of each word, so that few and frequent words keep all cores busy.
PARTS = 8


def _bits(names: Column) -> Column:
    """64 bits, one of them set for each name: where two have no bit in common, their names differ."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(names, F.lit(0).cast("long"), lambda held, x: held.bitwiseOR(one(x)))


def placed(rows: DataFrame, *key: str) -> DataFrame:
    """The columns of ``key``, each with its words, the words before each and their bits; rows: key, word.

    A key's words are gathered: they are as many as it has of the known names.
    """
    held = rows.groupBy(*key).agg(F.array_sort(F.collect_set("word")).alias("held"))
    each = held.select(*key, "held", F.posexplode("held").alias("at", "word"))
    before = F.slice("held", F.lit(1), F.col("at"))
    return each.select(*key, "word", before.alias("before"), _bits(before).alias("bits"))


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left key with each right key that has a word in common, once: at the first such word.

    Both are of ``placed``, with columns of different names; right may have been joined with more columns.
    """
    name = lambda df, p: [F.col(c).alias(f"_{p}_{c}") if c in ("before", "bits") else F.col(c) for c in df.columns]
    keys = [c for c in left.columns if c not in ("word", "before", "bits")]
    a = left.select(*name(left, "a"), F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int").alias("part"))
    b = right.select(*name(right, "b"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    first = (F.col("_a_bits").bitwiseAND(F.col("_b_bits")) == 0) | ~F.arrays_overlap("_a_before", "_b_before")
    both = a.join(b, ["word", "part"]).where(first)
    return both.select(*keys, *[c for c in right.columns if c not in ("word", "before", "bits")])
