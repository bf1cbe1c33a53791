"""References to records that do not exist, by dictionary-encoded keys and bitmaps.

Keys become integers by a dictionary written in key order. For each word of 64 neighbouring keys three kinds
of bits are kept, and only words that are not zero: the keys that are referred to, by month; the parents that
exist at all; the parents that are alive through a whole month. Referred AND NOT existing leaves the missing
keys. Referred AND existing AND NOT alive leaves the (key, month) pairs in which a reference may be late or
point to a deleted parent; only their rows are compared in time.

No step gathers one key's rows in one task: keys are first reduced to one row per month, and the comparison in
time runs within hours, each of which starts from the state that the hours before it leave behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import key
from tracewell.session import Scratch

WORD = 64


def _month(t: Column) -> Column:
    return F.coalesce(F.year(t) * 12 + F.month(t) - 1, F.lit(-1))


def _bits(ident: Column) -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (ident % WORD).cast("int")))


def dictionary(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(target, key) -> ident: integers in key order, so that neighbouring keys share words."""
    ordered = keys.distinct().repartitionByRange("target", "key").sortWithinPartitions("target", "key")
    # written, as numbers given by partition must not be given twice
    return scratch.write(ordered.withColumn("ident", F.monotonically_increasing_id()), "dictionary")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphan references with their reason.

    refs: source_table, record_id, target, ref (raw key), recorded_at. parents: target, key (raw),
    record_id, status, recorded_at. Result, one row per (source_table, record_id, ref_key): reason is
    ``missing`` (no parent row has the key), ``late`` (all are recorded after the reference) or ``deleted``
    (the last parent row recorded at or before the reference is deleted); period is the month YYYY-MM.

    Null and blank keys are no reference. A parent row with a null time exists but never counts as recorded
    before a reference; a reference with a null time can only be missing, with period ''. A null status counts
    as not deleted. Of parent rows with equal times the one with the larger record_id is the last. Repeated
    rows and repeated keys of a row count once; of rows with the same id the earliest reference counts. Empty
    tables give an empty result, or all references as missing. Other columns are ignored.
    """
    scratch = Scratch(refs.sparkSession)
    ref = refs.select(
        "source_table", F.col("record_id").cast("long").alias("record_id"), "target", key(F.col("ref")).alias("key"), F.col("recorded_at").alias("t")
    ).where("key <> ''")
    par = parents.select(
        "target",
        key(F.col("key")).alias("key"),
        F.col("record_id").cast("long").alias("record_id"),
        (F.lower(F.trim(F.coalesce(F.col("status"), F.lit("")))) == "deleted").alias("dead"),
        F.col("recorded_at").alias("t"),
    ).where("key <> ''")

    par_month = par.groupBy("target", "key", _month(F.col("t")).alias("month")).agg(
        F.max_by("dead", F.struct("t", "record_id")).alias("ends_dead"), F.bool_or("dead").alias("any_dead")
    )
    ref_month = ref.select("target", "key", _month(F.col("t")).alias("month")).distinct()
    par_month, ref_month = scratch.write(par_month, "par_month"), scratch.write(ref_month, "ref_month")
    codes = dictionary(ref_month.select("target", "key").union(par_month.select("target", "key")), scratch)

    coded = par_month.join(codes, ["target", "key"])
    word = F.floor(F.col("ident") / WORD).alias("word")
    exist = coded.groupBy("target", word).agg(_bits(F.col("ident")).alias("exist"))
    horizon = ref_month.agg(F.max("month")).first()[0]  # one number
    horizon = -1 if horizon is None else horizon
    by_key = Window.partitionBy("ident").orderBy("month")  # at most one row a month
    spans = (
        coded.where("month >= 0")
        .withColumn("was_dead", F.lag("ends_dead").over(by_key))
        .withColumn("until", F.coalesce(F.lead("month").over(by_key) - 1, F.lit(horizon)))
    )
    alive_within = F.when((~F.coalesce(F.col("was_dead"), F.lit(True))) & ~F.col("any_dead"), F.array("month"))
    alive_after = F.when(~F.col("ends_dead") & (F.col("until") > F.col("month")), F.sequence(F.col("month") + 1, F.col("until")))
    none = F.array().cast("array<int>")
    alive = (
        spans.select("target", "ident", F.explode(F.concat(F.coalesce(alive_within, none), F.coalesce(alive_after, none))).alias("month"))
        .groupBy("target", word, "month")
        .agg(_bits(F.col("ident")).alias("alive"))
    )
    referred = ref_month.join(codes, ["target", "key"]).groupBy("target", word, "month").agg(_bits(F.col("ident")).alias("referred"))

    zero = F.lit(0).cast("long")
    left = (
        referred.join(exist, ["target", "word"], "left")
        .join(alive, ["target", "word", "month"], "left")
        .select(
            "target",
            "word",
            "month",
            F.col("referred").bitwiseAND(F.bitwise_not(F.coalesce("exist", zero))).alias("missing"),
            F.col("referred").bitwiseAND(F.coalesce("exist", zero)).bitwiseAND(F.bitwise_not(F.coalesce("alive", zero))).alias("doubtful"),
        )
        .where("missing <> 0 or doubtful <> 0")
    )

    def decode(bits: str, missing: bool) -> DataFrame:
        on = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(F.col(bits), b) == 1)
        rows = left.where(F.col(bits) != 0).select("target", "month", "word", F.explode(on).alias("bit"))
        return rows.select("target", "month", (F.col("word") * WORD + F.col("bit")).alias("ident"), F.lit(missing).alias("missing"))

    survivors = scratch.write(
        decode("missing", True).union(decode("doubtful", False)).join(codes, ["target", "ident"]).select("target", "key", "month", "missing"), "survivors"
    )
    # hot keys stay on the left, where adaptive execution splits them
    hit = ref.withColumn("month", _month(F.col("t"))).join(survivors, ["target", "key", "month"])
    hit = hit.groupBy("source_table", "record_id", "target", "key").agg(F.min_by(F.struct("t", "missing"), F.struct("t", "missing")).alias("x"))
    hit = scratch.write(hit.select("source_table", "record_id", "target", "key", "x.*"), "hit")

    doubtful = hit.where("not missing and t is not null")
    rows = par.where("t is not null").join(survivors.where("not missing").select("target", "key").distinct(), ["target", "key"], "left_semi")
    hour = (F.datediff(F.col("t").cast("date"), F.lit("1970-01-01").cast("date")) * 24 + F.hour("t")).alias("hour")
    none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("long")
    columns = ["target", "key", "hour", "t", "kind", "record_id", "dead", "source_table"]
    parts = rows.select("target", "key", hour, "t", F.lit(0).alias("kind"), "record_id", "dead", none_s.alias("source_table"))
    asks = doubtful.select("target", "key", hour, "t", F.lit(1).alias("kind"), "record_id", F.lit(None).cast("boolean").alias("dead"), "source_table")
    before = Window.partitionBy("target", "key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # at most one row an hour
    carried = (
        parts.unionByName(asks)
        .groupBy("target", "key", "hour")
        .agg(F.max_by("dead", F.when(F.col("kind") == 0, F.struct("t", "record_id"))).alias("ends_dead"))
        .withColumn("dead", F.last("ends_dead", ignorenulls=True).over(before))
        .where("dead is not null")
        .select("target", "key", "hour", F.lit(None).cast(par.schema["t"].dataType).alias("t"), F.lit(-1).alias("kind"), none_l.alias("record_id"), "dead", none_s.alias("source_table"))
    )
    within = Window.partitionBy("target", "key", "hour").orderBy("t", "kind", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    judged = (
        reduce(DataFrame.unionByName, [x.select(columns) for x in (parts, asks, carried)])
        .withColumn("state", F.last("dead", ignorenulls=True).over(within))
        .where("kind = 1 and coalesce(state, true)")
        .select("source_table", "record_id", "key", "t", F.when(F.col("state"), "deleted").otherwise("late").alias("reason"))
    )
    absent = hit.where("missing").select("source_table", "record_id", "key", "t", F.lit("missing").alias("reason"))
    period = F.coalesce(F.date_format("t", "yyyy-MM"), F.lit(""))
    return absent.union(judged).select("source_table", "record_id", F.col("key").alias("ref_key"), "reason", period.alias("period"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and reason, with the number of distinct keys."""
    return found.groupBy("source_table", "period", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
