"""Entities named in free text: the single best one, or a ranked list of candidates.

Names that are single words are found by equality with the words of the text, so nothing is tried pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import Scratch

#: What the paths of files mostly consist of, in lower case.
_PLAIN = r"a-z0-9_./@()\[\]~+$\-"


def word_counts(texts: DataFrame) -> DataFrame:
    """id, word, n: whole words in lower case with their number of occurrences; texts: id, text."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\w+)"), F.lit(1))
    return texts.select("id", F.explode(words).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))


def path_mentions(texts: DataFrame, files: DataFrame) -> DataFrame:
    """id, file: texts that hold a path, without letter case, between characters that no path has."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![a-z0-9_@.~\-])([a-z0-9_@.~\-]++(?:/[a-z0-9_@.()\[\]~\-]*[a-z0-9_)\]])+)"), F.lit(1))
    paths = texts.select("id", F.explode(F.array_distinct(found)).alias("p"))
    return paths.join(files.select("file", F.lower("file").alias("p")), "p").select("id", "file").distinct()


def _near(texts: DataFrame, files: DataFrame) -> DataFrame:
    """id, file, score of each text and file that share the four letters before the file's extension and hit; only
    shorter paths are tried on every text. texts: id, text in lower case."""
    f = files.withColumn("gram", F.when(F.length("bare") > 3, F.right("bare", F.lit(4))).when(F.length("path") > 3, F.left("path", F.lit(4))))
    grams = texts.where("length(text) > 3").select("id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?s)(?=(.{4}))"), F.lit(1)))).alias("gram"))
    near = grams.join(f, "gram").drop("gram").unionByName(f.where("gram is null").drop("gram").join(texts, F.contains("text", "path")))
    score = F.when(F.contains("text", "path"), 8).when((F.length("stem") > 3) & F.contains("text", "stem"), 3)
    return near.select("id", "file", score.cast("long").alias("score")).where("score is not null")


def file_hits(texts: DataFrame, files: DataFrame) -> DataFrame:
    """id, file, score: eight where a text holds the path of a file, else three where it holds the name without its
    extension, of more than three letters; anywhere in the text and without letter case.

    Paths of plain characters lie within a run of them, so their files meet the distinct runs of all texts, and texts
    only those runs that hit; a long run is cut into parts of which one holds any such path whole. Files with other
    characters meet the texts themselves.
    """
    t = texts.select("id", F.lower("text").alias("text")).where("text is not null")
    path, name = F.lower("file"), F.lower(F.substring_index("file", "/", -1))
    f = files.select("file").where("file <> ''").distinct().select("file", path.alias("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_replace(path, r"\.[^./]*$", "").alias("bare"))
    scratch = Scratch(texts.sparkSession)
    f = scratch.write(f, "files")
    plain = F.rlike("path", F.lit(f"^[{_PLAIN}]+$"))
    most = f.where(plain).agg(F.max(F.length("path"))).first()[0] or 1
    runs = F.filter(F.split("text", f"[^{_PLAIN}]+"), lambda x: x != "")
    parts = F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(F.lit(1), F.length(x), F.lit(most)), lambda i: F.substr(x, i, F.lit(2 * most)))))
    said = scratch.write(t.select("id", F.explode(F.array_distinct(parts)).alias("run")), "said")
    distinct = said.select("run").distinct()
    held = scratch.write(_near(distinct.select(F.col("run").alias("id"), F.col("run").alias("text")), f.where(plain)).withColumnRenamed("id", "run"), "held")
    found = said.join(held, "run").groupBy("id", "file").agg(F.max("score").alias("score"))
    rest = f.where(~plain)
    return found if rest.isEmpty() else found.unionByName(_near(t, rest))


def candidates(texts: DataFrame, tables: DataFrame, columns: DataFrame, files: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """id, entity_type, entity_name, score, rank: candidates by score, type and name.

    A table scores ten a mention; a column of a mentioned table that plus twenty a mention, of another table
    fifteen; a path eight, the name of a file of more than three letters three, also within words.
    """
    counts = word_counts(texts)
    hit = lambda names, c: counts.join(names.withColumn("word", F.lower(c)), "word")
    t = hit(tables.select("name").distinct(), F.col("name")).select("id", F.col("name").alias("tbl"), F.col("n").alias("nt"))
    c = hit(columns.select("tbl", "name").distinct(), F.col("name")).select("id", "tbl", "name", F.col("n").alias("nc"))
    cols = c.join(t, ["id", "tbl"], "left").select(
        "id", F.lit("column").alias("entity_type"), F.concat_ws(".", "tbl", "name").alias("entity_name"), F.when(F.col("nt").isNull(), 15 * F.col("nc")).otherwise(10 * F.col("nt") + 20 * F.col("nc")).alias("score")
    )
    found = cols.unionByName(t.select("id", F.lit("table").alias("entity_type"), F.col("tbl").alias("entity_name"), (10 * F.col("nt")).alias("score")))
    if files is not None:
        held = file_hits(texts, files)
        found = found.unionByName(held.select("id", F.lit("file").alias("entity_type"), F.col("file").alias("entity_name"), "score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "entity_type", "entity_name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def best_entity(texts: DataFrame, tables: DataFrame, columns: DataFrame, files: DataFrame) -> DataFrame:
    """id, entity_type, entity_name: the first mentioned table with a mentioned column, else the first table, else
    the first column with a table, else the first path, else unknown. First means first in name order."""
    counts = word_counts(texts)
    t = counts.join(tables.select("name", F.lower("name").alias("word")).distinct(), "word").select("id", F.col("name").alias("tbl"))
    c = counts.join(columns.select("tbl", "name", F.lower("name").alias("word")).distinct(), "word").select("id", "tbl", "name")
    made = lambda p, kind, name, a, b: (F.lit(p).alias("p"), a.alias("a"), b.alias("b"), F.lit(kind).alias("entity_type"), name.alias("entity_name"))
    dotted: Column = F.concat_ws(".", "tbl", "name")
    rows = (
        t.join(c, ["id", "tbl"]).select("id", *made(0, "column", dotted, F.col("tbl"), F.col("name")))
        .unionByName(t.select("id", *made(1, "table", F.col("tbl"), F.col("tbl"), F.lit(""))))
        .unionByName(c.select("id", *made(2, "column", dotted, F.col("name"), F.col("tbl"))))
        .unionByName(path_mentions(texts, files).select("id", *made(3, "file", F.col("file"), F.col("file"), F.lit(""))))
    )
    best = rows.groupBy("id").agg(F.min_by(F.struct("entity_type", "entity_name"), F.struct("p", "a", "b")).alias("e"))
    return texts.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("e.entity_type", F.lit("unknown")).alias("entity_type"), F.coalesce("e.entity_name", F.lit("")).alias("entity_name"))
