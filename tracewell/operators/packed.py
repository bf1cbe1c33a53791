"""Several values packed in one field: delimiters inferred per source, then one row per value with its position.

A source is a field as one writer fills it. Each candidate delimiter of a source is scored over all its values:
consistency is the share of values whose piece count is that of their delimiters, as no piece is empty, regularity
the share of pieces that have the type which is most frequent in the source. What reaches the threshold is a delimiter of that source, and its
values are split there outside quotes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import strip
from tracewell.session import Scratch

#: Candidates by name; the order only fixes the order of the report.
CANDIDATES = {"comma": ",", "semicolon": ";", "bar": "|", "tab": "\t", "line": "\n", "space": " "}
#: A candidate whose consistency times regularity is at least this is a delimiter.
THRESHOLD = 0.8

_HARD = r",;|\t\n"
_DOUBLE = r'"(?:[^"\\]|\\.|"")*"'
_SINGLE = r"'(?:[^'\\]|\\.)*'"


def _where(char: str, c: Column, f: Callable[[Column], Column]) -> Column:
    """f where the text holds the character; elsewhere it would change nothing and only cost."""
    return F.when(F.contains(c, F.lit(char)), f(c)).otherwise(c)


def _unwrapped(raw: Column) -> Column:
    """The inside of the list marks, without bullets, carriage returns and outer delimiters."""
    t = F.regexp_replace(strip(_where("\r", raw, lambda c: F.regexp_replace(c, r"\r\n?", "\n"))), r"[\s,;|]+$", "")
    inner = F.when(t.rlike(r"(?s)^(\[.*\]|\{.*\}|\(.*\))$"), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return strip(F.regexp_replace(inner, r"(?m)^[ \t]*(?:[-*+•‣]|\d+[.)])[ \t]+", ""))


def _listed() -> Column:
    """The elements of a value that is a JSON list, else null."""
    return F.when(F.ltrim("raw").startswith("["), F.from_json("raw", "array<string>"))


def _kind(piece: Column) -> Column:
    """The type of a piece."""
    return (
        F.when(piece == "", "empty")
        .when(piece == "￼", "quoted")
        .when(piece.rlike(r"^[A-Za-z]+[-_ ]?[0-9]+$"), "id")
        .when(piece.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .when(piece.rlike(r"/.*\.[A-Za-z0-9]+$"), "path")
        .when(piece.rlike(r"^\w+$"), "word")
        .otherwise("other")
    )


def long_values(df: DataFrame, id_col: str, fields: list[str], source: list[str]) -> DataFrame:
    """id, source, field, raw: one row per id and field."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]
    order = F.struct(*([F.col("predicted_at")] if "predicted_at" in df.columns else []), *[F.col(f) for f in fields])
    writer = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source]) if source else F.lit("")
    one = df.groupBy(F.col(id_col).alias("id")).agg(F.max_by(F.struct(writer.alias("writer"), F.array(*parts).alias("parts")), order).alias("x"))
    return one.select("id", F.col("x.writer").alias("writer"), F.inline("x.parts").alias("field", "raw")).where("raw is not null")


def score_delimiters(values: DataFrame) -> DataFrame:
    """writer, field, delimiter, name, pieces, consistency, regularity of ``values`` (writer, field, raw).

    One row per source and candidate that occurs; JSON lists have no delimiter to infer. Pieces are those directly before the candidate, outside
    quotes; a space only counts between two pieces, not beside another candidate. Quoted pieces are of any type.
    """
    rows = values.where(_listed().isNull()).select("writer", "field", _unwrapped(F.col("raw")).alias("bare"))
    quoted = lambda q: lambda c: F.regexp_replace(c, rf"(?:(?<=^|[{_HARD}\s])){q}(?=\s*(?:[{_HARD} ]|$))", "￼")
    bare = _where("'", _where('"', F.col("bare"), quoted(_DOUBLE)), quoted(_SINGLE))
    rows = rows.select("writer", "field", bare.alias("bare"))
    tight = _where("\n", F.regexp_replace("bare", r"[ \n]*([,;|\t])[ \n]*", "$1"), lambda c: F.regexp_replace(c, r" *(\n) *", "$1"))
    rows = rows.select("writer", "field", F.when(F.col("bare").rlike(r"[,;|\t\n]"), tight).otherwise(F.col("bare")).alias("bare"))
    found = []
    for name, char in CANDIDATES.items():
        if char == " ":
            left = F.regexp_extract_all("bare", F.lit(rf"([^{_HARD} ]+) +(?=[^{_HARD} ])"), F.lit(1))
        else:
            left = F.regexp_extract_all("bare", F.lit(rf"([^{_HARD}]*)[{char}](?=[^{_HARD}])" if char != "|" else rf"([^{_HARD}]*)\|(?=[^{_HARD}])"), F.lit(1))
        left = F.when(F.contains("bare", F.lit(char)), left).otherwise(F.array().cast("array<string>"))
        kinds = F.transform(left, _kind)
        even = F.when(F.array_contains(kinds, "empty"), F.array(F.lit("#value"))).otherwise(F.array(F.lit("#value"), F.lit("#even")))
        found.append(F.struct(F.lit(name).alias("name"), F.when(F.size(kinds) > 0, F.concat(kinds, even)).otherwise(kinds).alias("kinds")))
    whole = F.struct(F.lit("whole").alias("name"), F.array(_kind(F.col("bare"))).alias("kinds"))
    counts = (
        rows.select("writer", "field", F.inline(F.array(*found, whole)))
        .select("writer", "field", "name", F.explode("kinds").alias("kind"))
        .groupBy("writer", "field", "name", "kind")
        .agg(F.count("*").alias("n"))
    )
    counts = Scratch(values.sparkSession).write(counts, "counts")  # a few rows a source, read twice
    typed = counts.where("kind not in ('empty', 'quoted', 'other', '#value', '#even')").groupBy("writer", "field", "kind").agg(F.sum("n").alias("n"))
    main = typed.groupBy("writer", "field").agg(F.max_by("kind", F.struct("n", "kind")).alias("main"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    kind, piece = F.col("kind"), ~F.col("kind").startswith("#")
    scored = (
        counts.where("name <> 'whole'")
        .join(main, ["writer", "field"], "left")
        .groupBy("writer", "field", "name")
        .agg(
            n(piece).alias("pieces"),
            (n(kind == "#even") / n(kind == "#value")).alias("consistency"),
            (n((kind == "quoted") | (kind == F.col("main"))) / n(piece)).alias("regularity"),
        )
    )
    char = reduce(lambda c, kv: c.when(F.col("name") == kv[0], kv[1]), CANDIDATES.items(), F.when(F.lit(False), ""))
    return scored.withColumn("delimiter", char)


def _clean(piece: Column) -> Column:
    """Without outer quotes and their escapes."""
    p = strip(piece)
    inside = F.substr(p, F.lit(2), F.length(p) - 2)
    double = F.regexp_replace(F.regexp_replace(inside, '""', '"'), r"\\(.)", "$1")
    return (
        F.when(p.rlike(rf"(?s)^{_DOUBLE}$"), strip(double))
        .when(p.rlike(rf"(?s)^{_SINGLE}$"), strip(F.regexp_replace(inside, r"\\(.)", "$1")))
        .when(p.rlike("(?s)^(`[^`]*`|“[^”]*”|‘[^’]*’|«[^»]*»)$"), strip(inside))
        .otherwise(p)
    )


def packed_values(df: DataFrame, id_col: str, fields: list[str], source: list[str]) -> DataFrame:
    """id_col, field, pos, value: one row per non-empty value of each field; pos counts from 1.

    A JSON list is read as JSON. Otherwise list marks and bullets go and the rest is split at the delimiters
    inferred for its source (the field and the columns ``source``), outside quotes; doubled quotes and backslash
    escapes within quotes are undone. A line end always separates. Repeated values stay. Null, empty and blank fields and empty lists give
    no row. Of rows with the same id the last counts. Unbalanced quotes are ordinary characters.
    """
    values = long_values(df, id_col, fields, source)
    accepted = score_delimiters(values).where(F.col("consistency") * F.col("regularity") >= THRESHOLD)
    # at most one short row per source
    sets = accepted.groupBy("writer", "field").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("delimiter") == "|", r"\|").otherwise(F.col("delimiter")))), "").alias("d"))
    rows = values.join(sets, ["writer", "field"], "left")
    d = F.when(F.coalesce("d", F.lit("")) == "", F.lit("\n")).otherwise(F.concat(F.col("d"), F.lit("\n")))
    token = F.concat(F.lit(rf"(?:{_DOUBLE}|{_SINGLE})(?=\s*(?:["), d, F.lit("]|$))|[^"), d, F.lit(r"\s][^"), d, F.lit("]*"))
    split = F.transform(F.regexp_extract_all(_unwrapped(F.col("raw")), token, F.lit(0)), _clean)
    listed = F.filter(F.transform(F.coalesce(_listed(), split), strip), lambda v: v.isNotNull() & (v != ""))
    out = rows.select("id", "field", F.posexplode(listed).alias("at", "value"))
    return out.select(F.col("id").alias(id_col), "field", (F.col("at") + 1).cast("int").alias("pos"), "value")
