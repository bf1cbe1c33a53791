"""Imports and calls between files: specifiers resolved to files, calls linked to declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import repo_path
from tracewell.operators.graph import closure

#: Order in which left-off extensions are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx")


def _joined(folder: Column, rest: Column) -> Column:
    """A relative path below a folder, with . and .. resolved; null where it leads out of the repo."""
    parts = F.filter(F.split(F.concat_ws("/", folder, rest), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(False).alias("out"))
    step = lambda a, x: F.struct(
        F.when(x != "..", F.concat(a["held"], F.array(x))).when(F.size(a["held"]) > 0, F.slice(a["held"], 1, F.size(a["held"]) - 1)).otherwise(a["held"]).alias("held"),
        (a["out"] | ((x == "..") & (F.size(a["held"]) == 0))).alias("out"),
    )
    end = F.aggregate(parts, start, step)
    return F.when(~end["out"], F.array_join(end["held"], "/"))


def resolve_imports(specifiers: DataFrame, files: DataFrame, aliases: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """repo, path, specifier, target: the file that each import statement names; what names none gives no row.

    specifiers: repo, path, specifier; files: repo, path; aliases: repo, alias_map. The longest alias of the repo
    that the specifier starts with is replaced and counts from the repo root, as a leading slash does. A leading dot
    is relative to the importing file. Several names joined by dots are folders from the root. All else is no file
    of the repo. The exact path comes first, then the extensions in their order, then an index file with them in
    order, then __init__.py; a specifier with an extension is taken exactly. Null and blank specifiers and repos
    without files give no row; repeated rows count once; other columns are ignored.
    """
    asked = specifiers.select("repo", "path", "specifier").where("specifier is not null").distinct().withColumn("said", F.trim("specifier")).where("said <> ''")
    known = aliases.groupBy("repo").agg(F.max_by("alias_map", F.to_json("alias_map")).alias("alias_map"))
    rows = asked.join(known, "repo", "left")
    entries = F.coalesce(F.map_entries("alias_map"), F.array().cast("array<struct<key:string,value:string>>"))
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    fits = F.filter(entries, lambda e: (F.col("said") == bare(e["key"])) | F.startswith(F.col("said"), e["key"]) | F.startswith(F.col("said"), F.concat(bare(e["key"]), F.lit("/"))))
    best = F.element_at(F.array_sort(fits, lambda a, b: F.length(b["key"]) - F.length(a["key"])), 1)
    rows = rows.withColumn("hit", F.when(F.size(fits) > 0, best))
    rest = F.regexp_replace(F.substr("said", F.length(bare(F.col("hit.key"))) + 1), "^/+", "")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    none = F.lit("")
    base = (
        F.when(F.col("hit").isNotNull(), _joined(none, F.concat_ws("/", "hit.value", rest)))
        .when(F.startswith("said", F.lit("/")), _joined(none, F.col("said")))
        .when(F.startswith("said", F.lit(".")), _joined(folder, F.col("said")))
        .when(F.col("said").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$"), F.replace("said", F.lit("."), F.lit("/")))
    )
    rows = rows.withColumn("base", base).where("base is not null")
    ends = [*extensions, *[f"/index{e}" for e in extensions], "/__init__.py"]
    tries = F.when(F.col("base").rlike(r"\.[^./]+$"), F.array(none)).otherwise(F.array(none, *map(F.lit, ends)))
    tried = rows.select("repo", "path", "specifier", "base", F.posexplode(tries).alias("rank", "end")).withColumn("target", F.concat("base", "end"))
    held = files.select("repo", F.col("path").alias("target")).distinct()
    return tried.join(held, ["repo", "target"]).groupBy("repo", "path", "specifier").agg(F.min_by("target", "rank").alias("target"))


def call_edges(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """file, caller, dst, callee: calls from a declared function to one that the same or a directly imported file declares.

    calls: file, caller, callee, as said in the text; functions: file, name; imports: src, dst. All files are linked
    in one pass, so their order does not matter. Repeated rows count once; a call of itself is an edge.
    """
    said = calls.select("file", "caller", "callee").distinct()
    said = said.join(functions.select("file", F.col("name").alias("caller")).distinct(), ["file", "caller"], "left_semi")
    declared = functions.select(F.col("file").alias("dst"), F.col("name").alias("callee")).distinct()
    there = said.select("file", "caller", F.col("file").alias("dst"), "callee").unionByName(said.join(imports.select(F.col("src").alias("file"), "dst").distinct(), "file").select("file", "caller", "dst", "callee"))
    return there.join(declared, ["dst", "callee"], "left_semi").select("file", "caller", "dst", "callee").distinct()


def calling_files(edges: DataFrame, depth: int = 3) -> DataFrame:
    """file, caller_file: files with a function that calls, over ``depth`` calls at most, one that the file declares."""
    node = lambda f, n: F.struct(F.col(f).alias("file"), F.col(n).alias("name"))
    up = edges.select(node("dst", "callee").alias("src"), node("file", "caller").alias("dst"))
    return closure(up, depth).select(F.col("src.file").alias("file"), F.col("dst.file").alias("caller_file")).distinct()
