"""Column expressions on text: trimming, keys, repository paths, ignore tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without outer white space of any script; the space characters are those of Unicode."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def key(c: Column) -> Column:
    """A key as it is compared: stripped and in upper case; '' for null."""
    return F.coalesce(F.upper(strip(c)), F.lit(""))


def repo_path(c: Column) -> Column:
    """The identity of a repository path: forward slashes, no outer space, no leading ./, no outer /."""
    slashed = strip(F.regexp_replace(c, r"\\", "/"))
    return F.regexp_replace(F.regexp_replace(slashed, r"^(?:\./)+", ""), r"^/+|/+$", "")


def unalias(path: Column, aliases: Column) -> Column:
    """``path`` with the longest alias that it starts with replaced; ``aliases`` is a map or null."""
    hits = F.filter(F.map_entries(aliases), lambda e: (e["key"] != "") & F.startswith(path, e["key"]))
    best = F.element_at(
        F.array_sort(hits, lambda a, b: F.length(b["key"]) - F.length(a["key"])), 1
    )
    replaced = repo_path(F.concat(best["value"], F.substr(path, F.length(best["key"]) + 1)))
    return F.when(F.size(F.coalesce(hits, F.array().cast("array<struct<key:string,value:string>>"))) > 0, replaced).otherwise(path)


def extension(path: Column) -> Column:
    """The extension in lower case with its dot; '' where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def is_ignored(path: Column, tokens: Column) -> Column:
    """True where a token is a run of whole segments of the path; glob characters are literal."""
    framed = F.concat(F.lit("/"), repo_path(path), F.lit("/"))
    return F.coalesce(
        F.exists(
            tokens,
            lambda t: (F.coalesce(repo_path(t), F.lit("")) != "")
            & F.contains(framed, F.concat(F.lit("/"), repo_path(t), F.lit("/"))),
        ),
        F.lit(False),
    )
