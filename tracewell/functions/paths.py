"""Column expressions on paths: languages, globs, backend files, matching forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import extension, repo_path, strip

#: Languages by extension (fixed values).
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
}
#: Segments that keep a file out of the backend, and segments that put it there (fixed values).
FRONT, BACK = ("ui", "views", "components"), ("server", "api", "db", "trpc", "inngest")


def language(path: Column) -> Column:
    """The language of a path's extension; null for others."""
    ext = extension(path)
    return reduce(lambda c, kv: c.when(ext == kv[0], kv[1]), LANGUAGES.items(), F.when(F.lit(False), ""))


def is_backend(path: Column, prefixes: list[str] | None = None, front: tuple[str, ...] = FRONT) -> Column:
    """Below one of the prefixes in any letter case or, without prefixes, by the segments of the path."""
    p = F.lower(repo_path(path))
    if prefixes:
        return reduce(lambda a, b: a | b, [(p == x.lower()) | p.startswith(x.lower() + "/") for x in prefixes])
    parts = F.split(p, "/")
    hit = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (p != "") & ~hit(front) & hit(BACK)


def gate_path(path: Column) -> Column:
    """As plans are compared: slashes only; a leading ./ stays and letter case counts."""
    return F.regexp_replace(strip(F.regexp_replace(path, r"\\", "/")), "^/+|/+$", "")


def match_path(path: Column) -> Column:
    """As rules are matched: slashes, no outer slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+|/+$", ""))


def glob_regex(pattern: Column) -> Column:
    """A pattern of shell wildcards as a regular expression for the whole text.

    A star crosses slashes, a question mark is one character, [ab] and [!ab] are sets, and a bracket that is not
    closed stands for itself; everything else is literal.
    """
    p = F.regexp_replace(pattern, r"\[(?![^\[\]]+\])", "\x01")  # unclosed
    p = F.regexp_replace(p, r"([.+^${}()|\\])", r"\\$1")
    p = F.regexp_replace(F.regexp_replace(p, r"\*+", ".*"), r"\?", ".")
    p = F.regexp_replace(F.regexp_replace(p, r"\[!", "[^"), "\x01", r"\\[")
    return F.concat(F.lit("(?s)^"), p, F.lit("$"))


def specificity(pattern: Column) -> list[Column]:
    """Literal characters, segments, less wildcards, length: the larger, the more specific."""
    p = F.regexp_replace(F.regexp_replace(pattern, r"\\", "/"), "^/+|/+$", "")
    wild = F.length(F.regexp_replace(p, r"[^*?\[\]]", ""))
    segments = F.length(F.regexp_replace(p, "[^/]", "")) + F.when(p != "", 1).otherwise(0)
    return [F.length(p) - wild, segments, -wild, F.length(p)]


def has_wildcards(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def is_relative_pattern(pattern: Column) -> Column:
    """Not empty, not absolute, without parent segments or a drive."""
    p = F.regexp_replace(F.trim(F.coalesce(pattern, F.lit(""))), r"\\", "/")
    return (p != "") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike("^[A-Za-z]:")


def is_safe_symbol(name: Column) -> Column:
    """Letters, digits and underscores, not beginning with a digit."""
    return F.coalesce(name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.lit(False))


def below(path: Column, prefix: Column) -> Column:
    """The prefix itself or anything under it."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))
