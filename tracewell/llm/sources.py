"""Source files that do not parse: every file against all grammars, in the order of its tokens' ranking."""

from __future__ import annotations

import ast
import io
import re
import sys
import tokenize
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.paths import LANGUAGES
from tracewell.llm.grammar import cfamily, go, java, script
from tracewell.llm.grammar.base import Bad
from tracewell.session import spread

#: Words by which a text is ranked as a language before the grammars are tried; a word counts once.
MARKS = {
    "python": "def import from self elif None True False lambda raise except yield with pass print __init__",
    "typescript": "const export import interface type from string number async await readonly private undefined extends Promise",
    "javascript": "const let var function require module export async await this undefined null return typeof",
    "go": "package func import type struct range defer chan nil err make string error interface map",
    "java": "package import public class private final static void new extends implements throws return String int",
    "c": "include define struct static int char void return const sizeof typedef ifndef endif unsigned NULL",
    "cpp": "include namespace template class std public const auto explicit private virtual typename nullptr vector override",
}
#: Frames of a grammar's recursion.
DEPTH = 50_000
_MARKS = {k: frozenset(v.split()) for k, v in MARKS.items()}


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError) as e:
            raise Bad(str(e)) from None
        except (RecursionError, MemoryError):
            _shallow(text)


def _shallow(text: str) -> None:
    """What is left to check of a Python text that is nested deeper than the parser's stack: its tokens, brackets and
    indentation."""
    try:
        for _ in tokenize.generate_tokens(io.StringIO(text).readline):
            pass
    except (tokenize.TokenError, SyntaxError) as e:
        raise Bad(str(e)) from None


PARSERS: dict[str, Callable[[str], None]] = {
    "python": _python,
    "typescript": lambda t: script.parse(t, ts=True, jsx=False),
    "tsx": lambda t: script.parse(t, ts=True, jsx=True),
    "javascript": lambda t: script.parse(t, ts=False, jsx=True),
    "go": go.parse,
    "java": java.parse,
    "c": lambda t: cfamily.parse(t, cpp=False),
    "cpp": lambda t: cfamily.parse(t, cpp=True),
}


def parses(text: str, grammar: str) -> bool:
    """Whether the whole text is in the language. A byte order mark at its start does not count.

    Tokens and brackets are checked without recursion; where the brackets match, but are nested deeper than DEPTH
    frames of the grammar, that is all that is checked.
    """
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEPTH))
    try:
        PARSERS[grammar](text.removeprefix("\ufeff"))
        return True
    except Bad:
        return False
    except RecursionError:
        return True
    finally:
        sys.setrecursionlimit(limit)


def ranked(text: str) -> list[str]:
    """All languages, the likeliest first, by their marks among the tokens of the text."""
    seen = set(re.findall(r"[A-Za-z_]\w*", text))
    return sorted(_MARKS, key=lambda k: (-len(_MARKS[k] & seen), k))


def judge(path: str, text: str) -> tuple[str, bool, str]:
    """The language of the extension, whether the text parses as that, and all other languages as which it does."""
    ext = re.search(r"(\.[^./\\]+)$", path.lower()).group(1)
    language = LANGUAGES[ext]
    as_ = {k: "tsx" if k == "typescript" and ext == ".tsx" else k for k in _MARKS}
    found = [k for k in ranked(text) if parses(text, as_[k])]
    return language, language in found, ",".join(k for k in found if k != language)


_PATTERN = r"(?i)\.(py|tsx?|jsx?|go|java|c|h|cpp|hpp|cc|cxx)\s*$"


def parsed_sources(files: DataFrame) -> DataFrame:
    """file_id, repo, language, ok, foreign: one row per source file with content.

    files: file_id, repo, path, content, ingested_at. language is that of the extension in any letter case; the
    column of that name is not read. Every file is tried as every language, the likeliest by its tokens first; foreign
    lists the others as which it parses. Where a file is not ok, a foreign that is not '' means a wrong extension, else
    the content is damaged. Files with other extensions,
    null paths, and null, empty or blank contents give no row. Whole contents are parsed. Of rows with the same
    id the last ingested counts. An empty table gives an empty result; other columns are ignored.
    """
    rows = files.where(F.col("path").rlike(_PATTERN) & F.col("content").rlike(r"\S") & F.col("file_id").isNotNull())
    rows = spread(rows.select(F.col("file_id").cast("long").alias("file_id"), "repo", F.rtrim("path").alias("path"), "content", "ingested_at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([judge(p, t) for p, t in zip(b["path"], b["content"])], columns=["language", "ok", "foreign"])
            yield pd.concat([b[["file_id", "repo", "ingested_at"]].reset_index(drop=True), found], axis=1)

    schema = f"file_id long, repo string, ingested_at {rows.schema['ingested_at'].dataType.simpleString()}, language string, ok boolean, foreign string"
    each = rows.mapInPandas(run, schema)
    verdict = F.struct("language", "ok", "foreign", F.coalesce("repo", F.lit("")).alias("repo"))
    return each.groupBy("file_id").agg(F.max_by(verdict, F.struct("ingested_at", verdict)).alias("v")).select("file_id", "v.repo", "v.language", "v.ok", "v.foreign")


def broken_rates(parsed: DataFrame) -> DataFrame:
    """Files, failures and their kinds per repository and language."""
    bad = ~F.col("ok")
    return parsed.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"),
        F.sum(bad.cast("long")).alias("n_broken"),
        F.sum((bad & (F.col("foreign") != "")).cast("long")).alias("n_wrong_extension"),
        F.round(F.avg(bad.cast("double")), 6).alias("rate"),
    )
