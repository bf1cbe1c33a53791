"""Text to rows: schema dialects, code structure, governance documents, agent replies.

Each table function works on one text at a time in Arrow batches, so its output is one shuffle-free pass.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import ship, spread

# ---- schema texts

_QUIET = re.compile(r"--[^\n]*|//[^\n]*|#[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\.|'')*'|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`", re.S)


def _quiet(text: str, keep_strings: bool = False) -> str:
    """The text with comments, and unless kept the insides of strings, blanked; positions stay."""

    def blank(m: re.Match) -> str:
        s = m.group()
        if s[0] in "'\"`":
            return s if keep_strings else s[0] + "x" * (len(s) - 2) + s[-1]
        return re.sub(r"[^\n]", " ", s)

    return _QUIET.sub(blank, text)


def _close(quiet: str, start: int) -> int:
    """The end of the bracket that opens at start, or of the text."""
    depth, opens, closes = 0, "([{", ")]}"
    for i in range(start, len(quiet)):
        if quiet[i] in opens:
            depth += 1
        elif quiet[i] in closes:
            depth -= 1
            if depth == 0:
                return i
    return len(quiet)


def _entries(text: str, quiet: str, start: int, end: int) -> list[str]:
    """The parts between commas at the top level of text[start:end]."""
    out, depth, at = [], 0, start
    for i in range(start, end):
        c = quiet[i]
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:end])
    return [x.strip() for x in out if x.strip()]


def _bare(name: str) -> str:
    return name.strip().strip("\"'`[]").strip()


_NO_COLUMN = re.compile(r"(?i)(constraint|primary|foreign|unique|key|index|check)\s")


def _sql(text: str) -> Iterator[tuple[str, list[str]]]:
    quiet, seen = _quiet(text), _quiet(text, keep_strings=True)
    part = r"(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[\w$]+)"
    for m in re.finditer(rf"(?i)\bcreate\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?({part}(?:\s*\.\s*{part})*)\s*\(", seen):
        end = _close(quiet, m.end() - 1)
        columns = []
        for e in _entries(seen, quiet, m.end(), end):
            if _NO_COLUMN.match(e):
                continue
            c = re.match(rf"({part})", e)
            if c:
                columns.append(_bare(c.group(1)))
        yield _bare(re.split(r"\.(?=(?:[^\"`]*[\"`][^\"`]*[\"`])*[^\"`]*$)", m.group(1))[-1]), columns


def _drizzle(text: str) -> Iterator[tuple[str, list[str]]]:
    quiet, seen = _quiet(re.sub(r"(?m)#", " ", text)), _quiet(re.sub(r"(?m)#", " ", text), keep_strings=True)
    for m in re.finditer(r"\b(?:pg|sqlite|mysql)Table\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*\{", seen):
        end = _close(quiet, m.end() - 1)
        columns = []
        for e in _entries(seen, quiet, m.end(), end):
            key, _, value = e.partition(":")
            s = re.search(r"[\"'`]([^\"'`]+)[\"'`]", value)
            if s and re.fullmatch(r"\s*[\"']?[\w$]+[\"']?\s*", key):
                columns.append(s.group(1))
        yield m.group(1), columns


def _prisma(text: str) -> Iterator[tuple[str, list[str]]]:
    for m in re.finditer(r"\bmodel\s+(\w+)\s*\{([^}]*)\}", text):
        yield m.group(1).lower(), re.findall(r"(?m)^[ \t]+(\w+)[ \t]+\w", m.group(2))


def _class_bodies(text: str, head: str) -> Iterator[tuple[re.Match, str]]:
    """Python classes whose header matches, with the indented lines that follow."""
    for m in re.finditer(rf"(?m)^([ \t]*){head}[^\n]*\n", text):
        indent, lines = len(m.group(1)), []
        for line in text[m.end() :].split("\n"):
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            lines.append(line)
        yield m, "\n".join(lines)


def _sqlalchemy(text: str) -> Iterator[tuple[str, list[str]]]:
    for _, body in _class_bodies(text, r"class\s+(\w+)"):
        name = re.search(r"__tablename__\s*=\s*[\"']([^\"']+)[\"']", body)
        if name:
            yield name.group(1), re.findall(r"(?m)^[ \t]{2,}(\w+)\s*(?::[^=\n]+)?=\s*(?:\w+\.)?(?:mapped_column|Column)\s*\(", body)
    quiet = _quiet(text)
    for m in re.finditer(r"\bTable\s*\(\s*[\"']([^\"']+)[\"']", text):
        end = _close(quiet, text.index("(", m.start()))
        yield m.group(1), re.findall(r"\bColumn\s*\(\s*[\"']([^\"']+)[\"']", text[m.end() : end])


def _django(text: str) -> Iterator[tuple[str, list[str]]]:
    for m, body in _class_bodies(text, r"class\s+(\w+)\s*\([^)\n]*\bmodels\.Model\b[^)\n]*\)\s*:"):
        name = re.search(r"db_table\s*=\s*[\"']([^\"']+)[\"']", body)
        yield name.group(1) if name else m.group(2).lower(), re.findall(r"(?m)^[ \t]{2,}(\w+)\s*=\s*models\.\w+Field\b", body)


_COLUMNS = "Column|PrimaryColumn|PrimaryGeneratedColumn|CreateDateColumn|UpdateDateColumn|DeleteDateColumn|VersionColumn|ViewColumn"


def _typeorm(text: str) -> Iterator[tuple[str, list[str]]]:
    quiet = _quiet(text)
    for m in re.finditer(r"@Entity\s*\(\s*(?:[\"']([^\"']*)[\"'])?[^)]*\)", text):
        c = re.compile(r"\bclass\s+(\w+)[^{]*\{").search(text, m.end(), m.end() + 400)
        if c:
            body = text[c.end() : _close(quiet, c.end() - 1)]
            yield m.group(1) or c.group(1).lower(), re.findall(rf"@(?:{_COLUMNS})\b[^;]*?\n\s+(?:readonly\s+)?(\w+)\s*[?!]?\s*[=:]", body)


DIALECTS: dict[str, tuple[Callable[[str], Iterator[tuple[str, list[str]]]], bool]] = {
    "drizzle": (_drizzle, True), "sql": (_sql, True), "prisma": (_prisma, False),
    "sqlalchemy": (_sqlalchemy, False), "django": (_django, False), "typeorm": (_typeorm, False),
}


def schema_rows(text: str) -> list[tuple[str, str, str]]:
    """(dialect, table, column); a table without columns has column '' in the dialects that keep such."""
    out = set()
    for dialect, (parse, keep) in DIALECTS.items():
        for name, columns in parse(text):
            if name and (columns or keep):
                out |= {(dialect, name, c) for c in columns} or {(dialect, name, "")}
    return sorted(out)


def parse_schemas(texts: DataFrame) -> DataFrame:
    """id, dialect, tbl, col for texts (id, text). Null texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, t in zip(b["id"], b["text"]) for r in schema_rows(t)], columns=["id", "dialect", "tbl", "col"])

    kind = texts.schema["id"].dataType.simpleString()
    return spread(texts.where("text is not null").select("id", "text")).mapInPandas(run, f"id {kind}, dialect string, tbl string, col string")


def merged_schema(parsed: DataFrame) -> DataFrame:
    """tbl, columns: tables united by name over dialects and texts, columns sorted."""
    return parsed.groupBy("tbl").agg(F.array_sort(F.collect_set(F.when(F.col("col") != "", F.col("col")))).alias("columns"))


# ---- code structure

_JS_IMPORT = re.compile(r"(?:import|export)\s[^'\"`;]*?from\s*['\"]([^'\"]+)['\"]|import\s*['\"]([^'\"]+)['\"]|(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
_JS_FUNCTION = re.compile(r"\bfunction\s*\*?\s+(\w+)\s*\(|\b(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|\w+\s*=>)")
_JS_METHOD = re.compile(r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set|override)\s+)*(\w+)\s*\([^)]*\)\s*(?::[^{=\n]+)?\{")
_NO_METHOD = frozenset("if for while switch catch function return constructor with".split())


def _calls(quiet: str, at: int, name: str) -> set[tuple[str, str, str]]:
    """What the body says that begins at the next brace."""
    at = quiet.find("{", at)
    body = "" if at < 0 else re.sub(r"\bfunction\s*\*?\s+\w+\s*\(", "", quiet[at : _close(quiet, at)])
    return {("call", c, name) for c in re.findall(r"(\w+)\s*\(", body) if c not in _NO_METHOD}


def code_rows(language: str, text: str) -> list[tuple[str, str, str]]:
    """(kind, name, within) of imports, functions, classes, methods and calls (name is the callee)."""
    out: set[tuple[str, str, str]] = set()
    if language == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                tree = ast.parse(text.removeprefix("﻿"))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return []
        stack: list[tuple[ast.AST, str, str]] = [(tree, "", "")]
        while stack:
            node, owner, function = stack.pop()
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.Import):
                    out |= {("import", a.name, "") for a in child.names}
                elif isinstance(child, ast.ImportFrom):
                    out.add(("import", "." * child.level + (child.module or ""), ""))
                if isinstance(child, ast.ClassDef):
                    out.add(("class", child.name, ""))
                    stack.append((child, child.name, function))
                elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.add(("method" if owner else "function", child.name, owner))
                    stack.append((child, "", child.name))
                else:
                    if isinstance(child, ast.Call) and function:
                        callee = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", "")
                        if callee:
                            out.add(("call", callee, function))
                    stack.append((child, owner if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else "", function))
        return sorted(out)
    seen, quiet = _quiet(text.replace("#", " "), keep_strings=True), _quiet(text.replace("#", " "))
    if language in ("typescript", "javascript"):
        out |= {("import", next(g for g in m.groups() if g), "") for m in _JS_IMPORT.finditer(seen)}
        spans = []
        for m in re.finditer(r"\bclass\s+(\w+)[^{\n]*\{", quiet):
            end = _close(quiet, m.end() - 1)
            out.add(("class", m.group(1), ""))
            for x in _JS_METHOD.finditer(quiet, m.end(), end):
                if x.group(1) not in _NO_METHOD:
                    out.add(("method", x.group(1), m.group(1)))
                    spans.append((x.group(1), x.end() - 1))
        for m in _JS_FUNCTION.finditer(quiet):
            name = m.group(1) or m.group(2)
            out.add(("function", name, ""))
            spans.append((name, quiet.find("{", m.end() - 1)))
        for name, at in spans:
            if at >= 0:
                out |= _calls(quiet, at, name)
    elif language == "go":
        for m in re.finditer(r"(?ms)^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", seen):
            out |= {("import", x, "") for x in ([m.group(2)] if m.group(2) else re.findall(r"\"([^\"]+)\"", m.group(1) or ""))}
        for m in re.finditer(r"(?m)^func\s*(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)", quiet):
            out.add(("method" if m.group(1) else "function", m.group(2), m.group(1) or ""))
            out |= _calls(quiet, m.end(), m.group(2))
        out |= {("class", m, "") for m in re.findall(r"(?m)^type\s+(\w+)\s+struct", quiet)}
    elif language == "java":
        out |= {("import", m, "") for m in re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", quiet)}
        for m in re.finditer(r"\b(?:class|interface|enum|record)\s+(\w+)[^{;]*\{", quiet):
            out.add(("class", m.group(1), ""))
            for x in re.finditer(r"[\w>\]]\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\{", quiet[m.end() : _close(quiet, m.end() - 1)]):
                if x.group(1) not in _NO_METHOD:
                    out.add(("method", x.group(1), m.group(1)))
                    out |= _calls(quiet, m.end() + x.end() - 1, x.group(1))
    elif language in ("c", "cpp"):
        out |= {("import", m, "") for m in re.findall(r"(?m)^\s*include\s*[<\"]([^>\"]+)[>\"]", seen)}
        out |= {("class", m, "") for m in re.findall(r"\b(?:struct|class)\s+(\w+)[^;{(]*\{", quiet)}
        for m in re.finditer(r"(?m)^[\w:<>,&* ]*?[\w>&*]\s+\**(\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{", quiet):
            if m.group(1) not in _NO_METHOD:
                out.add(("function", m.group(1), ""))
                out |= _calls(quiet, m.end() - 1, m.group(1))
    return sorted(out)


def parse_code(files: DataFrame) -> DataFrame:
    """id, kind, name, within for files (id, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, k, t in zip(b["id"], b["language"], b["text"]) for r in code_rows(k, t)]
            yield pd.DataFrame(rows, columns=["id", "kind", "name", "within"])

    kind = files.schema["id"].dataType.simpleString()
    return spread(files.where("text is not null and language is not null").select("id", "language", "text")).mapInPandas(run, f"id {kind}, kind string, name string, within string")


# ---- governance documents, as column expressions


def front_matter(docs: DataFrame) -> DataFrame:
    """id, key, value of ``key: value`` lines that are not indented; keys in lower case, the last of a key wins."""
    lines = docs.select("id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    parts = lines.where(F.col("line").rlike(r"^[A-Za-z][\w \-]*:")).select(
        "id", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value")
    )
    return parts.groupBy("id", "key").agg(F.max_by("value", "pos").alias("value"))


def rule_blocks(docs: DataFrame) -> DataFrame:
    """id, rule_id, operation, path_pattern, min_role, effect, source_priority, policy_id of rule documents.

    A rule begins at a line ``- rule_id:``; its number is a running sum within its own document.
    """
    lines = docs.select("id", F.regexp_extract("text", r"(?im)^Policy ID:[ \t]*(\S+)", 1).alias("policy_id"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    start = F.col("line").rlike(r"^\s*-\s*rule_id:")
    block = F.sum(start.cast("int")).over(Window.partitionBy("id").orderBy("pos"))
    rows = lines.withColumn("block", block).where("block > 0")
    pair = rows.select("id", "policy_id", "block", "pos", F.regexp_extract("line", r"^\s*(?:-\s*)?(rule_id|operation|path_pattern|min_role|effect|source_priority):[ \t]*(.*?)\s*$", 1).alias("k"), F.regexp_extract("line", r"^\s*(?:-\s*)?(rule_id|operation|path_pattern|min_role|effect|source_priority):[ \t]*(.*?)\s*$", 2).alias("v")).where("k <> ''")
    value = lambda k: F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("pos"))).alias(k)
    out = pair.groupBy("id", "policy_id", "block").agg(*[value(k) for k in ("rule_id", "operation", "path_pattern", "min_role", "effect")], value("source_priority"))
    return out.withColumn("source_priority", F.col("source_priority").try_cast("int")).drop("block")


def document_metadata(text: Column) -> list[Column]:
    """doc_ref, owner, effective_date as written in a document's lines."""
    pick = lambda p: F.nullif(F.regexp_extract(text, rf"(?im)^(?:{p}):[ \t]*(.+?)[ \t\r]*$", 1), F.lit(""))
    return [pick("id|policy id|document id").alias("doc_ref"), pick("owner").alias("owner"), pick("effective date|review date").alias("effective_date")]


# ---- agent replies


def first_json(text: str | None) -> str | None:
    """The first JSON object in a reply: the whole, the inside of a fence, or the first part that decodes."""
    if not text:
        return None
    decoder = json.JSONDecoder(strict=False)
    fenced = re.findall(r"```[\w]*\s*\n(.*?)```", text, re.S)
    for part in (text.strip(), *fenced):
        try:
            value = decoder.decode(part.strip())
        except (ValueError, RecursionError):
            continue
        if isinstance(value, (dict, list)):
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    for m in re.finditer(r"[{\[]", text):
        try:
            value, _ = decoder.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def decode_replies(replies: DataFrame) -> DataFrame:
    """id, parsed, requirements, files of replies (id, text): decoded JSON, and ids and paths named anywhere."""
    ship(replies.sparkSession)

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda t: first_json(t if isinstance(t, str) else None))

    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"\b(RQ-\d+)\b"), F.lit(1))))
    files = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-\[\]()]+)+\.(?:tsx?|jsx?|py))"), F.lit(1))))
    return replies.select("id", parse("text").alias("parsed"), F.coalesce(ids, F.array().cast("array<string>")).alias("requirements"), F.coalesce(files, F.array().cast("array<string>")).alias("files"))
