"""Text trees, documents, result files and configuration as frames; results as files."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.paths import language
from tracewell.functions.text import extension, is_ignored
from tracewell.session import spread

SCHEMA_EXTENSIONS = (".sql", ".ts", ".js", ".json", ".yaml", ".yml")
DOCUMENT_EXTENSIONS = (".md", ".txt", ".pdf", ".docx", ".doc")


def tree(spark: SparkSession, root: str, ignore: list[str] = [], extensions: tuple[str, ...] | None = None) -> DataFrame:  # noqa: B006
    """path, length, modified, content of the files below a folder, paths relative to it.

    Extensions are matched without letter case; a path below an ignore token is left out. Contents are read by the
    tasks, after the filters on the path.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file://").rstrip("/")
    path = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), base + "/", -1)
    out = found.select(path.alias("path"), "length", F.unix_micros("modificationTime").alias("modified"), "content")
    if extensions:
        out = out.where(extension(F.col("path")).isin(*extensions))
    return out.where(~is_ignored(F.col("path"), F.array(*map(F.lit, ignore)))) if ignore else out


def code_tree(spark: SparkSession, root: str, ignore: list[str] = []) -> DataFrame:  # noqa: B006
    """path, language, modified, text of source files."""
    files = tree(spark, root, ignore).withColumn("language", language(F.col("path"))).where("language is not null")
    return files.select("path", "language", "modified", F.try_validate_utf8("content").alias("text") if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8").alias("text"))


def schema_files(spark: SparkSession, path: str) -> DataFrame:
    """id, text of schema files: of a folder those with schema extensions, a single file whatever its name."""
    single = os.path.isfile(path.removeprefix("file://"))
    files = spark.read.format("binaryFile").load(path).select("path", "content") if single else tree(spark, path, extensions=SCHEMA_EXTENSIONS)
    return files.select(F.col("path").alias("id"), F.decode("content", "UTF-8").alias("text"))


def identifier_files(files: DataFrame, roots: list[str], max_bytes: int = 200_000, max_identifiers: int = 5_000) -> DataFrame:
    """path, identifiers of files below the roots that are small enough and have few enough identifiers."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | F.startswith("path", F.lit(r.rstrip("/") + "/"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)"), F.lit(1))))
    out = files.where(inside & (F.octet_length("text") <= max_bytes)).select("path", names.alias("identifiers"))
    return out.where(F.size("identifiers") <= max_identifiers)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word document that are not blank, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n".join(x for x in lines if x)


def pdf_text(data: bytes) -> str:
    """The pages of a PDF, one after the other; needs pypdf."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def document_text(path: str, data: bytes) -> tuple[str | None, str | None]:
    """Text and problem of a document, by its extension."""
    ext = os.path.splitext(path)[1].lower()
    try:
        if ext in (".md", ".txt"):
            return data.decode("utf-8", "ignore"), None
        if ext == ".docx":
            return docx_text(data), None
        if ext == ".pdf":
            return pdf_text(data), None
        if ext == ".doc":
            import textract  # noqa: F401

        return None, f"no reader for {ext or 'files without extension'}"
    except ImportError as e:
        return None, f"needs {e.name}"
    except Exception as e:  # a damaged document must not end the job
        return None, shortened(str(e))


def shortened(text: str, limit: int = 160) -> str:
    """On one line and of at most ``limit`` characters."""
    line = re.sub(r"\s+", " ", text).strip()
    return line if len(line) <= limit else line[: limit - 3] + "..."


def documents(spark: SparkSession, root: str) -> DataFrame:
    """path, text, problem of the documents below a folder, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [document_text(p, bytes(c)) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "text": [g[0] for g in got], "problem": [g[1] for g in got]})

    return spread(tree(spark, root, extensions=DOCUMENT_EXTENSIONS).select("path", "content")).mapInPandas(run, "path string, text string, problem string")


def clean_text(c):
    """Without NUL characters and with at most one blank line in a row."""
    return F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), r"\n{3,}", "\n\n")


def result_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV results with a header."""
    return spark.read.csv(path, header=True, schema=schema)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """Captured replies, one JSON object a line: scenario_id, raw, latency_ms."""
    return spark.read.schema("scenario_id string, raw string, latency_ms double").json(path)


def summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def dependency_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of an external dependency graph, a JSON object of path to list of imported paths."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("src", "to")).select("src", F.explode("to").alias("dst"))


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Results as json, csv (with a header) or parquet; an earlier result is replaced."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "csv": writer.option("header", True).csv, "parquet": writer.parquet}[kind](path)


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A small report as a Markdown table; the driver holds at most ``limit`` rows of it."""
    rows = df.limit(limit).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


@dataclass(frozen=True)
class Settings:
    """Settings of a project: defaults, then a YAML file, then the environment."""

    project: str = "."
    code: list[str] = field(default_factory=lambda: ["."])
    schema: list[str] = field(default_factory=list)
    requirements: list[str] = field(default_factory=list)
    policies: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    backend: list[str] = field(default_factory=list)
    deny_default: bool = True
    rule_ttl: float = 300.0

    @staticmethod
    def load(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "TRACEWELL_") -> Settings:
        values: dict[str, Any] = {}
        if path:
            import yaml

            with open(path, encoding="utf-8") as f:
                values |= yaml.safe_load(f) or {}
        for f_ in fields(Settings):
            raw = (os.environ if env is None else env).get(prefix + f_.name.upper())
            if raw not in (None, ""):
                values[f_.name] = raw
        out = Settings()
        for f_ in fields(Settings):
            if f_.name not in values:
                continue
            v, now = values[f_.name], getattr(out, f_.name)
            if isinstance(now, bool):
                v = v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(now, float):
                v = float(v)
            elif isinstance(now, list):
                v = [str(x) for x in v] if isinstance(v, list) else [x.strip() for x in str(v).split(",") if x.strip()]
            else:
                v = str(v)
            out = replace(out, **{f_.name: v})
        return out


_WRITES = re.compile(r"(?i)\b(create|insert|update|delete|merge|drop|alter|truncate|overwrite)\b")


def run_sql(spark: SparkSession, text: str, read_only: bool = True, **args: Any) -> DataFrame:
    """SQL passed through with named parameters; statements that write need ``read_only=False``."""
    if read_only and _WRITES.search(re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)):
        raise PermissionError("this session only reads")
    return spark.sql(text, args=args or None)


def describe(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of each column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
