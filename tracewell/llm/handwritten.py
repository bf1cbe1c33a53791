"""Generated, minified, vendored and blob files: clusters of identifier-masked shingles, then a check of each file.

Every file becomes a set of shingles of five tokens in which identifiers and literals are masked. Files with the
same set are one shape; shapes are banded by MinHash, verified at a similarity of 0.8 and joined to classes. A
class that holds nothing but literals is data; one within a repository is a family, one across repositories a
candidate for vendoring. As hand-written files of one house also share their masked shapes, a class alone is no
proof but for data: within it each file is checked for marks of tools and upstream projects in its comments and
path, for its layout, and for unmasked shingles that are similar to those of a marked file of the class at 0.8.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import is_ignored
from tracewell.llm.sources import _PATTERN
from tracewell.session import Scratch, spread

SHINGLE, SIMILARITY = 5, 0.8
#: 16 bands of 4 rows: a pair at 0.8 shares a band with probability 0.9998.
BANDS, ROWS = 16, 4
#: Unmasked shingles are spread over bins by their hash, BIN in one on average at most; two files meet in a bin that is
#: the same in both. At 0.8 a bin is the same with probability 0.37 at least: one of BINS with 0.9999, and where all are
#: taken, one surely, as more bins than shingles that differ are made.
BIN, BINS = 4, 24
#: Sizes up to which files have as many bins; a marked file is given the bins of all levels from 0.8 to 1.25 of its size.
LEVELS = np.array([round(8 * 1.5**k) for k in range(60)], dtype=np.int64)
#: Bits of the parity sketch of unmasked shingles, in longs: at most as many bits differ as shingles do.
BITS = 256
ODD = [f"odd{k}" for k in range(BITS // 64)]
#: Shapes of a bucket from which it is split into parts; each two parts are then a cell, in which all is compared.
CELL = 1_000
#: Columns of a cell's matrix at a time, characters of text that are read at a time, tokens whose codes are kept.
COLUMNS, CHARS, KEPT = 4_096, 1_000_000, 1 << 17
#: Links up to which one task joins them, and files up to which their ids are broadcast.
FEW_LINKS, FEW_FILES = 2_000_000, 500_000
#: Share of literals among the names and literals of a file from which it is data.
LITERAL = 0.9
#: Literals that make a file a blob: so many, or so many characters in them.
LITERALS, LITERAL_CHARS = 40, 400
#: A line of code is long from here on, and a file with more than half of its code in long lines is minified.
LONG_LINE = 300
#: Marks that a copy of a file inherits.
COPIED = ("generated", "vendored")

_TOKEN = re.compile(
    r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![^\s;{}()])\#(?!include\b|define\b|if|endif|else|elif|undef|pragma)[^\n]*)"
    r"|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)"
    r"|(?P<d>\d[\w.]*)|(?P<n>[^\W\d][\w$]*|\$[\w$]*)|(?P<p>[^\s\w])",
    re.S,
)
#: The same tokens; a comment gives an empty one.
_PLAIN = re.compile(re.sub(r"\(\?P<[csdnp]>", "(?:", _TOKEN.pattern.replace("|(?P<s>", "|((?P<s>", 1)) + ")", re.S)
_KEYWORDS = frozenset(
    """abstract and as assert async await break case catch class const continue def default defer del do elif else enum export extends
    except false final finally for from func function go goto if implements import in instanceof interface is lambda let map namespace
    new nil not null or package pass private protected public raise range return select self static struct super switch template this
    throw throws true try type typedef typename typeof union using var void while with yield None True False""".split()
)

#: What a tool writes at the start of a comment line.
GENERATED = re.compile(
    r"""@generated\b
    | code\s+generated\s+(?:by|from|with)\b.*do\s+not\s+(?:edit|modify)
    | auto-?\s?generated\b
    | <auto-?generated
    | (?:this\s+)?(?:file|code|module|class|output|source)\s+(?:was|is|has\s+been)\s+(?:automatically\s+|auto-?)?(?:generated|created\s+by\s+a\s+tool)\b
    | (?:machine|automatically|programmatically)[-\s]generated\b
    | generated\s+(?:automatically\s+)?(?:by|from|with|using)\b.*(?:do\s+not|don'?t)\s+(?:edit|modify|change|touch)
    | do\s+not\s+(?:edit|modify)\b.*\b(?:re)?generated\b
    """,
    re.I | re.X,
)
#: What comes with a copy of another project.
VENDORED = re.compile(
    r"""@license\b
    | (?:released|licensed|distributed)\s+under\s+(?:the\s+)?[\w.\- ]*(?:license|licence|MIT|BSD|Apache|GPL|ISC|zlib|MPL)
    | imported\s+from\s+(?:the\s+)?\S+\s+project\b
    | .*\bvendored\s+(?:copy|from)\b
    | SPDX-License-Identifier
    | copyright\b.*\b(?:foundation|contributors|authors)\b
    | \(c\)\s.*\bcontributors\b
    """,
    re.I | re.X,
)
#: Without one of these no mark is there; outside of ASCII other letters may be equal to these.
_HINTS = ("generated", "created", "license", "under", "imported", "vendored", "spdx", "copyright", "(c)")
GENERATED_PATH = re.compile(r"(?i)(?:^|/)__generated__/|\.generated\.\w+$|\.g(?:en)?\.\w+$|\.pb\.(?:go|cc|h)$|_pb2(?:_grpc)?\.py$|\.designer\.\w+$")
VENDORED_PATH = re.compile(r"(?i)^(?:[\w.-]+/)*(?:third[_-]party|node_modules|bower_components)/|^vendor/[^/]+\.[a-z]+/|[-@_]v?\d+\.\d+\.\d+(?:[-.][\w.]*)?\.\w+$|[-@]v?\d+\.\d+\.\d+/")

def comment_marks(text: str) -> set[str]:
    """generated or vendored, by all comment lines of a text; lines of a string are none."""
    if text.isascii() and not any(map(text.lower().__contains__, _HINTS)):
        return set()
    found = _line_marks(text)
    return found and _line_marks(_TOKEN.sub(lambda m: '""' if m.lastgroup == "s" and "\n" in m.group() else m.group(), text))


def _line_marks(text: str) -> set[str]:
    found, inside = set(), False
    for line in text.lstrip("﻿").split("\n"):
        s = line.strip()
        begins = s.startswith(("//", "#", "/*", "*", "--", "<!--", ";;"))
        if not (begins or inside):
            continue
        if s.startswith("/*"):
            inside = "*/" not in s
        elif inside and "*/" in s:
            inside = False
        body = re.sub(r"^(?://+!?|#+!?|/\*+!?|\*+|--+|<!--|;;+)\s*", "", s).rstrip("*/->  ")
        if GENERATED.match(body):
            found.add("generated")
        if VENDORED.match(body):
            found.add("vendored")
    return found


def is_minified(text: str) -> bool:
    """Whether most of the code, comments and the insides of strings aside, is in long lines."""
    if len(text) < LONG_LINE or max(map(len, text.splitlines()), default=0) < LONG_LINE:
        return False
    code = _TOKEN.sub(lambda m: " " if m.lastgroup == "c" else '""' if m.lastgroup == "s" and len(m.group()) > 40 else m.group(), text)
    lengths = [len(x.strip()) for x in code.splitlines()]
    total = sum(lengths)
    held = [n for n in lengths if n >= LONG_LINE]
    return bool(held) and sum(held) > 0.5 * total and code.count(" ") < 0.15 * max(1, len(code)) and len(re.findall(r"[;{}()]", code)) > 0.05 * len(code)


_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 2**61 - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1))[:, None]
_B = _rng.integers(0, 2**61 - 1, BANDS * ROWS, dtype=np.uint64)[:, None]


def shingles_of(codes: np.ndarray) -> np.ndarray:
    """Distinct 32-bit shingles of a token sequence; a shorter one is a single shingle."""
    n = max(1, len(codes) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        part = codes[k : k + n] if len(codes) >= SHINGLE else (codes[k : k + 1] if k < len(codes) else np.zeros(1, np.uint64))
        h = (h * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1)) ^ (h >> np.uint64(29))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def bands_of(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B, size: int = ROWS) -> list[int]:
    """A hash of each band of ``size`` rows of the MinHash signature."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 20_000):  # so that memory does not grow with the text
        part = shingles[i : i + 20_000].astype(np.uint64)[None, :]
        mixed = a * part + b
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(31))).min(axis=1))
    rows = low.reshape(-1, size)
    h = np.zeros(len(rows), dtype=np.uint64)
    for k in range(size):
        h = (h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]) ^ (h >> np.uint64(31))
    return h.view(np.int64).tolist()


#: Codes of masked tokens: names 0, strings 1, numbers 2, keywords from 3, other characters by their number.
_CODES = {w: k for k, w in enumerate(sorted(_KEYWORDS), 3)}


class _Codes(dict):
    """The code of a masked token above that of the token itself, by the token."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        masked = 1 if c in "\"'`" else 2 if c.isdecimal() else _CODES.get(token, 0) if c in "$_" or c.isalnum() else 1_000 + ord(c)
        code = masked << 32 | zlib.crc32(token.encode("utf-8", "surrogatepass"))
        if len(token) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[token] = code
        return code


_codes = _Codes()
_GOLD, _MIX, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _rolled(codes: np.ndarray) -> np.ndarray:
    """32-bit hashes of all runs of SHINGLE codes, as ``shingles_of`` has them."""
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h * _GOLD + codes[k : k + n] + np.uint64(1)) ^ (h >> np.uint64(29))
    h ^= h >> np.uint64(32)
    return (h * _MIX) >> np.uint64(32)


def own_shingles(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """File and unmasked 32-bit shingle, ordered and distinct, of the token codes of files, of SHINGLE tokens or more,
    behind each other; a shingle that comes again is another, so half of a text is not all."""
    same = of[: -SHINGLE + 1] == of[SHINGLE - 1 :]
    key = np.sort(of[: -SHINGLE + 1][same] << np.uint64(32) | _rolled(codes)[same])
    at = np.arange(len(key))
    again = at - np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
    more = again > 0
    key[more] = key[more] & ~_LOW | _mixed((key[more] & _LOW) + again[more].astype(np.uint64) * _GOLD) >> np.uint64(32)
    key = np.unique(key)
    return key >> np.uint64(32), key & _LOW


def own_bins(of: np.ndarray, own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """File and hash of each bin of a file that is not empty, the bins made for the size of ``level`` of each file; a
    negative level has none. Files of few bins have several tables of them."""
    made = np.where(level >= 0, LEVELS[np.maximum(level, 0)] // BIN + 1, 0)
    tables, files, found = -(-BINS // np.maximum(made, 1)) * (made > 0), [], []
    for t in range(int(tables.max(initial=0))):
        has = tables[of] > t
        f, x = of[has].astype(np.int64), own[has]
        spread_ = _mixed(x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64((t + 1) * int(_GOLD) % 2**64))
        where = (((spread_ >> np.uint64(32)) * made[f].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        f, where, x = (v[where < BINS] for v in (f, where, spread_))
        x = _mixed(x * _GOLD)
        cell, n = f * BINS + where, len(level) * BINS
        held = np.bincount(cell, minlength=n)
        low = np.bincount(cell, (x & _LOW).astype(np.float64), n).astype(np.uint64)  # sums below 2 ** 53 are exact
        high = np.bincount(cell, (x >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
        at = np.flatnonzero(held)
        h = _mixed(low[at] * _GOLD + high[at])
        h = _mixed(h * _GOLD + ((held[at].astype(np.uint64) * np.uint64(64) + level[at // BINS].astype(np.uint64)) * np.uint64(64) + np.uint64(t)) * np.uint64(64) + (at % BINS).astype(np.uint64))
        files.append(at // BINS)
        found.append(h)
    if not files:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    f, h = np.concatenate(files), np.concatenate(found).view(np.int64)
    order = np.argsort(f, kind="stable")
    return f[order], h[order]


def level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, n)


def parities(of: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Longs of BITS bits for each of ``n`` files: of how many of its shingles fall on a bit, whether that is odd."""
    bit = (_mixed(own * _MIX + _GOLD) >> np.uint64(20)) % np.uint64(BITS)
    odd = np.bincount(of.astype(np.int64) * BITS + bit.astype(np.int64), minlength=n * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def _tokens(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, how many, the codes of all and the text of each."""
    plain = [[x for x in _PLAIN.findall(t) if x] for t in texts]
    sizes = np.array([len(x) for x in plain], dtype=np.int64)
    codes = np.fromiter(chain.from_iterable(map(_codes.__getitem__, x) for x in plain), np.uint64, int(sizes.sum()))
    return plain, sizes, codes, np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)


def _body(plain: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(plain).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _own_of(codes: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    long = (sizes >= SHINGLE)[of.astype(np.int64)]
    if not long.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return own_shingles((codes[long] & _LOW) * np.uint64(0xBF58476D1CE4E5B9), of[long])


def _lists(of: np.ndarray, values: np.ndarray, n: int, kept: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list of each of ``n`` files; null where it is not kept. ``of`` is in order."""
    ends = np.searchsorted(of, np.arange(n + 1, dtype=of.dtype))
    values = values[kept[of.astype(np.int64)]]
    ends = np.concatenate([[0], np.cumsum(np.where(kept, np.diff(ends), 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind), mask=pa.array(~kept))


def features(paths: list[str], texts: list[str], shapes: set, bodies: set) -> dict[str, pa.Array]:
    """Of each file its marks, whether it is a blob, its literals and names, fingerprints of its body and shape, the
    shape's shingles, and of the unmasked shingles how many there are, their sketch and their bins.

    Shingles are given with the first file of a shape, bins with the first of a body and its marks: ``shapes`` and
    ``bodies`` have what was given before. A text that comes again is read once.
    """
    at = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    row, texts = np.array([at[t] for t in texts], dtype=np.int64), list(at)
    n = len(texts)
    plain, sizes, codes, of = _tokens(texts)
    masked = codes >> np.uint64(32)
    where = of.astype(np.int64)
    literals = np.bincount(where[(masked == 1) | (masked == 2)], minlength=n)
    names = np.bincount(where[(masked == 0) | (masked >= 3) & (masked < 1_000)], minlength=n)
    masked = masked * np.uint64(0xBF58476D1CE4E5B9)
    if len(codes) >= SHINGLE:
        same = of[: -SHINGLE + 1] == of[SHINGLE - 1 :]
        key = np.unique(of[: -SHINGLE + 1][same] << np.uint64(32) | _rolled(masked)[same])
    else:
        key = np.zeros(0, np.uint64)
    ends, starts = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)), np.concatenate([[0], np.cumsum(sizes)])
    low = (key & _LOW).astype(np.uint32)
    blobs, body, shape, sets, own_marks = [], [], [], [], []
    for i, (text, x) in enumerate(zip(texts, plain)):
        blob = literals[i] >= LITERAL * max(1, literals[i] + names[i]) and literals[i] >= LITERALS
        if not blob and names[i] <= 6:  # one long literal under a name is data as well: then its characters count
            chars = sum(len(t) for t in x if t[0] in "\"'`" or t[0].isdecimal())
            blob = chars >= LITERAL_CHARS and chars >= LITERAL * len(text)
        blobs.append(bool(blob))
        own_marks.append(comment_marks(text) | ({"minified"} if is_minified(text) else set()))
        body.append(_body(x))
        s = low[ends[i] : ends[i + 1]] if sizes[i] >= SHINGLE else shingles_of(masked[starts[i] : starts[i + 1]])
        shape.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
        sets.append(s.view(np.int32))
    marks, shingles, first, given = [], [], np.zeros(len(row), bool), np.zeros(len(row), bool)
    for j, (path, i) in enumerate(zip(paths, row.tolist())):
        found = set(own_marks[i])
        if GENERATED_PATH.search(path):
            found.add("generated")
        if VENDORED_PATH.search(path):
            found.add("vendored")
        marks.append(sorted(found))
        shingles.append(None if shape[i] in shapes else sets[i])
        shapes.add(shape[i])
        copied = tuple(m in found for m in COPIED)
        if sizes[i] >= SHINGLE and (body[i], copied) not in bodies:
            bodies.add((body[i], copied))
            first[j], given[j] = True, any(copied)
    asked, wanted = np.zeros(n, bool), np.zeros(n, bool)
    asked[row[first]], wanted[row[given]] = True, True
    who, own = _own_of(codes, sizes, of)
    many = np.bincount(who.astype(np.int64), minlength=n)
    odd = parities(who, own, n)
    level = np.where(asked, level_of(many), -1)
    # a similar file has 0.8 to 1.25 times as many shingles
    least, most = level_of(-(-many * 4 // 5)), level_of(many * 5 // 4)
    bins = _lists(*own_bins(who, own, level), n, asked, pa.int64())
    wide = [own_bins(who, own, np.where(wanted & (least <= x) & (x <= most) & (x >= 0), x, -1)) for x in (level - 1, level, level + 1)]
    f, h = (np.concatenate(x) for x in zip(*wide))
    order = np.argsort(f, kind="stable")
    wide = _lists(f[order], h[order], n, wanted, pa.int64())
    by_row = {
        "literal": pa.array(blobs, pa.bool_()), "literals": pa.array(literals, pa.int64()), "names": pa.array(names, pa.int64()), "body": pa.array(body, pa.int64()), "size": pa.array(sizes, pa.int64()),
        "shape": pa.array(shape, pa.int64()), "many": pa.array(many, pa.int32()), **{c: pa.array(odd[:, k].copy(), pa.int64()) for k, c in enumerate(ODD)},
    }
    out = {k: x.take(pa.array(row)) for k, x in by_row.items()}
    out |= {"marks": pa.array(marks, pa.list_(pa.string())), "shingles": pa.array(shingles, pa.list_(pa.int32()))}
    return out | {"bins": bins.take(pa.array(row, mask=~first)), "wide": wide.take(pa.array(row, mask=~given))}


_FEATURES = "file_id long, repo string, path string, ingested_at {}, marks array<string>, literal boolean, literals long, names long, body long, size long, shape long, shingles array<int>, many int, " + ", ".join(f"{c} long" for c in ODD) + ", bins array<long>, wide array<long>"


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about CHARS bytes of content in each."""
    ends = np.cumsum([x or 0 for x in pa.compute.binary_length(b.column("content")).to_pylist()])
    start = 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHARS, "right")))
        yield b.slice(start, stop - start)
        start = stop


def source_files(files: DataFrame) -> DataFrame:
    """file_id, repo, path, content, ingested_at of all source files, a null content as an empty one."""
    rows = files.where(F.col("path").rlike(_PATTERN) & F.col("file_id").isNotNull())
    return rows.select(F.col("file_id").cast("long").alias("file_id"), "repo", F.rtrim("path").alias("path"), F.coalesce("content", F.lit("")).alias("content"), "ingested_at")


def file_features(files: DataFrame) -> DataFrame:
    """One row per source file row, without its content.

    Where texts come again, they are brought together first, and each is read once.
    """
    rows = source_files(files)
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("content"))).first()
    if distinct < n / 2:
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution().toRdd().getNumPartitions())
        rows = rows.repartition(parts, F.xxhash64("content")).sortWithinPartitions(F.xxhash64("content"))
    else:
        rows = spread(rows)

    schema = _FEATURES.format(rows.schema["ingested_at"].dataType.simpleString())
    columns = [x.split()[0] for x in _FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, bodies = set(), set()
        for b in (x for batch in batches for x in _slices(batch)):
            paths, texts = [p.replace("\\", "/") for p in b.column("path").to_pylist()], b.column("content").to_pylist()
            kept = {x: b.column(x) for x in ("file_id", "repo", "path", "ingested_at")}
            out = kept | features(paths, texts, shapes, bodies)
            yield pa.RecordBatch.from_pydict({c: out[c] for c in columns})

    return rows.mapInArrow(run, schema)


def body_sets(rows: DataFrame) -> DataFrame:
    """body, own of rows with a content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in _slices(batch)):
            plain, sizes, codes, of = _tokens(b.column("content").to_pylist())
            sets = _lists(*_own_of(codes, sizes, of), len(plain), np.ones(len(plain), bool), pa.uint32())
            own = pa.ListArray.from_arrays(sets.offsets, sets.values.view(pa.int32()))
            yield pa.RecordBatch.from_pydict({"body": pa.array([_body(x) for x in plain], pa.int64()), "own": own})

    return rows.select("content").mapInArrow(run, "body long, own array<int>")


def _similar(sets: list[np.ndarray], classes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between the classes of a cell of which shapes are similar; none that others already make."""
    order = np.argsort(classes, kind="stable")
    classes, sets = classes[order], [sets[i] for i in order]
    names, starts = np.unique(classes, return_index=True)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1  # others are in no intersection
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    blocks = []
    for c in range(0, int(shared.sum()), COLUMNS):
        m = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - c)), dtype=np.float32)
        inside = (column >= c) & (column < c + COLUMNS)
        m[row[inside], column[inside] - c] = 1
        blocks.append(m if len(sets) * int(shared.sum()) <= 20_000_000 else np.packbits(m.astype(np.uint8), axis=1))
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    of = np.searchsorted(names, classes)
    for k, start in enumerate(starts[:-1]):
        stop = starts[k + 1]
        common = np.zeros((stop - start, len(sets) - stop), dtype=np.float32)
        for m in blocks:
            a, b = (np.unpackbits(x, axis=1).astype(np.float32) if x.dtype == np.uint8 else x for x in (m[start:stop], m[stop:]))
            common += a @ b.T
        common = common.astype(np.float64)
        near = (common >= SIMILARITY * (sizes[start:stop, None] + sizes[None, stop:] - common)).any(axis=0)
        for other in np.unique(of[stop:][near]).tolist():
            if root(other) != root(k):
                parent[root(other)] = root(k)
                yield int(names[k]), int(names[other])


def _links(rows: DataFrame) -> DataFrame:
    """a, b: classes of rows (cell, class, shingles) that are linked by similar shapes of a cell; all of it is compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, sets, classes = None, [], []

        def links() -> list[tuple[int, int]]:
            return list(_similar(sets, np.array(classes))) if len(set(classes)) > 1 else []

        for b in batches:
            out = []
            for key, c, s in zip(b["cell"], b["class"], b["shingles"]):
                if key != cell:
                    out += links()
                    cell, sets, classes = key, [], []
                sets.append(s)
                classes.append(c)
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        yield pd.DataFrame(links(), columns=["a", "b"]).astype("int64")

    return rows.select("cell", "class", "shingles").repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame([(x, root(x)) for x in list(parent)], columns=["node", "class"]).astype("int64")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, class: the least node that is linked with it. edges: a, b; a node without others is left out."""
    both = scratch.write(edges.select("a", "b").distinct(), f"{name}-links")
    if both.count() <= FEW_LINKS:
        return scratch.write(both.repartition(1).mapInPandas(_joined, "node long, class long"), f"{name}0")
    both = scratch.write(both.union(both.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    state, k, total = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("class")), f"{name}0"), 0, None
    while True:
        now = state.agg(F.sum(F.col("class").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return state
        total, k = now, k + 1
        near = both.join(state.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        lower = state.join(near, "node").select("node", F.least("class", "near").alias("class"))
        jump = lower.select(F.col("node").alias("class"), F.col("class").alias("further"))
        state = scratch.write(lower.join(jump, "class", "left").select("node", F.least("class", F.coalesce("further", "class")).alias("class")), f"{name}{k}")
        if k > 1:
            scratch.drop(f"{name}{k - 1}")


def _banded(shapes: DataFrame) -> DataFrame:
    """shape, shingles, bands of shapes without bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(bands=[bands_of(s.astype(np.int32).view(np.uint32)) for s in b["shingles"]])

    return shapes.mapInPandas(run, "shape long, shingles array<int>, bands array<long>")


def shape_classes(feats: DataFrame, scratch: Scratch) -> DataFrame:
    """shape, class for every shape of ``feats``: shapes joined by verified similarity of at least 0.8.

    Each shape of a bucket is compared with the first; what that joins is a class, and only in buckets of several
    classes the shapes of each two are compared as well.
    """
    shapes = scratch.write(feats.groupBy("shape").agg(F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands")), "shapes")
    sets, cells = shapes.select("shape", "shingles"), shapes.select("shape", F.posexplode("bands").alias("band", "h"))
    heads = cells.groupBy("band", "h").agg(F.min("shape").alias("head"), F.count("*").alias("n")).where("n > 1")
    cells = scratch.write(cells.join(heads, ["band", "h"]), "cells")
    pairs = cells.where("shape <> head").select("shape", "head").distinct().join(sets, "shape").join(sets.select(F.col("shape").alias("head"), F.col("shingles").alias("theirs")), "head")
    common = F.size(F.array_intersect("shingles", "theirs"))
    pairs = pairs.where(common >= SIMILARITY * (F.size("shingles") + F.size("theirs") - common))
    first = components(pairs.select(F.col("shape").alias("a"), F.col("head").alias("b")), scratch, "first").withColumnRenamed("node", "shape")
    cells = cells.join(first, "shape", "left").withColumn("class", F.coalesce("class", "shape"))
    parts = cells.groupBy("band", "h").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).where("least < most")
    cells = cells.drop("n", "head").join(parts.select("band", "h", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), ["band", "h"]).withColumn("part", F.pmod(F.xxhash64("shape"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = cells.select("shape", "class", "band", "h", "part", others.alias("other"))
    cells = cells.select("shape", "class", F.concat_ws(":", "band", "h", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    last = components(_links(cells.join(sets, "shape")), scratch, "last").select(F.col("node").alias("class"), F.col("class").alias("joined"))
    classes = sets.select("shape").join(first, "shape", "left").withColumn("class", F.coalesce("class", "shape"))
    return scratch.write(classes.join(last, "class", "left").select("shape", F.coalesce("joined", "class").alias("class")), "classes")


def inherited(last: DataFrame, raw: DataFrame, files: DataFrame, scratch: Scratch) -> DataFrame:
    """class, body, copied: the marks that a body or others of its class have to which its similarity is at least 0.8.

    last: class, body, size, marks; raw: as of ``file_features`` of files.
    """
    bodies = last.where(f"size >= {SHINGLE}").select("class", "body", F.explode_outer("marks").alias("mark"))
    bodies = scratch.write(bodies.groupBy("class", "body").agg(*[F.max(F.coalesce(F.col("mark") == m, F.lit(False))).alias(m) for m in COPIED]), "bodies")
    given = bodies.select("class", "body", F.inline(F.array(*[F.struct(F.lit(m).alias("mark"), F.col(m).alias("has")) for m in COPIED]))).where("has").drop("has")
    given = scratch.write(given, "given")
    # the row's own marks, a bit each: a file of these marks in the table gives its body the same
    bits = sum(F.array_contains("marks", m).cast("int") * 2**k for k, m in enumerate(COPIED)).alias("bits")
    asked = raw.where("bins is not null").select("body", "many", *ODD, bits, F.explode("bins").alias("h")).where(f"bits < {2 ** len(COPIED) - 1}")
    theirs = raw.where("wide is not null").select("body", "many", *ODD, bits, F.explode("wide").alias("h"))
    theirs = theirs.select(*[F.col(c).alias(f"their_{c}") for c in ("body", "many", *ODD, "bits")], "h")
    # a similar body has at least 0.8 of the other's shingles, and at most a ninth of both together differ
    differ = " + ".join(f"bit_count({c} ^ their_{c})" for c in ODD)
    near = f"body <> their_body and their_bits & ~bits <> 0 and least(many, their_many) >= {SIMILARITY} * greatest(many, their_many) - 1e-6 and 9 * ({differ}) <= many + their_many"
    pairs = scratch.write(asked.join(theirs, "h").where(near).select("body", F.col("their_body").alias("other")).distinct(), "met")
    marked = given.withColumnRenamed("body", "other")
    pairs = pairs.join(bodies.select("class", "body"), "body").join(marked, ["class", "other"]).join(given, ["class", "body", "mark"], "left_anti")
    pairs = scratch.write(pairs, "pairs")
    # the shingles of these few are made again
    wanted = pairs.select("body").union(pairs.select("other")).distinct()
    ids = scratch.write(raw.select("body", "file_id").join(wanted, "body").groupBy("body").agg(F.min("file_id").alias("file_id")).select("file_id").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= FEW_FILES else ids
    sets = body_sets(spread(source_files(files).join(ids, "file_id", "left_semi")))
    sets = scratch.write(sets.groupBy("body").agg(F.any_value("own").alias("own")), "sets")
    pairs = pairs.join(sets, "body").join(sets.select(F.col("body").alias("other"), F.col("own").alias("theirs")), "other")
    common = F.size(F.array_intersect("own", "theirs"))
    near = pairs.where(common >= SIMILARITY * (F.size("own") + F.size("theirs") - common))
    return given.select("class", "body", "mark").union(near.select("class", "body", "mark")).groupBy("class", "body").agg(F.collect_set("mark").alias("copied"))  # at most two marks


def judged_files(files: DataFrame, specs: DataFrame) -> DataFrame:
    """file_id, repo, class, n_files, n_repos, kind, reasons: every source file with its class and what it is.

    files: file_id, repo, path, content, ingested_at; specs: name, ignore. kind is that of the class: literal,
    across (repositories), family (of one repository) or single. reasons holds ignored (below an ignore token of
    its own repo; tokens are runs of whole path segments, literally), data, minified, generated, vendored; where
    it is empty the file is hand-written. Files with other extensions or null paths give no row. A null or empty
    content has a shape of no tokens. Of rows with the same id the last ingested counts. Unknown repos have no
    ignore tokens. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(files.sparkSession)
    order = F.struct("ingested_at", "path", "body")
    raw = scratch.write(file_features(files), "raw")
    last = raw.groupBy("file_id").agg(F.max_by(F.struct("repo", "path", "marks", "literal", "literals", "names", "body", "size", "shape"), order).alias("x")).select("file_id", "x.*")
    last = scratch.write(last, "files")
    shapes = raw.where("shingles is not null").groupBy("shape").agg(F.any_value("shingles").alias("shingles"))
    classes = shape_classes(_banded(spread(shapes)), scratch)
    classed = last.join(classes, "shape")
    stats = classed.groupBy("class").agg(
        F.count("*").alias("n_files"), F.approx_count_distinct("repo").alias("n_repos"), (F.min("repo") < F.max("repo")).alias("across"),
        F.greatest(F.avg(F.col("literal").cast("int")) / 0.5, F.sum("literals") / F.greatest(F.sum("literals") + F.sum("names"), F.lit(1)) / LITERAL).alias("share"),
    )
    marked = inherited(classed, raw, files, scratch)
    tokens = specs.groupBy(F.col("name").alias("repo")).agg(F.max("ignore").alias("tokens"))
    out = classed.join(stats, "class").join(marked, ["class", "body"], "left").join(tokens, "repo", "left")
    kind = F.when(F.col("share") >= 1, "literal").when(F.col("n_files") == 1, "single").when(F.coalesce("across", F.lit(False)), "across").otherwise("family")
    none = F.array().cast("array<string>")
    copied = F.when(F.col("size") >= SHINGLE, F.coalesce("copied", none)).otherwise(none)
    reasons = F.array_distinct(
        F.concat(
            F.when(is_ignored(F.col("path"), F.col("tokens")), F.array(F.lit("ignored"))).otherwise(none),
            F.when(F.col("literal") | (kind == "literal"), F.array(F.lit("data"))).otherwise(none),
            F.col("marks"),
            copied,
        )
    )
    return out.select("file_id", "repo", "class", "n_files", "n_repos", kind.alias("kind"), F.array_sort(reasons).alias("reasons"))
