"""Evaluation texts in training text, by a positional inverted index.

The index is partitioned by document, so it is built where the text is and never shuffled: of every document it
stores the positions of all words that any item has. Its counts over the whole corpus say which pairs of
neighbouring words of each window of an item are the rarest. From those on the postings are intersected by their
offsets, and where as many pairs of a window meet as a passage keeps at least, all postings of the item's words there are aligned with the
item, word by word. The text itself is read once, by the one function that also reads the items.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import Scratch, spread

#: A passage has so many consecutive words of an item, of which one in ten may be replaced.
PASSAGE, REPLACED = 20, 2
#: Words that are not the item's, such as line numbers, of which so many may stand before each word.
INSERT = 3
#: What stands between two spaces, such as ``a.b_c``, counts as one word where it is replaced, if it has so many at most.
PART = 4
#: Words of a document in which a passage lies.
SPAN = PASSAGE * (INSERT + 1)
#: Pairs of neighbouring words in a passage.
PAIRS = PASSAGE - 1
#: Words of the items that go to the executors at once; more are worked off in blocks of about so many.
BLOCK = 1_000_000

_ESCAPES = re.compile(r"\\+[nrtbf\"'/]|\\+")
_CODEPOINT = re.compile(r"\\+u([0-9a-fA-F]{4})")
#: Markup is a name and attributes with values; anything else between angle brackets is text.
_TAG = re.compile(r"</?[a-zA-Z][\w:.-]*(?:\s+[\w:@.-]+\s*=\s*(?:\\*\"[^\"<>]*\"|\\*'[^'<>]*'|[^\s\"'<>]+))*\s*/?>")
_WORD = re.compile(r"[^\W_]+")
_CF = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def words(text: str, unescape: bool) -> list[str]:
    """The words of a text, compared without case and compatibility forms."""
    return _WORD.findall(_plain(text, unescape))


def spaced(text: str) -> list[tuple[str, int]]:
    """The words of an item with the number of what stands between two spaces, such as ``a.b_c``, which counts as one
    where it is replaced."""
    return [(w, k) for k, part in enumerate(_plain(text, False).split()) for w in _WORD.findall(part)]


def _plain(text: str, unescape: bool) -> str:
    t = _TAG.sub(" ", text) if "<" in text else text
    t = html.unescape(t) if "&" in t else t
    if unescape and "\\" in t:
        t = _ESCAPES.sub(" ", _CODEPOINT.sub(lambda m: chr(int(m.group(1), 16)), t))
    return t.casefold() if t.isascii() else unicodedata.normalize("NFKC", _CF.sub("", t)).casefold()


def forms(text: str) -> list[list[str]]:
    """The words of a text, with and without its escapes where it has any."""
    return [words(text, True), words(text, False)] if "\\" in text else [words(text, False)]


@lru_cache(1 << 20)
def _term(word: str) -> int:
    """A word as a number other than 0."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def _useful(mask: int) -> int:
    """Matched positions, the last one as bit 0, without those that only windows with too many others reach."""
    gaps = 0
    for k in range(PASSAGE):
        if not mask >> k & 1:
            gaps += 1
            if gaps > REPLACED:
                return mask & (1 << k) - 1
    return mask & (1 << PASSAGE) - 1


def _steps(parts: list[int]) -> list[list[tuple[int, int]]]:
    """For every position of an item, how far back the matched one before it may lie, with the positions between as
    bits: of those in one part the first is another, the rest count as its own."""
    out = []
    for i in range(len(parts)):
        steps, bits, gaps, size, back = [], 0, 0, 0, 1
        while back <= i:
            steps.append((back, bits))
            size = 1 if back == 1 or parts[i - back] != parts[i - back + 1] else size + 1
            if 1 < size <= PART:  # the one behind is no longer the first of its part
                bits |= 1 << back - 1
            else:
                gaps += 1
            if gaps > REPLACED or back >= PASSAGE:
                break
            back += 1
        out.append(steps)
    return out


def aligned(places: list[tuple[int, int]], item: list[int], parts: list[int], insert: int = INSERT) -> bool:
    """Whether places, as (position, term) in order, hold PASSAGE consecutive terms of the item, REPLACED of them others.

    parts: the number of each term's part of the item; PART terms of one part that are replaced together count once.
    Every alignment is followed: of those that end at the same place, what another one holds as well is dropped.
    """
    n = len(item)
    if n < PASSAGE:
        return False
    at: dict[int, list[int]] = {}
    for i, w in enumerate(item):
        at.setdefault(w, []).append(i)
    steps, last = _steps(parts), {}  # last: item position -> (position, its masks), those still in reach
    for j, w in places:
        found = []
        for i in at.get(w, ()):
            masks = {1}
            for back, bits in steps[i]:
                for k, held in last.get(i - back, ()):
                    if 0 < j - k <= back + insert:
                        masks.update(_useful(m << back | bits | 1) for m in held)
            for m in masks:
                for e in range(REPLACED + 1):  # others at the end of the passage
                    if PASSAGE - 1 <= i + e < n and (m & (1 << PASSAGE - e) - 1).bit_count() >= PASSAGE - REPLACED:
                        return True
            found.append((i, [m for m in masks if not any(m != o and m & o == m for o in masks)]))
        for i, masks in found:
            last[i] = [*(x for x in last.get(i, ()) if j - x[0] < PASSAGE + insert), (j, masks)]
    return False


def holds_passage(document: list[str], item: str, insert: int = INSERT) -> bool:
    """Whether the words of a document hold a passage of an item."""
    own = spaced(item)
    return aligned([(j, _term(w)) for j, w in enumerate(document)], [_term(w) for w, _ in own], [k for _, k in own], insert)


def _broken(parts: list[int]) -> list[int]:
    """For every window, how many of its pairs break at most where REPLACED parts are replaced."""
    runs = [0] * len(parts)  # at the first term of a part, or of PART of its terms, how many they are
    first = 0
    for i in range(len(parts)):
        if i == 0 or parts[i] != parts[i - 1] or i - first == PART:
            first = i
        runs[first] += 1
    return [sum(sorted((min(n, PASSAGE) + 1 for n in runs[max(0, s - PART) : s + PASSAGE]), reverse=True)[:REPLACED]) for s in range(len(parts) - PASSAGE + 1)]


def _pairs(items: list[tuple[list[int], list[int]]], count: dict[int, int]) -> tuple[np.ndarray, ...]:
    """The distinct terms in order; and code, item, position, need and rarity of all pairs of neighbouring words, by code.

    The code is made of the places of both words among the terms. Of the rarest pairs of a window one holds wherever
    there is a passage; need is how many pairs hold at least from the first of a passage on.
    """
    terms = np.unique(np.array([t for item, _ in items for t in item], dtype=np.int64))
    place, rows = {t: k for k, t in enumerate(terms.tolist())}, []
    for k, (item, parts) in enumerate(items):
        n = [count.get(t, 0) for t in item]
        rank = [(min(n[i], n[i + 1]), max(n[i], n[i + 1]), i) for i in range(len(item) - 1)]
        broken, rare = _broken(parts), set()
        for s, lost in enumerate(broken):
            rare.update(sorted(range(s, s + PAIRS), key=rank.__getitem__)[: lost + 1])
        for i in range(len(item) - 1):  # the first pair that holds may be so far behind the window's start
            most = max(broken[max(0, min(i, len(broken) - 1) - REPLACED * (PART + 1)) : i + 1])
            rows.append((place[item[i]] * len(terms) + place[item[i + 1]], k, i, PAIRS - most, i in rare))
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return terms, *(a[:, c].copy() for c in range(5))


def _packed(*columns: np.ndarray) -> np.ndarray | None:
    """The columns, none negative, in one number each; None where they do not fit."""
    out, room = np.zeros(len(columns[0]), dtype=np.int64), 1
    for c in columns:
        size = int(c.max()) + 1
        room *= size
        if room >= 1 << 63:
            return None
        out = out * size + c
    return out


def _met(doc: np.ndarray, pos: np.ndarray, term: np.ndarray, pairs: tuple[np.ndarray, ...], items: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(doc, item) with the spans of positions in which as many pairs of the item lie as a passage holds."""
    terms, codes, of, places, need, rare = pairs
    at = np.searchsorted(terms, term)
    at[at == len(terms)] = 0
    known = terms[at] == term
    doc, pos, at = doc[known], pos[known], at[known]
    distinct, begin, times = np.unique(codes, return_index=True, return_counts=True)
    parts = []
    for ahead in range(1, INSERT + 2):  # the neighbour in the item may stand so many postings further
        if len(pos) <= ahead:
            break
        near = np.flatnonzero((doc[ahead:] == doc[:-ahead]) & (pos[ahead:] - pos[:-ahead] <= INSERT + 1))
        code = at[near] * len(terms) + at[near + ahead]
        slot = np.searchsorted(distinct, code)
        slot[slot == len(distinct)] = 0
        hit = distinct[slot] == code
        near, slot = near[hit], slot[hit]
        n = times[slot]
        each = np.repeat(begin[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(int(n.sum()))
        near = np.repeat(near, n)
        parts.append((doc[near] * items + of[each], pos[near], each))
    if not parts:
        return {}
    group, pos, each = (np.concatenate(x) for x in zip(*parts))
    begun = np.isin(group, np.unique(group[rare[each] == 1]))
    group, pos, each = group[begun], pos[begun], each[begun]
    place, need = places[each], need[each]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for shift in (0, SPAN):
        band = (pos + shift) // (2 * SPAN)
        if not len(group):
            break
        packed = _packed(group, band, place)
        order = np.lexsort((place, band, group)) if packed is None else np.argsort(packed)
        g, b, p = group[order], band[order], place[order]
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])])
        g, b, p, last = g[first], b[first], p[first], np.arange(int(first.sum())) + need[order][first] - 1
        out = last >= len(g)
        last[out] = 0
        near = ~out & (g[last] == g) & (b[last] == b) & (p[last] - p < PAIRS)
        for x, y in sorted(set(zip(g[near].tolist(), b[near].tolist()))):
            start = y * 2 * SPAN - shift
            found.setdefault(divmod(x, items), []).append((start - SPAN, start + 3 * SPAN))
    return found


def positions(documents: DataFrame, vocabulary: dict[str, int] | None) -> DataFrame:
    """doc_id, pos, term: the index, one row per document and form; with a vocabulary its words only."""
    docs = spread(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = (lambda w: vocabulary.get(w, 0)) if vocabulary is not None else _term
        for b in batches:
            out = []
            for d, text in zip(b["doc_id"], b["text"]):
                for found in forms(text):
                    terms = np.fromiter(map(of, found), np.int64, len(found))
                    pos = np.flatnonzero(terms)
                    if len(pos):
                        out.append((d, pos.astype(np.int32), terms[pos]))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "term"])

    return docs.mapInPandas(run, "doc_id long, pos array<int>, term array<long>")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: each document with each item of which it holds a passage.

    documents: doc_id, text; items: item_id, text. A passage is PASSAGE consecutive words of the item in their
    order, REPLACED of them replaced at most (or of what stands between two spaces), with up to INSERT foreign words
    before each. Case, punctuation,
    spacing, line breaks and prefixes, markup and escapes do not matter. Whole texts are read. Null and empty texts
    and items shorter than a passage give no row; an item_id or doc_id that comes again with another text counts
    with all its texts. Empty tables give an empty result; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    held = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [spaced(t) for t in b["text"]]
            yield pd.DataFrame({"item_id": b["item_id"], "words": [[w for w, _ in x] for x in own], "parts": [[k for _, k in x] for x in own]})

    asked = scratch.write(held.mapInPandas(read, "item_id long, words array<string>, parts array<int>").where(F.size("words") >= PASSAGE), "items")
    spoken = asked.select(F.explode("words").alias("word"))
    size, distinct = spoken.agg(F.count("*"), F.count_distinct("word")).first()
    vocabulary = {r.word: _term(r.word) for r in spoken.distinct().collect()} if distinct <= BLOCK else None
    index = scratch.write(positions(documents, vocabulary), "index")
    counts = scratch.write(index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "counts")
    blocks = max(1, -(-size // BLOCK))
    found = []
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()
        ids, terms = [r.item_id for r in block], [([_term(w) for w in r.words], list(r.parts)) for r in block]
        mine = {t for item, _ in terms for t in item}
        known = index.sparkSession.createDataFrame([(t,) for t in mine], "term long")
        pairs = _pairs(terms, {r.term: r.n for r in counts.join(known, "term", "left_semi").collect()})
        found.append(_search(index, ids, terms, pairs))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _search(index: DataFrame, ids: list[int], items: list[tuple[list[int], list[int]]], pairs: tuple[np.ndarray, ...]) -> DataFrame:
    """doc_id, item_id of one block of items."""
    own = [set(x) for x, _ in items]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], b["pos"].map(len).to_numpy(np.int64)
            part = np.cumsum(size) // 500_000  # documents that are looked at together
            for one in np.unique(part):
                rows = np.flatnonzero(part == one)
                pos, term = (np.concatenate([b[c].iloc[r] for r in rows]).astype(np.int64) for c in ("pos", "term"))
                for (r, k), spans in _met(np.repeat(rows, size[rows]), pos, term, pairs, len(items)).items():
                    p, t = b["pos"].iloc[r], b["term"].iloc[r]
                    for low, high in spans:
                        x, y = np.searchsorted(p, [low, high])
                        places = [(i, w) for i, w in zip(p[x:y].tolist(), t[x:y].tolist()) if w in own[k]]
                        if aligned(places, *items[k]):
                            out.append((b["doc_id"].iloc[r], ids[k]))
                            break
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    return index.mapInPandas(run, "doc_id long, item_id long")
