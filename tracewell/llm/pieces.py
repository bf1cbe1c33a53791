"""Splitting oversized texts at natural boundaries by content-defined landmarks.

A rolling hash over the last words marks landmarks; a cut is the best natural boundary near the first landmark
within the minimum and maximum size. As landmarks depend on the words around them alone, an edit moves only the
cuts near it: the next landmark that both versions share brings them together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tokens import Encoder, default_vocabulary
from tracewell.session import spread

#: Classes of boundaries before a word, best first.
HEADING, PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 5, 4, 3, 2, 1, 0
NAMES = {HEADING: "heading", PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", INSIDE: "inside"}

_HEADING = regex.compile(r"(?:#{1,6}\s|={3,}|\d+(?:\.\d+)*\.?\s+\p{Lu}|[\p{Lu}\d][\p{Lu}\d \-]{3,}(?:\n|$))")
#: What a sentence may end with; other words need no pattern.
_ENDS = frozenset(".!?…。！？\"'”’»)]*")
_SENTENCE_END = regex.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s*$")


@dataclass(frozen=True)
class Sizes:
    """limit: tokens of a piece; overlap: tokens that a piece repeats at most; least: tokens before a cut; window: words of the rolling hash; every: mean distance of landmarks in words; reach: tokens around a landmark that are searched for a boundary."""

    limit: int = 1000
    overlap: int = 100
    least: int = 400
    window: int = 8
    every: int = 96
    reach: int = 120

    def __post_init__(self):
        if not 0 <= self.overlap < self.limit or not 0 < self.least <= self.limit - self.overlap or min(self.window, self.every) < 1:
            raise ValueError("sizes do not fit")


def landmarks(hashes: np.ndarray, window: int, every: int) -> np.ndarray:
    """Where the polynomial hash of the last ``window`` words is divisible by ``every``."""
    if len(hashes) < window:
        return np.zeros(len(hashes), dtype=bool)
    h = np.zeros(len(hashes) - window + 1, dtype=np.uint64)
    for k in range(window):
        h = h * np.uint64(1_000_003) + hashes[k : k + len(h)]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return np.r_[np.zeros(window - 1, dtype=bool), h % np.uint64(every) == 0]


def boundaries(words: list[str], text: str, starts: np.ndarray) -> np.ndarray:
    """The class of the boundary before each word. White space belongs to what it follows."""
    out = np.full(len(words), WORD, dtype=np.int8)
    newlines, sentence, solid = 0, False, False
    for i, w in enumerate(words):
        blank = w.isspace()
        if i and not blank:
            own = w.count("\n")
            n = newlines + own
            if n:
                out[i] = PARAGRAPH if n > 1 else LINE
                if _HEADING.match(text, int(starts[i]) + len(w) - len(w.lstrip())):
                    out[i] = HEADING
            elif sentence and (w[0].isspace() or not solid):
                out[i] = SENTENCE
            elif solid and not w[0].isspace():
                out[i] = INSIDE  # within what a reader sees as one word
        elif i and blank:
            out[i] = INSIDE
        if blank:
            newlines += w.count("\n")
            solid = False
        else:
            newlines, solid = 0, True
            sentence = w[-1] in _ENDS and (bool(_SENTENCE_END.search(w)) or sentence and not any(c.isalnum() for c in w))
    return out


def _units(text: str, encoder: Encoder, limit: int) -> tuple[list[str], np.ndarray, bool]:
    """The vocabulary's words with their numbers of tokens; a word over the limit is cut between characters.

    Last, whether the words are whole: then the tokens of a run of words are those of its text.
    """
    words = encoder.pieces(text)
    counts = encoder.counts(words)
    if len(counts) and counts.max() > limit:
        parts: list[str] = []
        for w, n in zip(words, counts):
            step = max(1, limit // 4)  # a character has at most four bytes, so at most four tokens
            parts += [w] if n <= limit else [w[i : i + step] for i in range(0, len(w), step)]
        return parts, encoder.counts(parts), False
    return words, counts, True


def split_text(text: str, encoder: Encoder, sizes: Sizes = Sizes()) -> list[tuple[int, int, int, int, str]]:
    """(start, end, core, n_tokens, boundary) of each piece, in characters.

    Pieces hold at most ``limit`` tokens of their own text; the cores follow each other without gap from the
    start of the text to its end, and a piece begins at most ``overlap`` tokens before its core. A text within
    the limit is one piece, an empty one none. boundary is the class of the cut before the core.
    """
    if not text:
        return []
    core_max = sizes.limit - sizes.overlap
    words, counts, whole = _units(text, encoder, core_max)
    total = int(counts.sum())
    if total <= sizes.limit or not whole:
        size = total if whole else len(encoder.encode_batch([text])[0])
        if size <= sizes.limit:
            return [(0, len(text), 0, size, "start")]
    starts = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    tokens = np.r_[0, np.cumsum(counts)].astype(np.int64)
    kinds = boundaries(words, text, starts)
    marks = landmarks(np.array([crc32(w.strip().encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64), sizes.window, sizes.every)

    def tokens_of(begin: int, end: int) -> int:
        """Tokens of the text of words[begin:end]."""
        if not whole:
            return len(encoder.encode_batch([text[starts[begin] : starts[end]]])[0])
        last = end
        while last > begin and words[last - 1].isspace():
            last -= 1
        # white space at the end of a text is one word, in its middle it may have been two
        tail = int(encoder.counts([text[starts[last] : starts[end]]])[0]) if end - last > 1 else int(tokens[end] - tokens[last])
        return int(tokens[last] - tokens[begin]) + tail

    n, cuts, at = len(words), [0], 0
    while tokens[n] - tokens[at] > core_max:
        low = int(np.searchsorted(tokens, tokens[at] + sizes.least, "left"))
        high = int(np.searchsorted(tokens, tokens[at] + core_max, "right")) - 1  # a cut before word high still fits
        low = min(max(low, at + 1), high)
        found = np.flatnonzero(marks[low:high])
        if len(found):
            mark = low + int(found[0])
            a = max(low, int(np.searchsorted(tokens, tokens[mark] - sizes.reach, "left")))
            b = min(high, int(np.searchsorted(tokens, tokens[mark] + sizes.reach, "right")) - 1)
            best = kinds[a : b + 1].max()
            if best < SENTENCE:  # no boundary near the landmark: the best of the whole range
                a, b, best = low, high, kinds[low : high + 1].max()
            near = a + np.flatnonzero(kinds[a : b + 1] == best)
            cut = int(near[np.argmin(np.abs(tokens[near] - tokens[mark]))])
        else:
            best = kinds[low : high + 1].max()
            cut = int(low + np.flatnonzero(kinds[low : high + 1] == best)[-1])
        cuts.append(cut)
        at = cut
    out = []
    for k, cut in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else n
        begin = cut
        if k and sizes.overlap:
            first = int(np.searchsorted(tokens, tokens[cut] - sizes.overlap, "left"))
            first = max(first, cuts[k - 1])
            if first < cut:
                best = kinds[first:cut].max()
                begin = int(first + np.flatnonzero(kinds[first:cut] == best)[0])
        while True:
            size = tokens_of(begin, end)
            if size <= sizes.limit or begin >= cut:
                break
            begin = min(cut, begin + max(1, (cut - begin) // 2))
        out.append((int(starts[begin]), int(starts[end]), int(starts[cut]), int(size), "start" if not k else NAMES[int(kinds[cut])]))
    return out


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def pieces(documents: DataFrame, sizes: Sizes = Sizes(), vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece_no, char_start, char_end, core_start, n_tokens, boundary, text: the pieces of oversized texts.

    documents: doc_id (unique), text. Only texts over the limit have rows; piece_no counts from 0. The text of a
    piece is that of the document from char_start to char_end (code points); char_start of a piece is at most
    the char_end of the one before, so together they cover the text. Null and empty texts give no row.
    """
    encoder = Encoder.load(vocabulary or default_vocabulary())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"]):
                if len(t.encode("utf-8", "surrogatepass")) <= sizes.limit:  # a token has at least one byte
                    continue
                found = split_text(t, encoder, sizes)
                if len(found) > 1:
                    out += [(d, k, a, e, c, n, kind, t[a:e]) for k, (a, e, c, n, kind) in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "piece_no", "char_start", "char_end", "core_start", "n_tokens", "boundary", "text"])

    return _texts(documents).mapInPandas(run, "doc_id long, piece_no int, char_start long, char_end long, core_start long, n_tokens int, boundary string, text string")


def oversized(documents: DataFrame, sizes: Sizes = Sizes(), vocabulary: str | None = None) -> DataFrame:
    """doc_id of the texts that are split: the documents of ``pieces``."""
    return pieces(documents, sizes, vocabulary).where("piece_no = 0").select("doc_id")
