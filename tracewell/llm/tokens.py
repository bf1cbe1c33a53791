"""Encoding with a public byte-level BPE vocabulary, by batched merge rounds over one flat array."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import spread


#: How the vocabulary splits text before its merges (a fixed value of the published vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int32).max
#: Words kept with their ids between batches.
CACHE = 200_000


def default_vocabulary() -> str:
    """Where byte_bpe_50k.json lies; the environment may name another place."""
    folder = os.environ.get("TRACEWELL_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A vocabulary as arrays: sorted pair keys with rank and merged id, and the id of each byte.

    About one megabyte whatever the corpus, so it travels to the tasks as it is.
    """

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.byte_ids, self.keys, self.ranks, self.merged = byte_ids, keys, ranks, merged
        self.cache: dict[str, np.ndarray] = {}
        self.split = regex.compile(PATTERN)

    def __getstate__(self):
        return self.byte_ids, self.keys, self.ranks, self.merged

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> Encoder:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        byte_ids = np.zeros(256, dtype=np.int32)
        for char, b in _byte_symbols().items():
            byte_ids[b] = vocab[char]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        return Encoder(byte_ids, keys[order], order.astype(np.int32), merged[order])

    def _ranks(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the rank of the pair that begins there, and where it stands among the keys."""
        key = sym[:-1].astype(np.int64) << 20 | sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], _NONE)
        return rank, at

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by rounds in which every word merges all places of its lowest-ranked pair."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[np.ndarray | None] = [None] * len(words)
        while len(sym):
            if len(sym) > 1:
                rank, at = self._ranks(sym, owner)
                rank, at = np.append(rank, _NONE), np.append(at, 0)
            else:
                rank, at = np.array([_NONE]), np.array([0])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, starts)
            still = low < _NONE
            counts = np.diff(np.r_[starts, len(sym)])
            if not still.all():  # finished words leave the array
                for s, n in zip(starts[~still].tolist(), counts[~still].tolist()):
                    done[owner[s]] = sym[s : s + n]
                keep = np.repeat(still, counts)
                sym, owner, rank, at = sym[keep], owner[keep], rank[keep], at[keep]
                low, counts = low[still], counts[still]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, counts)
            places = np.flatnonzero(hit)
            # of places that overlap, as in a run of one symbol, every second one merges, from the left
            new_run = np.r_[True, places[1:] != places[:-1] + 1]
            first = places[new_run]
            offset = places - np.repeat(first, np.diff(np.r_[np.flatnonzero(new_run), len(places)]))
            places = places[offset % 2 == 0]
            sym = sym.copy()
            sym[places] = self.merged[at[places]]
            gone = np.ones(len(sym), dtype=bool)
            gone[places + 1] = False
            sym, owner = sym[gone], owner[gone]
        empty = np.zeros(0, dtype=np.int32)
        return [d if d is not None else empty for d in done]

    def learn(self, words: set[str]) -> None:
        """Ids of words that are not known yet; blocks bound the memory."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(words)
        block, held = [], 0
        for w in [*new, None]:
            if w is not None:
                block.append(w)
                held += len(w)
            if block and (w is None or held > 1_000_000):
                for x, ids in zip(block, self.encode_words([x.encode("utf-8", "surrogatepass") for x in block])):
                    self.cache[x] = ids
                block, held = [], 0

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 256):
            split = [self.pieces(t) for t in texts[i : i + 256]]
            self.learn({w for ws in split for w in ws})
            out += [np.concatenate([self.cache[w] for w in ws]) if ws else np.zeros(0, dtype=np.int32) for ws in split]
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        self.learn(set(words))
        return np.array([len(self.cache[w]) for w in words], dtype=np.int64)


def encoded(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of each text, without special tokens.

    documents: doc_id (unique), text. What looks like a special token is ordinary text. An empty and a null text
    give an empty list. Whole texts are encoded; a repeated doc_id gives a row each time. The vocabulary is the
    path of a byte-level BPE file with merges, read once by the driver. Nothing is shuffled.
    """
    encoder = Encoder.load(vocabulary or default_vocabulary())
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": encoder.encode_batch(part["text"].tolist())})

    return rows.mapInPandas(run, "doc_id long, ids array<int>")
