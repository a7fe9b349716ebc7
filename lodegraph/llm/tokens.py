"""Encoding of whole texts with a public byte-level BPE, as a monoid tree reduction.

A text is halved recursively down to leaves, each leaf is encoded on its own, and neighbours are
joined by re-encoding a window around their seam. The window grows on either side until it starts
(ends) at a place where the encoding provably can't depend on what lies beyond: between a
non-blank character and a blank. No pre-token of the vocabulary's pattern holds a non-blank
followed by a blank, and none looks back, so tokens outside the window are those of the whole
text. Decoding concatenates byte strings up the same tree.

Defined results: the empty text and a null text both give an empty list; blanks are encoded as
they stand; special-token strings are ordinary text; every input row gives one row. Ids are those
of the ranks file; nothing is added at the ends.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Characters a leaf may hold, and the first window on either side of a seam.
LEAF_CHARS = 8192
WINDOW_CHARS = 64
#: The pre-token pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TreeEncoder:
    def __init__(self, encoding, leaf_chars: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        self.encoding, self.leaf_chars, self.window = encoding, leaf_chars, window

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf_chars:
            return self.encoding.encode_ordinary(text)
        return self._node(text, 0, len(text))

    def _node(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf_chars:
            return self.encoding.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._node(text, a, mid), self._node(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        lo, hi = _stable_before(text, a, mid, self.window), _stable_after(text, mid, b, self.window)
        seam = self.encoding.encode_ordinary(text[lo:hi])
        drop_left = len(self.encoding.encode_ordinary(text[lo:mid]))
        drop_right = len(self.encoding.encode_ordinary(text[mid:hi]))
        return left[: len(left) - drop_left] + seam + right[drop_right:]

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids).decode("utf-8", errors="replace")

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(self.encoding.decode_tokens_bytes(ids))
        mid = len(ids) // 2
        return self._bytes(ids[:mid]) + self._bytes(ids[mid:])


def _cut_at(text: str, i: int) -> bool:
    """Pre-tokens end before i whatever surrounds the text: a non-blank, then a blank."""
    return text[i] in " \n\t\r" and not text[i - 1].isspace()


def _stable_before(text: str, a: int, mid: int, window: int) -> int:
    """The last such place within a growing window before ``mid``, else ``a``."""
    i = mid - 1
    while i > a:
        low = max(a, mid - window)
        while i > low:
            if _cut_at(text, i):
                return i
            i -= 1
        window *= 2
    return a


def _stable_after(text: str, mid: int, b: int, window: int) -> int:
    i = mid + 1
    while i < b:
        high = min(b, mid + window)
        while i < high:
            if _cut_at(text, i):
                return i
            i += 1
        window *= 2
    return b


@lru_cache(maxsize=4)
def load(directory: str = TOKENIZERS, name: str = NAME) -> TreeEncoder:
    import tiktoken

    with open(f"{directory}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeEncoder(tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))


def token_ids(texts: DataFrame, id_col: str, text_col: str, directory: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, ids): the token ids of each text; see the module for nulls and empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(directory, name)
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            out = []
            for t in pdf["text"]:
                if not t:
                    out.append([])
                    continue
                ids = seen.get(t)
                if ids is None:
                    ids = seen[t] = enc.encode(t)
                out.append(np.array(ids, dtype=np.int32))
            yield pd.DataFrame({id_col: pdf["id"], "ids": out})

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {kind}, ids array<int>")


def token_counts(texts: DataFrame, id_col: str, text_col: str, directory: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, n_tokens) with the same encoder; only the counts leave the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(directory, name)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["id"], "n_tokens": [len(enc.encode(t)) for t in pdf["text"]]})

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {kind}, n_tokens long")
