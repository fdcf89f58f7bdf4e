"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method.  A text is cut into pieces by the tokenizer's pattern.  Within a
piece a segment tree over byte positions stores the leftmost minimum rank of
the pairs of adjacent live parts; a merge takes the root's pair and updates
at most three leaves (the merged pair, its neighbour on each side) in
logarithmic time, so a piece of n bytes costs O(n log n) however long it is.
Pieces that occur again are kept in a bounded per-process cache.

The vocabulary file stays where it is (``folder``); it is read once per
Python worker and never copied.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import map_arrow, spread

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_PAIR = 1 << 30
CACHE_PIECES = 200_000
BATCH_TEXTS = 256


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 2).bit_length())
    tree = [NO_PAIR] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NO_PAIR)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # end[i]: where the live part beginning at i ends
    before = list(range(-1, n))  # before[i]: where the live part ending at i begins

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while (low := tree[1]) != NO_PAIR:
        i = 1
        while i < size:
            i = 2 * i if tree[2 * i] == low else 2 * i + 1
        i -= size
        j = end[i]
        stop = end[j]
        end[i] = stop
        before[stop] = i
        put(j, NO_PAIR) if j < n - 1 else None
        put(i, get(piece[i : end[stop]], NO_PAIR) if stop < n else NO_PAIR)
        if i:
            left = before[i]
            put(left, get(piece[left:stop], NO_PAIR))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class BytePairEncoder:
    """Encodes texts; ids are the ranks of the vocabulary file, without special tokens."""

    def __init__(self, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> None:
        import regex

        with open(f"{folder}/{vocabulary}", "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.pieces = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no tokens."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for m in self.pieces.finditer(text):
            piece = m.group()
            ids = cache.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 64:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> BytePairEncoder:
    return BytePairEncoder(folder, vocabulary)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids (array<int>) of every row, without special tokens.

    Null, and empty texts get an empty list; a string that looks like a
    special token is ordinary text; repeated rows come out repeated; rows with
    a null key come out too; an empty table gives an empty result.
    """
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(at, BATCH_TEXTS)
                ids = [np.array(enc.encode(t), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return map_arrow(spread(documents.select(key, F.col(text).cast("string"))), run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keys: list[str], text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys and n_tokens of every row; the token ids themselves never leave the worker."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(len(keys)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], n], [*keys, "n_tokens"])

    return map_arrow(spread(documents.select(*keys, F.col(text).cast("string").alias("__text"))), run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n_tokens bigint")
