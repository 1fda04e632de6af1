"""Encode a corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern; each distinct piece is
merged with a segment tree over the ranks of adjacent pairs: the root names the
leftmost pair of the lowest rank, and a merge costs three point updates.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; lone surrogates are replaced before
encoding; texts and pieces of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text into pieces (a fixed value that belongs to the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker; the memory is emptied when it is full.
REMEMBER = 200_000
_NONE = 1 << 62


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << max(0, (n - 2).bit_length())
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(parts[i] + parts[i + 1])
        if rank is not None:
            tree[width + i] = rank << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, key: int) -> None:
        k = width + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        parts[i] += parts[j]
        after[i] = k = after[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            rank = ranks.get(parts[i] + parts[k])
            put(i, _NONE if rank is None else rank << 32 | i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            rank = ranks.get(parts[h] + parts[i])
            put(h, _NONE if rank is None else rank << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Cuts and merges texts; remembers the ids of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for piece in self.cut(text):
            got = known.get(piece)
            if got is None:
                if len(known) >= REMEMBER:
                    known.clear()
                got = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 64:
                    known[piece] = got
            out += got
        return out


def spread(df: DataFrame) -> DataFrame:
    """Give work that is bound by CPU at least as many tasks as there are cores."""
    want = df.sparkSession.sparkContext.defaultParallelism * 2
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def _mapper(documents: DataFrame, vocabulary: str, only_count: bool):
    # the vocabulary is a public file of fixed size (under 1 MB), so every worker may hold it
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [encoder.ids(t) for t in batch["text"]]
            keep = batch.drop(columns="text")
            yield keep.assign(n_tokens=[len(x) for x in ids]) if only_count else keep.assign(ids=ids)

    return run


def encode(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""
    docs = spread(documents.select("doc_id", "text"))
    return docs.mapInPandas(_mapper(documents, vocabulary, False), "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""
    docs = spread(documents.select("doc_id", "source", "text"))
    return docs.mapInPandas(_mapper(documents, vocabulary, True), "doc_id long, source string, n_tokens long")


def vocabulary_use(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(token_id, n) over the whole corpus, counted map-side first."""
    return encode(documents, vocabulary).select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
