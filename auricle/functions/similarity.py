"""Ratcliff-Obershelp similarity in Arrow batches, with a cheap bound before it."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "").ratio()


def places(text: str) -> dict[str, int]:
    """Bit set of the places of every letter."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def in_order(where: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence, which no sum of matching blocks exceeds; one step of all places a letter."""
    free = full = (1 << n) - 1
    for c in text:
        used = free & where.get(c, 0)
        free = (free + used | free - used) & full
    return n - free.bit_count()


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, all code points in a row, and the text of each of them."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return size, np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64), np.repeat(np.arange(len(texts)), size)


def parities(n: int, at: np.ndarray, items: np.ndarray, words: int) -> np.ndarray:
    """A row of bits a text: each item flips one of them, so two rows differ in no more bits than the texts in items."""
    mixed = items * np.uint64(0x9E3779B97F4A7C15)
    place = (mixed >> np.uint64(40)) % np.uint64(64 * words)
    out = np.zeros((n, words), np.uint64)
    if len(at):
        starts = np.nonzero(np.diff(at, prepend=-1))[0]
        for w in range(words):
            bits = np.where(place // np.uint64(64) == w, np.uint64(1) << place % np.uint64(64), np.uint64(0))
            out[at[starts], w] = np.bitwise_xor.reduceat(bits, starts)
    return out


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M/T of two texts; the order of the arguments matters. The metric has no built-in form."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def percent_ratio(a: Column, b: Column) -> Column:
    """0 to 100, and 0 where a side is empty."""
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(ratio_udf(a, b) * 100.0)


def bound(a: Column, b: Column) -> Column:
    """No ratio of the two texts can be greater, by their lengths."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def fuzzy_match_score(artist: Column, title: Column, duration_gap_ms: Column) -> Column:
    """0.35 artist, 0.50 title, 0.15 duration in steps; an unknown duration counts half."""
    step = (
        F.when(duration_gap_ms.isNull(), 0.5).when(duration_gap_ms <= 5000, 1.0).when(duration_gap_ms <= 15000, 0.7).when(duration_gap_ms <= 30000, 0.4).otherwise(0.1)
    )
    return artist * 0.35 + title * 0.50 + step * 0.15
