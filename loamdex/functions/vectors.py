"""Vector functions over array columns, and the offline embedder."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; a zero vector on the left has norm 1e-9, one on the right gives null."""
    left = F.sqrt(dot(a, a))
    right = F.sqrt(dot(b, b))
    return dot(a, b) / (F.when(left == 0, 1e-9).otherwise(left) * F.nullif(right, F.lit(0.0)))


@lru_cache(maxsize=100_000)
def _word_slots(word: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a word and its character trigrams are added, and with which sign."""
    grams = (word, *(f"#{word}#"[i : i + 3] for i in range(len(word))))
    h = np.array([int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for g in grams], np.uint64)
    return (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def embed_text(text: str | None, dim: int) -> np.ndarray:
    """Unit vector of hashed words and character trigrams; no model file is needed. Empty text is the zero vector.

    A word is hashed once and remembered; a text is one weighted count over the slots of its words.
    """
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return np.zeros(dim, np.float32)
    at, sign = zip(*(_word_slots(w, dim) for w in words))
    v = np.bincount(np.concatenate(at), np.concatenate(sign), dim).astype(np.float32)
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embedder(dim: int = 64):
    """Column function from text to array<float>. Any function of this shape can stand in for it."""

    @F.pandas_udf("array<float>")
    def embed(c: pd.Series) -> pd.Series:
        return pd.Series([embed_text(t, dim) for t in c])

    return embed
