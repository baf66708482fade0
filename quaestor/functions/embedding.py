"""Pluggable models as Arrow UDFs, and a deterministic stand-in embedder."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor.functions.text import bind, words
from quaestor.functions.vectors import l2_normalize

Embedder = Callable[[Sequence[str]], np.ndarray]


def embed_udf(provider: Callable[[], Embedder]) -> Callable[[str], Column]:
    """Text column to vector column; `provider` builds the model once per task.

    A null text has no vector.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for texts in batches:
            given = texts.notna()
            result = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if given.any():
                vectors = np.asarray(model(texts[given].tolist()), dtype=np.float32)
                result[given] = pd.Series(list(vectors), index=texts.index[given])
            yield result

    return embed


def text_model_udf(provider: Callable[[], Callable[[str], str]]) -> Callable[[str], Column]:
    """Prompt column to answer column through a pluggable text model."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for prompts in batches:
            yield prompts.map(lambda p: None if p is None else model(p))

    return answer


def hashed_words(text: Column, dim: int) -> Column:
    """`HashEmbedder` as a Spark expression: no Python in the plan."""
    place = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim
    every = F.sequence(F.lit(0), F.lit(dim - 1))

    def counted(places: Column) -> Column:
        return F.transform(every, lambda p: F.size(F.filter(places, lambda x: x == p)).cast("double"))

    counts = bind(F.transform(words(F.lower(text)), place), counted)
    return bind(counts, lambda c: F.coalesce(l2_normalize(c), c)).cast("array<float>")


class HashEmbedder:
    """Unit vector of word counts hashed into `dim` places; for tests and demos."""

    def __init__(self, dim: int = 16) -> None:
        self.dim = dim
        self._place = lru_cache(maxsize=1 << 16)(self._hash)

    def _hash(self, word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        vectors = np.zeros((len(texts), self.dim))
        for row, text in zip(vectors, texts):
            for word, count in Counter(text.lower().split()).items():
                row[self._place(word)] += count
        norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        return np.divide(vectors, norms, out=vectors, where=norms > 0).astype(np.float32)
