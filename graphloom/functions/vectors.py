"""Cosine similarity as an expression, and an embedder that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double precision; 0 where a vector is all zero, null where one is null."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def embed_texts(texts: list[str], size: int = 64) -> np.ndarray:
    """Hashed counts of character trigrams, of length 1; a text without characters is all zero."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts):
        padded = f" {(text or '').lower()} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            row[h % size] += 1 if h & 1 << 16 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(n == 0, 1, n)).astype(np.float32)


def embedder(embed=embed_texts):
    """A function from a text column to vectors; ``embed`` takes a list of texts and is called once a batch."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(texts.fillna("").tolist())))

    return vectors


_LOADED: dict = {}


def model_embedder(load):
    """The same with a model: ``load()`` gives the function from a list of texts to vectors, and is called once a worker process."""
    name = (load.__module__, load.__qualname__)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _LOADED:
            _LOADED[name] = load()
        for texts in batches:
            yield pd.Series(list(_LOADED[name](texts.fillna("").tolist())))

    return vectors
