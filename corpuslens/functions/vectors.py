"""Vectors as arrays: dot products, norms, and the stand-in encoder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import release

DIMENSIONS, MOST_TOKENS = 64, 512
_TOKEN = re.compile(r"\w+")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def bag_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each text: counts of its first tokens by hash, of length 1 (zeros without tokens)."""
    words = [_TOKEN.findall((t or "").lower())[:MOST_TOKENS] for t in texts]
    place = {w: crc32(w.encode()) % dimensions for w in set(chain.from_iterable(words))}
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), np.int64, len(texts)))
    at = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64, len(row))
    out = np.bincount(row * dimensions + at, minlength=len(texts) * dimensions).reshape(len(texts), dimensions).astype(np.float64)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Deterministic stand-in for a sentence encoder, in Arrow batches."""
    for texts in batches:
        yield pd.Series(list(bag_vectors(texts.tolist())))
    release()
