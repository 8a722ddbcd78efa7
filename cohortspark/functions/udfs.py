"""Arrow functions where no built-in expression exists; models are made once a worker."""

from __future__ import annotations

import difflib
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def ratio(query: pd.Series, target: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio, the query first: it is not symmetric."""
    memo: dict[tuple[str, str], float] = {}

    def one(q: str | None, t: str | None) -> float | None:
        if q is None or t is None:
            return None
        if (q, t) not in memo:
            memo[q, t] = difflib.SequenceMatcher(None, q, t).ratio()
        return memo[q, t]

    return pd.Series([one(q, t) for q, t in zip(query, target, strict=True)], dtype="float64")


@functools.cache
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(1).standard_normal((4096, size)).astype(np.float32)


def hashed_ngrams(text: str, size: int) -> np.ndarray:
    """A stand-in for a sentence encoder: hashed character trigrams, projected and scaled to length 1."""
    padded = f"  {text.lower()} "
    slots = [zlib.crc32(padded[i : i + 3].encode()) % 4096 for i in range(len(padded) - 2)]
    vector = _directions(size)[slots].sum(axis=0)
    length = float(np.linalg.norm(vector))
    return vector / length if length else vector


def default_encoder():
    return hashed_ngrams


@functools.cache
def _loaded(load):
    return load()


def embedder(size: int = 64, encode=hashed_ngrams, load=None):
    """A column function from text to a unit vector by ``encode(text, size)``.

    ``load()`` may give that function instead: it is called when the first text
    comes, once a worker process, so that a model is not sent with the tasks.
    It must be a function of an importable module to be known as the same one.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            model = _loaded(load) if load else encode
            yield part.map(lambda x: model(x, size).tolist(), na_action="ignore")

    return embed


def embedding(given: Column, term: Column, size: int = 64) -> Column:
    """The vector given, or else the term's."""
    return F.coalesce(given, embedder(size)(F.when(given.isNull(), term)))
