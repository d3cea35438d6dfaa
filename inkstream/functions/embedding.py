"""Text embeddings as an Arrow batch function with a pluggable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(size: int = 1024) -> Encoder:
    """An encoder that needs no model: words are counted in ``size`` hashed places and the vector has length 1."""
    places: dict[str, int] = {}

    def place(word: str) -> int:
        at = places.get(word)
        if at is None:
            at = places[word] = int.from_bytes(hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()[:4], "big") % size
        return at

    def encode(texts: list[str]) -> np.ndarray:
        if len(places) > 500_000:
            places.clear()
        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            np.add.at(out[i], [place(w) for w in text.lower().split()] or slice(0, 0), 1)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def embed(text: Column, make: Callable[[], Encoder] = hashed_words) -> Column:
    """Unit vectors of ``text``; ``make`` is called once in each Python worker. Null gives null, a text without words zeros."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in batches:
            some = s.notna().to_numpy()
            out = np.empty(len(s), object)
            for i, v in zip(np.flatnonzero(some), encoder(list(s[some]))):
                out[i] = v
            yield pd.Series(out)

    return run(text)
