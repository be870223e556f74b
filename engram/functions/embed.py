"""Embedders: vectors for texts."""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(ABC):
    @abstractmethod
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


class HashingEmbedder(Embedder):
    """Words hashed into signed buckets, of length 1: needs no model and is the same everywhere. Texts that share no word are
    near to orthogonal; one without words is all zeros."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in "".join(c if c.isalnum() else " " for c in t.lower()).split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h // 2 % self.dims] += 1.0 if h % 2 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def _singly(own: Embedder, texts: list[str]) -> list[list[float] | None]:
    out: list[list[float] | None] = []
    for t in texts:
        try:
            out.append(own.embed(t))
        except Exception:  # whatever a model raises
            out.append(None)
    return out


def embed_column(text: Column, make: Callable[[], Embedder], singly: bool = False) -> Column:
    """array<float> of each text, by Arrow batches; ``make`` builds the embedder once a worker's run of batches. Null stays
    null. ``singly``: one text at a time, null for those at which the embedder fails."""

    def run(batches):
        own = make()
        for texts in batches:
            some = [t for t in texts if t is not None]
            found = iter(_singly(own, some) if singly else own.embed_batch(some) if some else [])
            yield pd.Series([None if t is None else next(found) for t in texts])

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)
