"""Vectors for chunks, through any embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..sources.batches import small_batches

#: Fixed value: the vectors' length.
DIMENSION = 768


_WORD = re.compile(r"\w+")


class HashedWords:
    """An offline embedder: signed counts of hashed words, of length 1. A stand-in for a model.

    A word's place is the first eight hex digits of its MD5, as a number, modulo the dimension; the next digit,
    if it is less than 8, makes the sign negative. Each different word is hashed once for as
    long as MOST_WORDS aren't held.
    """

    MOST_WORDS = 200_000

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.known: dict[str, int] = {}

    def _place(self, word: str) -> int:
        """The place, as its complement for a negative sign."""
        own = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
        at = int(own[:8], 16) % self.dimension
        if len(self.known) >= self.MOST_WORDS:
            self.known.clear()
        self.known[word] = at = at if int(own[8], 16) >= 8 else ~at
        return at

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for low in range(0, len(texts), 1000):
            out += self._some(texts[low : low + 1000])
        return out

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        known, place = self.known, self._place
        words = [_WORD.findall(t.lower()) for t in texts]
        at = np.array([known[w] if w in known else place(w) for own in words for w in own], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        flat = np.bincount(row * self.dimension + np.where(at < 0, ~at, at), np.where(at < 0, -1.0, 1.0), len(texts) * self.dimension)
        vectors = flat.reshape(len(texts), self.dimension)
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return list((vectors / np.where(length == 0, 1.0, length)).astype(np.float32))


def embed(chunks: DataFrame, make: Callable[[], Callable[[list[str]], list]] = HashedWords) -> DataFrame:
    """Chunks that aren't blank, with `embedding`.

    make is called once a task, so a client is made where it is used; each Arrow batch is one
    call. A call that returns another number of vectors fails the task.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            vectors = model(batch.tolist()) if len(batch) else []
            if len(vectors) != len(batch):
                raise ValueError(f"{len(batch)} texts gave {len(vectors)} vectors")
            yield pd.Series(vectors, dtype=object)

    small_batches(chunks.sparkSession)
    return chunks.where(~is_blank(F.col("text"))).withColumn("embedding", run.asNondeterministic()("text"))


def embed_question(question: str, make: Callable = HashedWords) -> list[float]:
    return [float(v) for v in make()([question])[0]]
