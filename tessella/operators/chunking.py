"""Units of text into overlapping chunks."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.batches import small_batches
from .sentences import Boundaries, told

#: Tokens of a chunk, and of it those shared with the chunk before.
CHUNK_SIZE = 550
CHUNK_OVERLAP = 100


def window_chunks(units: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """Word windows, in SQL functions alone: units with chunk_idx, n_chunks and the chunk as text.

    A window starts size - overlap words after the one before; the last is the first that
    reaches the end. A unit without words has no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    split = units.withColumn("_words", words).where(F.size("_words") > 0)
    last = F.ceil(F.greatest(F.size("_words") - size, F.lit(0)) / step).cast("int")
    placed = split.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"), (last + 1).alias("n_chunks"))
    chunk = F.array_join(F.slice("_words", F.col("chunk_idx") * step + 1, F.lit(size)), " ")
    return placed.withColumn(text, chunk).drop("_words")


_SENTENCE = re.compile(r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]")


def count_words(text: str) -> int:
    """The default token count: words and single marks. A tokenizer's count can stand in."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def split_text(text: str, size: int, count: Callable[[str], int], ends: Callable[[str], list[int]] | None = None) -> list[str]:
    """Parts of at most size tokens: by paragraph, sentence, clause, word, and at last character. ends: where sentences end, if not at every stop."""
    if count(text) <= size:
        return [text]
    for cut in (
        lambda t: [x for x in _PARAGRAPH.split(t) if x],
        lambda t: [x for x in _STOP.split(t) if x] if ends is None else [t[a:b] for a, b in zip([0, *ends(t)], [*ends(t), len(t)], strict=True) if b > a],
        _SENTENCE.findall,
        _SPACED.findall,
        list,
    ):
        parts = cut(text)
        if len(parts) > 1:
            return [y for x in parts for y in split_text(x, size, count, ends)]
    return [text]


_PARAGRAPH = re.compile(r"(?<=\n\n\n)")
_STOP = re.compile(r"(?<=[.!?。？！])(?=\s)")
_SPACED = re.compile(r"\S+\s*|\s+")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 for white space, 1 for a mark, 2 for a letter or digit, as count_words has them, by code point."""
    out = np.ones(sys.maxunicode + 1, dtype=np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum() or c == "_":
            out[i] = 2
        elif c.isspace():
            out[i] = 0
    return out


class _Counted:
    """count_words of any part of a text in constant time, after one pass over it."""

    def __init__(self, text: str):
        kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        self.inside = kind == 2
        opens = self.inside.copy()
        opens[1:] &= ~self.inside[:-1]
        self.counted = opens | (kind == 1)
        self.total = int(np.count_nonzero(self.counted))

    @cached_property
    def before(self) -> list[int]:
        return np.concatenate([[0], np.cumsum(self.counted)]).tolist()

    def __call__(self, a: int, b: int) -> int:
        """Tokens of text[a:b]; a word that is cut at a counts here too."""
        return self.before[b] - self.before[a] + (1 if 0 < a < b and self.inside[a] and self.inside[a - 1] else 0)


def _cuts(text: str, a: int, b: int, level: int, ends: Callable[[str], list[int]] | None = None) -> list[int]:
    """Where split_text() cuts text[a:b] at a level, a and b included."""
    if level < 2:
        part = text[a:b]  # a part of its own, as the patterns look around
        if level and ends:
            return [a, *(a + e for e in ends(part) if 0 < e < b - a), b]
        return [a, *(a + m.start() for m in (_PARAGRAPH, _STOP)[level].finditer(part) if 0 < m.start() < b - a), b]
    if level < 4:
        return [a, *(m.end() for m in (_SENTENCE, _SPACED)[level - 2].finditer(text, a, b))]
    return list(range(a, b + 1))


def _counted_parts(text: str, size: int, ends: Callable[[str], list[int]] | None = None) -> Iterator[tuple[str, int]]:
    """The parts of split_text() with their counts, for count_words."""
    count = _Counted(text)
    if count.total <= size:
        yield text, count.total
        return

    def parts(a: int, b: int) -> Iterator[tuple[str, int]]:
        if (n := count(a, b)) > size:
            for level in range(5):
                if len(at := _cuts(text, a, b, level, ends)) > 2:
                    for x, y in zip(at, at[1:], strict=False):
                        yield from parts(x, y)
                    return
        yield text[a:b], n

    yield from parts(0, len(text))


def sentence_chunks(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, count: Callable[[str], int] = count_words, ends: Callable[[str], list[int]] | None = None) -> list[str]:
    """Parts merged greedily up to size; each chunk begins with the last parts of the one before, up to overlap tokens."""
    chunks, held, total, fresh = [], [], 0, False
    counted = _counted_parts(text, size, ends) if count is count_words and text else ((p, count(p)) for p in split_text(text, size, count, ends))
    for part, n in counted:
        if held and total + n > size and fresh:
            chunks.append("".join(p for p, _ in held).strip())
            tail, kept = [], 0
            for p, k in reversed(held):
                if kept + k > overlap or kept + k + n > size:
                    break
                tail.append((p, k))
                kept += k
            held, total, fresh = tail[::-1], kept, False
        held.append((part, n))
        total += n
        fresh = True
    if fresh:
        chunks.append("".join(p for p, _ in held).strip())
    return [c for c in chunks if c]


def sentence_chunk_rows(units: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, count: Callable[[str], int] = count_words, text: str = "text", model: Boundaries | None = None) -> DataFrame:
    """units with chunk_idx, n_chunks and the chunk as text; one Arrow-batched pass. model: learned ends of sentences, instead of every stop."""
    whole, model = told(units, model, text) if model else (units, None)
    sent = units.sparkSession.sparkContext.broadcast(model) if model else None
    small_batches(units.sparkSession)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: sentence_chunks(t or "", size, overlap, count))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut_learned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, known in batches:
            yield pd.Series([sentence_chunks(t or "", size, overlap, count, sent.value.told(k).ends) for t, k in zip(texts, known, strict=True)], dtype=object)

    # nondeterministic, else the filter that Spark infers for the explode cuts a second time
    chunks: Column = cut_learned.asNondeterministic()(F.col(text), F.col("_told")) if model else cut.asNondeterministic()(F.col(text))
    whole = whole.withColumn("_chunks", chunks).withColumn("n_chunks", F.size("_chunks"))
    own = [c for c in units.columns if c not in (text, "chunk_idx", "n_chunks")]  # neither the text nor the array goes along with each chunk
    return whole.select(*own, F.posexplode("_chunks").alias("chunk_idx", text), "n_chunks")
