"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

The library gets a text of more than SLICE characters in slices that begin where a match of its
pattern begins whatever the slice is: at white space after other characters. A run of RUN or
more white-space characters, on which the library's regex engine runs out of stack, is merged
as the one match that it is, all of it at the end of a text and all but its last character
elsewhere. So the ids are those of the whole text. Decoding takes the bytes of each id from a
table, an Arrow batch at a time, and never goes through text.

Cases: a null text gives no ids (an empty array), as an empty one does; null ids stay null; an id
that the ranks don't have fails; texts of any length are encoded whole, in time linear in them but
for single matches of many characters, whose merges take n log n; repeated rows are encoded alike;
other columns pass through, but for one named like the output, which is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: Characters of a text that the library gets at once, and of white space that are merged as one match.
SLICE, RUN = 1 << 16, 1 << 12

#: Fixed value: the characters of the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WHITE}]{{{RUN},}}")
_SAFE = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")


def slices(text: str, most: int = SLICE) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match) of text, in order."""
    start = 0
    while start < len(text):
        run = _RUN.search(text, start)
        stop = run.start() if run else len(text)
        while start < stop:
            safe = _SAFE.search(text, start + most, stop) if stop - start > most else None
            end = safe.start() if safe else stop
            yield text[start:end], False
            start = end
        if run:
            start = run.end() - (run.end() < len(text))
            yield text[run.start() : start], True  # what is left of it goes with what follows


class Ranks:
    """The library's encoder of a rank file (a base64 token and its id a line), without special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.tokens = pa.array(table, pa.large_binary())

    def encode(self, text: str) -> np.ndarray:
        parts = [self.encoding._encode_single_piece(part) if one else self.encoding.encode_to_numpy(part, disallowed_special=()) for part, one in slices(text)]
        return np.concatenate([np.asarray(p, dtype=np.int32) for p in parts]) if parts else np.zeros(0, dtype=np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = ids.flatten()
        low, high = pc.min_max(flat).values() if len(flat) else (pa.scalar(0), pa.scalar(0))
        if flat.null_count or low.as_py() < 0 or high.as_py() >= len(self.tokens) or (found := self.tokens.take(flat)).null_count:
            raise ValueError("an id that the ranks don't have")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, dtype=np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at[ends].tobytes()), found.buffers()[2]])
        gone = ids.is_null()
        return pc.if_else(gone, pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())


@lru_cache(maxsize=2)
def ranks_of(path: str, pattern: str) -> Ranks:
    """One for all tasks of a worker process."""
    return Ranks(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with out: array<int>, the ids of text."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = ranks_of(path, pattern)
        for texts in batches:
            own = [ranks.encode(t) if t else np.zeros(0, dtype=np.int32) for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *own])))

    return docs.withColumn(out, run(F.col(text)))


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with out: binary, the bytes of ids."""
    small_batches(coded.sparkSession)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = ranks_of(path, pattern)
        for lists in batches:
            yield ranks.decode(lists)

    return coded.withColumn(out, run(F.col(ids)))


def default_ranks() -> tuple[str, str]:
    """The path and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), *default_ranks()), *default_ranks())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
