"""Packing documents into fixed sequences as a cutting-stock problem.

Documents become token ids and an end id; each is cut at multiples of the sequence length, and
the rest of each document is one shorter piece. Lengths are counted in classes of GRAIN
tokens, rounded up. Over that histogram, which is as small for any corpus, column generation
solves the linear program of how often to use each cutting pattern: the simplex basis prices
the lengths, a knapsack by dynamic programming finds the pattern that those prices make most
worth while, and it enters the basis. Pattern counts are rounded down; what that leaves is
packed by best fit. Pieces of a class are ranked over all partitions, and ranges of ranks
belong to the slots of the patterns' copies.

Only the histogram and the patterns reach the driver. Pieces are ranked by their place in the
table of pieces, which is written once: their rank in their partition, plus the count of
their class in earlier partitions.

Cases: a null or empty text is its end id alone; repeated rows are documents of their own; a
null doc_id stays null; a very long text is cut into as many pieces as it takes; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, small_batches, written

CAPACITY = 1024
GRAIN = 4
END = 0
#: Characters of text that are encoded together.
BATCH_CHARS = 2_000_000

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _plain() -> str:
    """A class of the characters that all libraries split alike.

    Those are letters, marks, numbers, punctuation and symbols of the basic plane whose class
    is the same in Unicode 3.2 and now, with the space, tab and line ends.
    """
    old, runs = unicodedata.ucd_3_2_0, [[9, 10], [13, 13], [32, 32]]
    for i in range(33, 0xFFFE):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LMNPS" and old.category(chr(i)) == kind:
            if runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    return "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in runs)


class ByteLevelBPE:
    """The ids that the tokenizers library gives, for many texts at a time.

    No word reaches past a space that follows other than a space. So where no two spaces
    meet, the strings between spaces are encoded on their own: each different string of a
    batch once, all of them in one call, and a text's ids are gathered from theirs. That is
    for texts without rare characters and without the string of an added token; others are left to
    the library itself with its defaults, so the string of a special token is that token's id. It is
    loaded when the first of them comes.
    """

    def __init__(self, path: str):
        self.path = path
        self.plain = re.compile(f"[{_plain()}]*")
        self.ranked = self._ranked(path)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranked(self, path: str):
        """The same vocabulary as ranks, if the file's merges stand in the order of their ids."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.added = whole["model"], [x["content"] for x in whole.get("added_tokens") or []]
        byte_of = _byte_alphabet()
        vocab = {k: v for k, v in model["vocab"].items() if all(c in byte_of for c in k)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocab.get(a + b) for a, b in merges]
        if None in ids or ids != sorted(ids):
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)  # ids that begin with a space
        self.opens[[v for k, v in ranks.items() if k[:1] == b" "]] = True
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> np.ndarray:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and END."""
        fast = [self.ranked is not None and "  " not in t and not any(a in t for a in self.added) and self.plain.fullmatch(t) is not None for t in texts]
        split = pc.split_pattern(pa.array([t for t, f in zip(texts, fast, strict=True) if f], pa.large_string()), " ")
        quick = iter(self._gather(split))
        return [next(quick) if f else np.append(self._one(t), np.uint32(END)) for t, f in zip(texts, fast, strict=True)]

    def _gather(self, split: pa.Array) -> list[np.ndarray]:
        if not len(split):
            return []
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        ids = self.ranked.encode_to_numpy(" " + " ".join(known), disallowed_special=())
        starts = np.flatnonzero(self.opens[ids]).astype(np.int32)
        if len(starts) != len(known):
            raise ValueError("the vocabulary joins strings across a space")
        part = coded.indices.to_numpy(zero_copy_only=False)
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        first = [np.array(self.ranked.encode_ordinary(known[part[i]]), dtype=np.uint32) for i in at[:-1]]  # no space stands before these
        ids = np.concatenate([ids, *first, np.array([END], dtype=np.uint32)])
        start, size = starts[part], np.diff(np.append(starts, np.int32(len(ids) - 1 - sum(map(len, first)))))[part]
        size[at[:-1]] = [len(x) for x in first]
        start[at[:-1]] = len(ids) - 1 - np.cumsum(size[at[:-1]][::-1])[::-1]
        start, size = np.insert(start, at[1:], len(ids) - 1), np.insert(size, at[1:], 1)
        ends = np.cumsum(size)
        out = ids[np.repeat((start - (ends - size)).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)]
        return np.split(out, ends[at[1:-1] + np.arange(len(first) - 1)])


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevelBPE:
    """One for all tasks of a worker process."""
    return ByteLevelBPE(path)


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow 255."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: doc_id travels as a string: pandas holds longs beside nulls as floats, which round large ones.
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        part, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for own in _slices([t or "" for t in batch["text"]]):
                out = []
                for doc_id, ids in zip(batch["doc_id"].iloc[own], encode([t or "" for t in batch["text"].iloc[own]]), strict=True):
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity].tobytes()
                        kind = -(-len(piece) // (4 * grain))
                        out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids), kind, part, met[kind], piece if with_ids else None))
                        met[kind] += 1
                yield _piece_frame(out)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, PIECES)


def _slices(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Runs of texts of about that many characters together, one text at least."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    yield slice(start, len(texts))


def _piece_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits, and how often it takes each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            worth = best[c - sizes[:fit]] + prices[:fit]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], last[c] = worth[i], i
    taken, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            taken[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), taken


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan. The matrices are small, and threads of a linear-algebra library may fight Spark's for the cores."""
    m = len(a)
    w = np.hstack([a.astype(float), np.eye(m)])
    for i in range(m):
        p = i + int(np.abs(w[i:, i]).argmax())
        if p != i:
            w[[i, p]] = w[[p, i]]
        w[i] /= w[i, i]
        by = w[:, i].copy()
        by[i] = 0
        w -= by[:, None] * w[i]
    return w[:, m:]


def cutting_patterns(demand: dict[int, int], capacity: int, rounds: int = 1500) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many pieces of each size) and how often to use each, for all of demand.

    Every basis is a feasible plan, so stopping after `rounds` only costs padding.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), dtype=int)
    if not len(sizes):
        return []
    want = np.array([demand[s] for s in sizes], dtype=float)
    m = len(sizes)
    # filling with the largest sizes left until one is used up, in fractions of sequences, makes
    # a triangular and so regular basis, with a pattern of its own for each size of a tie
    columns, rest = [], want.copy()
    while (rest > 0).any():
        pattern, room = np.zeros(m), capacity
        for i in np.flatnonzero(rest > 0)[::-1]:
            pattern[i], room = room // sizes[i], room % sizes[i]
        times = (rest[pattern > 0] / pattern[pattern > 0]).min()
        gone = np.flatnonzero((pattern > 0) & (rest <= times * pattern * (1 + 1e-12)))
        rest = np.maximum(rest - times * pattern, 0)
        rest[gone] = 0
        columns.append(pattern)
        columns += [np.where(np.arange(m) == i, capacity // sizes[i], 0).astype(float) for i in gone[1:]]
    cost, inverse = np.ones(m), _inverse(np.array(columns).T)
    for k in range(rounds):
        prices = (cost[:, None] * inverse).sum(axis=0)
        low = int(prices.argmin())
        if prices[low] < -1e-9:  # the size is cut too often: a slack column takes its place
            entering, price = -np.eye(m)[low], 0.0
        else:
            worth, entering = knapsack(sizes, prices, capacity)
            price = 1.0
            if worth <= 1 + 1e-7:
                break
        step, have = (inverse * entering).sum(axis=1), (inverse * want).sum(axis=1)
        ratio = np.where(step > 1e-9, np.maximum(have, 0) / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(out := ratio.min()):
            break
        leaving = int(np.flatnonzero(ratio <= out + 1e-12)[np.argmax(step[ratio <= out + 1e-12])])
        columns[leaving], cost[leaving] = entering, price
        if k % 60 == 59:
            inverse = _inverse(np.array(columns).T)
        else:
            row = inverse[leaving] / step[leaving]
            inverse -= step[:, None] * row
            inverse[leaving] = row
    plan, left = [], want.astype(int)
    counts = np.floor(np.maximum((inverse * want).sum(axis=1), 0) + 1e-6).astype(int)
    for i in np.argsort(-counts):
        a = columns[i].astype(int)
        if cost[i] and (used := a > 0).any():
            n = int(min(counts[i], (left[used] // a[used]).min()))
            if n > 0:
                plan.append(({int(sizes[j]): int(a[j]) for j in np.flatnonzero(used)}, n))
                left = left - n * a
    return plan + best_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n > 0}, capacity)


def best_fit(rest: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Each sequence is filled by the largest pieces that still fit; equal fillings are counted together.

    A filling is used as often as the pieces last, so the loop is as long as there are sizes, whatever their numbers.
    """
    rest, plan = dict(rest), []
    while rest:
        room, taken = capacity, {}
        for s in sorted(rest, reverse=True):
            if n := min(rest[s], room // s):
                taken[s] = n
                room -= n * s
        times = min(rest[s] // n for s, n in taken.items())
        plan.append((taken, times))
        rest = {s: left for s, n in rest.items() if (left := n - times * taken.get(s, 0))}
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per size: (first rank, pieces a sequence, first sequence, first slot), by rank."""
    out, met, base = defaultdict(list), Counter(), 0
    for pattern, times in plan:
        slot = 0
        for size, n in sorted(pattern.items(), reverse=True):
            out[size].append((met[size], n, base, slot))
            met[size] += n * times
            slot += n
        base += times
    return dict(out)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """The pieces of (doc_id, text) with sequence_id and offset."""
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    small_batches(docs.sparkSession)
    cut = written(pieces(docs, tokenizer, capacity, grain, with_ids))
    counts = cut.groupBy("class", "part").agg(F.count("*").alias("n"))
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    where = slots(cutting_patterns(demand, capacity // grain))
    tables = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in where.items()}
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("class", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            sequence, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for kind, rows in batch.groupby("class").indices.items():
                first, n, base, place = tables[int(kind)]
                own = np.searchsorted(first, rank[rows], side="right") - 1
                at = rank[rows] - first[own]
                sequence[rows], slot[rows] = base[own] + at // n[own], place[own] + at % n[own]
            yield batch.drop(columns=["class", "rank"]).assign(sequence_id=sequence, slot=slot)

    fields = [x for x in PIECES.split(", ") if x.split()[0] not in ("class", "part", "rank")]
    placed = ranked.select(*[x.split()[0] for x in fields], "class", "rank").mapInPandas(place, ", ".join([*fields, "sequence_id long", "slot long"]))
    upto = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({"doc_id": F.col("doc_id").cast("long"), "offset": F.coalesce(F.sum("length").over(upto), F.lit(0)).cast("long")}).drop("slot")
    return out if with_ids else out.drop("ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
