"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask takes from a stretch of words; words at its
other places may differ. Wherever two of SPAN words in a row differ, some mask fits between
them, so no overlap is without a seed. Seeds of the test items and of the documents are joined.
A hit lays an item along a document; the overlap counts if somewhere in it WINDOW words in a row
agree but for at most SUBSTITUTIONS. Of a run of hits along one line only the first is
verified, as all lie on the same overlap.

The test side is a stated query set. It is cut into segments of bounded length and dealt into
blocks of bounded size; each block is broadcast, and more blocks mean more passes over the
documents, which are never shuffled. What is shuffled are verified hits. Beyond MOST_BLOCKS, one
pass gives the documents' seeds, which are shuffled to those of all items; only then are the texts
that were hit fetched, once for all their copies.

Items of fewer than SPAN words, down to SHORT, count where all their words stand in a row.

Words are runs of letters and digits in lower case. Cases: null texts and items of fewer
than SHORT words have no hits, as such few words say nothing; equal rows of documents give one row
a pair, and so do different texts under equal keys; several
overlaps of a pair give the one with most words, then the first; an empty side gives no rows;
other columns pass as `keys` name them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_ROWS, let, read, without, written

#: Fixed masks: 1 takes the word, 0 ignores it. Of SPAN words, any SUBSTITUTIONS leave one of them whole at some place.
MASKS = ("1101111", "111100011", "1100011011")
SPAN = 11
WINDOW = 13
SUBSTITUTIONS = 2
#: Least words of an item.
SHORT = 5
#: Bounds: words of a segment of an item, and segments of a block (their seeds fit in some 100 MB).
SEGMENT = 128
BLOCK_SEGMENTS = 8192
#: Passes over the documents before their seeds are shuffled instead.
MOST_BLOCKS = 8

_LEAST = min(map(len, MASKS))
_OFFSETS = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, mask: int) -> Column:
    """Null where the mask reaches beyond the words."""
    return F.when(at + len(MASKS[mask]) <= F.size(hashes), F.xxhash64(F.lit(mask), *[F.get(hashes, at + o) for o in _OFFSETS[mask]]))


def _seeds(hashes: Column, at: Column) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("mask"), _seed(hashes, at, m).alias("seed")) for m in range(len(MASKS))])


def _before(hashes: Column, at: Column) -> Column:
    """The seed one word earlier, by mask; null at the start."""
    value = F.when(at > 0, _seed(hashes, at - 1, 0))
    for m in range(1, len(MASKS)):
        value = F.when(F.col("mask") == m, F.when(at > 0, _seed(hashes, at - 1, m))).otherwise(value)
    return value


def segments(items: DataFrame) -> DataFrame:
    """(segment, item_id, item_words, item_hashes, first): overlapping runs of an item's words."""
    step = SEGMENT - WINDOW + 1
    hashed = items.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") >= SPAN).distinct()
    cut = hashed.select("item_id", F.size("h").alias("item_words"), F.col("h"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0)), F.lit(step))).alias("first"))
    return cut.select(F.xxhash64("item_id", "h", "first").alias("segment"), "item_id", "item_words", F.slice("h", F.col("first") + 1, SEGMENT).alias("item_hashes"), "first").where(F.size("item_hashes") >= SPAN)


def _agreement(doc: Column, item: Column, diagonal: Column) -> Column:
    """1 or 0 for each word of the item, as the document agrees where it lies."""
    return F.transform(item, lambda x, j: F.when(F.when(diagonal + j >= 0, F.get(doc, diagonal + j)).eqNullSafe(x), 1).otherwise(0))


def _close(agree: Column) -> Column:
    n = F.least(F.size(agree), F.lit(WINDOW))
    whole = lambda m: F.exists(F.sequence(F.lit(1), F.size(m) - n + 1), lambda i: F.aggregate(F.slice(m, i, n), F.lit(0), lambda a, x: a + x) >= n - SUBSTITUTIONS)
    return whole(agree)


def _verified(laid: DataFrame, keys: list[str]) -> DataFrame:
    """The overlaps among laid (keys, h, item_hashes, item_id, item_words, at, item_at, first)."""
    found = laid.withColumn("diagonal", F.col("at") - F.col("item_at"))
    found = found.withColumn("matched", let(_agreement(F.col("h"), F.col("item_hashes"), F.col("diagonal")), lambda m: F.when(_close(m), F.aggregate(m, F.lit(0), lambda a, x: a + x))))
    return found.where(F.col("matched").isNotNull()).select(*keys, "item_id", "item_words", "matched", (F.col("diagonal") - F.col("first")).alias("start"))


def _seeds_of(parts: DataFrame) -> DataFrame:
    placed = parts.select("segment", "item_hashes", F.explode(F.sequence(F.lit(0), F.size("item_hashes") - _LEAST)).alias("item_at"))
    seeds = placed.select("segment", "item_hashes", "item_at", F.inline(_seeds(F.col("item_hashes"), F.col("item_at"))))
    return seeds.select("segment", "item_at", "mask", "seed", _before(F.col("item_hashes"), F.col("item_at")).alias("item_before")).where("seed is not null")


def _in_blocks(own: DataFrame, parts: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    out = None
    for block in range(blocks):
        part = parts if blocks == 1 else parts.where(F.pmod("segment", F.lit(blocks)) == block)
        hits = own.join(F.broadcast(_seeds_of(part)), ["mask", "seed"])
        first = hits.where(F.col("item_before").isNull() | ~F.col("item_before").eqNullSafe(_before(F.col("h"), F.col("at"))))
        found = _verified(first.join(F.broadcast(part), "segment"), keys)
        out = found if out is None else out.unionByName(found)
    return out


#: Longs of the filter of item seeds, which all tasks know: some 30 MB with 67 million bits, however many the items are.
FILTER_SLOTS = 1 << 20


def _place(seeds: DataFrame, slots: int) -> DataFrame:
    """seeds with the slot and the bit of the filter that theirs is."""
    own = F.xxhash64("mask", "seed")
    return seeds.withColumns({"slot": F.pmod(own, F.lit(slots)), "bit": F.expr("shiftleft(1L, cast(pmod(xxhash64(seed, mask), 64) as int))")})


def _maybe(seeds: DataFrame, items: DataFrame, slots: int) -> DataFrame:
    """seeds without most of those that no item has, before anything is shuffled."""
    known = _place(items.select("mask", "seed"), slots).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    placed = _place(seeds, slots).join(F.broadcast(known), "slot")  # slots rows at most
    return placed.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("slot", "bit", "bits")


def _shuffled(hashed: DataFrame, parts: DataFrame, keys: list[str], slots: int = FILTER_SLOTS) -> DataFrame:
    named = hashed.select(*keys, "h", F.xxhash64("h").alias("text_hash"))  # once a text, not once a word
    item_seeds = written(_seeds_of(parts))
    seeds = _maybe(_placed(named), item_seeds, slots)
    seeds = seeds.select("text_hash", "at", "mask", "seed", _before(F.col("h"), F.col("at")).alias("before")).distinct()
    hits = seeds.join(item_seeds, ["mask", "seed"])
    hits = written(hits.where(F.col("item_before").isNull() | ~F.col("item_before").eqNullSafe(F.col("before"))).select("text_hash", "segment", "at", "item_at").distinct())
    texts = named.join(hits.select("text_hash").distinct(), "text_hash", "left_semi").groupBy("text_hash").agg(F.any_value("h").alias("h"))
    found = written(_verified(hits.join(texts, "text_hash").join(parts, "segment"), ["text_hash"]))
    return named.drop("h").join(found, "text_hash").drop("text_hash")


def _placed(hashed: DataFrame) -> DataFrame:
    """A row per word and mask: at, mask, seed."""
    at = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("h") - _LEAST)).alias("at"))
    return at.select("*", F.inline(_seeds(F.col("h"), F.col("at")))).where("seed is not null")


def _short(hashed: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame | None:
    """The rows of items of fewer than SPAN words; null if there are none."""
    named = items.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h").between(SHORT, SPAN - 1)).distinct()
    named = named.select("item_id", F.size("h").alias("item_words"), F.xxhash64("h").alias("seed"))
    lengths = [r[0] for r in named.select("item_words").distinct().collect()]  # SPAN - SHORT at most
    if not lengths:
        return None
    windows = lambda n: F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.struct(F.lit(n).alias("item_words"), F.xxhash64(F.transform(F.sequence(i, i + n - 1), lambda k: F.get("h", k))).alias("seed"), i.alias("start")))
    none = F.expr("cast(array() as array<struct<item_words:int,seed:bigint,start:int>>)")
    at = hashed.select(*keys, F.inline(F.concat(*[F.when(F.size("h") >= n, windows(n)).otherwise(none) for n in lengths])))
    few = named.count() <= SMALL_ROWS
    found = at.join(F.broadcast(named) if few else named, ["item_words", "seed"])
    return found.select(*keys, "item_id", "item_words", F.col("item_words").alias("matched"), "start")


def overlaps(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item_id, item_words, matched, start: verified overlaps of documents (keys, text) with items (item_id, text)."""
    parts = segments(items)
    blocks = max(1, math.ceil(parts.count() / BLOCK_SEGMENTS))
    whole = docs.select(*keys, word_hashes(F.col("text")).alias("h"))
    hashed = whole.where(F.size("h") >= _LEAST)
    if blocks <= MOST_BLOCKS:
        out = _in_blocks(_placed(hashed), parts, keys, blocks)
    else:
        out = _shuffled(hashed, written(parts), keys)
    if (short := _short(whole, items, keys)) is not None:
        out = out.unionByName(short)
    best = F.max(F.struct("matched", (-F.col("start")).alias("start"), "item_words")).alias("best")
    return out.groupBy(*keys, "item_id").agg(best).select(*keys, "item_id", F.col("best.item_words").alias("item_words"), F.col("best.matched").alias("matched"), (-F.col("best.start")).alias("start"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without those that overlap an item."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    found = written(overlaps(keyed, items, ["doc_id", "_text"]).select("doc_id", "_text").distinct())
    return without(docs, found, {"doc_id": F.col("doc_id"), "_text": F.xxhash64("text")})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that overlap; documents that aren't there are clean."""
    return overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), ["doc_id"])
