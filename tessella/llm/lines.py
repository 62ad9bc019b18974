"""Line dedup over content-defined chunks of lines and whole repeated runs.

A text's lines are hashed; a rolling hash over WIDTH line hashes ends a chunk where it falls
on one residue of EVERY, so a passage is cut alike wherever it stands. A line of LONG_WORDS or
more words is a chunk of its own. Chunks of several lines, and long lines, that occur again
anywhere are removed but for their first occurrence (least doc_id, then text, then line).

A repeated run of RUN_WORDS or more words, from one line with words to another, goes whole,
wherever chunks end: from each line the fewest lines onwards, and the fewest lines back, that
have so many words are spans too, and those spans that lie in a run cover all its lines. Where
an occurrence overlaps the first one in the same text, only the lines beyond that go.

Hashes only propose: a second pass takes the bytes of the spans whose hash occurs again, and a hash
whose spans' bytes are not all equal removes nothing. Both groupings combine before they shuffle, so
neither a frequent span nor a group of copies gathers in one task; what a span decides reaches its
occurrences through a salted join.

Cases: a null text stays null, an empty one empty; rows that repeat both doc_id and text are one
occurrence and are edited alike; spans without a letter or digit are left alone, as are blank
lines before and after a run; a text whose lines all go becomes empty; very long texts are cut like others; other columns pass through
unless they bear the names that this adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lookup, read, written

WIDTH = 2
EVERY = 2
LONG_WORDS = 50
RUN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _part(array: Column, first: Column, last: Column) -> Column:
    """The elements from first to last. F.slice() copies the whole array each time, which is quadratic when it is done for every line."""
    return F.transform(F.sequence(first, last), lambda i: F.get(array, i))


def _long(line: Column, words: int) -> Column:
    return (F.char_length(line) >= 2 * words - 1) & (F.size(F.filter(F.split(line, " "), lambda w: w != "")) >= words)


def chunk_bounds(text: Column, width: int = WIDTH, every: int = EVERY, words: int = LONG_WORDS) -> Column:
    """array<struct<first, last, hash>> of the chunks that may be removed; lines count from 0."""

    def bounds(lines: Column) -> Column:
        n = F.size(lines)
        rolled = lambda i: F.pmod(F.xxhash64(*[F.get(lines, i - k)["h"] for k in range(width)]), F.lit(every)) == 0
        alone = lambda i: F.coalesce(F.get(lines, i)["long"], F.lit(False))
        ends = F.filter(F.transform(lines, lambda x, i: F.when((i == n - 1) | x["long"] | alone(i + 1) | rolled(i), i)), lambda i: i.isNotNull())

        def chunks(ends: Column) -> Column:
            spans = F.transform(ends, lambda last, k: F.struct(F.coalesce(F.get(ends, k - 1) + 1, F.lit(0)).alias("first"), last.alias("last")))
            wanted = F.filter(spans, lambda c: (c["last"] > c["first"]) | alone(c["first"]))
            return F.transform(wanted, lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), F.xxhash64(F.transform(_part(lines, c["first"], c["last"]), lambda x: x["h"])).alias("hash")))

        return let(ends, chunks)

    return let(F.transform(_lines(text), lambda x: F.struct(F.xxhash64(x).alias("h"), _long(x, words).alias("long"))), bounds)


def run_bounds(text: Column, words: int = RUN_WORDS) -> Column:
    """array<struct<first, last>> of the spans that cover any run of so many words; lines count from 0."""
    counted = F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.size(F.array_remove(F.split(x, " "), "")).alias("n")))

    def reach(own: Column, k: Column) -> Column:
        """The line at which the words from the k-th on are enough; null if they never are."""

        def within(n: int) -> Column:
            start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"))
            add = lambda a, x: F.when(a["n"] >= words, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), x["at"].alias("at")))
            return F.aggregate(_part(own, k, F.least(k + n, F.size(own)) - 1), start, add, lambda a: F.when(a["n"] >= words, a["at"]))

        return F.coalesce(within(min(6, words)), within(words))  # few lines do mostly

    # a span as one number, as arrays of numbers are made distinct in linear time
    span = lambda first, last: F.shiftleft(first.cast("long"), 32) + last

    def spans(own: Column) -> Column:
        onwards = F.transform(own, lambda x, k: span(x["at"], reach(own, k)))
        back = let(F.reverse(own), lambda turned: F.transform(turned, lambda x, k: span(reach(turned, k), x["at"])))
        # blank lines after a line that is enough by itself
        gaps = F.transform(own, lambda x, k: F.when((x["n"] >= words) & (F.get(own, k + 1)["at"] > x["at"] + 1), span(x["at"], F.get(own, k + 1)["at"])))
        return F.array_compact(F.array_distinct(F.concat(onwards, back, gaps)))

    found = let(F.filter(counted, lambda x: x["n"] > 0), spans)
    return F.transform(found, lambda s: F.struct(F.shiftright(s, 32).cast("int").alias("first"), s.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("last")))


def chunks_and_runs(text: Column) -> Column:
    return F.concat(F.transform(chunk_bounds(text), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"))), run_bounds(text))


#: Hashes of repeated spans that may be broadcast: some 60 MB.
SMALL_HASHES = 2_000_000


def repeated_spans(docs: DataFrame, bounds: Callable[[Column], Column] = chunk_bounds) -> DataFrame:
    """doc_id, _text, first, last of spans to remove; _text is the hash of the text."""

    def spans(fields: Callable[[Column, Column], list[Column]]) -> DataFrame:
        """A row per span with a letter or digit; fields(span, its bytes)."""

        def of(lines: Column) -> Column:
            piece = lambda s: F.array_join(_part(lines, s["first"], s["last"]), "\n")
            return F.transform(bounds(F.col("text")), lambda s: let(piece(s), lambda b: F.when(b.rlike(r"[\p{L}\p{N}]"), F.struct(F.xxhash64(b).alias("hash"), *fields(s, b)))))

        named = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")  # a column of its own first: beside inline() it would be computed, and the text carried, for each span
        return named.select("doc_id", "_text", F.inline(F.array_compact(let(_lines(F.col("text")), of))))

    places = written(spans(lambda s, _: [s["first"].alias("first"), s["last"].alias("last")]).distinct())
    firsts = places.groupBy("hash").agg(F.min(F.struct("doc_id", "_text", "first")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("hash", "kept")
    firsts = written(firsts)
    again = firsts.select("hash")
    again = F.broadcast(again) if again.count() <= SMALL_HASHES else again
    # the bytes of repeated spans, once a task, and the hashes that stand for several
    bytes_of = spans(lambda _, b: [b.alias("bytes")]).select("hash", "bytes").join(again, "hash", "left_semi").distinct()
    mixed = bytes_of.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash")
    equal = firsts.join(mixed, "hash", "left_anti")
    hit = lookup(places, equal, ["hash"], ["doc_id", "_text", "first"], "inner")
    again = hit.where(~F.struct("doc_id", "_text", "first").eqNullSafe(F.col("kept")))
    own = F.struct("doc_id", "_text").eqNullSafe(F.struct("kept.doc_id", "kept._text"))
    beyond = F.when(own, F.greatest(F.col("first"), F.col("kept.first") + F.col("last") - F.col("first") + 1)).otherwise(F.col("first"))
    return again.select("doc_id", "_text", beyond.alias("first"), "last")


def _kept(lines: Column, drops: Column) -> Column:
    """The lines beyond all drops, in time linear in both."""
    left = lambda x, k: F.greatest(x["first"], F.coalesce(F.get(drops, k - 1)["last"] + 1, F.lit(0)))  # noqa: E731  most of what the one before covers is left out
    covered = F.flatten(F.transform(drops, lambda x, k: F.when(left(x, k) <= x["last"], F.sequence(left(x, k), x["last"])).otherwise(F.array().cast("array<int>"))))
    return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda i: F.get(lines, i))


def remove_repeats(docs: DataFrame, bounds: Callable[[Column], Column] = chunk_bounds) -> DataFrame:
    """docs (doc_id, text, ...) with edited text, lines_removed and chunks_removed (spans, which may overlap)."""
    drops = repeated_spans(docs, bounds).groupBy("doc_id", "_text").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("drops"))
    drops = drops.select(F.col("doc_id").alias("_tessella_doc"), F.col("_text").alias("_tessella_hash"), F.col("drops").alias("_tessella_drops"))
    own = docs.withColumn("_tessella_text", F.xxhash64("text"))
    joined = own.join(drops, F.col("doc_id").eqNullSafe(F.col("_tessella_doc")) & (F.col("_tessella_text") == F.col("_tessella_hash")), "left").drop("_tessella_doc", "_tessella_hash", "_tessella_text")
    edited = let(F.split("text", "\n"), lambda x: let(_kept(x, F.col("_tessella_drops")), lambda k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(x) - F.size(k)).cast("long").alias("n"))))
    joined = joined.withColumn("_tessella_edit", F.when(F.col("_tessella_drops").isNotNull(), edited))
    return joined.withColumns(
        {
            "text": F.when(F.col("_tessella_drops").isNull(), F.col("text")).otherwise(F.col("_tessella_edit.text")),
            "lines_removed": F.coalesce("_tessella_edit.n", F.lit(0).cast("long")),
            "chunks_removed": F.when(F.col("_tessella_drops").isNull(), 0).otherwise(F.size("_tessella_drops")).cast("long"),
        }
    ).drop("_tessella_drops", "_tessella_edit")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), chunks_and_runs)
