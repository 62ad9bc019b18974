"""Quality rules: fixed rules, and divergence from what the language looks like.

Per language, two reference histograms are counted over all documents: classes of characters,
and the most frequent words with all other words as one bin. A document whose own
histogram lies further than a limit from its language's, by Jensen-Shannon distance (the
root of the divergence to base 2, from 0 to 1), is not kept. Short documents have noisy
histograms, so each comparison needs a least length.

A document without a language, or of one with fewer than LEAST_REFERENCE_WORDS words in all, is
compared to the histograms of all documents together.

Cases: a null text has no words, so it fails the base rules; very long texts are read whole;
repeated rows are judged alike; any string is a language; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, lookup, read, written

#: Fixed values of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

#: Words of a reference, and words that a language must have for a reference of its own.
COMMON = 50
LEAST_REFERENCE_WORDS = 10_000
#: References that may be broadcast: some 10 MB.
MOST_BROADCAST = 10_000
#: Distances beyond these reject; lengths below these don't compare.
MOST_CHARS_DISTANCE = 0.28
MOST_WORDS_DISTANCE = 0.37
LEAST_CHARS_COMPARED = 300
LEAST_WORDS_COMPARED = 100

_CLASSES = (r"\p{Lu}+", r"\p{N}+", r"[\p{P}\p{S}]+")
_PLAIN = r"[\p{Ll}\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _without(text: Column, what: str) -> Column:
    return F.char_length(F.regexp_replace(text, what, ""))


def class_counts(n: Column, word_chars: Column, marked: Column) -> Column:
    """Lower case, upper case, numbers, punctuation with symbols, white space, others.

    marked: the text without lower case and white space, which is short in common texts.
    """
    left = F.char_length(marked)
    own = [left - _without(marked, c) for c in _CLASSES]
    rest = left
    for c in own:
        rest = rest - c
    return F.array(*[c.cast("double") for c in [word_chars - left, *own, n - word_chars, rest]])


def repeated_words(words: Column, hashed: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window which the text has twice or more; hashed are the words' hashes.

    Most texts repeat no window; those that do are looked at more closely: the high bits of a
    window's hash and its place share a long, and sorted, equal windows are neighbours. What
    that finds is sorted again by hash and words, so only equal words count.
    """

    def covered(h: Column) -> Column:
        n = F.size(h)
        last = n - window
        windows = F.transform(F.slice(h, 1, F.greatest(last + 1, F.lit(0))), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

        def placed(w: Column) -> Column:
            room = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long"))))

            def cover(room: Column) -> Column:
                high = let(F.lit((1 << 63) - 1).bitwiseAND(-room), lambda mask: F.sort_array(F.transform(w, lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("long")))))
                twice = lambda s: F.filter(s, lambda x, i: (x.bitwiseXOR(F.get(s, i + 1)) < room) | (x.bitwiseXOR(F.get(s, i - 1)) < room))
                close = F.transform(let(high, twice), lambda x: x.bitwiseAND(room - 1).cast("int"))
                whole = F.sort_array(F.transform(close, lambda i: F.struct(F.get(w, i).alias("h"), F.slice(words, i + 1, window).alias("words"), i.cast("long").alias("i"))))
                like = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["words"] == y["words"]), F.lit(False))
                equal = let(whole, lambda s: F.filter(s, lambda x, i: like(x, F.get(s, i + 1)) | like(x, F.get(s, i - 1))))
                places = F.sort_array(F.transform(equal, lambda x: x["i"]))
                start = F.struct(F.lit(-window).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
                step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window).cast("long"), x - a["last"])).alias("n"))
                return F.aggregate(places, start, step, lambda a: a["n"])

            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(room, cover))

        return F.when(n <= window, F.lit(0).cast("long")).otherwise(let(windows, placed))

    return let(hashed, covered)


def _reference(top: DataFrame, on: list[str], totals: DataFrame) -> DataFrame:
    """on, hashes, shares, others, longest: top has a row a word with its count k, totals the words in all."""
    best = top.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "word"))).alias("best"), F.max(F.char_length("word")).alias("longest"))
    shares = F.transform("best", lambda x: -x["k"] / F.col("n"))
    others = 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return totals.join(best, on).select(*on, F.transform("best", lambda x: F.xxhash64(x["word"])).alias("hashes"), shares.alias("shares"), others.alias("others"), "longest")


def word_references(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, hashes, shares, others, longest) of the most frequent words, and the same in one row for all languages together."""
    words = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    per_word = written(words.groupBy("lang", "word").agg(F.count("*").alias("k")))
    totals = per_word.groupBy("lang").agg(F.sum("k").cast("double").alias("n"))
    enough = totals.where(F.col("lang").isNotNull() & (F.col("n") >= LEAST_REFERENCE_WORDS))
    first = Window.partitionBy("lang").orderBy(F.desc("k"), "word")  # each partition passes COMMON rows a language on
    top = per_word.where("lang is not null").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= COMMON).drop("rank")
    together = per_word.groupBy("word").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "word").limit(COMMON).withColumn("pool", F.lit(0))
    pooled = totals.agg(F.sum("n").alias("n")).withColumn("pool", F.lit(0))
    return written(_reference(top, ["lang"], enough)), _reference(together, ["pool"], pooled).drop("pool")


def with_reference(rows: DataFrame, own: DataFrame, pool: DataFrame, spread: list[str]) -> DataFrame:
    """rows with the reference of their language, or the pooled one; all null if there is none."""
    rows = rows.join(F.broadcast(own), "lang", "left") if own.count() <= MOST_BROADCAST else lookup(rows, own, ["lang"], spread)
    found = pool.first()
    for f in pool.schema.fields:
        rows = rows.withColumn(f.name, F.coalesce(F.col(f.name), F.lit(found[f.name] if found else None).cast(f.dataType)))
    return rows


def base_counts(docs: DataFrame, *more: str) -> DataFrame:
    """docs with words, hashed, marked, n_chars and the counts of the base rules, which need no reference; more: other columns to keep."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.size(h) - F.size(F.array_distinct(h)))
    split = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text")).withColumns({"words": words_of(F.col("text")), "marked": F.regexp_replace("text", _PLAIN, ""), "n_chars": F.char_length("text")})
    split = split.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    return split.select(
        "doc_id",
        *more,
        "words",
        "hashed",
        "n_chars",
        "marked",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("marked") - _without(F.col("marked"), SYMBOLS)).cast("long").alias("n_symbols"),
        repeats.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashed")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of the base rules, base_failed, class counts and words_distance, for docs with a word reference."""
    reference = ["hashes", "shares", "others", "longest"]
    common = F.filter("hashed", lambda x, i: (F.char_length(F.get("words", i)) <= F.col("longest")) & F.array_contains("hashes", x))
    n_words = F.size("words")
    distance = F.when(n_words >= LEAST_WORDS_COMPARED, words_distance(n_words, common, F.col("hashes"), F.col("shares"), F.col("others"))).alias("words_distance")
    counted = base_counts(docs, "lang", *reference).select("doc_id", "lang", "n_chars", "marked", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", distance)
    return counted.withColumn("base_failed", base_failed()).withColumn("classes", class_counts(F.col("n_chars"), F.col("word_chars"), F.col("marked"))).drop("marked")


def class_references(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, ref_classes) from features, and the same in one row for all languages together."""
    names = [f"c{i}" for i in range(6)]
    sums = found.groupBy("lang").agg(F.sum("n_words").alias("n"), *[F.sum(F.get("classes", F.lit(i))).alias(c) for i, c in enumerate(names)])
    share = lambda total: F.array(*[F.col(c) / F.greatest(total, F.lit(1.0)) for c in names]).alias("ref_classes")
    total = sum((F.col(c) for c in names), F.lit(0.0))
    sums = written(sums)
    enough = sums.where(F.col("lang").isNotNull() & (F.col("n") >= LEAST_REFERENCE_WORDS))
    return enough.select("lang", share(total)), sums.agg(*[F.sum(c).alias(c) for c in names]).select(share(total))


def _term(p: Column, q: Column) -> Column:
    part = lambda x: F.when(x > 0, x * F.ln(2 * x / (p + q))).otherwise(0.0)
    return (part(p) + part(q)) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)) / F.ln(F.lit(2.0)))


def classes_distance(counts: Column, reference: Column) -> Column:
    def against(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        terms = F.zip_with(c, reference, lambda x, q: _term(x / F.greatest(total, F.lit(1.0)), q))
        return _distance(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))

    return let(counts, against)


def words_distance(n_words: Column, common: Column, hashes: Column, shares: Column, others: Column) -> Column:
    """common: the hashes of the document's words that hashes has. Bins that the document lacks add half their share times ln 2 each."""
    n = F.greatest(n_words, F.lit(1)).cast("double")
    def against(c: Column) -> Column:
        def over(found: Column) -> Column:
            at = F.transform(found, lambda x: F.array_position(c, x))

            def terms(place: Column) -> Column:
                share = lambda i: (F.coalesce(F.get(place, i + 1), F.size(c).cast("long") + 1) - F.get(place, i)) / n
                q = lambda x: F.get(shares, F.array_position(hashes, x).cast("int") - 1)
                start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
                pairs = F.transform(found, lambda x, i: F.struct(share(i).alias("p"), q(x).alias("q")))
                add = lambda a, x: F.struct((a["d"] + _term(x["p"], x["q"])).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q"))
                end = lambda a: a["d"] + F.greatest(1 - others - a["q"], F.lit(0.0)) / 2 * F.ln(F.lit(2.0)) + _term(F.greatest(1 - a["p"], F.lit(0.0)), others)
                return F.aggregate(pairs, start, add, end)

            return let(at, terms)

        return let(F.array_distinct(c), over)

    return _distance(let(F.sort_array(common), against))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, both distances, base_failed and kept, for documents (doc_id, text, lang).

    Words are counted in a first pass over the texts; a second one gives each document's counts and
    distances and is written, without texts or words; classes are compared to what that sums up to.
    """
    docs = docs.select("doc_id", "lang", "text")
    found = written(features(with_reference(docs, *word_references(docs), ["doc_id"])))
    found = with_reference(found, *class_references(found), ["doc_id"])
    found = found.withColumn("chars_distance", F.when(F.col("n_chars") >= LEAST_CHARS_COMPARED, classes_distance(F.col("classes"), F.col("ref_classes"))))
    far = F.coalesce(F.col("chars_distance") > MOST_CHARS_DISTANCE, F.lit(False)) | F.coalesce(F.col("words_distance") > MOST_WORDS_DISTANCE, F.lit(False))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.round("chars_distance", 6).alias("chars_distance"), F.round("words_distance", 6).alias("words_distance"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
