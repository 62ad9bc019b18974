"""Language ID by compression: a text belongs to the language whose dictionary shortens it most.

Each language has a raw-content zstandard dictionary, made of texts that are labelled with
it. A text, letters only and in lower case, is cut into blocks; every block is compressed
with every dictionary and the sizes of a language's blocks are added up, so the whole text
counts. The smallest sum wins. The margin is the saving over the second smallest, as a part
of it; a narrow margin rejects the text.

Cases: a null text, or one without a letter, is `und` with score 0 and rejected; languages of
equal size: the first by name; one learned language: margin 1; none (no labelled rows): every
text is `und`; repeated rows are judged alike; other columns pass through, but for one of the
name of the result, which is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

UNKNOWN = "und"
#: Bounds of what is learned: languages (those with most labels), rows drawn of each, characters of a row, and bytes of a
#: dictionary, into which some 70 to 400 of the rows fit, by their length.
LANGUAGES = 256
SAMPLE_ROWS = 400
SAMPLE_CHARS = 1500
DICTIONARY_BYTES = 100_000
BLOCK = 4000
LEVEL = 5
#: Texts whose best language saves less than this over the next are rejected: on held-out rows 0.3 % of those whose
#: language is right, and 58 to 96 % of the texts of a language that was left out of the dictionaries.
MARGIN = 0.03


def letters(text: Column) -> Column:
    """Letters in lower case, with their marks; whatever stands between them is one space. Empty if there is no letter."""
    return F.when(text.rlike(r"\p{L}"), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))).otherwise("")


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary a language from a bounded sample of labelled (text, lang).

    Rows are drawn by a hash of their text, about 4 * rows a language before the cut, so
    neither the draw nor what reaches the driver grows with the input. Labels may be wrong:
    each half of the sample is judged by the dictionaries of the other half, and rows that
    another language wins are left out of the final ones.
    """
    ok = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in ok.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * rows / n))]), F.col("lang"))
    drawn = ok.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).groupBy("lang", "h").agg(F.min(letters(F.left("text", F.lit(chars)))).alias("text"))
    kept = drawn.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "text"))), 1, rows).alias("drawn"))
    sample = [(row["lang"], x["text"], i % 2) for row in kept.collect() for i, x in enumerate(row["drawn"])]

    def pack(chosen: list[tuple]) -> dict[str, bytes]:
        texts = defaultdict(list)
        for lang, text, _ in chosen:
            texts[lang].append(text)
        return {lang: "\n".join(x).encode()[-size:] for lang, x in texts.items()}

    halves = [Classifier(pack([x for x in sample if x[2] == half])) for half in (0, 1)]
    agreed = [x for x in sample if (judge := halves[1 - x[2]]).names and judge(x[1])[0] == x[0]]
    return pack(sample) | pack(agreed)


class Classifier:
    """The winning language and its margin, for texts that letters() made."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, level: int = LEVEL):
        self.block, self.names, self.coders = block, sorted(dictionaries), []
        for name in self.names:
            raw = dictionaries[name]
            how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(raw), source_size=block, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def __call__(self, text: str) -> tuple[str, float]:
        plain = text.encode()
        if not plain or not self.names:
            return UNKNOWN, 0.0
        parts = [plain[i : i + self.block] for i in range(0, len(plain), self.block)]
        sizes = [sum(len(c.compress(p)) for p in parts) for c in self.coders]
        if len(sizes) == 1:
            return self.names[0], 1.0
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], (second - sizes[best]) / second


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN, out: str = "language") -> DataFrame:
    """docs with a struct, named by out: lang_pred, score (the margin, 0 to 1) and rejected."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Classifier(dictionaries)
        for texts in batches:
            found = [judge(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[0] == UNKNOWN or x[1] < margin for x in found]})

    return docs.withColumn(out, run(letters(F.col(text))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = learn(docs.where(~held_out(F.col("doc_id"))))
    return classify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), known).select("doc_id", "held_out", "language.*")
