"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Null texts and texts without letters go in the first stage; the second
edits texts and keeps every row; an empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, language, lines, near, packing
from tessella.llm.common import read, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. The dictionaries are learned from the labelled rows of docs."""
    judged = language.classify(docs, language.learn(docs.select("text", "lang")), out="_tessella_language")
    return judged.where(~F.col("_tessella_language.rejected")).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    edited = lines.remove_repeats(docs, lines.chunks_and_runs)
    return edited.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs).select(*docs.columns)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language", keep_known_languages),
    ("lines", remove_repeated_lines),
    ("near", keep_one_of_each),
    ("benchmarks", remove_benchmarks),
    ("packing", pack_sequences),
]

#: Compression, banded hashes and column generation are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
