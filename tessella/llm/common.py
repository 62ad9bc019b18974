"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import BATCH_ROWS, small_batches  # noqa: F401
from ..sources.scratch import scratch
from ..sources.spread import spread

#: Copies of a lookup row over which the rows of a hot key are dealt.
SALTS = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: the cut of its lineage."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A key is hot from this many rows on, and from this part of all rows, so there are at most so many hot keys.
LEAST_HOT, MOST_HOT = 256, 2000


def lookup(df: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "left", n: str | None = None) -> DataFrame:
    """Join df with small, which has a row a key; rows of one key are dealt over SALTS tasks.

    spread: columns of df that tell the rows of a key apart. n: a column of small with the number
    of df's rows of the key; then only hot keys, of which there are at most MOST_HOT, are dealt
    out, and small should be a written table, as it is read twice.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if n is None:
        copies, dealt = small.withColumn("_tessella_salt", F.explode(every)), df.withColumn("_tessella_salt", salt)
    else:
        total = small.agg(F.sum(n)).first()[0] or 0
        hot = F.col(n) >= max(LEAST_HOT, total / MOST_HOT)
        copies = small.withColumn("_tessella_salt", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0)))))
        keys = small.where(hot).select(*on, F.lit(True).alias("_tessella_hot"))
        dealt = df.join(F.broadcast(keys), on, "left").withColumn("_tessella_salt", F.when(F.col("_tessella_hot"), salt).otherwise(F.lit(0))).drop("_tessella_hot")
    return dealt.join(copies, [*on, "_tessella_salt"], how).drop("_tessella_salt")


#: Rows of two 64-bit keys that may be broadcast: some 50 MB.
SMALL_ROWS = 500_000


def without(df: DataFrame, gone: DataFrame, keys: dict) -> DataFrame:
    """df but for the rows whose keys are in gone, a table that is written already.

    keys: the expressions of df, by gone's column names. gone is broadcast if its rows are few.
    """
    gone = gone.select(*[F.col(k).alias(f"_tessella_gone_{i}") for i, k in enumerate(keys)]).distinct()
    few = gone.count() <= SMALL_ROWS
    on = [value.eqNullSafe(F.col(f"_tessella_gone_{i}")) for i, value in enumerate(keys.values())]
    both = on[0]
    for x in on[1:]:
        both = both & x
    return df.join(F.broadcast(gone) if few else gone, both, "left_anti")
