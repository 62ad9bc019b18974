"""Incremental copies by etag, and the metadata of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "file_path string, etag string"
META = "object_key string, bucket string, filename string, file_type string, size long, etag string, last_modified timestamp, uri string, ingested_at timestamp"


def changed(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Objects (file_path, etag, ...) that are new or have another etag."""
    return listing.join(state.select("file_path", "etag"), ["file_path", "etag"], "left_anti")


def next_state(state: DataFrame, copied: DataFrame) -> DataFrame:
    """The state after a copy: the newest etag of each path. Objects that went stay."""
    both = state.select("file_path", "etag", F.lit(0).alias("gen")).unionByName(copied.select("file_path", "etag", F.lit(1).alias("gen")))
    return both.groupBy("file_path").agg(F.max_by("etag", F.struct("gen", "etag")).alias("etag"))


def gone(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Paths of the state that the listing no longer has."""
    return state.select("file_path").join(listing.select("file_path"), "file_path", "left_anti")


def upsert_metadata(known: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (object_key, etag), the one ingested last: a history of versions. Of equal times new rows win, then the greatest row.

    The aggregation combines before the shuffle.
    """
    fields = [c for c in known.columns if c not in ("object_key", "etag")]
    both = known.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    best = both.groupBy("object_key", "etag").agg(F.max(F.struct("ingested_at", "_gen", *[c for c in fields if c != "ingested_at"])).alias("r"))
    return best.select(*[F.col(c) if c in ("object_key", "etag") else F.col(f"r.{c}").alias(c) for c in known.columns])


def upload_plan(files: DataFrame, bucket: str, allowed) -> DataFrame:
    """filename, bucket, key (`extension/name`) and status of the files that may be uploaded."""
    from ..functions.text import basename, extension

    named = files.select(basename(F.col("path")).alias("filename"), extension(F.col("path")).alias("ext"))
    return named.where(F.col("ext").isin(*allowed)).select("filename", F.lit(bucket).alias("bucket"), F.concat_ws("/", "ext", "filename").alias("key"), F.lit("uploaded").alias("status"))


def skip_present(files: DataFrame, present: DataFrame, name: str = "filename") -> DataFrame:
    return files.join(present.select(name), name, "left_anti")
