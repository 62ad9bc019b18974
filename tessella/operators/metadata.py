"""Chunk metadata and the payload of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, object_key


def with_metadata(chunks: DataFrame, unit: list[str]) -> DataFrame:
    """chunks (source, chunk_idx, ...) with key, len (chunks of the unit) and file_format.

    chunks that carry n_chunks need no window; others are counted by unit.
    """
    if "n_chunks" in chunks.columns:
        n = F.col("n_chunks")
    else:
        from pyspark.sql import Window

        n = F.count("*").over(Window.partitionBy(*unit))
    return chunks.withColumns({"key": object_key(F.col("source"), F.col("chunk_idx")), "len": n.cast("int"), "file_format": file_format(F.col("source"))})


def file_format(source: Column) -> Column:
    """Word files count as docx and slides as pdf, as the extractors that read them."""
    own = extension(source)
    return F.when(own.isin("doc", "docx"), "docx").when(own.isin("pdf", "ppt", "pptx"), "pdf").otherwise(own)


def optional(value: Column) -> Column:
    """Null for the empty string, as metadata leaves out what is empty."""
    return F.nullif(value, F.lit(""))


def payload(points: DataFrame, fields: list[str]) -> DataFrame:
    """points with point_id and payload, the JSON of text and fields (nulls are left out)."""
    unique = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields], F.col("text")), 256)
    return points.withColumns({"point_id": unique, "payload": F.to_json(F.struct("text", *fields))})


def merged(left: Column, right: Column) -> Column:
    """Map union in which the right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
