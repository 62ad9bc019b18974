"""Listings, pages and selections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 5


def documents_of(objects: DataFrame) -> DataFrame:
    """Keys without the markers that keep folders."""
    return objects.select("path").where(~F.col("path").endswith("/.keep") & (F.col("path") != ".keep"))


def total_pages(n: int, size: int = PAGE_SIZE) -> int:
    return max(math.ceil(n / size), 1)


def page(df: DataFrame, number: int, order: str, size: int = PAGE_SIZE) -> DataFrame:
    return df.orderBy(order).offset((number - 1) * size).limit(size)


def preview(objects: DataFrame, most: int = 5) -> DataFrame:
    """path, line_no and the first lines of each text, stripped."""
    from ..functions.text import lines, strip

    return objects.select("path", F.posexplode(F.slice(lines(F.col("text")), 1, most)).alias("line_no", "line")).withColumn("line", strip(F.col("line")))


def previews(rows: DataFrame, order: str, text: str = "text", most: int = 3, chars: int = 100) -> DataFrame:
    """order and the first characters of the first rows, for logs."""
    return rows.orderBy(order).limit(most).select(order, F.left(text, F.lit(chars)).alias("preview"))


def appended(rows: DataFrame, key: str, order: str, part: Column) -> DataFrame:
    """key and `parts`, the parts of its rows in order. Meant for keys of a file's size."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, part.alias("part")))).alias("_parts")).select(key, F.transform("_parts", lambda x: x["part"]).alias("parts"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
