"""Exact vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 5
ASK_K = 4
#: Names that a filter takes as a list; a longer one is joined.
MOST_NAMES = 200


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, query: list[float]) -> Column:
    """Null for vectors of length 0 or of another dimension."""
    q = F.array(*[F.lit(float(v)) for v in query])
    length = sum(v * v for v in query) ** 0.5
    return F.when(F.size(x) == len(query), dot(x, q) / F.nullif(norm(x) * F.lit(length), F.lit(0.0)))


def from_sources(points: DataFrame, names: list[str] | None) -> DataFrame:
    """points of the named sources; no names mean no filter."""
    if not names:
        return points
    if len(names) <= MOST_NAMES:
        return points.where(F.col("source").isin(*names))
    table = points.sparkSession.createDataFrame([(n,) for n in set(names)], "source string")
    return points.join(table, "source", "left_semi")


def topk(points: DataFrame, query: list[float], k: int = TOP_K, names: list[str] | None = None, unique: bool = False, id: str = "point_id") -> DataFrame:
    """The k nearest with score and rank; the filter comes before the limit, ties go by id.

    The sort and limit are one TakeOrderedAndProject: each task keeps k rows. unique drops
    repeats of (text, source) before the limit rather than after it.
    """
    scored = from_sources(points, names).withColumn("score", cosine(F.col("embedding"), query)).where(F.col("score").isNotNull())
    if unique:
        scored = scored.groupBy("text", "source").agg(F.min_by(F.struct(*scored.columns), F.struct((-F.col("score")).alias("far"), F.col(id).alias("tie"))).alias("r")).select("r.*")
    best = scored.orderBy(F.desc("score"), F.col(id)).limit(k)
    # a window without partitions over k rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(id))))


def drop_repeats(hits: DataFrame, id: str = "point_id") -> DataFrame:
    """Hits without the later ones of an equal (text, source); at most k rows, ranked anew."""
    first = Window.partitionBy("text", "source").orderBy(F.desc("score"), F.col(id))
    kept = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(id))))
