"""Files to points, and questions to answers, as whole plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import row_range
from ..operators.answer import ask, checked_question, extractive
from ..operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, sentence_chunk_rows
from ..operators.embedding import HashedWords, embed, embed_question
from ..operators.metadata import optional, with_metadata
from ..operators.search import ASK_K, drop_repeats, topk
from ..operators.store import VectorTable
from ..sources.extract import extract
from ..sources.objects import read_objects


def points_of(objects: DataFrame, make: Callable = HashedWords, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, extra: dict[str, str] | None = None) -> DataFrame:
    """Objects (path, length, content) to rows of the vector table, one lazy plan."""
    return points_of_units(extract(objects), make, size, overlap, extra)


def points_of_units(units: DataFrame, make: Callable = HashedWords, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, extra: dict[str, str] | None = None) -> DataFrame:
    """Units of extract() to rows of the vector table. extra: more metadata that all of them get; what is empty is left out."""
    chunks = with_metadata(sentence_chunk_rows(units.where("unit_kind <> 'error'"), size, overlap), ["object_key", "unit_kind", "unit_idx"])
    tabular, figure = F.col("unit_kind").isin("table", "sheet", "csv_table"), F.col("unit_kind") == "figure"
    chunks = chunks.withColumns(
        {
            "content_type": F.lit("text"),
            "row_range": F.when(tabular, row_range(F.col("text"))).when(figure, F.lit("image_detected")),
            "figure_id": F.when(figure, optional(F.col("table_id"))),
            "table_id": optional(F.col("table_id")),
            "sheet_name": optional(F.col("sheet_name")),
        }
    )
    if more := {k: str(v) for k, v in (extra or {}).items() if v not in (None, "")}:
        chunks = chunks.withColumn("extra", F.create_map(*[F.lit(x) for pair in sorted(more.items()) for x in pair]))
    return embed(chunks.drop("n_chunks"), make)


#: Dead letters that ingest() returns; n_failed counts all, and the table's folder `failed` has them.
MOST_FAILED = 1000


def ingest(spark: SparkSession, folder: str, table: VectorTable, **options) -> dict:
    """Read a folder once, replace its files' points and return counts and dead letters."""
    return land(read_objects(spark, folder), table, **options)


def land(objects: DataFrame, table: VectorTable, load: str | None = None, **options) -> dict:
    """Replace the points of objects (path, length, content), read once, and return counts and dead letters.

    The units, and a row for each file, are written beside the table first; points, keys and
    dead letters come from there. The dead letters of a load replace those of an earlier try.
    """
    spark = objects.sparkSession
    table.ensure()
    place = f"{table.path}/units-{uuid.uuid4().hex}"
    files = extract(objects, mark=True)
    files.write.parquet(place)
    units = spark.read.schema(files.schema).parquet(place)
    keys = units.where("unit_kind = 'file'").select("object_key")
    batch = table.upsert(points_of_units(units.where("unit_kind <> 'file'"), **options), keys=keys)
    failed = units.where("unit_kind = 'error'").select("object_key", "text")
    n = failed.count()
    if n:
        failed.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").parquet(f"{table.path}/failed/load={load or batch}")
    out = {"points": table.stats()["vectors_count"], "failed": [r.asDict() for r in failed.orderBy("object_key").limit(MOST_FAILED).collect()], "n_failed": n}
    table.remove(place)
    return out


def question(table: VectorTable, text: str, documents: list[str] | None = None, k: int = ASK_K, make: Callable = HashedWords, model: Callable[[str], str] = extractive) -> dict:
    """Answer and citations from the table's points, of the named documents if any are named."""
    checked_question(text)
    hits = topk(table.live(), embed_question(text, make), k, documents)
    return ask(drop_repeats(hits), text, model)
