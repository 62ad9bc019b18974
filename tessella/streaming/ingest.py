"""Incremental ingestion as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import VectorTable
from ..plans.ingest import land
from ..sources.arrivals import arrivals


def ingest_stream(spark: SparkSession, folder: str, table: VectorTable, checkpoint: str, **options) -> StreamingQuery:
    """New and changed files under folder become points; each batch replaces the points of its files.

    A batch that is tried again writes the same point ids and buries the earlier try, and its dead
    letters replace those of that try, so the table ends the same. Stops when all files that are
    there are read, hidden and empty ones too. Dead letters are in the folder `failed` of the table.
    """

    def one(batch: DataFrame, number: int) -> None:
        land(batch, table, f"stream-{number}", **options)

    files = arrivals(spark, folder, f"{checkpoint.rstrip('/')}/admitted")
    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of an event stream by window and type, with late rows up to `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
