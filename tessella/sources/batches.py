"""Bounds of what a Python worker holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of an Arrow batch that goes to Python, where the session has Spark's own default.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker holds: texts and pages are long rows, of which 10,000 are a lot of memory.

    A session that has chosen another number keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
