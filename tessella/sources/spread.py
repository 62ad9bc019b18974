"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes on disk up to which a table is dealt out; larger ones have the row groups to be read by many tasks.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, a table just read, dealt over all cores if it is small and of fewer files than cores.

    A file may be one row group, which one task reads, and then does all that follows on it.
    Filters and the choice of columns still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)
