"""Change capture as a stream: listings in, changes of files out.

The state has a file's last etag and when it was last listed. A listing that is older than that says nothing,
one of the same time wins by the greater etag, so the order of arrival doesn't matter to what is known in the
end: it is what a batch job over all listings gives (known()). A file that no listing has named for
as long as `horizon` is gone, by a timer of its own on event time, and new if it comes back.
The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "file_path string, etag string, change string, listed_at timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Changes(StatefulProcessor):
    def __init__(self, horizon: timedelta):
        self.horizon = int(horizon.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "etag string, listed_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for batch in rows:
            for listed, etag in zip(batch["listed_us"], batch["etag"], strict=True):
                newest = max(newest, (int(listed), etag or "")) if newest else (int(listed), etag or "")
        known = self.last.get() if self.last.exists() else None
        if newest is None or (known and (known[1], known[0]) >= newest):
            return
        self.last.update((newest[1], newest[0]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest[0] // 1000 + self.horizon)
        if known is None or known[0] != newest[1]:
            yield self._row(key, newest[1], "new" if known is None else "changed", newest[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        etag, listed = self.last.get()
        self.last.clear()
        yield self._row(key, etag, "gone", listed)

    def _row(self, key, etag: str, change: str, listed: int) -> pd.DataFrame:
        return pd.DataFrame({"file_path": [key[0]], "etag": [etag], "change": [change], "listed_at": [pd.Timestamp(listed, unit="us")]})

    def close(self) -> None:
        pass


def changes(listings: DataFrame, horizon: timedelta, late: str = "10 minutes") -> DataFrame:
    """(file_path, etag, change, listed_at) of a stream of listings (file_path, etag, listed_at); change is new, changed or gone.

    Listings without a path or time say nothing; a null etag is an empty one.
    """
    if listings.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    timed = listings.where("file_path is not null and listed_at is not null").withColumn("listed_us", F.unix_micros("listed_at")).withWatermark("listed_at", late)
    found = timed.select("file_path", "etag", "listed_us", "listed_at").groupBy("file_path")
    return found.transformWithStateInPandas(_Changes(horizon), CHANGES, "Append", "EventTime")


def known(listings: DataFrame) -> DataFrame:
    """What a batch job over all listings knows: the etag of each file's last listing."""
    named = listings.where("file_path is not null and listed_at is not null")
    return named.groupBy("file_path").agg(F.max(F.struct("listed_at", F.coalesce("etag", F.lit("")).alias("etag"))).alias("r")).select("file_path", "r.etag")


def folded(found: DataFrame) -> DataFrame:
    """The state after changes: the etag of each file whose last change isn't that it is gone."""
    order = F.struct("listed_at", F.when(F.col("change") == "gone", 1).otherwise(0), "etag", "change")
    return found.groupBy("file_path").agg(F.max(order).alias("r")).where("r.change <> 'gone'").select("file_path", "r.etag")
