"""Small tables that are replaced as a whole: the state of copies, the metadata of files.

Each version is a folder of its own, which is written in full before a pointer names it, so no
path is overwritten while it is read and a crash leaves the version before. Pointers are
numbered files that are made and never changed: of two writers that read the same version one makes the next
pointer, and the other finds it there and starts again from what that one wrote.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cdc import META, STATE, upsert_metadata

#: How often a writer that others overtake starts again.
TRIES = 20


class Pointers:
    """The numbered pointers of a folder."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "current"):
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What lies right under a folder; nothing if it isn't there."""
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def make(self, name: str, value: str, over: bool = False) -> bool:
        """Write a small file; False if it is there already, unless it may be written over."""
        try:
            out = self.fs.create(self.at(name), over)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(value.encode()))
        out.close()
        return True

    def last(self) -> tuple[int, str | None]:
        """Number and value of the last pointer; (0, None) if there is none. One that is being written is empty and doesn't count."""
        found = sorted((int(m[1]) for n in self.names() if (m := re.fullmatch(rf"{self.prefix}-(\d+)", n))), reverse=True)
        for n in found:
            if value := self.text(f"{self.prefix}-{n:012d}").strip():
                return n, value
        return 0, None

    def swap(self, n: int, value: str) -> bool:
        """Make the pointer after number n; False if somebody else has."""
        return self.make(f"{self.prefix}-{n + 1:012d}", value)

    def drop_before(self, n: int) -> None:
        for name in self.names():
            if (m := re.fullmatch(rf"{self.prefix}-(\d+)", name)) and int(m[1]) < n:
                self.fs.delete(self.at(name), False)


class Snapshot:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.pointers = Pointers(spark, path)

    def version(self) -> str | None:
        return self.pointers.last()[1]

    def _at(self, version: str | None) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if version is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def read(self) -> DataFrame:
        """The table; empty if there is no version yet."""
        return self._at(self.version())

    def update(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """change(the table) as the new version; again, from the newer one, if another writer was faster."""
        columns = [x.split(" ", 1)[0] for x in self.schema.split(", ")]
        for _ in range(TRIES):
            n, before = self.pointers.last()
            name = f"v-{uuid.uuid4().hex}"
            change(self._at(before)).select(columns).write.parquet(f"{self.path}/{name}")
            if self.pointers.swap(n, name):
                return
            self.pointers.fs.delete(self.pointers.at(name), True)
        raise RuntimeError(f"{TRIES} other writers were faster at {self.path}")

    def replace(self, df: DataFrame) -> None:
        """df as the new version, whatever the one before has."""
        self.update(lambda _: df)

    def vacuum(self) -> None:
        """Remove the versions that the last pointer doesn't name."""
        n, now = self.pointers.last()
        for name in self.pointers.names() if now else []:
            if name.startswith("v-") and name != now:
                self.pointers.fs.delete(self.pointers.at(name), True)
        self.pointers.drop_before(n)


def copy_state(spark: SparkSession, path: str) -> Snapshot:
    """(file_path, etag) of what was copied; etags are strings, whatever they look like."""
    return Snapshot(spark, path, STATE)


class MetadataTable(Snapshot):
    """A row per (object_key, etag): the versions of files."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, META)

    def upsert(self, rows: DataFrame) -> None:
        columns = [x.split(" ", 1)[0] for x in META.split(", ")]
        self.update(lambda known: upsert_metadata(known, rows.select(columns)))

    def scan(self, where: str | None = None) -> DataFrame:
        """The rows, also with the names that their readers know: file_name and path."""
        rows = self.read().withColumns({"file_name": F.col("filename"), "path": F.col("uri")})
        return rows if where is None else rows.where(where)
