"""All files under a folder as rows, empty and hidden ones included.

Spark's binaryFile leaves out empty files and names that begin with a dot or underscore. This
source has its columns and reads every file of a local or mounted folder. Other paths are
listed through Hadoop's file systems, whose settings (endpoints, credentials, fallbacks) are those
of the session, and read by Spark.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = re.sub("^file:(//)?", "", options["path"])
        self.deep = str(options.get("recursive", "true")).lower() == "true"
        self.content = str(options.get("content", "true")).lower() == "true"
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.most = int(options.get("maxLength", 1 << 30))

    def partitions(self) -> list[_Files]:
        """Files in order, as many a partition as hold partitionBytes."""
        names = []
        for top, folders, files in os.walk(self.root):
            folders.sort()
            names += [os.path.join(top, f) for f in sorted(files)]
            if not self.deep:
                break
        out, held = [[]], 0
        for n in names:
            size = os.path.getsize(n) + 4096
            if out[-1] and held + size > self.bytes:
                out.append([])
                held = 0
            out[-1].append(n)
            held += size
        return [_Files(x) for x in out]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for n in partition.names:
            stat = os.stat(n)
            content = None
            if self.content and stat.st_size <= self.most:
                with open(n, "rb") as f:
                    content = f.read()
            yield n, datetime.fromtimestamp(stat.st_mtime, timezone.utc), stat.st_size, content


class ObjectSource(DataSource):
    """Options: path; recursive; content (false lists only); partitionBytes; maxLength (longer files have null content)."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)


def _is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def read_objects(spark: SparkSession, path: str, **options) -> DataFrame:
    """All files under path. Options as in ObjectSource; other than local paths take recursive and content."""
    if not _is_local(path):
        return store_objects(spark, path, **options)
    spark.dataSource.register(ObjectSource)
    return spark.read.format("objects").options(**{k: str(v) for k, v in options.items()}).load(path)


def list_store(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of all files, hidden and empty ones too, of any path that Spark reaches."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, rows = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, recursive), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), datetime.fromtimestamp(f.getModificationTime() / 1000, timezone.utc), f.getLen()))
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, length long")


def store_objects(spark: SparkSession, path: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """Files of a store. Spark reads the content of ordinary ones; empty ones have empty content, and other hidden ones null."""
    listed = list_store(spark, path, recursive)
    if not content:
        return listed.withColumn("content", F.lit(None).cast("binary"))
    name = F.substring_index("path", "/", -1)
    left = listed.where((F.col("length") == 0) | name.rlike("^[._]"))
    left = left.withColumn("content", F.when(F.col("length") == 0, F.lit(b"")))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).where("length > 0")
    return read.select("path", "modificationTime", "length", "content").where(~name.rlike("^[._]")).unionByName(left)


def folder_listing(spark: SparkSession, path: str) -> DataFrame:
    """(kind, path, size) of what lies right under path: `file` or `directory`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    rows = [("directory" if f.isDirectory() else "file", f.getPath().toString(), f.getLen()) for f in found]
    return spark.createDataFrame(rows, "kind string, path string, size long")


def glob_objects(spark: SparkSession, path: str) -> DataFrame:
    """Files right under path but for dotfiles."""
    from ..functions.text import basename

    return read_objects(spark, path, recursive=False).where(~basename(F.col("path")).startswith("."))


def nonempty(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("length") > 0)


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """All files under path, without content."""
    return read_objects(spark, path, content=False).drop("content")


def with_etag(objects: DataFrame) -> DataFrame:
    """objects with `etag`, of their content, which has to be there."""
    return objects.withColumn("etag", F.md5("content"))


def listed_etag() -> Column:
    """The etag of a listed object, of its time of change and length, so that no byte is read."""
    return F.concat_ws("-", F.hex(F.unix_micros("modificationTime")), F.hex("length"))


def with_listed_etag(objects: DataFrame) -> DataFrame:
    return objects.withColumn("etag", listed_etag())


def relative(objects: DataFrame, root: str, path: str = "path") -> DataFrame:
    """objects with `key`, the path below root. A path that isn't below it fails the job."""
    if _is_local(root):
        start = re.sub("^file:(//)?", "", root).rstrip("/") + "/"
    else:
        spark = objects.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        start = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/") + "/"
    own = F.regexp_replace(path, "^file:(//)?(?=/)", "") if _is_local(root) else F.col(path)
    cut = F.substr(own, F.lit(len(start) + 1))
    return objects.withColumn("key", F.when(own.startswith(start), cut).otherwise(F.raise_error(F.concat(F.lit(f"not below {start}: "), own))))
