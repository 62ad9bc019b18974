"""Files into the landing folder, and copies out of it."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ALLOWED_EXTENSIONS, basename, extension


#: Bytes that a copy holds at a time.
CHUNK = 8 << 20


def upload_files(paths: str | Iterable[str], root: str, bucket: str = "documents", facts: list | None = None) -> list[dict]:
    """Copy files to root/extension/name; what is missing, or has no or another extension, is skipped.

    facts gets (key, length, modification time, MD5) of each file, taken as it is copied.
    """
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        ext = os.path.splitext(p)[1].lstrip(".").lower()
        if not os.path.isfile(p) or ext not in ALLOWED_EXTENSIONS:
            continue
        name = os.path.basename(p)
        os.makedirs(f"{root}/{ext}", exist_ok=True)
        keep = f"{root}/{ext}/.keep"
        if not os.path.exists(keep):
            open(keep, "wb").close()
        with open(p, "rb") as source, open(f"{root}/{ext}/{name}", "wb") as target:
            size, digest = _pour(source, target)
        out.append({"filename": name, "bucket": bucket, "key": f"{ext}/{name}", "status": "uploaded"})
        if facts is not None:
            facts.append((f"{ext}/{name}", size, datetime.fromtimestamp(os.stat(f"{root}/{ext}/{name}").st_mtime, timezone.utc), digest))
    return out


def _pour(source, target) -> tuple[int, str]:
    """Copy a stream by chunks; its length and MD5."""
    digest, size = hashlib.md5(usedforsecurity=False), 0
    while part := source.read(CHUNK):
        target.write(part)
        digest.update(part)
        size += len(part)
    return size, digest.hexdigest()


def copy_files(files: DataFrame, target: str) -> DataFrame:
    """Copy files (path, key, ...) to target/key, task by task; each row comes back with copied (bytes), md5 and error.

    Paths and target are those of a folder that all executors mount, or URIs of a store that Arrow's file systems
    reach (hdfs, s3, gs, file). Files of any length are poured through CHUNK bytes. A copy is written under
    another name and moved, so nobody reads half of it; one that is tried again overwrites, so
    it is done at least once. A file that can't be copied has an error, and null copied and md5.
    """
    folder = _uri(target)

    def one(path: str, key: str) -> tuple[int, str]:
        store, base = _place(folder)
        end = f"{base}/{key}"
        part = f"{end}.{os.getpid()}.part"
        source, at = _place(_uri(path))
        store.create_dir(os.path.dirname(end), recursive=True)
        with source.open_input_stream(at, buffer_size=0) as f, store.open_output_stream(part) as out:
            got = _pour(f, out)
        store.move(part, end)
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path, key in zip(batch["path"], batch["key"], strict=True):
                try:
                    done.append((*one(path, key), None))
                except Exception as e:
                    done.append((None, None, f"{type(e).__name__}: {str(e)[:500]}"))
            more = pd.DataFrame(done, columns=["copied", "md5", "error"]).astype({"copied": "Int64"})
            yield pd.concat([batch.reset_index(drop=True), more], axis=1)

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.mapInPandas(run, f"{schema}, copied long, md5 string, error string")


def copy_changed(spark: SparkSession, changed: DataFrame, target: str) -> None:
    """Write the content of changed (key, content) to target/key, task by task, for rows that have it already; null content fails the job.

    copy_files() copies files that aren't rows. The same holds of targets and of copies tried again.
    """
    folder = _uri(target)

    def run(rows) -> None:
        for r in rows:
            if r["content"] is None:
                raise ValueError(f"no content to copy: {r['key']}")
            store, base = _place(folder)
            end = f"{base}/{r['key']}"
            part = f"{end}.{os.getpid()}.part"
            store.create_dir(os.path.dirname(end), recursive=True)
            with store.open_output_stream(part) as out:
                out.write(bytes(r["content"]))
            store.move(part, end)

    changed.select("key", "content").foreachPartition(run)


def _uri(path: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", path.replace("s3a://", "s3://", 1)).rstrip("/")


def _place(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


def below(name: str) -> str:
    """name, if it is one of something below a folder; ValueError for one that leads out of it or isn't plain."""
    if not name or name.startswith("/") or posixpath.normpath(name) != name or ".." in name.split("/") or name == "." or "\0" in name or re.match("[A-Za-z][A-Za-z0-9+.-]*:", name):
        raise ValueError(f"not a name below the folder: {name!r}")
    return name


def put_objects(spark: SparkSession, files: dict[str, bytes], root: str) -> list[str]:
    """Write named bytes below root, any path that Spark's file systems reach; what is there is replaced. Returns the paths.

    A name that leads out of root is refused before anything is written.
    """
    hadoop, out = spark._jvm.org.apache.hadoop.fs, []
    for name in files:
        below(name)
    for name, content in files.items():
        path = hadoop.Path(f"{root.rstrip('/')}/{name}")
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        out.append(f"{root.rstrip('/')}/{name}")
    return out


def keys_of(path: Column, bucket: str, base: str = "/documents") -> dict[str, Column]:
    """The names of an object: key (`extension/name`), uri (`s3://bucket/key`) and where a copy lies (`base/minio/key`)."""
    key = F.concat_ws("/", extension(path), basename(path))
    return {"key": key, "uri": F.concat(F.lit(f"s3://{bucket}/"), key), "copy": F.concat_ws("/", F.lit(base), F.lit("minio"), key)}
