"""Jobs on files: upload with metadata, incremental copies, and deletes with their vectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension
from ..operators.cdc import changed, next_state
from ..operators.snapshot import MetadataTable, Snapshot, copy_state
from ..operators.store import VectorTable
from ..sources.landing import below, copy_files, put_objects, upload_files
from ..sources.objects import list_objects, listed_etag, read_objects, relative, with_etag, with_listed_etag


def metadata_of(objects: DataFrame, bucket: str) -> DataFrame:
    """Rows of the metadata table for objects (key, length, modificationTime, etag)."""
    return objects.select(
        F.col("key").alias("object_key"),
        F.lit(bucket).alias("bucket"),
        basename(F.col("key")).alias("filename"),
        extension(F.col("key")).alias("file_type"),
        F.col("length").alias("size"),
        "etag",
        F.col("modificationTime").alias("last_modified"),
        F.concat(F.lit(f"s3://{bucket}/"), "key").alias("uri"),
        F.current_timestamp().alias("ingested_at"),
    )


def upload(spark: SparkSession, paths: str | Iterable[str], root: str, metadata: MetadataTable, bucket: str = "documents") -> list[dict]:
    """Copy files into the landing folder and write the metadata of what was copied."""
    facts: list[tuple] = []
    out = upload_files(paths, root, bucket, facts)
    if facts:
        metadata.upsert(metadata_of(spark.createDataFrame(facts, "key string, length long, modificationTime timestamp, etag string"), bucket))
    return out


#: Errors that copy_new() returns; `failed` counts all. Bytes of a task of copies, and most tasks.
MOST_ERRORS = 100
TASK_BYTES, MOST_TASKS = 64 << 20, 10_000
PLAN = "file_path string, etag string, path string, length long"


def copy_new(spark: SparkSession, source: str, target: str, state: str, content: bool = False) -> dict:
    """Copy the files of source that are new or have another etag, and save the state.

    Etags are those of the listing, time and length, or of the content, which reads every file. What is
    to be copied is listed once and written beside the state, and so is what became of each
    file; the state takes those that were copied, so a job that dies copies again and never skips. Files
    that went stay in the target and in the state. No change: no new version of the state.
    Returns copied and state, the numbers of files; if some failed also failed and errors.
    """
    saved, plan = copy_state(spark, state), Snapshot(spark, f"{state.rstrip('/')}/plan", PLAN)
    found = with_etag(read_objects(spark, source)) if content else with_listed_etag(list_objects(spark, source))
    if content:
        found = found.withColumn("etag", F.coalesce("etag", listed_etag()))  # files longer than a row may be
    plan.replace(changed(relative(found, source).select(F.col("key").alias("file_path"), "etag", "path", "length"), saved.read()))
    todo = plan.read()
    n, size = todo.agg(F.count("*"), F.sum("length")).first()
    done = Snapshot(spark, f"{state.rstrip('/')}/done", f"{PLAN}, key string, copied long, md5 string, error string")
    out = {"copied": 0}
    if n:
        tasks = min(max(1, -(-size // TASK_BYTES), min(n, spark.sparkContext.defaultParallelism)), MOST_TASKS)
        done.replace(copy_files(todo.repartition(tasks, "file_path").withColumn("key", F.col("file_path")), target))
        good, bad = done.read().where("error is null"), done.read().where("error is not null")
        out["copied"] = good.count()
        if out["copied"]:
            saved.update(lambda known: next_state(known, good))
            saved.vacuum()
        if out["copied"] < n:
            out["failed"] = n - out["copied"]
            out["errors"] = [{"file": r["file_path"], "error": r["error"]} for r in bad.orderBy("file_path").limit(MOST_ERRORS).collect()]
        done.vacuum()
    plan.vacuum()
    return out | {"state": saved.read().count()}


def put(spark: SparkSession, files: dict[str, bytes], root: str) -> list[str]:
    """Write named bytes below root, over what is there, through Hadoop's file systems."""
    return put_objects(spark, files, root)


def delete_documents(spark: SparkSession, table: VectorTable, root: str, names: list[str]) -> dict:
    """Delete objects and their vectors, name by name: those that fail are in `errors`, the others in `deleted`.

    A name that isn't there counts as deleted; one that leads out of root is an error. The names are those of one request.
    """
    deleted, errors = [], []
    for name in names:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{below(name)}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
            deleted.append(name)
        except Exception as e:
            errors.append({"file": name, "name": name, "error": f"{type(e).__name__}: {str(e)[:200]}"})
    table.delete([x for n in deleted for x in (n, f"{root.rstrip('/')}/{n}")])
    return {"deleted": deleted, "errors": errors, "message": f"Deleted {len(deleted)} file(s), {len(errors)} error(s)."}
