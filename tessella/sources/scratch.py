"""Folders for what a job writes in between."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only a local session, where there is one machine, may lack that setting. The folder goes
    with clean(), or when the driver's Python ends in the ordinary way.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def clean() -> None:
    """Remove the folders made so far. For long sessions, when the results of earlier queries are done with."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            pass


atexit.register(clean)
