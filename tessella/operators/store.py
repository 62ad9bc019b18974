"""A vector table on Parquet, for stores without MERGE.

Points lie in buckets of the hash of their object key, so what is asked of known keys reads their
buckets alone. Each upsert writes a folder of points of its own batch, and then a folder of the log: its
commit, and the keys whose earlier points it replaces. A delete is a log folder without points.
A batch that has no log folder doesn't count, so one that dies in between changes nothing.

Compaction folds batches: it writes the living points and the ids of the batches that they come
from to a new base and then makes a pointer to it. Folded batches are left out from then on, and
only from then on, so an upsert that commits while a base is written stays, and of two
compactions one counts. A batch that isn't folded yet comes after all that are: its keys'
points in the base are dead. Once all is folded, reading is a scan of the base, without a join.
Batch ids are times, but always above those of the log, whatever a driver's clock says.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import Pointers

POINTS = (
    "point_id string, object_key string, source string, unit_kind string, unit_idx int, chunk_idx int, text string, "
    "embedding array<float>, key string, len int, file_format string, page_num int, sheet_name string, content_type string, "
    "table_id string, figure_id string, headers array<string>, row_range string, extra map<string,string>, batch_id long"
)
FIELDS = [x.split(" ")[0] for x in POINTS.split(", ")]
LOG = "object_key string, batch_id long"
#: Buckets of a new table. Names of one request that are compared as a list; more are joined.
BUCKETS, MOST_NAMES = 32, 1000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


SKETCH_OF = "source string, text string"


def _sketch(points: DataFrame) -> DataFrame:
    """One row that says how many points there are, and in sketches that merge, which keys, how many sources and how long texts."""
    return points.agg(
        F.count("*").alias("n"), F.theta_sketch_agg("object_key").alias("keys"), F.hll_sketch_agg("source").alias("sources"), F.kll_sketch_agg_bigint(F.char_length("text").cast("long")).alias("lengths")
    )


class VectorTable:
    def __init__(self, spark: SparkSession, path: str, dimension: int = 768, metric: str = "cosine", buckets: int = BUCKETS):
        self.spark, self.path, self.dimension, self.metric, self.buckets = spark, path.rstrip("/"), dimension, metric, buckets
        self._files = Pointers(spark, self.path, "snapshot")

    def exists(self) -> bool:
        return self._files.fs.exists(self._files.at("table.json"))

    def _own(self) -> dict:
        return json.loads(self._files.text("table.json"))

    def ensure(self) -> VectorTable:
        """Make the table if it isn't there; its dimension, metric and number of buckets are fixed from then on."""
        if not self.exists():
            self._files.make("table.json", json.dumps({"dimension": self.dimension, "metric": self.metric, "buckets": self.buckets}))
        own = self._own()
        if (own["dimension"], own["metric"]) != (self.dimension, self.metric):
            raise ValueError(f"the table has {own}")
        self.buckets = own["buckets"]
        return self

    def _need(self) -> None:
        if not self.exists():
            raise RuntimeError(f"no vector table at {self.path}")
        self.buckets = self._own()["buckets"]

    def _base(self) -> tuple[int, str | None, set[int]]:
        """The last pointer, the base that it names, and the batches folded there."""
        n, base = self._files.last()
        return n, base, {r[0] for r in self.spark.read.parquet(f"{self.path}/{base}/batches").collect()} if base else set()

    def _batches(self) -> list[int]:
        """The batches that are committed and not vacuumed, from the names of the log's folders."""
        return sorted(int(n.split("=")[1]) for n in self._files.names("log") if n.startswith("batch_id="))

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._files.fs.exists(self._files.at(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _commit(self, keys: DataFrame | None, batch: int) -> None:
        """The log folder of a batch: written elsewhere first, as its name is what commits."""
        own = self.spark.createDataFrame([(None,)], "object_key string")
        if keys is not None:
            own = own.unionByName(keys.select("object_key").where("object_key is not null").distinct())
        part = f"log/_part-{uuid.uuid4().hex}"
        own.write.parquet(f"{self.path}/{part}")
        points = self._read(f"points/batch_id={batch}", f"{POINTS}, bucket int")
        dead = self._read(part, "object_key string").agg(F.theta_sketch_agg("object_key").alias("dead"))
        _sketch(points).crossJoin(F.broadcast(dead)).write.mode("overwrite").parquet(f"{self.path}/sketches/batch_id={batch}")  # a row each
        if self._files.fs.exists(self._files.at(f"log/batch_id={batch}")) or not self._files.fs.rename(self._files.at(part), self._files.at(f"log/batch_id={batch}")):
            raise RuntimeError(f"batch {batch} is there already")

    def next_batch(self) -> int:
        return max(time.time_ns(), max([0, *self._batches(), *self._base()[2]]) + 1)

    def _asked(self, keys: list[str]) -> Column:
        """The filter of known keys, by bucket first: a filter of partitions."""
        rows = self.spark.createDataFrame([(k,) for k in keys], "k string").select(bucket_of(F.col("k"), self.buckets)).distinct().collect()
        return F.col("bucket").isin([r[0] for r in rows]) & F.col("object_key").isin(keys)

    def _living(self, base: str | None, batches: list[int], asked: Column | None = None) -> DataFrame:
        """POINTS and bucket of the living points of a base and of batches that aren't folded in it."""
        some = lambda df: df if asked is None else df.where(asked)
        whole = some(self._read(f"{base}/points" if base else "none", f"{POINTS}, bucket int"))
        if not batches:
            return whole
        log = self._read("log", LOG).where(F.col("batch_id").isin(batches) & F.col("object_key").isNotNull())
        dead = log.groupBy("object_key").agg(F.max("batch_id").alias("dead"))
        new = some(self._read("points", f"{POINTS}, bucket int").where(F.col("batch_id").isin(batches)))
        new = new.join(dead, "object_key", "left").where(F.col("dead").isNull() | (F.col("batch_id") >= F.col("dead")))
        return whole.join(dead, "object_key", "left_anti").select(*FIELDS, "bucket").unionByName(new.select(*FIELDS, "bucket"))

    def live(self, keys: list[str] | None = None) -> DataFrame:
        """The living points; of known object keys only their buckets are read."""
        self._need()
        _, base, folded = self._base()
        return self._living(base, [b for b in self._batches() if b not in folded], None if keys is None else self._asked(keys)).select(FIELDS)

    def upsert(self, points: DataFrame, replace: bool = True, keys: DataFrame | None = None) -> int:
        """Append points (columns of POINTS but for point_id and batch_id; those that lack are null).

        replace: earlier points of the same object keys go, or of keys (object_key) if given, which
        also has the files that no longer give a point. Vectors of another dimension fail the write.
        """
        self.ensure()
        batch = self.next_batch()
        unique = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("object_key", "unit_kind", "unit_idx", "chunk_idx")], F.col("text")), 256)
        right = F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector is not of dimension {self.dimension}")))
        own = points.withColumn("embedding", right)
        kinds = dict(x.split(" ", 1) for x in POINTS.split(", "))
        for c in FIELDS:
            if c not in own.columns:
                own = own.withColumn(c, F.lit(None).cast(kinds[c]))
        own = own.withColumn("point_id", unique).select(*[F.col(c).cast(kinds[c]).alias(c) for c in FIELDS if c != "batch_id"])
        self._write(own.withColumn("bucket", bucket_of(F.col("object_key"), self.buckets)), f"points/batch_id={batch}")
        if replace and keys is None:
            keys = self._read(f"points/batch_id={batch}", "object_key string, bucket int")
        self._commit(keys if replace else None, batch)
        return batch

    def _write(self, rows: DataFrame, name: str) -> None:
        """Rows by bucket; Spark splits large buckets and joins small files."""
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def delete(self, names: list[str]) -> dict:
        """Delete all points of object keys; a name without a folder also deletes by base name.

        Names that match nothing count as deleted. No table: nothing to do. Keys go to the log
        as they are, so nothing is read for them; base names are looked up.
        """
        out = {"deleted": list(names), "errors": [], "message": f"Deleted {len(names)} file(s)."}
        if not self.exists() or not names:
            return out
        keys = self.spark.createDataFrame([(n,) for n in names], "object_key string")
        bases = [n for n in names if "/" not in n]
        if bases:
            found = self.live().select("object_key", "source")
            table = self.spark.createDataFrame([(n,) for n in bases], "source string")
            found = found.where(F.col("source").isin(bases)) if len(bases) <= MOST_NAMES else found.join(table, "source", "left_semi")
            keys = keys.unionByName(found.select("object_key"))
        self._commit(keys, self.next_batch())
        return out

    def scroll(self, where: str | None = None, limit: int | None = None, payload: bool = False, keys: list[str] | None = None) -> DataFrame:
        rows = self.live(keys) if where is None else self.live(keys).where(where)
        rows = rows.drop("embedding") if payload else rows.select("point_id")
        return rows if limit is None else rows.limit(limit)

    def stats(self) -> dict:
        return {"vectors_count": self.live().count(), "dimension": self.dimension, "metric": self.metric}

    def estimate(self) -> dict:
        """What the sketches of the base and of later batches say; no points are read.

        points_at_most counts points that a later batch replaced or deleted as well, until compact(),
        and so do sources and the lengths of texts (their quartiles); keys are those that live.
        """
        self._need()
        _, base, folded = self._base()
        empty = self.spark.createDataFrame([], f"object_key string, {SKETCH_OF}")
        whole = (self.spark.read.parquet(f"{self.path}/{base}/sketch") if base else _sketch(empty)).withColumns({"dead": F.lit(None).cast("binary"), "batch_id": F.lit(-1).cast("long")})
        later = [b for b in self._batches() if b not in folded]
        if later:
            whole = whole.unionByName(self.spark.read.parquet(f"{self.path}/sketches").where(F.col("batch_id").isin(later)).withColumn("batch_id", F.col("batch_id").cast("long")))
        steps = F.array_sort(F.collect_list(F.struct("batch_id", "keys", "dead")))
        alive = F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.get(steps, 0)["keys"], lambda keys, x: F.theta_union(F.theta_difference(keys, x["dead"]), x["keys"]))
        merged = whole.agg(F.sum("n").alias("n"), alive.alias("keys"), F.hll_union_agg("sources").alias("sources"), F.kll_merge_agg_bigint("lengths").alias("lengths"))
        quartiles = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
        r = merged.select("n", F.theta_sketch_estimate("keys").alias("keys"), F.hll_sketch_estimate("sources").alias("sources"), *quartiles).first()
        return {"points_at_most": r["n"], "keys": r["keys"], "sources": r["sources"], "length_quartiles": [r["q0"], r["q1"], r["q2"]]}

    def compact(self) -> bool:
        """Fold all batches committed so far into a new base; False if another compaction was faster. What was there stays for its readers until vacuum()."""
        self._need()
        n, base, folded = self._base()
        batches = [b for b in self._batches() if b not in folded]
        name = f"base-{uuid.uuid4().hex}"
        self._write(self._living(base, batches), f"{name}/points")
        self.spark.createDataFrame([(b,) for b in sorted(folded.union(batches))], "batch_id long").coalesce(1).write.parquet(f"{self.path}/{name}/batches")
        _sketch(self._read(f"{name}/points", f"{POINTS}, bucket int")).write.parquet(f"{self.path}/{name}/sketch")
        if self._files.swap(n, name):
            return True
        self.remove(f"{self.path}/{name}")
        return False

    def vacuum(self) -> None:
        """Remove former bases, and the points and log of folded batches."""
        n, base, folded = self._base()
        if base is None:
            return
        for name in self._files.names():
            if name.startswith("base-") and name != base:
                self.remove(f"{self.path}/{name}")
        for b in folded:
            self.remove(f"{self.path}/log/batch_id={b}")
            self.remove(f"{self.path}/points/batch_id={b}")
            self.remove(f"{self.path}/sketches/batch_id={b}")
        self._files.drop_before(n)

    def remove(self, path: str) -> None:
        self._files.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def drop(self) -> None:
        self.remove(self.path)

    def reset(self) -> VectorTable:
        self.drop()
        return self.ensure()
