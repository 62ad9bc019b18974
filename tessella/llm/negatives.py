"""Hard-negative mining by blocked dense GEMM.

Vectors become whole numbers, so a score is exact in float64 as long as no sum of products can
reach 2^53; each pair of blocks is held to that bound, and one that may pass it is multiplied in
Python's whole numbers instead. Anchors go in blocks of at most ANCHOR_BYTES, each
broadcast in turn against all rows. A task multiplies an anchor block with blocks of ROWS
candidates and carries the best of each anchor from block to block, so it hands on a few rows an
anchor however many it reads; the best of the tasks are merged by rank. Pass one finds each anchor's
positives; their scores, a few an anchor, are the windows of pass two, in which a block's scores
that fall into no window of their anchor go at once.

Cases: rows with a null label, vector or component, a component that isn't finite, or a null
vec_id, which leaves nothing to name, take no part; vectors of fewer components than others
count as if zeros followed; rows that repeat a vec_id are rows of their own as candidates and as
anchors, but for an anchor those of its vec_id aren't others; ties go to the smaller vec_id, and then
to nothing, as equal rows are alike; an anchor without positives or negatives has no rows; a score
beyond 64 bits fails the job; a table without anchors gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .common import read, written

POSITIVES = NEGATIVES = 5
#: The window: LEAST * positive score <= 100 * negative score <= 100 * positive score.
LEAST = 80
SCALE = 256
#: Bytes of the anchors' numbers that are broadcast at once, anchors and candidates of a product.
ANCHOR_BYTES, ANCHORS, ROWS = 32 << 20, 512, 4096
EXACT = 2**53


def numbers(rows: DataFrame, label: Column, vector: str = "embedding", id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v: array<double> of whole numbers) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    huge = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= float(2**62))
    whole = F.when(huge, F.transform(vector, lambda x: x.cast("double") * scale)).otherwise(whole)  # such doubles are whole already
    own = rows.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v"), finite.alias("finite"))
    return own.where("finite and label is not null").drop("finite")


class _Matrix:
    """Rows of whole numbers; width: components."""

    def __init__(self, table: pa.Table, width: int):
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        lists = table["v"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.v = np.zeros((len(lists), width))
        self.v[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        self.largest = float(np.abs(self.v).max(initial=0))


def products(a: np.ndarray, a_most: float, b: np.ndarray, b_most: float) -> np.ndarray:
    """Exact inner products of rows, as longs."""
    if a_most * b_most * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], dtype=object).reshape(b.shape).T
    return exact.astype(np.int64)  # OverflowError beyond 64 bits


def _best(keys: tuple[np.ndarray, ...], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group of keys, by score descending and id."""
    order = np.lexsort((ids, -scores, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
    starts = np.flatnonzero(new)
    within = np.arange(len(order)) - starts[np.cumsum(new) - 1]
    return order[within < k]


class Positives:
    """The best rows of an anchor's own label, block by block."""

    fields = ("anchor", "score", "id")

    def __init__(self, anchors: _Matrix, k: int):
        self.anchors, self.k = anchors, k
        self.held = [np.zeros(0, dtype=np.int64) for _ in self.fields]
        self.floor = np.full(len(anchors.ids), np.iinfo(np.int64).min)

    def add(self, rows: _Matrix) -> None:
        for label in np.unique(rows.labels):
            own, there = np.flatnonzero(self.anchors.labels == label), np.flatnonzero(rows.labels == label)
            for i in range(0, len(own), ANCHORS):
                a = own[i : i + ANCHORS]
                scores = products(self.anchors.v[a], self.anchors.largest, rows.v[there], rows.largest)
                x, y = np.nonzero((scores >= self.floor[a][:, None]) & (self.anchors.ids[a][:, None] != rows.ids[there][None, :]))
                self._merge(a[x], scores[x, y], rows.ids[there[y]])

    def _merge(self, *more: np.ndarray) -> None:
        anchor, score, id = (np.concatenate([h, m]) for h, m in zip(self.held, more, strict=True))
        keep = _best((anchor,), score, id, self.k)
        self.held = [anchor[keep], score[keep], id[keep]]
        first, count = np.unique(self.held[0], return_index=True, return_counts=True)[1:]
        full = count == self.k
        self.floor[self.held[0][first[full]]] = self.held[1][first[full] + self.k - 1]


class Negatives:
    """The best rows of other labels in the windows of an anchor's positives, block by block.

    windows: arrays of anchor, positive's place and score, in the order of anchors and places.
    """

    fields = ("window", "score", "id")

    def __init__(self, anchors: _Matrix, windows: tuple[np.ndarray, np.ndarray], k: int, least: int):
        self.anchors, self.k, self.least = anchors, k, least
        self.anchor, self.top = windows
        self.low = np.full(len(self.top), np.iinfo(np.int64).min)  # of each window: the score that its k-th has
        self.held = [np.zeros(0, dtype=np.int64) for _ in self.fields]
        self.bottom = np.array([-(-least * int(t) // 100) for t in self.top], dtype=np.int64)  # the least score of a window
        self.first = np.searchsorted(self.anchor, np.arange(len(anchors.ids) + 1))

    def add(self, rows: _Matrix) -> None:
        for i in range(0, len(self.anchors.ids), ANCHORS):
            a = np.arange(i, min(i + ANCHORS, len(self.anchors.ids)))
            a = a[self.first[a + 1] > self.first[a]]
            if not len(a):
                continue
            scores = products(self.anchors.v[a], self.anchors.largest, rows.v, rows.largest)
            other = self.anchors.labels[a][:, None] != rows.labels[None, :]
            most = self.first[a + 1] - self.first[a]
            for place in range(int(most.max())):
                of = most > place
                w = self.first[a[of]] + place
                low = np.maximum(self.low[w], self.bottom[w])
                x, y = np.nonzero((scores[of] <= self.top[w][:, None]) & (scores[of] >= low[:, None]) & other[of])
                if len(x):
                    self._merge(w[x], scores[of][x, y], rows.ids[y])

    def _merge(self, *more: np.ndarray) -> None:
        window, score, id = (np.concatenate([h, m]) for h, m in zip(self.held, more, strict=True))
        keep = _best((window,), score, id, self.k)
        self.held = [window[keep], score[keep], id[keep]]
        first, count = np.unique(self.held[0], return_index=True, return_counts=True)[1:]
        full = count == self.k
        self.low[self.held[0][first[full]]] = self.held[1][first[full] + self.k - 1]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Matrix]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield _Matrix(pa.Table.from_batches([batch.slice(i, ROWS)]), width)


def _merged(found: DataFrame, key: str, k: int) -> DataFrame:
    """The first k of a key, with rank; ranks are limited before the shuffle too."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """Hard negatives of anchors among rows, both as numbers() gives them.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    rows = written(rows)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    total = anchors.count()
    per = max(1, anchor_bytes // (8 * max(width, 1)))
    n_parts = -(-total // per) * 2 if total > per else 1  # hashing fills parts unevenly, but none to twice the mean or more
    anchors = written(anchors.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_parts))))
    out = scratch(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for part in range(n_parts):
        own = anchors.where(F.col("part") == part).toArrow()
        for start in range(0, own.num_rows, per):  # one step, by that
            _mine_block(spark, rows, own.slice(start, per), width, n_positives, n_negatives, least).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _mine_block(spark: SparkSession, rows: DataFrame, own: pa.Table, width: int, n_positives: int, n_negatives: int, least: int) -> DataFrame:
    anchors = _Matrix(own.combine_chunks(), width)
    sent = spark.sparkContext.broadcast(anchors)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Positives(sent.value, n_positives)
        for block in _blocks(batches, width):
            state.add(block)
        yield pa.record_batch(state.held, names=list(state.fields))

    best = _merged(rows.mapInArrow(nearest, "anchor long, score long, id long"), "anchor", n_positives).toArrow()
    anchor, score, id = (best[c].to_numpy() for c in ("anchor", "score", "id"))
    order = np.lexsort((id, -score, anchor))
    anchor, score, id = anchor[order], score[order], id[order]
    windows = spark.sparkContext.broadcast((anchor, score))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Negatives(sent.value, windows.value, n_negatives, least)
        for block in _blocks(batches, width):
            state.add(block)
        yield pa.record_batch(state.held, names=list(state.fields))

    found = _merged(rows.mapInArrow(hard, "window long, score long, id long"), "window", n_negatives)
    names = pa.table({"window": np.arange(len(anchor)), "anchor_id": anchors.ids[anchor], "positive_id": id, "positive_score": score})
    named = found.join(F.broadcast(spark.createDataFrame(names)), "window")  # as many rows as the block has positives
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = numbers(read(spark, sf_dir, "embeddings"), label)
    return mine(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = f"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), a as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from r a, r where a.vec_id % 100 = 0 and r.vec_id <> a.vec_id
), p as (
  select anchor_id, id as positive_id, score as positive_score from a where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES}
)
select anchor_id, positive_id, (row_number() over w)::integer as rank, id as negative_id, positive_score, score as negative_score
from p join a using (anchor_id) where not same and {LEAST} * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, id)
qualify row_number() over w <= {NEGATIVES}
"""
