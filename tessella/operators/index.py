"""Nearest neighbours by an inverted file: k-means cells with product-quantised codes.

An index holds its points sorted by cell, so a question that probes few cells reads few row groups.
The cells and codebooks are fitted to a bounded sample (SAMPLE rows, SAMPLE_BYTES at most); every
point is then assigned and coded. Similarity is the cosine.

One question: the cells nearest to it are scanned by code alone, the best RERANK of their points
are read whole and scored exactly. Many questions: each meets the points of its cells in blocks, a
product of matrices a block, which hands on the best k of each question; these partial tops are
merged by rank. So no pairs are formed beyond a block, and a cell that holds much of the
table, or that many questions probe, is many blocks. How many cells a question probes is measured when
the index is built: as many as hold RECALL of the true neighbours of TUNING points of the table,
found by a whole scan. `exact` goes on to every cell that can
still hold a better point than the k-th found so far, by the angle between question and
cell and the widest angle in the cell, so the result is that of a whole scan.

Cases: points or questions whose vector is null, of another dimension, of length 0 or has a component that
isn't finite take no part; of equal scores the smaller id wins; equal vectors share a cell, which
blocks split by id; fewer than k points give fewer rows; an empty table gives an empty index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .search import cosine

SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
MOST_CELLS = 4096
#: Points of a block, questions of a block, and questions that are multiplied at once.
POINTS, QUESTIONS, AT_ONCE = 8192, 4096, 256
SUBSPACES, CODES = 16, 256
RERANK = 200
#: The recall that probing is to have, the neighbours that it is measured on, and the points asked.
RECALL, TUNING_K, TUNING = 0.97, 4, 256
ROUNDS = 12


def _matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest(rows: np.ndarray, centres: np.ndarray, round_ones: bool, at_once: int = 4096) -> np.ndarray:
    """The nearest centre of each row, by inner product of unit vectors or by distance."""
    half = np.zeros(len(centres)) if round_ones else (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, dtype=np.int64), *[(rows[i : i + at_once] @ centres.T - half).argmax(axis=1) for i in range(0, len(rows), at_once)]])


def lloyd(rows: np.ndarray, k: int, seed: int, round_ones: bool = False, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of rows; round_ones: of unit vectors, unit vectors themselves."""
    draw = np.random.default_rng(seed)
    centres = rows[draw.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres, round_ones)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = (n == 0) | (np.linalg.norm(sums, axis=1) == 0 if round_ones else False)
        centres = np.where(empty[:, None], rows[draw.integers(len(rows), size=len(centres))], sums / np.maximum(n, 1)[:, None])
        if round_ones:
            centres = _unit(centres)
    return centres


class Model:
    """centres: cells x dimension; books: subspaces x codes x width; parts: blocks of each cell."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, parts: np.ndarray):
        self.centres, self.books, self.parts = centres, books, parts
        self.dimension = centres.shape[1]

    def pieces(self, rows: np.ndarray) -> np.ndarray:
        """rows as rows x subspaces x width, the last subspace filled up with zeros."""
        m, _, width = self.books.shape
        return np.pad(rows, ((0, 0), (0, m * width - rows.shape[1]))).reshape(-1, m, width)

    def codes(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = self.pieces(rows - self.centres[cells])
        return np.stack([_nearest(rest[:, s], self.books[s], False) for s in range(len(self.books))], axis=1).astype(np.uint8)


def _fit(spark: SparkSession, sample: np.ndarray, total: int, cells: int | None, subspaces: int, points: int, seed: int) -> Model:
    k = min(cells or max(1, round(total**0.5)), MOST_CELLS, len(sample))
    centres = lloyd(sample, k, seed, True)
    own = _nearest(sample, centres, True)
    share = np.bincount(own, minlength=k) * (1.5 * total / max(len(sample), 1) / points)
    m = min(subspaces, sample.shape[1])
    model = Model(centres, np.zeros((m, 0, -(-sample.shape[1] // m))), np.maximum(np.ceil(share), 1).astype(np.int64))
    sent = spark.sparkContext.broadcast(model.pieces(sample - centres[own]))

    def book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("id").to_pylist():
                rows = sent.value[:, s]
                centre = lloyd(rows, min(CODES, len(rows)), seed + s)
                yield pa.record_batch([pa.array([s]), pa.array([centre.tobytes()])], names=["s", "book"])

    found = spark.range(m).repartition(m, "id").mapInArrow(book, "s long, book binary").collect()
    model.books = np.stack([np.frombuffer(r["book"]).reshape(-1, model.books.shape[2]) for r in sorted(found, key=lambda r: r["s"])])
    return model


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row; of equal ones the first columns."""
    k = min(k, scores.shape[1])
    if not k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    rows, columns = np.nonzero(scores >= least[:, None])
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], columns[keep]


class VectorIndex:
    """An index in a folder: points, cells (cell, centre, near, n) and the model."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(spark.read.text(f"{self.path}/about").first()[0])
        self.id, self.vector, self.probes = about["id"], about["vector"], about.get("probes", 1)
        self.points = spark.read.parquet(f"{self.path}/points")
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").toArrow()
        books = spark.read.parquet(f"{self.path}/books").orderBy("s").collect()
        self.near, self.counts = (cells[c].to_numpy() for c in ("near", "n"))
        centres = _matrix(cells["centre"], about["dimension"]) if len(cells) else np.zeros((0, about["dimension"]))
        width = -(-about["dimension"] // max(len(books), 1))
        self.model = Model(centres, np.stack([np.frombuffer(b["book"]).reshape(-1, width) for b in books]) if books else np.zeros((1, 1, width)), cells["parts"].to_numpy())

    @staticmethod
    def build(points: DataFrame, path: str, id: str = "point_id", vector: str = "embedding", dimension: int | None = None, cells: int | None = None, subspaces: int = SUBSPACES, block: int = POINTS, seed: int = 7) -> VectorIndex:
        """Index points (id, vector and whatever else is to come with a hit) in the folder path."""
        spark = points.sparkSession
        dimension = dimension or points.agg(F.max(F.size(vector))).first()[0] or 0
        own = points.where(_takes_part(vector, dimension))
        total = own.count()
        rows = min(SAMPLE, max(1, SAMPLE_BYTES // (4 * max(dimension, 1))))
        drawn = own.where(F.pmod(F.xxhash64(F.col(id)), F.lit(1 << 30)) < min(1.0, rows / max(total, 1)) * (1 << 30)).select(vector).limit(2 * rows)
        sample = _unit(_matrix(drawn.toArrow()[vector], dimension)) if total else np.zeros((0, dimension))
        if not len(sample):
            sample = _unit(_matrix(own.select(vector).limit(rows).toArrow()[vector], dimension)) if total else sample
        model = _fit(spark, sample, total, cells, subspaces, block, seed) if total else Model(np.zeros((0, dimension)), np.zeros((1, 1, dimension)), np.zeros(0, dtype=np.int64))
        sent = spark.sparkContext.broadcast(model)

        @F.arrow_udf("struct<cell:int,parts:int,near:double,code:binary>")
        def assign(vectors: pa.Array) -> pa.Array:
            m = sent.value
            rows = _unit(_matrix(vectors, m.dimension))
            cell = _nearest(rows, m.centres, True)
            near = (rows * m.centres[cell]).sum(axis=1)
            codes = [c.tobytes() for c in m.codes(rows, cell)]
            return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(m.parts[cell].astype(np.int32)), pa.array(near), pa.array(codes, pa.binary())], names=["cell", "parts", "near", "code"])

        placed = own.withColumn("_at", assign.asNondeterministic()(F.col(vector))).select(*own.columns, "_at.*")
        placed = placed.withColumn("part", F.pmod(F.xxhash64(F.col(id)), F.col("parts")).cast("int")).drop("parts")
        # ranges of cells to ranges of files, by the sample's shares: nothing is sampled or computed twice
        files = int(min(max(model.parts.sum(), 1), max(8, spark.sparkContext.defaultParallelism)))
        upto = (np.cumsum(model.parts) - model.parts) * files // max(int(model.parts.sum()), 1)
        file_of = F.get(F.lit([int(x) for x in upto]), F.col("cell")) if total else F.lit(0)
        placed.repartitionById(files, file_of.cast("int")).sortWithinPartitions("cell", "part").write.parquet(f"{path}/points")
        stored = spark.read.parquet(f"{path}/points").groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near"))
        about = spark.createDataFrame([(i, c.tolist(), int(p)) for i, (c, p) in enumerate(zip(model.centres, model.parts, strict=True))], "cell int, centre array<double>, parts int")
        about.join(stored, "cell", "left").na.fill({"n": 0, "near": 1.0}).write.parquet(f"{path}/cells")
        spark.createDataFrame([(s, bytearray(b.tobytes())) for s, b in enumerate(model.books)], "s int, book binary").write.parquet(f"{path}/books")
        about = {"id": id, "vector": vector, "dimension": dimension}
        say = lambda: spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")
        say()
        if total:
            about["probes"] = VectorIndex(spark, path)._measured()
            say()
        return VectorIndex(spark, path)

    def _measured(self) -> int:
        """The cells that a question has to probe."""
        share = min(1.0, TUNING / int(self.counts.sum())) * (1 << 30)
        drawn = self.points.where(F.pmod(F.xxhash64(F.lit("tuning"), F.col(self.id)), F.lit(1 << 30)) < share).limit(2 * TUNING)
        asked = drawn.select(F.col(self.id).alias("question_id"), self.vector)
        true = self.neighbours(asked, TUNING_K + 1, 1, True, vector=self.vector).where(~F.col("id").eqNullSafe(F.col("question_id")))
        cells = true.join(self.points.select(F.col(self.id).alias("id"), "cell"), "id").join(asked, "question_id").select(self.vector, "cell").toArrow()
        if not len(cells):
            return len(self.counts)
        order = np.argsort(-(_unit(_matrix(cells[self.vector], self.model.dimension)) @ self.model.centres.T), axis=1, kind="stable")
        ranks = np.sort(np.nonzero(order == cells["cell"].to_numpy()[:, None])[1])
        return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))) - 1)]) + 1

    def read_share(self, probes: int | None = None) -> float:
        """The mean share of the points that a question of the table's own meets."""
        share = self.counts / max(self.counts.sum(), 1)
        order = np.argsort(-(self.model.centres @ self.model.centres.T), axis=1, kind="stable")[:, : probes or self.probes]
        return float(share @ share[order].sum(axis=1)) if len(share) else 0.0

    def topk(self, question: list[float], k: int, probes: int | None = None, rerank: int = RERANK, where: str | None = None) -> DataFrame:
        """The k nearest points of the cells nearest to one question, with score and rank. where: a filter of points, before any limit."""
        q = np.asarray(question, dtype=np.float64)
        q = q / (np.linalg.norm(q) or 1.0)
        towards = self.model.centres @ q
        chosen = [int(c) for c in np.argsort(-towards, kind="stable")[: probes or self.probes]]
        some = self.points.where(F.col("cell").isin(chosen))
        some = some if where is None else some.where(where)
        sent = self.spark.sparkContext.broadcast((towards, (self.model.books @ self.model.pieces(q[None])[0][:, :, None])[:, :, 0]))

        @F.arrow_udf("double")
        def guess(cells: pa.Array, codes: pa.Array) -> pa.Array:
            towards, table = sent.value
            own = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(-1, len(table))
            return pa.array(towards[cells.to_numpy(zero_copy_only=False)] + table[np.arange(len(table)), own].sum(axis=1))

        near = some.select("cell", "part", F.col(self.id).alias("_id"), guess("cell", "code").alias("guess")).orderBy(F.desc("guess"), "_id").limit(max(rerank, k))
        found = near.collect()  # rerank rows
        whole = some.where(F.col(self.id).isin([r["_id"] for r in found]))
        scored = whole.withColumn("score", cosine(F.col(self.vector), list(question)))
        best = scored.drop("cell", "part", "near", "code").orderBy(F.desc("score"), F.col(self.id)).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(self.id))))

    def neighbours(self, questions: DataFrame, k: int, probes: int | None = None, exact: bool = False, id: str = "question_id", vector: str = "embedding") -> DataFrame:
        """(question_id, id, score, rank): the k nearest points of every question, of probed cells or, if exact, of all."""
        asked = questions.where(_takes_part(vector, self.model.dimension)).select(F.col(id).alias("question_id"), F.col(vector).alias("asked"))
        probes = probes or self.probes
        sent = self.spark.sparkContext.broadcast((self.model.centres, self.near, self.model.parts, self.model.dimension))

        def to_cells(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[pa.RecordBatch]:
            centres, near, parts, dimension = sent.value
            for b in batches:
                for at in range(0, b.num_rows, AT_ONCE):
                    rows = b.slice(at, AT_ONCE)
                    towards = _unit(_matrix(rows.column("asked"), dimension)) @ centres.T
                    order = np.argsort(-towards, axis=1, kind="stable")
                    if second:
                        angle = np.arccos(np.clip(towards, -1, 1)) - np.arccos(np.clip(near, -1, 1))[None, :]
                        least = rows.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
                        may = np.cos(np.clip(angle, 0, np.pi)) >= least[:, None] - 1e-9
                        np.put_along_axis(may, order[:, :probes], False, axis=1)
                        q, cell = np.nonzero(may)
                    else:
                        cell = order[:, :probes].ravel()
                        q = np.repeat(np.arange(len(rows)), min(probes, len(centres)))
                    yield pa.record_batch([rows.column("question_id").take(pa.array(q)), pa.array(cell.astype(np.int32)), pa.array(parts[cell].astype(np.int32))], names=["question_id", "cell", "parts"])

        kind = dict(asked.dtypes)["question_id"]
        pairs = lambda rows, second: rows.mapInArrow(lambda b: to_cells(b, second), f"question_id {kind}, cell int, parts int")
        found = self._scanned(pairs(asked, False), asked, k)
        if exact:
            kth = found.where(F.col("rank") == k).select(F.col("question_id").alias("_q"), F.col("score").alias("least"))
            rest = asked.join(kth, F.col("question_id") == F.col("_q"), "left").drop("_q")
            more = self._scanned(pairs(rest, True), asked, k)
            found = _ranked(found.unionByName(more).drop("rank"), k)
        return found

    def _scanned(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """The k best of each question in its cells."""
        place = scratch(self.spark)
        pairs.write.parquet(place)
        pairs = self.spark.read.schema(pairs.schema).parquet(place)
        counts = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        shares = self.spark.createDataFrame([(c, -(-n // QUESTIONS)) for c, n in counts.items()], "cell int, shares int")
        dealt = pairs.join(F.broadcast(shares), "cell").withColumn("share", F.pmod(F.xxhash64("question_id"), F.col("shares")).cast("int"))
        dealt = dealt.select("question_id", "cell", "share", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(asked, "question_id")
        points = self.points.where(F.col("cell").isin(sorted(counts))) if len(counts) < len(self.counts) else self.points
        points = points.select(F.col(self.id).alias("id"), F.col(self.vector).alias("v"), "cell", "part").join(F.broadcast(shares), "cell")
        points = points.select("id", "v", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        dimension, names = self.model.dimension, {c: t for c, t in [*pairs.dtypes, *points.dtypes]}

        def block(_, p: pa.Table, q: pa.Table) -> pa.Table:
            out = {"question_id": [], "id": [], "score": []}
            if len(p) and len(q):
                p = p.sort_by("id")
                rows = _unit(_matrix(p["v"], dimension))
                for at in range(0, len(q), AT_ONCE):
                    some = q.slice(at, AT_ONCE)
                    scores = _unit(_matrix(some["asked"], dimension)) @ rows.T
                    i, j = _best(scores, k)
                    out["question_id"].append(some["question_id"].take(pa.array(i)).combine_chunks())
                    out["id"].append(p["id"].take(pa.array(j)).combine_chunks())
                    out["score"].append(pa.array(scores[i, j]))
            kinds = {"question_id": q.schema.field("question_id").type, "id": p.schema.field("id").type, "score": pa.float64()}
            return pa.table({c: pa.chunked_array(x, type=kinds[c]) for c, x in out.items()})

        key = ["cell", "part", "share"]
        schema = f"question_id {names['question_id']}, id {names['id']}, score double"
        return _ranked(points.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(block, schema), k)


def _takes_part(vector: str, dimension: int):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def recall(approximate: DataFrame, whole: DataFrame) -> float:
    """The share of whole's (question_id, id) that approximate has."""
    n = whole.count()
    return whole.join(approximate, ["question_id", "id"], "left_semi").count() / n if n else 1.0
