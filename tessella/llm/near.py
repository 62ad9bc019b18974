"""N-gram Jaccard join by MinHash banding.

A text's n-grams are the sets of five consecutive words (a shorter text is one gram), hashed.
Texts of equal words are one class; classes, not copies, are joined. BANDS and ROWS follow
from the similarity and the target recall: a pair as similar as the threshold agrees in some
band with that probability. Signatures are shuffled on their band hashes.

A band hash that few classes share yields its pairs; they are verified on full n-gram sets.
One that many share would yield a square of pairs. Such classes are grouped and a group is
verified as a grid: its members are dealt into blocks of bounded size, each pair of blocks is a
task of its own that multiplies the blocks' membership matrices, and only counts and a
spanning forest of the verified links leave it. A group is a component of the crowded band hashes,
so that classes which share many of them are compared once. Where common passages chain
components beyond GROUP classes, each crowded band hash is a group of its own, in which pairs that
share a lesser crowded hash are passed over, as they are counted there. Either way a link is a
pair of classes that share a band hash and are similar on their full sets, and counts once.

Result: for each document the class of texts it is linked with, directly or through others
(the least doc_id there), and to how many documents it is similar: copies of its own text and
documents of each linked text.

Words are runs of letters and digits in lower case. Cases: null texts and texts without words
are alone, with no links; repeated doc_ids are documents of their own and share a class; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_ROWS, lookup, read, small_batches, without, written
from .components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5
#: Classes that may share a band hash before their pairs are left to the grid.
CROWD = 4
#: Classes of a component that is verified as one group.
GROUP = 4096
#: Members of a block of the grid, and columns of a matrix.
BLOCK = 256
COLUMNS = 8192
SEED = 20240601


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of n words in a row."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    h = hashes.astype(np.int64).view(np.uint64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mix(out ^ h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.by = draw.integers(1, 1 << 63, size=bands * rows, dtype=np.uint64) | np.uint64(1)
        self.plus = draw.integers(0, 1 << 63, size=bands * rows, dtype=np.uint64)
        self.band = np.arange(bands, dtype=np.uint64)

    def __call__(self, own: np.ndarray, step: int = 2048) -> np.ndarray:
        least = np.full(len(self.by), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(own), step):
            part = own[i : i + step, None] * self.by
            part += self.plus
            np.minimum(least, part.min(axis=0), out=least)
        out = self.band
        for row in least.reshape(self.bands, self.rows).T:
            out = _mix(out ^ row)
        return out.view(np.int64)


def class_of(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.xxhash64(F.array_join(words, " ")))


def hashed_words(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, h (the hashes of the words) and cid, the 64-bit hash that tells classes apart (null without words)."""
    split = docs.select(*keep, words_of(F.col("text")).alias("words"))
    return split.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"), class_of(F.col("words")).alias("cid"))


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, cid and bands (null without words)."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer(bands, rows)
        for batch in batches:
            yield pd.Series([signer(grams(h)) if len(h) else None for h in batch], dtype=object)

    return hashed_words(docs, "doc_id").select("doc_id", "cid", sign("h").alias("bands"))


def shared_bands(classes: DataFrame) -> DataFrame:
    """(band, cid, k, low): the classes of each band hash that k > 1 of them share; low is the least."""
    rows = classes.select("cid", F.explode("bands").alias("band"))
    shared = written(rows.groupBy("band").agg(F.count("*").alias("k"), F.min("cid").alias("low")).where("k > 1"))
    return lookup(rows, shared, ["band"], ["cid"], "inner", "k")


def few_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of band hashes that at most CROWD classes share."""
    sets = members.where(F.col("k") <= CROWD).groupBy("band").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    first = sets.select(F.posexplode("c").alias("i", "a"), "c")
    return first.select("a", F.explode(F.slice("c", F.col("i") + 2, CROWD)).alias("b")).distinct()


def class_grams(docs: DataFrame, wanted: DataFrame, small: int = SMALL_ROWS) -> DataFrame:
    """(cid, n, grams) of wanted classes (cid, n, first: a doc_id that has it)."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def to_grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([grams(h).view(np.int64) for h in batch], dtype=object)

    side = wanted.select(F.col("cid").alias("w_cid"), F.col("first").alias("w_first"), "n")
    side = F.broadcast(side) if wanted.count() <= small else side
    own = hashed_words(docs, "doc_id").where(F.col("cid").isNotNull())
    hit = own.join(side, (F.col("cid") == F.col("w_cid")) & F.col("doc_id").eqNullSafe(F.col("w_first")))
    return hit.select("cid", "n", to_grams("h").alias("grams")).dropDuplicates(["cid"])


def similar_pairs(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n_a, n_b) of the pairs that are similar on their full sets."""
    side = lambda x: grams.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"g_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.size("g_a") >= similarity * F.size("g_b")) & (F.size("g_b") >= similarity * F.size("g_a")))
    common = F.size(F.array_intersect("g_a", "g_b"))
    return both.where(common * (1 + similarity) >= similarity * (F.size("g_a") + F.size("g_b")) - 1e-9).select("a", "b", "n_a", "n_b")


def _common(x: list[np.ndarray], y: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """How many hashes each of x shares with each of y."""
    words, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cuts = np.cumsum([len(v) for v in (*x, *y)])[:-1]
    rows = [np.sort(r) for r in np.split(place, cuts)]
    out = np.zeros((len(x), len(y)), dtype=np.float64)
    for low in range(0, len(words), columns):
        part = np.zeros((len(rows), min(columns, len(words) - low)), dtype=np.float32)
        for i, r in enumerate(rows):
            part[i, r[np.searchsorted(r, low) : np.searchsorted(r, low + columns)] - low] = 1
        out += part[: len(x)] @ part[len(x) :].T
    return out


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, left = [], np.ones(len(links), dtype=bool)
    for root in range(len(links)):
        if left[root]:
            left[root] = False
            queue = [root]
            while queue:
                i = queue.pop()
                new = np.flatnonzero(links[i] & left)
                left[new] = False
                out += [(i, int(j)) for j in new]
                queue += new.tolist()
    return out


def grid(groups: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """For groups (root, band, cid, n, bands, grams): rows (a, a, documents that are similar to a) and rows (a, b, -1) of a spanning forest.

    Where band is null, pairs need a common one of bands; else only pairs count that have no common one below it.
    Without the columns band and bands all pairs of a group count.
    """
    if "bands" not in groups.columns:
        groups = groups.withColumns({"band": F.lit(None).cast("long"), "bands": F.lit(None).cast("array<long>")})

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
        rows = rows.sort_values("cid")
        of = lambda b: rows[rows["own"] == b]
        first, second = of(x), of(y)
        sets = lambda part: [np.asarray(g) for g in part["grams"]]
        gx, gy = sets(first), sets(second)
        if not gx or not gy:
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        sx, sy = np.array([len(g) for g in gx]), np.array([len(g) for g in gy])
        links = _common(gx, gy) * (1 + similarity) >= similarity * (sx[:, None] + sy) - 1e-9
        if first["bands"].iloc[0] is not None:
            band = first["band"].iloc[0]
            whole = pd.isna(band)
            seen = lambda part: [np.unique(b if whole else b[b < band]) for b in map(np.asarray, part["bands"])]
            links &= (_common(seen(first), seen(second)) > 0) == whole
        cx, cy, nx, ny = first["cid"].to_numpy(), second["cid"].to_numpy(), first["n"].to_numpy(), second["n"].to_numpy()
        if x == y:
            np.fill_diagonal(links, False)
            ids, counts, square = cx, (links * ny).sum(axis=1), links
        else:
            ids, counts = np.concatenate([cx, cy]), np.concatenate([(links * ny).sum(axis=1), (links * nx[:, None]).sum(axis=0)])
            square = np.zeros((len(ids), len(ids)), dtype=bool)
            square[: len(cx), len(cx) :] = links
            square[len(cx) :, : len(cx)] = links.T
        edges = np.array(_forest(square), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([ids, ids[edges[:, 0]]]), "b": np.concatenate([ids, ids[edges[:, 1]]]), "links": np.concatenate([counts, np.full(len(edges), -1)]).astype(np.int64)})

    sizes = written(groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("size")))
    dealt = lookup(groups, sizes, ["root"], ["cid"], "inner", "size").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cid", "n", "band", "bands", "grams")
    return cells.groupBy("root", "band", "x", "y").applyInPandas(cell, "a long, b long, links long")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, group: int = GROUP) -> DataFrame:
    """doc_id, class_id, n_copies (documents of the same words), n_links and _cid for documents (doc_id, text)."""
    own = written(signed(docs, bands_for(similarity, recall, rows), rows))
    classes = written(own.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.any_value("bands").alias("bands")))
    members = written(shared_bands(classes))
    crowds = components(members.where(F.col("k") > CROWD).select(F.col("cid").alias("a"), F.col("low").alias("b")))
    groups = written(crowds.unionByName(crowds.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "cid"))
    sizes = written(groups.groupBy("root").agg(F.count("*").alias("size")))
    groups = written(lookup(groups, sizes, ["root"], ["cid"], "inner", "size"))
    # the classes of large components, with their crowded band hashes
    large = groups.where(F.col("size") > group).select("cid")
    crowded = members.where(F.col("k") > CROWD).select("cid", "band", "k").join(large, "cid", "left_semi")
    apart = written(crowded.groupBy("cid").agg(F.sort_array(F.collect_list("band")).alias("bands")))
    side = lambda x: groups.select(F.col("cid").alias(x), F.col("root").alias(f"root_{x}"), F.col("size").alias(f"size_{x}")).join(apart.select(F.col("cid").alias(x), F.col("bands").alias(f"bands_{x}")), x, "left")
    pairs = few_pairs(members).join(side("a"), "a", "left").join(side("b"), "b", "left")
    met = F.when(F.col("size_a") > group, F.arrays_overlap("bands_a", "bands_b")).otherwise(F.lit(True))
    pairs = written(pairs.where(~F.coalesce((F.col("root_a") == F.col("root_b")) & met, F.lit(False))).select("a", "b"))
    met = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(groups.select("cid")).distinct()
    grams = written(class_grams(docs, written(classes.select("cid", "n", "first").join(met, "cid"))))
    similar = written(similar_pairs(pairs, grams, similarity))
    of_class = classes.select("cid", "bands").join(groups.where(F.col("size") <= group).select("cid", "root"), "cid").select("root", F.lit(None).cast("long").alias("band"), "cid", "bands")
    of_band = crowded.join(apart, "cid").select(F.col("band").alias("root"), "band", "cid", "bands")
    covered = written(grid(of_class.unionByName(of_band).join(grams, "cid"), similarity))
    counts = similar.select(F.col("a").alias("cid"), F.col("n_b").alias("links")).unionByName(similar.select(F.col("b").alias("cid"), F.col("n_a").alias("links")))
    counts = counts.unionByName(covered.where("links >= 0").select(F.col("a").alias("cid"), "links")).groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(similar.select("a", "b").unionByName(covered.where("links < 0").select("a", "b")))
    table = classes.select("cid", "n", "first").join(counts, "cid", "left").join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    table = written(table)
    least = table.groupBy("root").agg(F.min("first").alias("class_id"))
    named = lookup(table, least, ["root"], ["cid"], "inner").select("cid", "n", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    out = lookup(own.select("doc_id", "cid"), written(named), ["cid"], ["doc_id"], n="n")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"), F.col("cid").alias("_cid"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text, ...) without the near-duplicates of a document that stays: the least doc_id of its class."""
    found = written(near_classes(docs.select("doc_id", "text"), similarity))
    gone = written(found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "_cid"))
    words = words_of(F.col("text"))
    kept = without(docs, gone, {"doc_id": F.col("doc_id"), "_cid": class_of(words)})
    again = found.where(F.col("_cid").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    return kept.where(F.size(words) == 0).unionByName(kept.where(F.size(words) > 0).dropDuplicates(["doc_id"]))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("_cid")
