"""The vector index against whole scans: exact results, recall, odd vectors, hot cells, plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import index as module
from tessella.operators.index import VectorIndex, recall
from tessella.plans import queries as q

DIM = 12


def clustered(n, seed, clusters=25):
    draw, centres = np.random.default_rng(seed), np.random.default_rng(0).normal(size=(clusters, DIM)) * 3
    return [(int(i), [float(x) for x in np.float32(centres[i % clusters] + draw.normal(size=DIM))]) for i in range(n)]


def brute(points, questions, k):
    own = [(i, np.array(v, dtype=float)) for i, v in points if i is not None and v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in questions:
        v = np.array(v, dtype=float)
        scored = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in own)
        out[i] = [(j, s) for s, j in scored[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "point_id long, embedding array<float>").withColumn("cell_name", F.lit("extra")).repartition(4)


def asked(spark, rows):
    return spark.createDataFrame(rows, "question_id long, embedding array<float>")


def got(df):
    out = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r["question_id"], []).append((r["id"], -round(r["score"], 9)))
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(3000, 1)
    return rows, VectorIndex.build(frame(spark, rows), str(tmp_path_factory.mktemp("index") / "a"), cells=30, subspaces=6)


def test_exact_is_a_whole_scan_and_probing_recalls(spark, built):
    rows, index = built
    questions = clustered(150, 2) + [(500 + i, v) for i, v in rows[:20]]
    exact = index.neighbours(asked(spark, questions), 5, exact=True)
    assert got(exact) == brute(rows, questions, 5)
    near = index.neighbours(asked(spark, questions), 5)
    assert recall(near, exact) >= 0.95 and index.probes < len(index.counts) and index.read_share() < 0.6


def test_one_question(spark, built):
    rows, index = built
    found = 0
    for i, v in clustered(8, 3):
        true = [j for j, _ in brute([r for r in rows if r[0] % 2 == 0], [(i, v)], 4)[i]]
        near = index.topk(v, 4, where="point_id % 2 = 0").orderBy("rank").collect()
        whole = index.topk(v, 4, probes=len(index.counts), where="point_id % 2 = 0").orderBy("rank").collect()
        assert [h["point_id"] for h in whole] == true and whole[0]["cell_name"] == "extra" and [h["rank"] for h in near] == [1, 2, 3, 4]
        found += len({h["point_id"] for h in near} & set(true))
    assert found >= 25


def test_cells_filter_reaches_the_scan(built):
    plan = built[1].topk(built[0][0][1], 4, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell," in plan and "In(point_id" in plan


def test_odd_vectors_ties_and_a_hot_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "QUESTIONS", 7)
    rows = clustered(300, 4)
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one vector over and over, in blocks
    rows += [(2000, None), (2001, [1.0]), (2002, [0.0] * DIM), (2003, [float("nan")] * DIM), (2004, [None] * DIM), (2005, [float("inf")] * DIM)]
    index = VectorIndex.build(frame(spark, rows), str(tmp_path / "i"), cells=6, subspaces=5, dimension=DIM, block=32)
    assert index.counts.sum() == 500 and index.model.parts.max() > 3
    questions = [(i, v) for i, v in rows[:40]] + [(600 + i, rows[7][1]) for i in range(30)]
    found = got(index.neighbours(asked(spark, [*questions, (9000, None), (9001, [0.0] * DIM)]), 6, exact=True))
    assert found == brute(rows, questions, 6)


def test_text_ids_few_points_and_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "point_id string, embedding array<float>")
    index = VectorIndex.build(rows, str(tmp_path / "few"))
    ask = spark.createDataFrame([(1, [3.0, 0.0])], "question_id long, embedding array<float>")
    assert [(r["id"], r["rank"]) for r in index.neighbours(ask, 5, exact=True).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    none = VectorIndex.build(rows.limit(0), str(tmp_path / "none"), dimension=2)
    assert none.neighbours(ask, 5, exact=True).count() == 0 == none.topk([1.0, 0.0], 3).count()


def test_best_of_equal_scores():
    scores = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    assert [x.tolist() for x in module._best(scores, 2)] == [[0, 0, 1, 1], [1, 2, 0, 1]]
    assert [len(x) for x in module._best(scores[:, :0], 2)] == [0, 0]


def test_recall_query(spark, sf):
    (row,) = q.QUERIES["index_recall"](spark, sf).collect()
    assert row["recall"] >= 0.9 and 0 < row["read_share"] <= 1 and row["questions"] > 0
