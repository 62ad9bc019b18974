"""Hard negatives against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, anchor int, v int"


def brute(rows, n_positives=5, n_negatives=5, least=80):
    own = []
    for i, v, g in rows:
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, (g + 1) % 10 if i % 7 == 0 else g, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, g, v in own:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, h) for j, h, w in own if j != i)
        for s, j, _ in [x for x in scored if x[2] == g][:n_positives]:
            close = [x for x in scored if x[2] != g and least * -s <= 100 * -x[0] <= 100 * -s][:n_negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(close)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = negatives.numbers(df.repartition(5), label)
    return sorted(tuple(r) for r in negatives.mine(own, own.where("vec_id % 100 = 0"), **options).collect())


def vectors(n, width, labels, seed, spread=1.0):
    draw = random.Random(seed)
    return [(i, [float(np.float32(draw.gauss(0.2, spread))) for _ in range(width)], draw.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("anchor_bytes", [32 << 20, 8 * 6 * 3])
def test_brute_force_in_blocks(spark, anchor_bytes):
    rows = vectors(900, 6, 3, 1)
    rows += [(i, rows[400][1], i % 3) for i in range(900, 1200)]  # one vector over and over: ties
    rows[:6] = [(100, None, 1), (200, [None] * 6, 1), (300, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 2), (None, rows[6][1], 1), (600, rows[7][1], None)]
    got = mined(spark, rows, anchor_bytes=anchor_bytes)
    assert got == brute(rows) and len(got) > 50


def test_numbers_that_float64_cannot_hold(spark):
    rows = [(i, [x * 2.0**20 for x in v], g) for i, v, g in vectors(120, 3, 2, 2)]
    assert 256 * 2**20 * 256 * 2**20 > negatives.EXACT
    assert mined(spark, rows) == brute(rows) != []


def test_short_vectors_repeated_rows_and_empty_tables(spark):
    rows = [(100, [1.0], 1), (101, [1.0, 5.0], 1), (102, [], 1), (103, [0.9, 1.0, 9.0], 2), (103, [0.9, 1.0, 9.0], 2), (200, [0.0], 3)]
    assert mined(spark, rows) == brute(rows) == [(100, 101, 1, 103, 256 * 256, 256 * 230), (100, 101, 2, 103, 256 * 256, 256 * 230), (100, 102, 1, 200, 0, 0)]
    assert mined(spark, [*rows, rows[0]]) == sorted(2 * mined(spark, rows))  # an anchor of two rows is answered twice
    assert mined(spark, []) == [] == mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    with pytest.raises(Exception, match="Overflow|too large"):
        mined(spark, [(100, [1e18], 1), (101, [1e18], 1), (102, [1e18], 2)])


def test_running_best_keeps_ties_by_id():
    order = negatives._best((np.array([1, 0, 1, 1, 0]),), np.array([5, 3, 5, 9, 3]), np.array([8, 4, 2, 7, 1]), 2)
    assert order.tolist() == [4, 1, 3, 2]
