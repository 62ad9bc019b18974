"""Decontamination finds every overlap that its rule names."""

import itertools
import random

import pytest

from tessella.llm import decontamination

from .cases import prose


def found(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()}


@pytest.mark.parametrize("n", [11, 12, 13])
def test_every_two_substitutions_leave_a_seed(spark, n):
    item = [f"w{k}" for k in range(n)]
    rows, whole = [], []
    for i, gone in enumerate(itertools.combinations(range(n), 2)):
        words = [f"other{i}" if k in gone else w for k, w in enumerate(item)]
        rows.append((i, " ".join(["before", *words, "after"])))
        whole.append((1000 + i, " ".join(words)))  # a document that has nothing else
    assert found(spark, rows + whole, [(1, " ".join(item))]) == {(i, 1) for i, _ in rows + whole}


def test_every_fifth_word_replaced(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (15, 20, 40, 59)]
    rows = [(n, "x " + " ".join("y" if k % 5 == 4 else w for k, w in enumerate(t.split())) + " z") for n, t in items]
    assert found(spark, rows, items) == {(n, n) for n, _ in items}


def test_equals_brute_force(spark):
    items = [(k, prose(3000 + k, 11 + k % 20)) for k in range(40)]
    draw, rows = random.Random(5), []
    for i in range(160):
        words = items[i % 40][1].split()
        for k in draw.sample(range(len(words)), i % 6):
            words[k] = f"swap{i}"
        own = prose(4000 + i, 30).split()
        own[10:10] = words[draw.randrange(3) :]
        rows.append((i, " ".join(own)))
    want = set()
    for i, t in rows:
        w = t.split()
        for k, x in items:
            y = x.split()
            n = min(13, len(y))
            for d in range(1 - len(y), len(w)):
                m = [0 <= d + j < len(w) and w[d + j] == y[j] for j in range(len(y))]
                if any(sum(m[a : a + n]) >= n - 2 for a in range(len(m) - n + 1)):
                    want.add((i, k))
                    break
    assert len(want) > 80 and found(spark, rows, items) == want


def test_shuffled_seeds_take_time_in_proportion(spark, monkeypatch):
    """One text of four times the words takes four times the time at most, where seeds are shuffled."""
    import time

    monkeypatch.setattr(decontamination, "MOST_BLOCKS", 0)
    items = spark.createDataFrame([(1, prose(1, 30, 100)), (2, prose(2, 40, 100))], "item_id long, text string")
    took = []
    for n in (5_000, 20_000, 80_000):
        text = prose(9, n, 50) + "\n" + prose(1, 30, 100)
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        found = decontamination.overlaps(docs, items, ["doc_id"]).collect()
        took.append(time.time() - start)
        assert [(r["item_id"], r["matched"]) for r in found] == [(1, 30)]
    assert took[2] < 4 * max(took[1], 2.0)


def test_filter_of_seeds_loses_none(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("mask"), F.xxhash64("id").alias("seed"))
    items = rows.where("seed % 7 = 0")
    for slots in (1, 8, 1 << 12):
        kept = decontamination._maybe(rows, items, slots)
        assert items.exceptAll(kept).count() == 0 and kept.columns == rows.columns and kept.exceptAll(rows).count() == 0
    assert kept.count() < 600
