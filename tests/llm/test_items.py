"""Short items, and more items than are broadcast."""

import random

from tessella.llm import decontamination

from .cases import prose


def test_short_items_stand_whole(spark):
    items = [(k, prose(3000 + k, k)) for k in (1, 4, 5, 7, 10)] + [(50, None), (51, prose(3000 + 7, 7))]
    rows = []
    for i, (k, t) in enumerate(items[:5]):
        words = prose(i, 30).split()
        rows += [(10 * i, " ".join(words[:9] + t.upper().split() + words[9:])), (10 * i + 1, " ".join(words[:9] + t.split()[:-1] + ["else"] + words[9:])), (10 * i + 2, t)]
    got = {tuple(r) for r in decontamination.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).select("doc_id", "item_id", "item_words", "matched", "start").collect()}
    want = {(10 * i + j, m, k, k, start) for i, (k, _) in enumerate(items[:5]) if k >= 5 for j, start in ((0, 9), (2, 0)) for m in ([7, 51] if k == 7 else [k])}
    assert got == want


def test_shuffled_seeds_equal_blocks(spark, monkeypatch):
    draw, items = random.Random(4), [(k, prose(2000 + k, 150)) for k in range(8)]
    rows = []
    for i in range(24):
        words = items[i % 8][1].split()[20 + i : 90]
        for _ in range(i % 4):
            words[draw.randrange(len(words))] = f"swap{i}"
        rows.append((i, prose(i, 30) + " " + " ".join(words) if i % 3 else prose(i, 60)))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, None), (103, "few words")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontamination.overlaps(docs, table, ["doc_id"]).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_SEGMENTS", 1)
    assert sorted(map(tuple, decontamination.overlaps(docs, table, ["doc_id"]).collect())) == one and len(one) >= 16
