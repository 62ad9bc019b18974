"""Classes and link counts against brute force, with crowds and a grid of many blocks."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import near
from tessella.llm.components import components

from .cases import prose


def sets(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, least=0.8):
    s = [sets(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= least * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {rows[i][0]: (min(groups[find(i)]), links[i]) for i in range(len(rows))}


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(5), []
    base = prose(77, 120)
    for i in range(60):  # a crowd: near copies of one text, no two alike
        words = base.split(" ")
        for _ in range(draw.randrange(1, 4)):
            words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
        out.append(" ".join(words))
    out += [base] * 7
    for k in range(10):  # pairs on either side of the threshold
        text = prose(200 + k, 100)
        words = text.split(" ")
        for _ in range(1 + k // 3):
            words[draw.randrange(len(words))] = f"other{k}"
        out += [text, " ".join(words)]
    out += [prose(500 + k, 60) for k in range(30)] + ["one two", "one two", "One, two!"]
    ids = draw.sample(range(1 << 55, (1 << 55) + 10_000), len(out))
    return list(zip(ids, out, strict=True))


def test_equals_brute_force(spark, rows):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_large_components_are_verified_by_band(spark, rows):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), group=8).collect()}
    assert got == brute(rows)


def test_passages_that_chain_a_component(spark):
    """Texts of two passages each, in a ring: every passage is a crowd of its own, all are one component."""
    parts = [prose(600 + k, 60) for k in range(6)]
    draw, out = random.Random(3), []
    for k in range(6):
        for _ in range(6):
            words = (parts[k] + " " + parts[(k + 1) % 6]).split(" ")
            words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            out.append(" ".join(words))
    rows = list(enumerate(out))
    want = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (4, 4096):
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.near_classes(frame, group=group).collect()} == want


def test_grid_of_small_blocks(spark, rows):
    texts = {i: t for i, t in rows[:67]}
    data = [(0, i, 1, near.grams(np.array([hash(w) for w in re.split(r"[\W_]+", t.lower()) if w])).view(np.int64).tolist()) for i, t in texts.items()]
    groups = spark.createDataFrame(data, "root long, cid long, n long, grams array<long>")
    out = near.grid(groups, 0.8, block=8).collect()
    want = brute(rows[:67])
    counts = defaultdict(int)
    for r in out:
        if r["links"] >= 0:
            counts[r["a"]] += r["links"]
    assert dict(counts) == {i: n for i, (_, n) in want.items()}
    edges = spark.createDataFrame([(r["a"], r["b"]) for r in out if r["links"] < 0], "a long, b long")
    least = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {i: least.get(i, i) for i in texts} == {i: c for i, (c, _) in want.items()}
    assert len(edges.collect()) < 67 * 67 / 4


def test_common_over_many_columns():
    draw = np.random.default_rng(1)
    x = [np.unique(draw.integers(0, 1 << 62, 50).astype(np.int64) - (1 << 61)) for _ in range(5)]
    x[1], x[4] = x[0][:30], np.concatenate([x[2][:9], x[3][:4]])
    got = near._common(x[:3], x[2:], columns=16)
    assert got.tolist() == [[len(set(a) & set(b)) for b in x[2:]] for a in x[:3]]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(10, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {k: 5 for k in range(10, 40)}


def test_bands_reach_the_recall():
    b = near.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)
