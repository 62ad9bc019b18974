"""Whole repeated runs of lines against brute force."""

import random
from collections import Counter

import pytest

from tessella.llm import lines

from .cases import prose


def removed_by_chunks(rows, bounds):
    count, first, out = Counter(), {}, set()
    for i, t in rows:
        for c in bounds[i]:
            piece = "\n".join(t.split("\n")[c["first"] : c["last"] + 1])
            count[piece] += 1
            first.setdefault(piece, (i, c["first"]))
            if first[piece] != (i, c["first"]):
                out |= {(i, k) for k in range(c["first"], c["last"] + 1)}
    return out


def removed_by_runs(rows, least=50):
    """Every line of a run of `least` words, between two lines with words, that stands in an earlier text too."""
    out = set()
    for n, (j, b) in enumerate(rows):
        b = b.split("\n")
        for _, a in rows[:n]:
            a = a.split("\n")
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] != b[y] or (x and y and a[x - 1] == b[y - 1]):
                        continue
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                        k += 1
                    own = [y + o for o in range(k)]
                    while own and not b[own[0]].split():
                        own.pop(0)
                    while own and not b[own[-1]].split():
                        own.pop()
                    if sum(len(b[o].split()) for o in own) >= least:
                        out |= {(j, o) for o in own}
    return out


@pytest.mark.parametrize(("n_lines", "per_line"), [(3, 20), (5, 12), (8, 7), (20, 3), (4, 60)])
def test_whole_runs_go(spark, n_lines, per_line):
    shared, draw, rows = prose(900, n_lines * per_line, per_line).split("\n"), random.Random(n_lines), []
    shared[1:1] = ["", ""]
    for i in range(14):
        own = prose(i, 60, 9).split("\n")
        part = shared if i % 4 else shared[: len(shared) // 2 + 1]
        at = draw.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + part + own[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = {r["doc_id"]: r["c"] for r in df.select("doc_id", lines.chunk_bounds(df["text"]).alias("c")).collect()}
    runs = removed_by_runs(rows)
    assert len(runs) >= 9 * n_lines
    gone = runs | removed_by_chunks(rows, bounds)
    for r in lines.remove_repeats(df, lines.chunks_and_runs).collect():
        t = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for k, x in enumerate(t) if (r["doc_id"], k) not in gone)
        assert r["lines_removed"] == sum(i == r["doc_id"] for i, _ in gone)


def test_first_occurrence_of_a_line_said_over_and_over_stays(spark):
    line = "one two three four five six seven eight nine ten"
    (row,) = lines.remove_repeats(spark.createDataFrame([(1, "\n".join([line] * 40))], "doc_id long, text string"), lines.run_bounds).collect()
    assert row["text"] == "\n".join([line] * 5) and row["lines_removed"] == 35


def test_op2_takes_whole_runs(spark, tmp_path):
    shared = prose(901, 60, 20)
    rows = [(i, prose(i, 40, 10) + "\n" + shared + "\n" + prose(50 + i, 40, 10)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["lines_removed"] >= 3 for r in lines.op2_lines(spark, str(tmp_path)).collect()} == {i: i > 0 for i in range(12)}


def test_very_long_texts(spark):
    """Twice the same 20,000 lines, and once with a line changed here and there."""
    draw = random.Random(6)
    own = [" ".join(draw.choices(["river", "stone", "light", "cloud", "paper"], k=draw.randrange(1, 20))) + f" {k}" for k in range(20_000)]
    other = [f"changed {k}" if k % 500 == 250 else x for k, x in enumerate(own)]
    rows = [(1, "\n".join(own)), (2, "\n".join(own)), (3, "\n".join(other))]
    got = {r["doc_id"]: r for r in lines.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), lines.chunks_and_runs).collect()}
    assert [got[i]["lines_removed"] for i in (1, 2, 3)] == [0, 20_000, 19_960] and got[2]["text"] == ""
    assert got[3]["text"].split("\n") == [x for x in other if x.startswith("changed")]


def test_kept_lines_of_overlapping_drops(spark):
    from pyspark.sql import functions as F

    draw, rows = random.Random(9), []
    for i in range(200):
        n = draw.randrange(1, 30)
        drops = sorted((a, min(n - 1, a + draw.randrange(6))) for a in (draw.randrange(n) for _ in range(draw.randrange(1, 8))))
        rows.append((i, [f"l{k}" for k in range(n)], drops))
    df = spark.createDataFrame(rows, "i int, lines array<string>, drops array<struct<first:int,last:int>>")
    got = {r["i"]: r["k"] for r in df.select("i", lines._kept(F.col("lines"), F.col("drops")).alias("k")).collect()}
    assert got == {i: [x for k, x in enumerate(own) if not any(a <= k <= b for a, b in drops)] for i, own, drops in rows}


def test_hashes_only_propose(spark, monkeypatch):
    """With a hash that is the same for many spans, only those of equal bytes would go; a hash that stands for several removes nothing."""
    from pyspark.sql import functions as F

    rows = [(1, "one\n" + "a " * 60), (2, "two\n" + "a " * 60), (3, "three\n" + "b " * 60), (4, "four\n" + "b " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = lambda t: F.array(F.struct(F.lit(1).alias("first"), F.lit(1).alias("last")))
    real = F.xxhash64
    got = lambda: {r["doc_id"]: r["lines_removed"] for r in lines.remove_repeats(df, bounds).collect()}
    assert got() == {1: 0, 2: 1, 3: 0, 4: 1}
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 and not isinstance(c[0], str) else real(*c))
    assert got() == {1: 0, 2: 0, 3: 0, 4: 0}
    monkeypatch.setattr(lines, "SMALL_HASHES", 0)
    assert got() == {1: 0, 2: 0, 3: 0, 4: 0}
    monkeypatch.undo()
    monkeypatch.setattr(lines, "SMALL_HASHES", 0)
    assert got() == {1: 0, 2: 1, 3: 0, 4: 1}
