"""The vector table's buckets, folded log, and writers beside each other."""

import pytest
from pyspark.sql import functions as F
from tessella.operators.snapshot import Snapshot
from tessella.operators.store import VectorTable


def points(spark, rows):
    made = spark.createDataFrame(rows, "object_key string, text string")
    return made.withColumns({"source": F.substring_index("object_key", "/", -1), "unit_kind": F.lit("text"), "unit_idx": F.lit(0), "chunk_idx": F.lit(0), "embedding": F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")})


def texts(table, **how):
    return sorted((r["object_key"], r["text"]) for r in table.live(**how).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    out = VectorTable(spark, str(tmp_path / "t"), 2, buckets=8)
    out.upsert(points(spark, [(f"k/{i}", f"old {i}") for i in range(40)]))
    return out


def test_an_upsert_beside_a_compaction_stays(spark, table, monkeypatch):
    write = table._write

    def slow(rows, name):
        write(rows, name)
        if name.startswith("base-"):
            monkeypatch.setattr(table, "_write", write)
            table.upsert(points(spark, [("k/0", "new 0"), ("k/99", "new 99")]))
            table.delete(["k/1"])

    monkeypatch.setattr(table, "_write", slow)
    assert table.compact()
    want = sorted([("k/0", "new 0"), ("k/99", "new 99"), *[(f"k/{i}", f"old {i}") for i in range(2, 40)]])
    assert texts(table) == want
    table.vacuum()
    assert texts(table) == want
    assert table.compact() and texts(table) == want


def test_of_two_compactions_one_counts(spark, table, monkeypatch):
    other, write = VectorTable(spark, table.path, 2), table._write

    def slow(rows, name):
        write(rows, name)
        if name.endswith("/points") and name.startswith("base-"):
            monkeypatch.setattr(table, "_write", write)
            assert other.compact()

    monkeypatch.setattr(table, "_write", slow)
    assert not table.compact()
    assert len(texts(table)) == 40 and len([n for n in table._files.names() if n.startswith("base-")]) == 1


def test_a_late_batch_comes_after_what_is_folded(spark, table):
    early = table.next_batch()
    table.upsert(points(spark, [("k/0", "middle")]))
    table.compact()
    table._write(points(spark, [("k/0", "late")]).withColumn("point_id", F.lit("p")).withColumn("bucket", F.lit(0)).select("point_id", "object_key", "source", "text", "embedding", "bucket"), f"points/batch_id={early}")
    table._commit(spark.createDataFrame([("k/0",)], "object_key string"), early)
    assert [t for k, t in texts(table) if k == "k/0"] == ["late"]


def test_the_log_folds_and_reading_needs_no_join(spark, table):
    for i in range(3):
        table.upsert(points(spark, [("k/0", f"again {i}")]))
    table.delete(["k/5", "7"])
    assert "Join" in plan(table.live())
    table.compact()
    table.vacuum()
    assert "Join" not in plan(table.live()) and table._batches() == [] and len(texts(table)) == 38
    assert table.next_batch() > max(table._base()[2])


def test_known_keys_read_their_buckets(spark, table):
    table.compact()
    table.upsert(points(spark, [("k/3", "new 3")]))
    asked = table.live(keys=["k/3", "k/4"])
    assert sorted((r["object_key"], r["text"]) for r in asked.collect()) == [("k/3", "new 3"), ("k/4", "old 4")]
    assert plan(asked).count("PartitionFilters: [") >= 2 and "bucket#" in plan(asked).split("PartitionFilters: [")[1].split("]")[0]


def test_writers_of_a_snapshot_do_not_lose_rows(spark, tmp_path):
    one, two = (Snapshot(spark, str(tmp_path / "s"), "k string") for _ in range(2))
    calls = []

    def add(df):
        if not calls:
            calls.append(1)
            two.update(lambda t: t.unionByName(spark.createDataFrame([("two",)], "k string")))
        return df.unionByName(spark.createDataFrame([("one",)], "k string"))

    one.update(add)
    assert sorted(r[0] for r in one.read().collect()) == ["one", "two"]
    one.vacuum()
    assert sorted(r[0] for r in two.read().collect()) == ["one", "two"] and len([n for n in one.pointers.names() if n.startswith("v-")]) == 1


def test_estimates_read_no_points(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "e"), 2, buckets=4).ensure()
    assert table.estimate() == {"points_at_most": 0, "keys": 0, "sources": 0, "length_quartiles": [None, None, None]}
    made = lambda a, b, long: points(spark, [("x", "x")]).drop("object_key", "source", "text").crossJoin(spark.range(a, b).select(F.concat(F.lit("k/"), F.col("id")).alias("object_key"), F.concat(F.lit("s"), F.col("id") % 3000).alias("source"), F.repeat(F.lit("x"), (F.col("id") % long).cast("int")).alias("text")))
    table.upsert(made(0, 20_000, 101))
    table.upsert(made(15_000, 30_000, 101))
    table.delete([f"k/{i}" for i in range(10_000)])
    table.upsert(made(0, 500, 101))
    for name in table._files.names("points"):  # nothing but sketches may be read
        table._files.fs.rename(table._files.at(f"points/{name}"), table._files.at(f"away-{name}"))
    got = table.estimate()
    assert got["points_at_most"] == 35_500 and abs(got["keys"] - 20_500) < 0.05 * 20_500 and abs(got["sources"] - 3000) < 0.05 * 3000
    assert all(abs(q - want) <= 5 for q, want in zip(got["length_quartiles"], (25, 50, 75), strict=True))
    for name in [n for n in table._files.names() if n.startswith("away-")]:
        table._files.fs.rename(table._files.at(name), table._files.at(f"points/{name[5:]}"))
    table.compact()
    table.vacuum()
    assert table.estimate()["points_at_most"] == table.stats()["vectors_count"] == 20_500
