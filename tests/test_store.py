from functools import partial

import pytest
from pyspark.sql import functions as F
from tessella.operators.answer import NO_MATCH
from tessella.operators.embedding import HashedWords, embed
from tessella.operators.generation import generate, joined
from tessella.operators.store import VectorTable
from tessella.plans.ingest import ingest, points_of, question
from tessella.sources.objects import read_objects
from tessella.streaming.ingest import event_rates, ingest_stream


@pytest.fixture
def files(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "cats.txt").write_text("Cats purr and sleep. " * 40)
    (d / "dogs.txt").write_text("Dogs bark at night.")
    (d / "t.csv").write_text("name,age\nann,3\n")
    return d


small = partial(HashedWords, 32)


def test_ingest_is_idempotent_and_delete_undoes_it(spark, files, tmp_path):
    table = VectorTable(spark, str(tmp_path / "store"), 32)
    with pytest.raises(RuntimeError):
        table.live()
    assert table.delete(["x"])["deleted"] == ["x"]
    options = {"make": small, "size": 50, "overlap": 10}
    first = ingest(spark, str(files), table, **options)
    ids = {r[0] for r in table.scroll().collect()}
    second = ingest(spark, str(files), table, **options)
    assert first["points"] == second["points"] == len(ids) and first["failed"] == []
    assert {r[0] for r in table.scroll().collect()} == ids
    row = table.live().where("source = 't.csv'").first()
    assert row["unit_kind"] == "csv_table" and row["row_range"] == "unknown" and row["headers"] == ["name", "age"] and row["key"] == "tcsv0"
    table.delete(["dogs.txt"])
    assert table.live().where("source = 'dogs.txt'").count() == 0
    table.compact()
    table.vacuum()
    assert table.stats()["vectors_count"] == first["points"] - 1
    ingest(spark, str(files), table, **options)
    assert table.stats()["vectors_count"] == first["points"]
    (files / "cats.txt").write_text("")
    ingest(spark, str(files), table, **options)
    assert table.live().where("source = 'cats.txt'").count() == 0 and table.live().where("source = 'dogs.txt'").count() == 1
    assert table.reset().stats()["vectors_count"] == 0


def test_question(spark, files, tmp_path):
    table = VectorTable(spark, str(tmp_path / "store"), 32)
    table.ensure()
    assert question(table, "dogs?", make=small)["answer_with_refs"] == NO_MATCH
    table.upsert(points_of(read_objects(spark, str(files)), small))
    got = question(table, "who does bark at night", make=small)
    assert got["citations"][0]["source"] == "dogs.txt" and got["citations"][0]["page_number"] == "1" and "[1]" in got["answer_with_refs"]
    only = question(table, "who does bark at night", ["cats.txt"], make=small)
    assert {c["source"] for c in only["citations"]} == {"cats.txt"}
    failed = question(table, "dogs", make=small, model=lambda p: 1 / 0)
    assert "division" in failed["error"]
    with pytest.raises(ValueError):
        question(table, "  ", make=small)


def test_wrong_dimension_fails(spark, files, tmp_path):
    table = VectorTable(spark, str(tmp_path / "store"), 16)
    with pytest.raises(Exception, match="dimension"):
        table.upsert(points_of(read_objects(spark, str(files)), small))


def test_embed_keeps_order_and_drops_blank(spark):
    df = spark.createDataFrame([(1, "a"), (2, "   "), (3, "b"), (4, None)], "id int, text string")
    assert [r["id"] for r in embed(df, small).orderBy("id").collect()] == [1, 3]

    with pytest.raises(Exception, match="gave 0 vectors"):
        embed(df, lambda: lambda texts: []).collect()


def test_generate(spark):
    df = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string")
    rows = {r["id"]: r for r in generate(df, lambda: lambda p: f" {p.upper()} ").collect()}
    assert rows[1]["answer"] == "P" and rows[1]["error"] is None and "failed" in rows[2]["answer"]
    assert joined(['{"response": "a"}', "", '{"response": "b", "done": true}']) == "ab"


def test_stream_ingests_once(spark, files, tmp_path):
    table = VectorTable(spark, str(tmp_path / "store"), 32)
    for _ in range(2):
        ingest_stream(spark, str(files), table, str(tmp_path / "check"), make=small).awaitTermination()
    assert table.live().select("source").distinct().count() == 3
    n = table.stats()["vectors_count"]
    (files / "dogs2.txt").write_text("More dogs.")
    ingest_stream(spark, str(files), table, str(tmp_path / "check"), make=small).awaitTermination()
    assert table.stats()["vectors_count"] == n + 1


def test_event_rates_stream(spark, sf):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = event_rates(events).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
