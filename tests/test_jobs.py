"""Uploads with metadata, incremental copies, deletes, listings, dead letters and unfinished batches."""

import datetime

import pytest
from pyspark.sql import functions as F
from tessella.functions.text import folded, utc_time
from tessella.operators.cdc import META, upsert_metadata
from tessella.operators.snapshot import MetadataTable, copy_state
from tessella.operators.store import VectorTable
from tessella.plans.copies import copy_new, delete_documents, put, upload
from tessella.plans.ingest import ingest, points_of
from tessella.plans.queries import QUERIES
from tessella.sources.extract import csv_tables, decoded, read_xlsx
from tessella.sources.objects import folder_listing, list_store, read_objects, store_objects
from tessella.sources.office import workbook_bytes


@pytest.fixture
def folder(tmp_path):
    for name, content in {"a.txt": b"one", "sub/b.txt": b"two", "_hidden.txt": b"three", "empty.txt": b"", "bad.html": b"<p>"}.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return tmp_path / "in"


def test_copies_go_once(spark, folder, tmp_path):
    source, target, state = str(folder), str(tmp_path / "out"), str(tmp_path / "state")
    assert copy_new(spark, source, target, state) == {"copied": 5, "state": 5}
    assert (tmp_path / "out/sub/b.txt").read_bytes() == b"two" and (tmp_path / "out/empty.txt").read_bytes() == b""
    version = copy_state(spark, state).version()
    (tmp_path / "out/a.txt").write_bytes(b"untouched")
    assert copy_new(spark, source, target, state) == {"copied": 0, "state": 5}
    assert (tmp_path / "out/a.txt").read_bytes() == b"untouched" and copy_state(spark, state).version() == version
    (folder / "a.txt").write_bytes(b"changed")
    (folder / "sub/b.txt").unlink()
    assert copy_new(spark, source, target, state) == {"copied": 1, "state": 5}
    assert (tmp_path / "out/a.txt").read_bytes() == b"changed" and (tmp_path / "out/sub/b.txt").exists()


def test_copies_to_a_uri(spark, folder, tmp_path):
    assert copy_new(spark, f"file://{folder}", f"file://{tmp_path}/out", str(tmp_path / "state"))["copied"] == 5
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a.txt": b"one", "sub/b.txt": b"two", "_hidden.txt": b"three", "empty.txt": b"", "bad.html": b"<p>"}


def test_upload_writes_metadata_by_version(spark, folder, tmp_path):
    table = MetadataTable(spark, str(tmp_path / "meta"))
    assert table.scan().count() == 0
    paths = [str(folder / "a.txt"), str(folder / "bad.html"), str(folder / "none.txt")]
    assert [x["key"] for x in upload(spark, paths, str(tmp_path / "land"), table)] == ["txt/a.txt"]
    upload(spark, paths, str(tmp_path / "land"), table)
    assert table.scan().count() == 1
    (folder / "a.txt").write_bytes(b"more")
    upload(spark, paths[0], str(tmp_path / "land"), table)
    rows = table.scan("filename = 'a.txt'").orderBy("size").collect()
    assert [(r["object_key"], r["size"], r["uri"], r["file_type"]) for r in rows] == [("txt/a.txt", n, "s3://documents/txt/a.txt", "txt") for n in (3, 4)]


def test_equal_times_give_one_defined_row(spark):
    at = datetime.datetime(2024, 1, 1)
    row = lambda n, size: (n, "b", "f", "t", size, "e", at, "u", at)
    known, new = spark.createDataFrame([row("k", 9), row("x", 1)], META), spark.createDataFrame([row("k", 5), row("k", 7)], META)
    assert {r["object_key"]: r["size"] for r in upsert_metadata(known, new).collect()} == {"k": 7, "x": 1}


def test_delete_takes_object_and_vectors(spark, folder, tmp_path):
    table = VectorTable(spark, str(tmp_path / "store"), 768)
    ingest(spark, str(folder), table)
    out = delete_documents(spark, table, str(folder), ["a.txt", "sub/b.txt", "missing.txt", "sub"])
    assert out["deleted"][:3] == ["a.txt", "sub/b.txt", "missing.txt"] and not (folder / "a.txt").exists()
    assert {r["source"] for r in table.live().select("source").collect()} == {"_hidden.txt"}
    put(spark, {"deep/x.txt": b"kept", "deep/y.txt": b"z"}, str(folder))
    out = delete_documents(spark, table, str(folder), ["deep", "_hidden.txt"])
    assert [e["name"] for e in out["errors"]] == ["deep"] and out["deleted"] == ["_hidden.txt"] and (folder / "deep/x.txt").exists()
    assert table.live().count() == 0


def test_ingest_counts_dead_letters_and_keeps_extra(spark, folder, tmp_path):
    table = VectorTable(spark, str(tmp_path / "store"))
    out = ingest(spark, str(folder), table, extra={"team": "a", "empty": ""})
    assert out["n_failed"] == 1 and out["failed"][0]["object_key"].endswith("bad.html")
    assert all(r["extra"] == {"team": "a"} for r in table.live().select("extra").collect())
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("units-")] and (tmp_path / "store/failed").exists()


def test_batch_that_dies_before_its_commit_changes_nothing(spark, folder, tmp_path, monkeypatch):
    table = VectorTable(spark, str(tmp_path / "store"))
    ingest(spark, str(folder), table)
    before = sorted(r[0] for r in table.scroll().collect())
    (folder / "a.txt").write_bytes(b"another text")

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", die)
        with pytest.raises(RuntimeError):
            table.upsert(points_of(read_objects(spark, str(folder))))
    assert sorted(r[0] for r in table.scroll().collect()) == before
    table.upsert(points_of(read_objects(spark, str(folder))))
    assert {r["text"] for r in table.live().select("text").collect()} == {"another text", "two", "three"}


def test_batches_go_up_whatever_the_clock_says(spark, folder, tmp_path, monkeypatch):
    table = VectorTable(spark, str(tmp_path / "store"))
    first = table.upsert(points_of(read_objects(spark, str(folder))))
    monkeypatch.setattr("tessella.operators.store.time.time_ns", lambda: 5)
    assert table.upsert(points_of(read_objects(spark, str(folder)))) == first + 1 and table.live().count() == 3


def test_store_listing_equals_the_folder(spark, folder):
    uri = f"file://{folder}"
    short = lambda df: sorted((r["path"].rsplit("/in/", 1)[1], r["length"]) for r in df.collect())
    assert short(list_store(spark, uri)) == short(read_objects(spark, uri, content=False))
    got = {r["path"].rsplit("/in/", 1)[1]: r["content"] for r in store_objects(spark, uri).collect()}
    assert got == {"a.txt": b"one", "sub/b.txt": b"two", "bad.html": b"<p>", "empty.txt": b"", "_hidden.txt": None}
    kinds = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["size"]) for r in folder_listing(spark, uri).collect()}
    assert kinds["sub"][0] == "directory" and kinds["a.txt"] == ("file", 3) and len(kinds) == 5


@pytest.mark.parametrize("mark", ["NA", "#N/A N/A", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN", "n/a", "null"])
def test_null_markers_part_tables(mark):
    assert csv_tables(f"a,b\n1,2\n{mark},{mark}\n3,4\n5,6") == [[["a", "b"], ["1", "2"]], [["3", "4"], ["5", "6"]]]


TEXTS = {
    "cp1252": ["La rivière coule le long de la forêt, où la lumière est très belle. ", "Der Fluß fließt über die Straße, und das Licht ist schön. ", "El niño comió piña en el jardín, según la señora. "],
    "cp1250": ["Příliš žluťoučký kůň úpěl ďábelské ódy, když řeka tekla kolem města. ", "Zażółć gęślą jaźń, a rzeka płynie wzdłuż cichego kamienia źródła. "],
    "cp1251": ["Река течёт вдоль тихого камня, и свет севера лежит на бумаге дома. "],
}


@pytest.mark.parametrize(("charset", "text"), [(c, t) for c, own in TEXTS.items() for t in own])
def test_charsets(charset, text):
    text = text * 10
    assert [decoded(text.encode(c)) for c in (charset, "utf-8", "utf-8-sig", "utf-16")] == [text] * 4


def test_dates_in_worksheets():
    day = datetime.datetime(2024, 2, 29, 6, 30)
    (unit,) = read_xlsx("x.xlsx", workbook_bytes({"S": [["d", "n"], [day, 45000], [datetime.datetime(1899, 12, 30, 10, 15), 0.5]]}))
    assert unit["text"] == '0: {"d":1709188200000,"n":45000}\n1: {"d":"10:15:00","n":0.5}'


def test_wrapped_and_utc(spark):
    rows = spark.createDataFrame([("one two three\nfour", datetime.datetime(2024, 1, 1, 12)), (None, None)], "t string, at timestamp")
    got = rows.select(folded(F.col("t"), 8).alias("t"), utc_time(F.col("at")).alias("at")).collect()
    assert [tuple(r) for r in got] == [("one two\n\nthree\n\nfour", "2024-01-01T12:00:00"), (None, None)]


def test_queries_without_sql_run(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '\\\\S'").count()
    rows = QUERIES["sentence_chunks"](spark, sf)
    assert rows.select("doc_id").distinct().count() == n and rows.where("chunk_idx >= n_chunks").count() == 0
