"""Jobs that tell the truth: long files, keys, failures, names that lead out, metadata of what was uploaded."""

import os

import pytest
from pyspark.sql import functions as F
from tessella.operators.snapshot import MetadataTable, copy_state
from tessella.operators.store import VectorTable
from tessella.plans.copies import copy_new, delete_documents, put, upload
from tessella.sources import landing
from tessella.sources.objects import list_objects, read_objects, relative, with_listed_etag


LONG = 70 << 20


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_a_long_file_is_copied_without_being_a_row(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "small.txt").write_bytes(b"small")
    with open(source / "long.bin", "wb") as f:  # a hole, but for its ends
        f.write(b"first")
        f.truncate(LONG + 1)
        f.seek(LONG)
        f.write(b"x")
    assert {r["content"] is None for r in read_objects(spark, str(source), maxLength=4).collect()} == {True}  # what a row can't hold
    assert copy_new(spark, str(source), str(target), str(tmp_path / "state")) == {"copied": 2, "state": 2}
    assert os.path.getsize(target / "long.bin") == LONG + 1 and (target / "small.txt").read_bytes() == b"small"
    with open(target / "long.bin", "rb") as f:
        assert f.read(5) == b"first" and f.seek(LONG) and f.read() == b"x"
    assert copy_new(spark, str(source), str(target), str(tmp_path / "state")) == {"copied": 0, "state": 2}


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_keys_are_what_follows_the_root(spark, tmp_path, scheme):
    root = tmp_path / "in"
    inner = root / str(root).lstrip("/")  # a folder below that repeats the root's path
    inner.mkdir(parents=True)
    (root / "a.txt").write_bytes(b"outer")
    (inner / "a.txt").write_bytes(b"inner")
    assert copy_new(spark, f"{scheme}{root}", str(tmp_path / "out"), str(tmp_path / "state"))["copied"] == 2
    assert files_of(tmp_path / "out") == files_of(root)
    stray = spark.createDataFrame([("/elsewhere/a.txt",)], "path string")
    with pytest.raises(Exception, match="not below"):
        relative(stray, str(root)).collect()


def test_failures_are_told_and_tried_again(spark, tmp_path):
    source, target, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    for name in ("a", "b", "c/d"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(name.encode())
    target.mkdir()
    (target / "c").write_bytes(b"a file where a folder should be")
    got = copy_new(spark, str(source), str(target), state)
    assert (got["copied"], got["failed"], got["state"]) == (2, 1, 2) and [e["file"] for e in got["errors"]] == ["c/d"] and got["errors"][0]["error"]
    assert {r["file_path"] for r in copy_state(spark, state).read().collect()} == {"a", "b"}
    (target / "c").unlink()
    assert copy_new(spark, str(source), str(target), state) == {"copied": 1, "state": 3} and files_of(target) == files_of(source)


def test_etags_of_content_and_of_listings(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_bytes(b"one")
    run = lambda content: copy_new(spark, str(source), str(tmp_path / "out"), str(tmp_path / f"state{content}"), content)["copied"]
    assert run(True) == run(False) == 1
    os.utime(source / "a", (1, 1))
    assert (run(True), run(False)) == (0, 1)
    plan = with_listed_etag(list_objects(spark, str(source))).select("etag")
    assert plan.first()[0] == f"{10**6:X}-3"


@pytest.mark.parametrize("name", ["../outside.txt", "a/../../outside.txt", "/etc/none", "", ".", "a/./b", "a//b", "file:/x", "s3://b/x", "a/.."])
def test_names_that_lead_out_are_refused(spark, tmp_path, name):
    root = tmp_path / "in"
    root.mkdir()
    (tmp_path / "outside.txt").write_bytes(b"stay")
    with pytest.raises(ValueError):
        landing.below(name)
    table = VectorTable(spark, str(tmp_path / "store"), 2)
    out = delete_documents(spark, table, str(root), [name])
    assert out["deleted"] == [] and out["errors"][0]["file"] == name and out["message"] == "Deleted 0 file(s), 1 error(s)."
    with pytest.raises(ValueError):
        put(spark, {"fine.txt": b"x", name: b"y"}, str(root))
    assert files_of(tmp_path) == {"outside.txt": b"stay"}


def test_upload_reads_only_what_it_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    land = tmp_path / "land/txt"
    land.mkdir(parents=True)
    (land / "unreadable.txt").symlink_to(tmp_path / "gone")  # a listing of the landing folder would fail on it
    table = MetadataTable(spark, str(tmp_path / "meta"))
    assert len(upload(spark, str(tmp_path / "a.txt"), str(tmp_path / "land"), table)) == 1
    (row,) = table.scan().collect()
    assert (row["object_key"], row["file_name"], row["path"], row["size"], row["etag"]) == ("txt/a.txt", "a.txt", "s3://documents/txt/a.txt", 3, "f97c5d29941bfb1b2fdab0874906ab82")


def test_copies_of_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "CHUNK", 3)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_bytes(b"0123456789")
    rows = list_objects(spark, str(source)).withColumn("key", F.lit("k/a"))
    (row,) = landing.copy_files(rows, f"file://{tmp_path}/out").collect()
    assert (row["copied"], row["md5"], row["error"]) == (10, "781e5e245d69b566979b86e28d23f2c7", None) and read_objects(spark, str(tmp_path / "out")).first()["content"] == b"0123456789"
