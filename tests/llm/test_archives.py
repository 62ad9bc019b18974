"""Names of captures, repeated rows, and archives of pages of all sizes."""

import random

from pyspark.sql import functions as F

from tessella.llm import warc
from tessella.llm.common import scratch


def test_names_are_the_same_however_rows_are_dealt(spark):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"page {i % 7} " * 300) for i in range(60)], "page_id long, url string, html string")
    name = lambda rows: {r["page_id"]: (r["capture"], r["revisits"]) for r in warc.plan_captures(rows).select("page_id", "capture", "revisits").collect()}
    assert name(df) == name(df.repartition(7)) == name(df.orderBy(F.rand(3)))


def test_sizes_have_files_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZE_CLASSES", ((100, 6000), (2000, 12), (20000, 6)))
    draw = random.Random(1)
    rows = [(i, f"http://a/{i}", "".join(draw.choices("abcdef ", k=draw.choice([5, 90, 1500, 15000, 40000])))) for i in range(80)] + [(100, "http://b", "x" * 30000), (101, "http://b", "x" * 30000)]
    path = scratch(spark)
    got = {r["page_id"]: r for r in warc.digest_rows(warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path)).collect()}
    assert {i: r["payload_bytes"] for i, r in got.items()} == {i: len(h) for i, _, h in rows}
    assert (got[100]["record_type"], got[100]["refers_to"]) == ("revisit", 101) and all(r["digest_ok"] for i, r in got.items() if i != 100)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()
    assert {r["path"].split("/")[-2] for r in files} == {"0", "1", "2", "3"}
    for f in [r["path"] for r in files if "/3/" in r["path"]]:
        assert len(list(warc.parse(open(f.removeprefix("file:").replace("//", "/"), "rb").read(), False))) <= 3


def test_rows_that_are_alike_stay_apart(spark):
    rows = [(1, "http://a", "same " * 300)] * 3 + [(2, "http://a", "same " * 300)] * 2 + [(3, "http://b", "tiny")] * 2
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.digest_rows(warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark))).collect()]
    assert sorted(got, key=str) == sorted([(1, "revisit", 2)] * 3 + [(2, "response", None), (2, "revisit", 2)] + [(3, "response", None)] * 2, key=str)
