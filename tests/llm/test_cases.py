"""Nulls, empty and long texts, repeats, empty tables and clashing names: every operator and stage gives its defined result."""

import corpus_pipeline
import pytest

from tessella.llm import decontamination, extraction, language, lines, near, packing, quality, secrets, urls, warc
from tessella.llm.common import scratch

from .cases import documents, prose

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def items(spark, docs=True):
    return spark.createDataFrame([(1, prose(1, 20)), (2, None), (3, "short"), (None, prose(4, 12))] if docs else [], ITEMS)


def test_language(spark, docs, none):
    known = language.learn(docs)
    rows = {r["doc_id"]: r["language"] for r in language.classify(docs, known).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[7]["lang_pred"] == "und" and rows[3]["rejected"]
    assert rows[1]["lang_pred"] in known
    assert language.learn(none) == {} and language.classify(docs, {}).where("language.lang_pred <> 'und'").count() == 0
    assert language.classify(none, known).count() == 0


def test_lines(docs, none):
    out = lines.remove_repeats(docs).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[1]["lines_removed"] == 0 and by[2]["lines_removed"] > 0 and by[9]["lines_removed"] > 0
    assert by[3]["text"] is None and by[4]["text"] == "" and by[1]["hash"] == 7
    assert len({r["text"] for r in out if r["doc_id"] == 2}) == 1
    assert lines.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, none):
    out = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, items(spark), ["doc_id"]).collect()}
    assert out == {(1, 1), (2, 1), (9, 1), (9, None)}
    assert decontamination.overlaps(none, items(spark), ["doc_id"]).count() == 0
    assert decontamination.overlaps(docs, items(spark, False), ["doc_id"]).count() == 0
    left = decontamination.clean(docs, items(spark))
    assert left.columns == docs.columns and left.count() == docs.count() - 4


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[4]["kept"]
    assert by[6]["n_words"] == 30000
    assert quality.judge(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, packing.default_tokenizer()).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1 and len([r for r in rows if r["doc_id"] == 2]) == 2
    assert any(r["doc_id"] is None for r in rows)
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


def test_near(docs, none):
    rows = near.near_classes(docs).collect()
    assert len(rows) == docs.count()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[1] == classes[2] == classes[9] == 1 and classes[3] == 3 and classes[4] == 4 and classes[None] is None
    assert {r["doc_id"]: r["n_links"] for r in rows}[1] == 3
    assert near.near_classes(none).count() == 0
    left = near.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]


def test_near_keeps_one_of_repeated_rows(spark):
    rows = documents(spark, [(1, prose(9, 60), "en")] * 3 + [(2, prose(9, 60), "en"), (5, None, "en"), (5, None, "en")])
    assert sorted(r["doc_id"] for r in near.one_of_each(rows).collect()) == [1, 5, 5]


def test_secrets(docs, none):
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == docs.count() and all(r["secrets"] == [] for r in rows if r["doc_id"] in (3, 4))
    assert secrets.find_secrets(none).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string, key int, n int, capture int, digest int")


PAGES = [
    (1, "http://a.com/x/1", "<p>" + "word " * 300 + "</p>", "", "", 1, 1, 1, 1),
    (2, None, None, "", "", 1, 1, 1, 1),
    (3, "no scheme", "", "", "", 1, 1, 1, 1),
    (4, "http://B.a.com/x/2?q", "<p>" + "word " * 300 + "</p>", "", "", 1, 1, 1, 1),
    (4, "http://B.a.com/x/2?q", "<p>" + "word " * 300 + "</p>", "", "", 1, 1, 1, 1),
    (None, "http://c.org", "x", "", "", 1, 1, 1, 1),
]


def test_extraction(spark):
    rows = extraction.extract_pages(pages(spark, PAGES)).collect()
    assert [r["main_text"] for r in rows if r["page_id"] in (2, 3)] == ["", ""]
    assert extraction.extract_pages(pages(spark, [])).count() == 0


def test_warc(spark):
    rows = warc.digest_rows(warc.archive_pages(pages(spark, PAGES), scratch(spark))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows) == [(0, "response", None), (1, "revisit", 4), (2, "response", None), (3, "response", None), (4, "response", None), (4, "revisit", 4)]
    assert {r["payload_bytes"] for r in rows if r["page_id"] in (1, 4)} == {1507}
    assert warc.digest_rows(warc.archive_pages(pages(spark, []), scratch(spark))).count() == 0


def test_urls(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (2, None)], "key long, label int")
    rows = urls.judge_urls(pages(spark, PAGES), labels).collect()
    assert len(rows) == len(PAGES)
    by = {r["page_id"]: r for r in rows}
    assert (by[2]["host"], by[2]["path"], by[2]["rule"]) == ("", "", None) == (by[3]["host"], by[3]["path"], by[3]["rule"])
    assert (by[4]["host"], by[4]["path"], by[4]["rule"], by[4]["verdict"]) == ("b.a.com", "/x/2", "com/", "allow")
    assert (by[None]["host"], by[None]["path"], by[None]["rule"]) == ("c.org", "", None)
    assert urls.judge_urls(pages(spark, []), labels.limit(0)).count() == 0


def test_stages(spark, docs, none, tmp_path):
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, str(tmp_path))
            assert name == "packing" or after.columns == now.columns
            after.write.parquet(str(tmp_path / f"{name}{table is none}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{table is none}"))
        assert (now.count() > 0) == (table is docs)
