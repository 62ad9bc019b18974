import pytest
from pyspark.sql import functions as F
from tessella.functions import text as t


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names))
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("path", "base", "ext", "reader"),
    [
        ("a/A.PDF", "A.PDF", "pdf", "PDF"),
        ("b.Docx", "b.Docx", "docx", "DOCX"),
        ("c.doc", "c.doc", "doc", "DOCX"),
        ("d.ppt", "d.ppt", "ppt", "PDF"),
        ("e.md", "e.md", "md", "TXT"),
        ("f.msg", "f.msg", "msg", "TXT"),
        ("g.xlsx", "g.xlsx", "xlsx", "XLSX"),
        ("x.helm", "x.helm", "helm", None),
        ("x.html", "x.html", "html", None),
        ("x", "x", "", None),
        ("p/.keep", ".keep", "", None),
    ],
)
def test_routing(spark, path, base, ext, reader):
    p = F.col("p")
    assert one(spark, t.basename(p), p=path) == base
    assert one(spark, t.extension(p), p=path) == ext
    assert one(spark, t.extractor(p), p=path) == reader


@pytest.mark.parametrize(("name", "i", "key"), [("Data quality.txt", 0, "Dataqualitytxt0"), ("Khảo sát_v1.txt", 3, "Khostv1txt3")])
def test_object_key(spark, name, i, key):
    assert one(spark, t.object_key(F.col("n"), F.col("i")), n=name, i=i) == key


@pytest.mark.parametrize(("text", "want"), [("4: a\n9: b", "4 - 9"), ("4: a\n9: b\n", "4 - 9"), (" 7 :x", "7 - 7"), ("a\n9: b", "unknown"), ("", "unknown"), ("1:\r\n2:x\r3", "1 - 3")])
def test_row_range(spark, text, want):
    assert one(spark, t.row_range(F.col("t")), t=text) == want


@pytest.mark.parametrize(("note", "page"), [("Page 3: 2 image(s) detected", 3), ("no page", -1), ("Page  12", 12)])
def test_figure_page(spark, note, page):
    assert one(spark, t.figure_page(F.col("t")), t=note) == page


@pytest.mark.parametrize(("text", "blank"), [("", True), ("  \t", True), ("a", False), (None, True)])
def test_blank(spark, text, blank):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(t.is_blank(F.col("t"))).first()[0] is blank


def test_strip_etag_fold(spark):
    assert one(spark, t.strip(F.col("t")), t="  a b\n") == "a b"
    assert one(spark, t.etag(F.col("t")), t='"abc"') == "abc"
    assert t.fold("a b\nc", 100) == "a b\n\nc"
