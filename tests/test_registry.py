"""Extractors added from outside, and table functions in SQL."""

from pyspark.sql import functions as F
from tessella.sources.office import workbook_bytes
from tessella.sources.registry import Extractors


def read_tsv(name, content):
    rows = [x.split("\t") for x in content.decode().splitlines()]
    yield {"unit_kind": "csv_table", "unit_idx": 0, "headers": rows[0], "text": f"{name}: {len(rows) - 1} row(s)"}


FILES = [("in/a.tsv", b"x\ty\n1\t2\n3\t4"), ("in/bad.tsv", b"\xff"), ("in/empty.tsv", b""), ("in/none.tsv", None), ("in/b.txt", b"text"), ("in/c.xyz", b"?")]


def objects(spark):
    return spark.createDataFrame(FILES, "path string, content binary").withColumn("length", F.coalesce(F.length("content"), F.lit(9)).cast("long"))


def test_an_extractor_is_added_without_a_change(spark):
    own = Extractors().add("TSV", ["tsv"], read_tsv, empty_ok=True)
    got = {r["source"]: (r["unit_kind"], r["text"]) for r in own.extract(objects(spark)).collect()}
    assert got["a.tsv"] == ("csv_table", "a.tsv: 2 row(s)") and got["b.txt"] == ("text", "text")
    assert {k for k, v in got.items() if v[0] == "error"} == {"bad.tsv", "none.tsv", "c.xyz"} and "empty.tsv" not in got
    assert {r["source"] for r in Extractors().extract(objects(spark)).where("unit_kind <> 'error'").collect()} == {"b.txt"}


def test_table_functions_in_sql(spark):
    names = Extractors().add("TSV", ["tsv"], read_tsv, empty_ok=True).register(spark)
    assert {"tsv_units", "txt_units", "xlsx_units", "sheet_rows"} <= set(names)
    objects(spark).createOrReplaceTempView("files")
    rows = spark.sql("select f.path, u.unit_kind, u.headers, u.text from files f, lateral tsv_units(f.path, f.content) u where f.path like '%tsv'").collect()
    got = {r["path"]: r for r in rows}
    assert got["in/a.tsv"]["headers"] == ["x", "y"] and {k for k, r in got.items() if r["unit_kind"] == "error"} == {"in/bad.tsv", "in/none.tsv"} and len(rows) == 3
    book = workbook_bytes({"S": [["a", "b"], [1, None]], "T": [["c"], [2.5]]})
    made = spark.createDataFrame([(1, book), (2, None), (3, b""), (4, b"no workbook")], "id int, content binary")
    rows = spark.sql("select id, s.* from {m}, lateral sheet_rows(content) s order by id, sheet_no, row_no", m=made).collect()
    assert [(r["id"], r["sheet_name"], r["row_no"], r["cells"]) for r in rows[:4]] == [(1, "S", 0, ["a", "b"]), (1, "S", 1, ["1"]), (1, "T", 0, ["c"]), (1, "T", 1, ["2.5"])] or rows[1]["cells"] == ["1", None]
    assert rows[-1]["id"] == 4 and rows[-1]["error"] and len(rows) == 5
