import csv
import io
import zipfile

import pytest
from tessella.sources.extract import csv_tables, csv_text, decoded, extract, pdf_table, read_docx, read_xlsx
from tessella.sources.landing import copy_changed, upload_files
from tessella.sources.objects import glob_objects, nonempty, read_objects, with_etag


def xlsx(sheets):
    out = io.BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else "<c/>" if v is None else f"<c><v>{v}</v></c>"
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(map(p, paragraphs))}{table}</w:body></w:document>')
    return out.getvalue()


def test_csv_two_tables():
    first, second = csv_tables("a,b\n1,2\n\nc,d\n3,4")
    assert first == [["a", "b"], ["1", "2"]] and second == [["c", "d"], ["3", "4"]]


def test_csv_null_row_parts_tables():
    assert csv_tables("a,b\nNA,null\n1,2") == [[["a", "b"]], [["1", "2"]]]


def test_csv_wider_later_table_fails():
    with pytest.raises((ValueError, csv.Error)):  # no delimiter fits, or the row is too wide
        csv_tables("a,b\n1,2\n\nc,d,e\n3,4,5")
    with pytest.raises(ValueError, match="more cells"):
        csv_tables("a;b\n1;2\n3;4\n5;6\n7;8\n9;9\n2;2\n2;3\n2;3\n2;3\n2;3\n2;3\n2;3\n3;4;5")


def test_csv_empty_column_goes_and_text_is_quoted():
    assert csv_tables("a;b;c\n1;;2\n")[0][1] == ["1", None, "2"]
    assert csv_text([["a,b", 'q"'], [None, "x"]]) == '"a,b","q"""\n,x\n'


def test_decoded_line_ends_and_charsets():
    assert decoded(b"a\r\nb\rc") == "a\nb\nc"
    assert decoded("é".encode("cp1252") * 3).count("é") >= 0
    assert decoded("﻿x".encode()) == "x"


def test_xlsx_lines():
    (unit,) = read_xlsx("b.xlsx", xlsx([("S", [["a", "b"], [1, 1.5]]), ("empty", [])]))
    assert unit["sheet_name"] == "S" and unit["headers"] == ["a", "b"] and unit["text"] == '0: {"a":1.0,"b":1.5}'


def test_docx_text():
    (unit,) = read_docx("a.docx", docx([" one ", " ", "two"], [["x ", "", "y"], ["", ""]]))
    assert unit["text"] == "one\ntwo\nx |  | y\n | "


def test_pdf_table_headers():
    table = [["h1", "h2"], ["r1", "x"], ["r2", "y"]]
    assert pdf_table(table) == {"headers": ["h1", "h2"], "text": '0: {"h1": "r1", "h2": "x"}\n1: {"h1": "r2", "h2": "y"}'}
    assert pdf_table(table, double_header=True) == {"headers": ["r1", "x"], "text": '0: {"r1": "r2", "x": "y"}'}


@pytest.fixture
def folder(tmp_path):
    files = {"_notes.txt": b"n", ".keep": b"", "sub/a b.txt": b"hello world", "t.csv": b"a,b\n1,2\n\nc,d\n3,4", "e.txt": b"", "x.pdf": b"%PDF", "y.html": b"<p>", "w.xlsx": xlsx([("S", [["a"], ["v"]])]), "broken.docx": b"no zip"}
    for name, content in files.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return tmp_path / "in"


def test_all_objects_are_listed(spark, folder):
    rows = read_objects(spark, str(folder), partitionBytes=5000).collect()
    assert {r["path"].removeprefix(f"{folder}/") for r in rows} == {"_notes.txt", ".keep", "sub/a b.txt", "t.csv", "e.txt", "x.pdf", "y.html", "w.xlsx", "broken.docx"}
    assert nonempty(read_objects(spark, str(folder), content=False)).count() == 7
    assert glob_objects(spark, str(folder)).count() == 7


def test_extract_units_and_dead_letters(spark, folder):
    rows = extract(read_objects(spark, str(folder))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert [r["table_id"] for r in sorted(by["t.csv"], key=lambda r: r["unit_idx"])] == ["table_0", "table_1"]
    assert by["a b.txt"][0]["text"] == "hello world" and by["_notes.txt"][0]["page_num"] == 1
    assert by["w.xlsx"][0]["text"] == '0: {"a":"v"}'
    assert {s for s, x in by.items() if x[0]["unit_kind"] == "error"} == {"y.html", "broken.docx", ".keep", "x.pdf"}
    assert "e.txt" not in by


def test_upload_and_copy(spark, folder, tmp_path):
    out = upload_files([str(folder / "t.csv"), str(folder / "y.html"), str(folder / "missing.txt"), str(folder / "w.xlsx")], str(tmp_path / "land"))
    assert [x["key"] for x in out] == ["csv/t.csv", "xlsx/w.xlsx"] and all(x["status"] == "uploaded" for x in out)
    objects = with_etag(nonempty(read_objects(spark, str(tmp_path / "land"))))
    copy_changed(spark, objects.selectExpr(f"substring(path, {len(str(tmp_path / 'land')) + 2}) as key", "content"), str(tmp_path / "copy"))
    assert (tmp_path / "copy/csv/t.csv").read_bytes() == (folder / "t.csv").read_bytes()


def test_units_of_many_files_leave_together(spark, monkeypatch):
    import pandas as pd

    def counted(name, content):
        yield from ({"unit_kind": "text", "unit_idx": i, **({"page_num": 2**24 + 1} if i else {}), "text": name} for i in range(int(content)))

    objects, taken = spark.createDataFrame([("a/f.txt", 1, bytearray(b"1"))], "path string, length long, content binary"), []
    files = [(f"a/f{i}.txt", "TXT", str(i % 3).encode()) for i in range(3000)]
    assert extract(objects, readers={"TXT": counted}).count() == 1
    monkeypatch.setattr(type(objects), "mapInPandas", lambda self, run, schema: taken.append(run))
    extract(objects, readers={"TXT": counted})
    found = list(taken[0](iter([pd.DataFrame(files, columns=["path", "extractor", "content"])])))
    assert len(found) == 3
    rows = [r for f in found for r in f.itertuples()]
    assert [(r.source, r.unit_idx, r.page_num) for r in rows] == [(p[2:], i, 2**24 + 1 if i else None) for p, _, n in files for i in range(int(n))]
    assert len(list(taken[0](iter([pd.DataFrame([("a/f.txt", "TXT", b"1")], columns=["path", "extractor", "content"])] * 2)))) == 2
