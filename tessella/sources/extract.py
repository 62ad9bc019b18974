"""Files of mixed formats into units of text.

A unit is a page, table, sheet or whole file. Each reader takes (name, bytes) and yields
rows; a failure becomes a dead-letter row (unit_kind `error`) and not a failed task.
"""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EXTRACTORS, extractor
from ..operators.tables import row_json
from .batches import small_batches

UNITS = (
    "object_key string, source string, unit_kind string, unit_idx int, page_num int, sheet_name string, "
    "table_id string, headers array<string>, text string"
)
#: What is sampled to find an encoding, and a delimiter.
ENCODING_BYTES, DELIMITER_CHARS = 10_000, 2_048
#: Units that leave a worker together: a frame has a cost of its own, and units may be long.
FRAME_ROWS, FRAME_CHARS = 1_000, 4 << 20
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def encoding_of(content: bytes) -> str:
    """UTF-8 where the sample is valid (a cut last character counts as valid), else a guess."""
    sample = content[:ENCODING_BYTES]
    if sample[:3] == b"\xef\xbb\xbf":
        return "utf-8-sig"
    if sample[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for cut in range(4):
        try:
            sample[: len(sample) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            if len(content) <= ENCODING_BYTES:
                break
    try:
        from charset_normalizer import from_bytes

        found = from_bytes(sample)
        best = found.best()
        # of guesses that are as good, the charset of western Europe; its neighbours differ in a few letters only
        common = best is None or "cp1252" in best.could_be_from_charset
        common = common or any(m.encoding == "cp1252" and m.chaos <= best.chaos and m.coherence >= best.coherence - 0.1 for m in found)
        return "cp1252" if common else best.encoding
    except ImportError:
        return "cp1252"


def decoded(content: bytes) -> str:
    text = content.decode(encoding_of(content), "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def read_text(name: str, content: bytes) -> Iterator[dict]:
    if content:
        yield {"unit_kind": "text", "unit_idx": 0, "page_num": 1, "text": decoded(content)}


#: Cells that count as null.
_NULLS = frozenset(
    ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
)


def csv_tables(text: str) -> list[list[list[str | None]]]:
    """Tables of rows of cells; rows of nulls part them, columns without a value go."""
    delimiter = csv.Sniffer().sniff(text[:DELIMITER_CHARS]).delimiter
    rows = [[None if c in _NULLS else c for c in r] or [None] for r in csv.reader(io.StringIO(text), delimiter=delimiter)]
    width = len(rows[0]) if rows else 0
    if any(len(r) > width for r in rows):
        raise ValueError("a row has more cells than the first")
    found: list[list[list[str | None]]] = [[]]
    for r in rows:
        if any(c is not None for c in r):
            found[-1].append(r + [None] * (width - len(r)))
        elif found[-1]:
            found.append([])
    out = []
    for table in found:
        if table:
            keep = [i for i in range(width) if any(r[i] is not None for r in table)]
            out.append([[r[i] for i in keep] for r in table])
    return out


def csv_text(rows: list[list]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["" if c is None else c for c in r] for r in rows])
    return out.getvalue()


def read_csv(name: str, content: bytes) -> Iterator[dict]:
    if not content:
        return
    for i, table in enumerate(csv_tables(decoded(content))):
        text = csv_text(table)
        if text.strip():
            yield {"unit_kind": "csv_table", "unit_idx": i, "table_id": f"table_{i}", "headers": [c or "" for c in table[0]], "text": text}


#: The built-in number formats that show dates or times.
_DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
_FORMAT_NOISE = re.compile(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)
_EPOCH_DAY = 25_569  # 1970-01-01 as a serial number; workbooks that count from 1904 are 1,462 less


def _dates(z: zipfile.ZipFile, names: set[str]) -> list[bool]:
    """Per cell style, whether it shows dates or times."""
    if "xl/styles.xml" not in names:
        return []
    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{_MAIN}numFmt")}
    shown = lambda i: re.search("[dmyhs]", _FORMAT_NOISE.sub("", own[i]), re.I) is not None if i in own else i in _DATE_FORMATS
    return [shown(int(x.get("numFmtId") or 0)) for x in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")]


def _moment(serial: float, first: int) -> int | str:
    """A date as milliseconds since 1970, a time of day as text."""
    if 0 <= serial < 1:
        seconds = round(serial * 86_400)
        return f"{seconds // 3600 % 24:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return round((serial - first) * 86_400_000)


def _cell(c: ElementTree.Element, shared: list[str], dates: list[bool], first: int):
    kind, value = c.get("t"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{_MAIN}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind in ("str", "e"):
        return value.text
    if kind == "b":
        return value.text == "1"
    number, style = float(value.text), int(c.get("s") or 0)
    if style < len(dates) and dates[style]:
        return _moment(number, first)
    return int(number) if number.is_integer() and "." not in value.text and "e" not in value.text.lower() else number


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def workbook(content: bytes) -> Iterator[tuple[str, list[list]]]:
    """(sheet, rows of cells); a sheet that can't be read is left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates, book = _dates(z, names), ElementTree.fromstring(z.read("xl/workbook.xml"))
        old = any((x.get("date1904") or "") in ("1", "true") for x in book.iter(f"{_MAIN}workbookPr"))
        first = _EPOCH_DAY - 1462 * old
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            try:
                rows = []
                for row in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}row"):
                    cells = {}
                    for i, c in enumerate(row.iter(f"{_MAIN}c")):
                        cells[_column(c.get("r")) if c.get("r") else i] = _cell(c, shared, dates, first)
                    rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            except (KeyError, ValueError, IndexError, ElementTree.ParseError):
                continue
            yield sheet.get("name"), rows


def read_xlsx(name: str, content: bytes) -> Iterator[dict]:
    if not content:
        return
    for i, (sheet, rows) in enumerate(workbook(content)):
        if len(rows) < 2:
            continue
        width = max(len(r) for r in rows)
        headers = [str(c) if c is not None else f"Unnamed: {k}" for k, c in enumerate(rows[0] + [None] * (width - len(rows[0])))]
        lines = [f"{k}: {row_json(dict(zip(headers, r + [None] * (width - len(r)), strict=True)))}" for k, r in enumerate(rows[1:])]
        yield {"unit_kind": "sheet", "unit_idx": i, "sheet_name": sheet, "headers": headers, "text": "\n".join(lines)}


def read_docx(name: str, content: bytes) -> Iterator[dict]:
    """Paragraphs, then the rows of all tables; blank ones go."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    words = lambda e: "".join({f"{_WORD}t": x.text or "", f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}.get(x.tag, "") for x in e.iter())
    lines = [words(p).strip() for p in body.findall(f"{_WORD}p")]
    for table in body.findall(f"{_WORD}tbl"):
        for row in table.findall(f"{_WORD}tr"):
            lines.append(" | ".join("\n".join(words(p) for p in c.iter(f"{_WORD}p")).strip() for c in row.findall(f"{_WORD}tc")))
    text = "\n".join(x for x in lines if x.strip())
    if text.strip():
        yield {"unit_kind": "text", "unit_idx": 0, "text": text}


def read_pdf(name: str, content: bytes) -> Iterator[dict]:
    """Pages, then tables, then figure notes. The libraries that read PDF files are optional."""
    import fitz

    if not content:
        return
    with fitz.open(stream=content, filetype=os.path.splitext(name)[1].lstrip(".") or "pdf") as pages:
        for i, page in enumerate(pages, 1):
            if text := page.get_text().strip():
                yield {"unit_kind": "text", "unit_idx": i - 1, "page_num": i, "text": text}
        figures = [(i, len(page.get_images())) for i, page in enumerate(pages, 1)]
    try:
        import pdfplumber
    except ImportError:
        pdfplumber = None
    if pdfplumber:
        with pdfplumber.open(io.BytesIO(content)) as pages:
            n = 0
            for i, page in enumerate(pages.pages, 1):
                for table in page.extract_tables():
                    if unit := pdf_table(table):
                        yield {"unit_kind": "table", "unit_idx": n, "page_num": i, "table_id": f"table_{n}", **unit}
                        n += 1
    for k, (i, images) in enumerate((i, m) for i, m in figures if m):
        yield {"unit_kind": "figure", "unit_idx": k, "page_num": i, "table_id": f"figure_{k}", "text": f"Page {i}: {images} image(s) detected"}


def pdf_table(table: list[list], double_header: bool = False) -> dict | None:
    """headers and JSON lines; double_header takes the second row as header and loses the first."""
    import json

    rows = table[1:] if double_header else table
    if not rows or all(c is None for r in rows for c in r):
        return None
    keep = [i for i in range(len(rows[0])) if any(r[i] is not None for r in rows)]
    headers = ["" if rows[0][i] is None else str(rows[0][i]) for i in keep]
    lines = [f"{k}: {json.dumps(dict(zip(headers, [r[i] for i in keep], strict=True)), ensure_ascii=False)}" for k, r in enumerate(rows[1:])]
    return {"headers": headers, "text": "\n".join(lines)}


READERS = {"TXT": read_text, "CSV": read_csv, "XLSX": read_xlsx, "DOCX": read_docx, "PDF": read_pdf}
#: Readers for which an empty file is simply no unit; the others fail on it.
EMPTY_OK = frozenset(("TXT", "CSV", "XLSX", "PDF"))


def extract(objects: DataFrame, mark: bool = False, readers: dict | None = None, routes: dict[str, str] | None = None, empty_ok: frozenset = EMPTY_OK) -> DataFrame:
    """Units of objects (path, length, content). Files without an extractor become error rows.

    readers, routes: the reader of each extractor and the extractor of each extension, if others than those here (sources.registry).

    Empty files are filtered before Python sees them, as Spark can't push filters through it.
    mark: a row of unit_kind `file` for each file too, so one pass tells which were there; then empty files go through Python.
    """
    empty = (F.col("length") == 0) & F.coalesce(F.col("extractor").isin(*empty_ok), F.lit(False))
    readers = readers or READERS
    routed = objects.withColumn("extractor", extractor(F.col("path"), routes or EXTRACTORS))
    routed = routed.withColumn("extractor", F.when(empty, "none").otherwise(F.col("extractor"))) if mark else routed.where(~empty)

    def units(path: str, kind: str | None, content: bytes | None) -> list[dict]:
        source = path.rsplit("/", 1)[-1]
        try:
            if kind == "none":
                rows = []
            elif kind not in readers:
                raise ValueError(f"no extractor for {source}")
            elif content is None:
                raise ValueError("the file is too long to read")
            else:
                rows = list(readers[kind](source, bytes(content)))
        except Exception as e:  # a dead letter
            rows = [{"unit_kind": "error", "unit_idx": 0, "text": f"{type(e).__name__}: {e}"}]
        if mark:
            rows.append({"unit_kind": "file", "unit_idx": 0})
        return [{"object_key": path, "source": source, **r} for r in rows]

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in UNITS.split(", ")], dtype=object)
        return out.where(out.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for path, kind, content in zip(batch["path"], batch["extractor"], batch["content"], strict=True):
                for r in units(path, kind, content):
                    held.append(r)
                    size += len(str(r.get("text") or ""))
                    if len(held) >= FRAME_ROWS or size >= FRAME_CHARS:
                        yield frame(held)
                        held, size = [], 0
            if held:
                yield frame(held)

    small_batches(objects.sparkSession)
    return routed.select("path", "extractor", "content").mapInPandas(run, UNITS)

