"""Extractors that can be added, and all of them as table functions of SQL.

    own = Extractors().add("TSV", ["tsv"], read_tsv)
    own.register(spark)
    spark.sql("select o.path, u.text from objects o, lateral tsv_units(o.path, o.content) u")

A reader takes (name, bytes) and yields dicts with the fields of a unit. A failure is a row of
unit_kind `error`, as in extract(); a null content is a failure, an empty one of a reader that
allows it no row. Table functions run where the row of the file is, one file after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTRACTORS
from .extract import EMPTY_OK, READERS, UNITS, extract, workbook

Reader = Callable[[str, bytes], Iterable[dict]]
#: What a table function of units yields: a unit but for the file's own fields.
FIELDS = [x.split(" ", 1) for x in UNITS.split(", ")][2:]
SHEET_ROWS = "sheet_no int, sheet_name string, row_no int, cells array<string>, error string"


class Extractors:
    def __init__(self, readers: dict[str, Reader] = READERS, routes: dict[str, str] = EXTRACTORS, empty_ok: frozenset = EMPTY_OK):
        self.readers, self.routes, self.empty_ok = dict(readers), dict(routes), empty_ok

    def add(self, kind: str, extensions: list[str], reader: Reader, empty_ok: bool = False) -> Extractors:
        """These and one more; it takes over extensions that another has."""
        return Extractors(self.readers | {kind: reader}, self.routes | {e.lower(): kind for e in extensions}, self.empty_ok | {kind} if empty_ok else self.empty_ok - {kind})

    def extract(self, objects: DataFrame, mark: bool = False) -> DataFrame:
        return extract(objects, mark, self.readers, self.routes, self.empty_ok)

    def register(self, spark: SparkSession) -> list[str]:
        """Table functions `<kind>_units(path, content)` of all readers, and sheet_rows(content). Returns their names."""
        names = []
        for kind, reader in self.readers.items():
            names.append(f"{kind.lower()}_units")
            spark.udtf.register(names[-1], F.udtf(_units(reader, kind in self.empty_ok), returnType=", ".join(f"{n} {t}" for n, t in FIELDS)))
        spark.udtf.register("sheet_rows", F.udtf(SheetRows, returnType=SHEET_ROWS))
        return [*names, "sheet_rows"]


def _units(reader: Reader, empty_ok: bool) -> type:
    names = [n for n, _ in FIELDS]

    class Units:
        def eval(self, path: str, content: bytes) -> Iterator[tuple]:
            try:
                if content is None:
                    raise ValueError("the file is too long to read")
                rows = [] if empty_ok and not content else list(reader((path or "").rsplit("/", 1)[-1], bytes(content)))
            except Exception as e:
                rows = [{"unit_kind": "error", "unit_idx": 0, "text": f"{type(e).__name__}: {e}"}]
            for r in rows:
                yield tuple(r.get(n) for n in names)

    return Units


class SheetRows:
    """A row per sheet and row of a workbook, cells as text; the header is row 0."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None or not content:
            return
        try:
            for i, (sheet, rows) in enumerate(workbook(bytes(content))):
                for k, row in enumerate(rows):
                    yield i, sheet, k, [None if c is None else str(c) for c in row], None
        except Exception as e:
            yield None, None, None, None, f"{type(e).__name__}: {e}"
