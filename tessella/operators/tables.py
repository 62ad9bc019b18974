"""Tables inside text files, and tables as text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip


#: Lines between tables: one blank line or more.
_GAP = r"(?U)\n(?:[\s&&[^\n]]*+\n)++"


def tables_of(text: Column) -> Column:
    """array<array<string>>: the lines of each run of lines that aren't blank."""
    filled = lambda table: F.filter(F.split(table, "\n"), lambda x: ~is_blank(x))  # noqa: E731  a blank line is left only before the first and after the last
    return F.transform(F.filter(F.split(text, _GAP), lambda t: ~is_blank(t)), filled)


def islands(files: DataFrame, id: str = "path", text: str = "text") -> DataFrame:
    """(id, table_no, row_no, line): runs of lines that aren't blank, each a table from 0; row 0 is the header.

    A file's lines lie in one row, so its tables are found there and nothing is shuffled.
    """
    found = files.select(id, F.posexplode(tables_of(F.col(text))).alias("table_no", "_lines"))
    return found.select(id, "table_no", F.posexplode("_lines").alias("row_no", "line"))


def filled_cells(files: DataFrame, id: str = "path", text: str = "text", delimiter: str = ",") -> DataFrame:
    """(id, table_no, row_no, col_no, value) of the columns that have a value somewhere in their table; no shuffle."""
    split = F.transform("_lines", lambda x: F.split(x, delimiter))
    width = F.array_max(F.transform("_rows", lambda r: F.size(r)))
    bare = F.filter(F.sequence(F.lit(0), width - 1), lambda i: ~F.exists("_rows", lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    found = files.select(id, F.posexplode(tables_of(F.col(text))).alias("table_no", "_lines")).select(id, "table_no", split.alias("_rows"))
    found = found.withColumn("_bare", bare).withColumn("_bare", F.when(F.size("_bare") > 0, F.col("_bare")))  # mostly null, so that cells carry nothing
    cells = found.select(id, "table_no", "_bare", F.posexplode("_rows").alias("row_no", "_row")).select(id, "table_no", "row_no", "_bare", F.posexplode("_row").alias("col_no", "_value"))
    kept = cells.where(F.col("_bare").isNull() | ~F.array_contains("_bare", F.col("col_no")))
    return kept.select(id, "table_no", "row_no", "col_no", F.nullif("_value", F.lit("")).alias("value"))


def joined_cells(cells: Column, mark: str = " | ") -> Column:
    return F.array_join(F.transform(cells, strip), mark)


def json_line(index: Column, row: Column) -> Column:
    """`index: {..}` with nulls kept."""
    return F.concat(index.cast("string"), F.lit(": "), F.to_json(row, {"ignoreNullFields": "false"}))


def quoted(cell: Column) -> Column:
    """A CSV cell, quoted only where it must be."""
    need = cell.rlike('[",\r\n]')
    return F.when(cell.isNull(), "").when(need, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def row_json(row: dict) -> str:
    """A worksheet row as compact JSON in ASCII with escaped slashes; whole numbers of mixed rows as floats."""
    values = list(row.values())
    if any(isinstance(v, float) for v in values) and all(isinstance(v, (int, float)) or v is None for v in values):
        row = {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in row.items()}
    return json.dumps(row, separators=(",", ":")).replace("/", "\\/")
