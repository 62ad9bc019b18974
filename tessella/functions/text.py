"""Column functions on names and text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that may be uploaded, and the extractor of each extension.
ALLOWED_EXTENSIONS = ("pdf", "csv", "xlsx", "docx", "doc", "pptx", "ppt", "md", "txt", "msg", "helm")
EXTRACTORS = {
    "pdf": "PDF", "pptx": "PDF", "ppt": "PDF", "csv": "CSV", "docx": "DOCX", "doc": "DOCX",
    "xlsx": "XLSX", "txt": "TXT", "md": "TXT", "msg": "TXT",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case; empty for names without one and for dotfiles."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def extractor(path: Column, routes: dict[str, str] = EXTRACTORS) -> Column:
    """The extractor's name; null if no extractor reads such files."""
    table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return F.element_at(table, extension(path))


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def object_key(source: Column, index: Column) -> Column:
    """ASCII letters and digits of the name, then the index. Not unique over units of a file."""
    return F.concat(F.regexp_replace(source, "[^a-zA-Z0-9]", ""), index.cast("string"))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r")


def row_range(text: Column) -> Column:
    """`a - b` from the numbers before the first colon of the first and last line, else `unknown`."""
    number = lambda line: F.expr("int(null)") if line is None else F.trim(F.substring_index(line, ":", 1)).try_cast("int")
    own = lines(text)
    both = F.concat(number(F.element_at(own, 1)).cast("string"), F.lit(" - "), number(F.element_at(own, -1)).cast("string"))
    return F.coalesce(both, F.lit("unknown"))


def figure_page(note: Column) -> Column:
    """The number after `Page`, or -1."""
    return F.coalesce(F.regexp_extract(note, r"Page\s+(\d+)", 1).try_cast("int"), F.lit(-1))


def etag(raw: Column) -> Column:
    return F.btrim(raw, F.lit('"'))


def fold(text: str, width: int = 100) -> str:
    """Words wrapped at width; each line end becomes a blank line."""
    import textwrap

    return "\n\n".join(line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))


def folded(text: Column, width: int = 100) -> Column:
    """fold() of a column, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else fold(t, width))

    return run(text)


def utc_time(moment: Column) -> Column:
    """A moment as UTC wall-clock text, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
