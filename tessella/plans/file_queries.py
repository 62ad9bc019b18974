"""Registered queries over files and tables that are made from the driver's tables, and their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, etag, extension, folded, utc_time
from ..operators import cdc, listing
from ..operators.metadata import merged
from ..operators.snapshot import MetadataTable, copy_state
from ..operators.store import VectorTable
from ..sources.extract import extract, pdf_table
from ..sources.landing import keys_of
from ..sources.objects import list_objects, read_objects
from ..sources.office import document_bytes, workbook_bytes
from ..sources.registry import Extractors
from ..sources.scratch import scratch
from .copies import copy_new
from .queries import _CHANGED, _OBJECTS, _POINTS, _STATE, _listing, _objects, _points, _state, _t, query


def _units(docs: DataFrame, ext: str, content: Column) -> DataFrame:
    """Units of files `Doc_<doc_id>.<ext>`, with doc_id."""
    objects = docs.select(F.concat(F.lit("in/Doc_"), F.col("doc_id").cast("string"), F.lit(f".{ext}")).alias("path"), content.alias("content"))
    found = extract(objects.withColumn("length", F.length("content").cast("long")))
    return found.withColumn("doc_id", F.regexp_extract("source", r"Doc_(-?\d+)\.", 1).cast("long"))


def _made(docs: DataFrame, make) -> DataFrame:
    """docs with `content`, the bytes that make(row) returns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": [make(r) for r in batch.itertuples()]})

    return docs.mapInPandas(run, "doc_id long, content binary")


@query(r"select doc_id, 1::bigint as page_num, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents where text <> ''")
def extract_text(spark, sf):
    """Text files as UTF-8, as UTF-8 with a mark, and as UTF-16."""
    d = _t(spark, sf, "documents").where("text <> ''")
    coded = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-16"))
    return _units(d, "txt", coded).select("doc_id", F.col("page_num").cast("long").alias("page_num"), "text")


@query(
    """select doc_id, 0::bigint as table_no, ['doc', 'source', 'lang', 'gap'] as headers,
      'doc,source,lang,gap' || chr(10) || repeat(doc_id || ',' || source || ',' || lang || ',' || chr(10), 3) as text from documents
    union all select doc_id, 1, ['doc', 'chars'], 'doc,chars' || chr(10) || repeat(doc_id || ',' || n_chars || chr(10), 2) from documents"""
)
def extract_csv(spark, sf):
    """Two tables a file, apart by a row of nulls; columns without a value go."""
    c = F.col("doc_id").cast("string")
    first = F.repeat(F.concat(c, F.lit(";"), "source", F.lit(";"), "lang", F.lit(";\n")), 3)
    second = F.repeat(F.concat(c, F.lit(";"), F.col("n_chars").cast("string"), F.lit(";;\n")), 2)
    text = F.concat(F.lit("doc;source;lang;gap\n"), first, F.lit("NA;NULL;nan;-1.#IND\ndoc;chars;;\n"), second)
    return _units(_t(spark, sf, "documents"), "csv", F.encode(text, "UTF-8")).select("doc_id", F.col("unit_idx").cast("long").alias("table_no"), "headers", "text")


@query(
    """select doc_id, 'Sheet' as sheet_name, ['doc', 'source', 'day', 'share'] as headers, '0: {"doc":' || doc_id || ',"source":"' || source || '","day":' || (1704067200000 + (doc_id % 1000) * 43200000) || ',"share":0.5}'
      || chr(10) || '1: {"doc":' || n_chars || ',"source":null,"day":null,"share":null}' as text from documents"""
)
def extract_xlsx(spark, sf):
    """Worksheets as JSON lines, dates as milliseconds."""

    def make(r) -> bytes:
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=12 * (r.doc_id % 1000))
        return workbook_bytes({"Sheet": [["doc", "source", "day", "share"], [r.doc_id, r.source, day, 0.5], [r.n_chars, None, None, None]], "empty": []})

    made = _made(_t(spark, sf, "documents").select("doc_id", "source", "n_chars"), make)
    return _units(made, "xlsx", F.col("content")).select("doc_id", "sheet_name", "headers", "text")


@query(
    """select doc_id, 'Sheet' as sheet_name, 0::bigint as row_no, ['doc', 'source', 'chars'] as cells from documents
    union all select doc_id, 'Sheet', 1, [doc_id::varchar, source, n_chars::varchar] from documents"""
)
def sheet_cells(spark, sf):
    """Rows of worksheets, by a table function in SQL."""
    d = _t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    made = _made(d, lambda r: workbook_bytes({"Sheet": [["doc", "source", "chars"], [r.doc_id, r.source, r.n_chars]]}))
    Extractors().register(spark)
    return spark.sql("select f.doc_id, s.sheet_name, cast(s.row_no as bigint) as row_no, s.cells from {files} f, lateral sheet_rows(f.content) s", files=made)


@query("select doc_id, source || chr(10) || 'Size' || chr(10) || lang || ' | ' || n_chars as text from documents")
def extract_docx(spark, sf):
    """Paragraphs, then table rows; blank ones go."""
    made = _made(_t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), lambda r: document_bytes([f" {r.source} ", "  ", "Size"], [[[r.lang, str(r.n_chars)], []]]))
    return _units(made, "docx", F.col("content")).select("doc_id", "text")


@query("""select doc_id, ['doc', 'source'] as headers, '0: {"doc": "' || doc_id || '", "source": "' || source || '"}' || chr(10) || '1: {"doc": null, "source": "' || lang || '"}' as text from documents""")
def pdf_table_lines(spark, sf):
    """Tables of pages as JSON lines; columns without a value go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [pdf_table([["doc", None, "source"], [str(r.doc_id), None, r.source], [None, None, r.lang]]) for r in batch.itertuples()]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "headers": [x["headers"] for x in found], "text": [x["text"] for x in found]})

    return _t(spark, sf, "documents").select("doc_id", "source", "lang").mapInPandas(run, "doc_id long, headers array<string>, text string")


@query("select source, sum(octet_length(encode(text)) + 1)::bigint as listed, sum(octet_length(encode(text)) + 1)::bigint as read from documents where text is not null group by source")
def objects_read(spark, sf):
    """Files written a folder a source, listed and read back: bytes that the listing names, and bytes read."""
    path = scratch(spark)
    _t(spark, sf, "documents").where("text is not null").select("text", "source").write.partitionBy("source").text(path)
    found = read_objects(spark, path).where(basename(F.col("path")).startswith("part-") & ~F.col("path").endswith(".crc"))
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("length").alias("listed"), F.sum(F.octet_length("content")).cast("long").alias("read"))


@query("select source, sum(octet_length(encode(text)) + 1)::bigint as bytes, true as told, 0::bigint as again from documents where text is not null group by source")
def copies_made(spark, sf):
    """Files written a folder a source, copied by a job, and read at the target: their bytes, whether the job told what it copied, and what it copies a second time."""
    source, target, state = scratch(spark), scratch(spark), scratch(spark)
    _t(spark, sf, "documents").where("text is not null").select("text", "source").write.partitionBy("source").text(source)
    first, second = copy_new(spark, source, target, state), copy_new(spark, source, target, state)
    made = list_objects(spark, target)
    told = made.count() == first["copied"] == first["state"] == second["state"] and "failed" not in first
    found = made.where(basename(F.col("path")).startswith("part-"))
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("length").alias("bytes"), F.lit(told).alias("told"), F.lit(second["copied"]).cast("long").alias("again"))


@query(
    f"""select file_path, etag from (select *, 0 as gen from {_STATE} union all select *, 1 from {_CHANGED})
    qualify row_number() over (partition by file_path order by gen desc, etag desc) = 1"""
)
def state_saved(spark, sf):
    """The state of a copy, saved, loaded, replaced by the next one and loaded again."""
    saved = copy_state(spark, scratch(spark))
    saved.replace(_state(spark, sf))
    new = cdc.changed(_listing(spark, sf), saved.read())
    saved.replace(cdc.next_state(saved.read(), new))
    return saved.read()


_KEY = "lower(regexp_extract(path, '^.+\\.([^./]+)$', 1)) || '/' || regexp_extract(path, '[^/]*$')"


@query(
    rf"""with o as (select distinct on (path) {_KEY} as object_key, regexp_extract(path, '[^/]*$') as filename, octet_length(encode(text))::bigint as size, etag, source from {_OBJECTS} where text is not null and regexp_matches(path, '[^/]\.[^./]+$'))
    select object_key, etag, filename, size, 's3://docs/' || object_key as uri, case when source = 'src1' then 'second' else 'first' end as load from o
    union all select object_key, 'v2', filename, size, 's3://docs/' || object_key, 'second' from o where source = 'src2'"""
)
def metadata_scanned(spark, sf):
    """Two loads into the metadata table, and a scan: a row a file and version, from the later load."""
    o = _objects(spark, sf).where("text is not null").where(extension(F.col("path")) != "")
    own = keys_of(F.col("path"), "docs")

    def rows(df: DataFrame, tag: Column, at: str) -> DataFrame:
        return df.select(
            own["key"].alias("object_key"), F.lit("docs").alias("bucket"), basename(F.col("path")).alias("filename"), extension(F.col("path")).alias("file_type"),
            F.octet_length("text").cast("long").alias("size"), tag.alias("etag"), F.lit(at).cast("timestamp").alias("last_modified"), own["uri"].alias("uri"), F.lit(at).cast("timestamp").alias("ingested_at"),
        )

    table = MetadataTable(spark, scratch(spark))
    table.upsert(rows(o, F.col("etag"), "2024-01-01"))
    table.upsert(rows(o.where(F.col("source").isin("src1", "src2")), F.when(F.col("source") == "src2", "v2").otherwise(F.col("etag")), "2024-02-01"))
    return table.scan().select("object_key", "etag", "filename", "size", "uri", F.when(F.year("ingested_at") * 100 + F.month("ingested_at") == 202402, "second").otherwise("first").alias("load"))


@query(
    f"""select 'k/' || doc_id as object_key, md5(case when source = 'src3' then 'new ' || text else text end) as text_md5, len(embedding)::bigint as dimension
    from {_POINTS} where source not in ('src1', 'src2') and 'k/' || doc_id <> 'k/5'"""
)
def vector_table(spark, sf):
    """Points written, some replaced, some deleted by name and by key, compacted and read."""
    p = _points(spark, sf).select(F.concat(F.lit("k/"), F.col("doc_id").cast("string")).alias("object_key"), "source", "text", F.lit("text").alias("unit_kind"), F.lit(0).alias("unit_idx"), F.lit(0).alias("chunk_idx"), "embedding")
    size = p.select(F.size("embedding")).first()[0]
    table = VectorTable(spark, scratch(spark), size)
    table.upsert(p)
    table.upsert(p.where("source = 'src3'").withColumn("text", F.concat(F.lit("new "), "text")))
    table.delete(["src1", "src2", "k/5", "none"])
    table.compact()
    return table.live().select("object_key", F.md5("text").alias("text_md5"), F.size("embedding").cast("long").alias("dimension"))


@query(f"select doc_id, {_KEY} as key, 's3://docs/' || {_KEY} as uri, '/documents/minio/' || {_KEY} as copy from {_OBJECTS} where path like '%._%'")
def object_uris(spark, sf):
    own = keys_of(F.col("path"), "docs")
    return _objects(spark, sf).where(extension(F.col("path")) != "").select("doc_id", *[c.alias(n) for n, c in own.items()])


@query(f"select doc_id, etag from {_OBJECTS}")
def etag_quotes(spark, sf):
    """Etags as stores give them, in quotes, without them."""
    return _objects(spark, sf).select("doc_id", etag(F.concat(F.lit('"'), "etag", F.lit('"'))).alias("etag"))


@query("select doc_id, to_json({'source': source, 'lang': 'n' || n_chars, 'page': doc_id::varchar}) as fields from documents")
def map_merge(spark, sf):
    """Two maps, the right of which wins."""
    left = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")
    right = F.create_map(F.lit("lang"), F.concat(F.lit("n"), F.col("n_chars").cast("string")), F.lit("page"), F.col("doc_id").cast("string"))
    both = merged(left, right)
    return _t(spark, sf, "documents").select("doc_id", F.to_json(F.struct(*[both[k].alias(k) for k in ("source", "lang", "page")])).alias("fields"))


@query("select doc_id, left(text, 100) as preview from documents order by doc_id limit 3")
def debug_previews(spark, sf):
    """The first chunks' first characters, as logs show them."""
    return listing.previews(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("select conv_id, string_agg(turn || ': ' || role, chr(10) order by turn) as lines, count(*) as n from conversations group by conv_id")
def appended_lists(spark, sf):
    """Rows of one key appended in order to one text, as parts of a file are."""
    return listing.appended(_t(spark, sf, "conversations"), "conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(": "), "role")).select("conv_id", F.array_join("parts", "\n").alias("lines"), F.size("parts").cast("long").alias("n"))


@query("select doc_id, source || chr(10) || chr(10) || lang || ' ' || n_chars as lines from documents")
def wrapped_words(spark, sf):
    """Lines wrapped at a width, with a blank line after each."""
    text = F.concat("source", F.lit("\n"), "lang", F.lit(" "), F.col("n_chars").cast("string"))
    return _t(spark, sf, "documents").select("doc_id", folded(text, 40).alias("lines"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as utc from events")
def event_times(spark, sf):
    """Moments as UTC text."""
    return _t(spark, sf, "events").select("event_id", utc_time(F.col("ts").cast("timestamp")).alias("utc"))
