"""WARC: archives written by Spark, read back, and assembled into captures.

A capture is a transaction of up to three records: the response (or a revisit of an
equal earlier one), the request that asked for it and the metadata about it. Request and
metadata name the response's id in WARC-Concurrent-To; the three are joined through that
id, in whatever files and order they were written.

Archives are Spark text files whose line separator is the blank line that ends a WARC
record, so any store that Spark writes to can hold them and a lost executor's file is
written again. A file has a number of records that their size class allows, and is read as one stream.

Cases: a null payload is an empty payload; a null url is an empty target; repeated rows are
captures of their own; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, read, scratch, written

SEPARATOR = "\r\n\r\n"
#: Payloads below this many bytes are stored again rather than revisited.
REVISIT_BYTES = 1000
#: Records of an archive file by the largest payload among them, in bytes; a reader holds one compressed file at a time.
RECORDS_PER_FILE = 6000
SIZE_CLASSES = ((1 << 16, RECORDS_PER_FILE), (1 << 20, 384), (1 << 24, 24))

RECORDS = (
    "record_id string, warc_type string, concurrent_to string, refers_to_record string, target_uri string, "
    "date string, payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary"
)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _rows(pages: DataFrame) -> DataFrame:
    rows = pages.select(
        F.monotonically_increasing_id().alias("place"),
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    return rows.withColumn("capture", F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.md5("url"), "digest"))


def page_keys(pages: DataFrame) -> DataFrame:
    """What a plan needs of the pages, without their payloads, written once."""
    return written(_rows(pages).select("place", "page_id", "capture", "digest", "bytes"))


def plan_captures(pages: DataFrame, least: int = REVISIT_BYTES, keys: DataFrame | None = None) -> DataFrame:
    """Per row: capture, payload, digest, bytes and, for a revisit, the response's capture.

    A capture is named by its page_id, url and digest, however often the rows are computed; only
    rows that are alike in all three are told apart by their place in the scan. Of equal payloads of
    at least `least` bytes the row with the largest page_id is the response; among rows with that
    page_id, the one whose name is the greatest.
    """
    keys = page_keys(pages) if keys is None else keys
    twice = written(keys.groupBy("capture").agg(F.count("*").alias("k")).where("k > 1"))
    apart = F.when(F.col("k").isNotNull(), F.concat_ws("|", "capture", F.col("place").cast("string"))).otherwise(F.col("capture"))
    # as a rule there are none
    named = lambda df: df if twice.isEmpty() else lookup(df, twice, ["capture"], ["place"], n="k").withColumn("capture", apart).drop("k")
    first = (
        named(keys).where(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "capture")).alias("first"))
        .where("n > 1")
        .select("digest", "bytes", "n", F.col("first.capture").alias("first"))
    )
    out = lookup(named(_rows(pages)), written(first), ["digest", "bytes"], ["capture"], n="n")
    return out.withColumn("revisits", F.expr("nullif(first, capture)")).drop("first", "place", "n")


def records(captures: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The request, response or revisit, and metadata record of each capture, as text."""
    ident = lambda kind, key="capture": _uuid(F.lit(kind), F.col(key).cast("string"))
    main = ident("response")
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    host = F.regexp_extract(uri, r"^[^/]*://([^/?#]*)", 1)
    path = F.regexp_replace(uri, r"^[^/]*://[^/?#]*", "")
    eol = F.lit("\r\n")

    def record(kind: Column, own: Column, mime: str, extra: list[Column], block: Column) -> Column:
        heads = [
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: "), own),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Target-URI: "), uri),
            *extra,
            F.lit(f"Content-Type: {mime}"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ]
        return F.concat(F.concat_ws("\r\n", *heads), F.lit(SEPARATOR), block)

    revisit = F.col("revisits").isNotNull()
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(SEPARATOR),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    to = F.concat(F.lit("WARC-Concurrent-To: "), main)
    return captures.select(
        F.explode(
            F.array(
                record(F.lit("request"), ident("request"), "application/http;msgtype=request", [to], F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(SEPARATOR))),
                record(
                    F.when(revisit, "revisit").otherwise("response"),
                    main,
                    "application/http;msgtype=response",
                    [F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), profile, F.concat(F.lit("WARC-Refers-To: "), F.when(revisit, ident("response", "revisits")))],
                    answer,
                ),
                record(F.lit("metadata"), ident("metadata"), "application/warc-fields", [to], F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), eol)),
            )
        ).alias("value")
    )


def write(archive: DataFrame, path: str, compression: str = "gzip", per_file: int = RECORDS_PER_FILE) -> None:
    archive.write.option("lineSep", SEPARATOR).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


class _Stream:
    """Bytes of an archive, inflated as they are asked for; members may follow one another."""

    def __init__(self, raw: bytes, step: int = 1 << 18):
        self.raw, self.at, self.step, self.held, self.pos = raw, 0, step, bytearray(), 0
        self.inflate = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        del self.held[: self.pos]
        self.pos = 0
        part = self.raw[self.at : self.at + self.step]
        self.at += len(part)
        while self.inflate and part:
            self.held += self.inflate.decompress(part)
            part = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.held += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (found := self.held.find(mark, self.pos + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.pos
            if not self.more():
                return None
        out = bytes(self.held[self.pos : found])
        self.pos = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.pos < n and self.more():
            pass
        out = bytes(self.held[self.pos : self.pos + n])
        self.pos += n
        return out


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _digest_ok(named: str | None, payload: bytes) -> bool | None:
    """None if there is no digest or it is of another kind."""
    kind, _, value = (named or "").partition(":")
    if kind.lower() != "sha1":
        return None
    own = hashlib.sha1(payload)
    return value in (own.hexdigest(), base64.b32encode(own.digest()).decode())


def parse(raw: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive, plain or gzip."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not (head := head.lstrip(b"\r\n")):
            continue
        h = _headers(head)
        block = stream.take(int(h.get("content-length") or 0))
        kind, fields, payload, size, ok, digest = h.get("warc-type"), {}, None, None, None, h.get("warc-payload-digest")
        if kind in ("response", "revisit"):
            start, _, payload = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, ok = len(payload), _digest_ok(digest, payload)
                digest = "sha1:" + hashlib.sha1(payload).hexdigest()
            else:  # it has the first answer's headers alone
                size, payload = int(_headers(start).get("content-length") or 0), None
        elif kind == "metadata":
            fields = _headers(b"\r\n" + block)
        bare = digest.partition(":")[2] if digest else None
        yield h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), bare, size, ok, fields, payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records under path."""
    names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                rows: list[tuple] = []
                held = 0
                for x in parse(bytes(raw), with_payload):
                    rows.append(x)
                    held += len(x[-1] or b"")
                    if len(rows) >= 5000 or held > 1 << 24:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: response, request, metadata.

    Of several requests or metadata records of one response the least id stays. Records
    that name no response that is there are left out.
    """
    own = lambda kind: found.where(F.col("warc_type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct("record_id", "target_uri", "date", "fields"), "record_id").alias(kind))
    answers = found.where(F.col("warc_type").isin("response", "revisit"))
    return answers.select("record_id", F.struct(*[c for c in answers.columns if c != "fields"]).alias("response")).join(own("request"), "record_id", "left").join(own("metadata"), "record_id", "left")


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write pages to archives under path, read them and return the captures, without payloads.

    Captures of a size class share files; as a rule there is one class, and so one pass.
    """
    keys = page_keys(pages)
    captures = plan_captures(pages, keys=keys)
    own = F.when(F.col("revisits").isNull(), F.col("bytes")).otherwise(0)
    kind = lambda size: sum(((size > most).cast("int") for most, _ in SIZE_CLASSES), F.lit(0))
    found = [r[0] for r in keys.select(kind(F.col("bytes")).alias("kind")).distinct().collect()]  # as many as there are classes
    for k in sorted({0, *found}) if len(found) > 1 else found or [0]:
        part = captures if len(found) <= 1 else captures.where(kind(own) == k)
        write(records(part), f"{path}/{k}", per_file=SIZE_CLASSES[k][1] if k < len(SIZE_CLASSES) else 3)
    return assemble(read_records(pages.sparkSession, path, with_payload=False))


def digest_rows(captures: DataFrame) -> DataFrame:
    """The contract's columns. A revisit's page is looked up among the responses it names."""
    flat = captures.select(
        F.expr("try_cast(nullif(metadata.fields['page_id'], '') as bigint)").alias("page_id"),
        "record_id",
        *[F.col(f"response.{c}").alias(c) for c in ("payload_bytes", "payload_digest", "warc_type", "refers_to_record", "digest_ok")],
    )
    named = flat.where(F.col("refers_to_record").isNotNull()).select("refers_to_record").distinct()
    pages = flat.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).join(named, "refers_to_record", "left_semi")
    return lookup(flat, pages, ["refers_to_record"], ["record_id"]).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "digest_ok")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(archive_pages(read(spark, sf_dir, "pages"), scratch(spark)))


#: Text that ends in a lone surrogate can't occur in Parquet strings; payloads are UTF-8.
OP9_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as b, sha1(coalesce(html, '')) as d from pages
), f as (
  select d, b, max(page_id) as first from p where b >= 1000 group by d, b
)
select p.page_id, p.b as payload_bytes, p.d as payload_digest,
  case when p.page_id <> f.first then 'revisit' else 'response' end as record_type,
  case when p.page_id <> f.first then f.first end as refers_to,
  case when p.page_id <> f.first then null else true end as digest_ok
from p left join f on p.d = f.d and p.b = f.b
"""
