"""Document collections: path lists, TREC and WARC bundles, plain and compressed.

Bundles are read whole, as one row a file; Spark's codecs undo gzip and deflate by
file name. Ids are given in file and record order.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.session import ship

FORMATS = ("text", "html", "trec", "warc")
#: Bits of a document's number within its bundle; the bundle's number is above them.
RECORD_BITS = 32


def collection_format(name: str) -> str:
    fmt = name.strip().lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown document collection format: {name!r}")
    return fmt


def paths_of(listing: str) -> list[str]:
    """Paths of a collection list, one a line."""
    return [p for p in (line.strip() for line in listing.splitlines()) if p]


def inflate(raw: bytes) -> bytes:
    """gzip or zlib by their headers; anything else as it is."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if len(raw) > 2 and raw[0] & 15 == 8 and ((raw[0] << 8) | raw[1]) % 31 == 0:
        try:
            return zlib.decompress(raw)
        except zlib.error:
            return raw
    return raw


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([inflate(x) for x in b.column(1).to_pylist()], pa.binary())], ["path", "content"])


def read_bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (path, content) of whole files, inflated; missing files are skipped."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths).select("path", "content")
    return raw.mapInArrow(_inflated, "path string, content binary")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds doc_id: dense in path and record order; bundles are counted, and only their counts are ordered together."""
    counts = rows.groupBy("path").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "before")
    inside = F.row_number().over(Window.partitionBy("path").orderBy("record")) - 1
    return rows.withColumn("inside", inside).join(before, "path").withColumn("doc_id", (F.col("before") + F.col("inside")).cast("bigint")).drop("before", "inside", "record")


def parse_trec(bundles: DataFrame) -> DataFrame:
    """Rows (doc_id, path, docno, url, html) of bundles (path, content)."""
    body = F.col("content").cast("string")
    docs = bundles.select("path", F.posexplode(F.regexp_extract_all(body, F.lit("(?is)<DOC>(.*?)</DOC>"), F.lit(1))).alias("record", "doc"))
    header = F.regexp_extract("doc", r"(?is)<DOCHDR>\s*(.*?)</DOCHDR>", 1)
    rows = docs.select("path", "record", F.trim(F.regexp_extract("doc", r"(?is)<DOCNO>([^<]*)<", 1)).alias("docno"), F.regexp_extract(header, r"^([^\r\n]*)", 1).alias("url"), F.regexp_replace("doc", r"(?is)^.*?</DOCHDR>\r?\n?", "").alias("html"))
    return _numbered(rows)


_LENGTH = re.compile(rb"(?im)^Content-Length:\s*(\d+)\s*$")
_HEADER_END = re.compile(rb"\r?\n\r?\n")


def warc_records(raw: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(record id, target address, body) of the records after the first, which describes the file."""
    at, n = 0, 0
    while True:
        at = raw.find(b"WARC/", at)
        if at < 0:
            return
        end = _HEADER_END.search(raw, at)
        if not end:
            return
        head = raw[at : end.start()]
        size = _LENGTH.search(head)
        length = int(size[1]) if size else 0
        body = raw[end.end() : end.end() + length]
        at = end.end() + length
        if n:
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.splitlines()[1:])}
            name = fields.get(b"warc-trec-id") or fields.get(b"warc-record-id") or b""
            yield name.decode("utf-8", "replace"), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), body
        n += 1


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows = list(warc_records(raw or b""))
            if rows:
                names, urls, bodies = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(names), pa.array(urls), pa.array([x.decode("utf-8", "replace") for x in bodies])], ["path", "record", "docno", "url", "html"])


def parse_warc(bundles: DataFrame) -> DataFrame:
    """Rows (doc_id, path, docno, url, html) of bundles (path, content)."""
    ship(bundles.sparkSession)
    return _numbered(bundles.select("path", F.col("content").cast("binary")).mapInArrow(_warc, "path string, record int, docno string, url string, html string"))


def read_collection(spark: SparkSession, paths: list[str], fmt: str = "trec") -> DataFrame:
    """Documents of a collection's files in a named format."""
    fmt = collection_format(fmt)
    bundles = read_bundles(spark, paths)
    if fmt == "trec":
        return parse_trec(bundles)
    if fmt == "warc":
        return parse_warc(bundles)
    whole = bundles.select("path", F.lit(0).alias("record"), F.lit("").alias("docno"), F.lit("").alias("url"), F.col("content").cast("string").alias("text" if fmt == "text" else "html"))
    return _numbered(whole)


def render_trec(docno: Column, url: Column, body: Column) -> Column:
    """One document as TREC text."""
    return F.concat(F.lit("<DOC>\n<DOCNO>"), docno, F.lit("</DOCNO>\n<DOCHDR>\n"), url, F.lit("\nHTTP/1.1 200 OK\n</DOCHDR>\n"), body, F.lit("\n</DOC>\n"))


def render_warc(docno: Column, url: Column, body: Column) -> Column:
    """One document as a WARC record."""
    return F.concat(F.lit("WARC/0.18\nWARC-Type: response\nWARC-Target-URI: "), url, F.lit("\nWARC-TREC-ID: "), docno, F.lit("\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\n\n"), body, F.lit("\n"))


WARC_INFO = "WARC/0.18\nWARC-Type: warcinfo\nContent-Length: 9\n\nsoftware\n\n"
