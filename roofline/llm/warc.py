"""Content-addressed WARC archive.

Records are split into their exact header bytes and their payload.  A payload is stored
once, under its SHA-256, whatever number of records have it; headers are stored for every
record.  Reading checks each stored payload against its digest and length, and joins
headers to payloads to give the original records back.  Of records with equal payloads
of at least ``min_revisit`` bytes the one with the largest id is written as a response
and the others as revisits that refer to it.

An archive is a folder with two Parquet tables, ``part=headers`` (record_id, sha256,
header) and ``part=payloads`` (sha256, payload, n_bytes), written in one pass.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "record_id long, sha256 binary, header binary, n_bytes long, payload binary, part string"


def record_urn(record_id: Column) -> Column:
    """A record id as a urn:uuid, from the integer id."""
    h = F.lpad(F.lower(F.hex(record_id)), 32, "0")
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def urn_id(urn: Column) -> Column:
    """The integer id of a ``record_urn``."""
    digits = F.regexp_replace(F.regexp_extract(urn, r"<urn:uuid:([0-9a-f-]+)>", 1), "-", "")
    return F.conv(F.when(digits != "", digits), 16, -10).cast("long")


def records(pages: DataFrame, min_revisit: int = 1000, date: str = "2026-01-01T00:00:00Z",
            id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record_id, rid, sha256, payload, header, stored): a WARC record per page.

    ``header`` is the record's header block with the HTTP header of a response;
    ``stored`` marks the one record of each payload whose copy the archive keeps.
    """
    base = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "n": F.length("payload")})
    # The holder of a payload, found on digests alone; only the join below moves payloads.
    who = F.struct("record_id", F.xxhash64("url").alias("u"))
    first = base.groupBy("sha256").agg(F.max(who).alias("keep"))
    rows = base.join(first, "sha256")
    is_first = F.struct("record_id", F.xxhash64("url")).eqNullSafe(F.col("keep"))
    revisit = (F.col("n") >= min_revisit) & ~is_first
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # A header value is one line: CR, LF and NUL in a URL are percent-encoded.
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A"), "\x00", "%00")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.when(F.col("record_id").isNotNull(), line("WARC-Record-ID", record_urn(F.col("record_id")))).otherwise(""),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.coalesce(line("WARC-Refers-To", record_urn(F.col("keep.record_id"))), F.lit("")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit("\r\n"), http)
    return rows.select("record_id", "sha256", "payload", header.cast("binary").alias("header"), is_first.alias("stored"))


def write_archive(recs: DataFrame, path: str) -> None:
    """Headers of all records and each payload once, in one pass over ``records()``.

    Rows that repeat an id, URL and payload may store a payload more than once; reading
    takes one of them.
    """
    null = F.lit(None)
    head = F.struct("record_id", "sha256", "header", null.cast("long").alias("n_bytes"),
                    null.cast("binary").alias("payload"), F.lit("headers").alias("part"))
    body = F.struct(null.cast("long").alias("record_id"), "sha256", null.cast("binary").alias("header"),
                    F.length("payload").cast("long").alias("n_bytes"), "payload", F.lit("payloads").alias("part"))
    (recs.select(F.inline(F.when(F.col("stored"), F.array(head, body)).otherwise(F.array(head))))
     .write.partitionBy("part").option("compression", "zstd").parquet(path))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(path).where("part = 'headers'").select("record_id", "sha256", "header")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload), each read once and verified: a payload that does not hash to its name fails the job."""
    rows = spark.read.schema(PARTS).parquet(path).where("part = 'payloads'")
    good = (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (F.length("payload") == F.col("n_bytes"))
    return rows.select("sha256", F.when(good, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("sha256")))).alias("payload"))


def header_field(header: Column, name: str) -> Column:
    """A named field of a WARC header block; null where absent."""
    found = F.regexp_extract(header, rf"(?i)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record: record_id, record_type, refers_to, payload_digest as its header states them, with the
    bytes and digest of the payload that the archive holds for it."""
    text = F.decode("header", "utf-8")
    head = read_headers(spark, path).select(
        "record_id", "sha256", header_field(text, "WARC-Type").alias("record_type"),
        urn_id(header_field(text, "WARC-Refers-To")).alias("refers_to"),
        F.regexp_replace(header_field(text, "WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"))
    held = read_payloads(spark, path).select("sha256", F.length("payload").cast("long").alias("payload_bytes"),
                                             F.sha1("payload").alias("payload_digest"))
    held = held.groupBy("sha256").agg(F.first("payload_bytes").alias("payload_bytes"),
                                      F.first("payload_digest").alias("payload_digest"))
    return head.join(held, "sha256")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record): the exact bytes of every record; a revisit's record ends with its HTTP header."""
    head = read_headers(spark, path)
    revisit = header_field(F.decode("header", "utf-8"), "WARC-Type") == "revisit"
    held = read_payloads(spark, path).groupBy("sha256").agg(F.first("payload").alias("payload"))
    return head.join(held, "sha256").select(
        "record_id", F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")),
                              F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(spark: SparkSession, path: str) -> DataFrame:
    """(warc): one gzip member per record, ready to be joined into .warc.gz files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([gzip.compress(x, mtime=0) for x in b.column(0).to_pylist()], pa.binary())], names=["warc"])
    return reconstruct(spark, path).select("record").mapInArrow(run, "warc binary")


def archive_pages(pages: DataFrame, path: str, min_revisit: int = 1000, **columns) -> DataFrame:
    """Write a record per page and read the archive back.

    A null html is an empty payload; a null URL an empty one; a null page_id a record
    without an id.  Rows that repeat an id, URL and html are each a response.  An empty
    table gives an empty archive.
    """
    write_archive(records(pages, min_revisit, **columns), path)
    return read_records(pages.sparkSession, path)
