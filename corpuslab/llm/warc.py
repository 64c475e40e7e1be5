"""Operator 7: content-addressed WARC archive.

An archive is a folder of two Parquet tables:

* ``payloads``: every distinct payload once, under its SHA-256; its length and SHA-1 are
  stored beside it, and rows are one content only if all three agree, so the digest is verified against a second one.
* ``headers``: the exact header bytes of each record, with the SHA-256 of its payload.

A record's bytes are its header, the payload (a response) or nothing (a
revisit), and the end mark; :func:`records` rebuilds them with a join of the
two tables, and reading checks every stored payload against its address.
:func:`export_warc` writes the records as plain WARC files.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest
``page_id`` is the response and the others are revisits that refer to it. A
hot payload is aggregated before the shuffle (one row for each task and content),
and only narrow rows are joined on the digest.

Defined results: a null html is an empty payload; a null url leaves the target line out;
line breaks in a url are percent-encoded; a null page_id counts as smaller than any
id, and where no record of a content has an id all are responses; repeated rows of the largest id are all responses;
payloads under the limit are always responses (stored once all the same); an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 1_000
WARC_DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PAYLOADS = "sha256 string, payload_bytes long, sha1 string, payload binary"
_HEADERS = "sha256 string, header binary"


def _record_id(page):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = WARC_DATE) -> None:
    """Write the payload and header tables of ``pages`` (page_id, url, html) below ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"),
    )
    content = ["sha256", "payload_bytes", "sha1"]
    rows.groupBy(*content).agg(F.first("payload").alias("payload")).select("sha256", "payload_bytes", "sha1", "payload").write.parquet(f"{path}/payloads")

    narrow = rows.drop("payload")
    keepers = narrow.where(F.col("payload_bytes") >= min_revisit).groupBy(*content).agg(F.max("page_id").alias("keeper"))
    joined = narrow.join(keepers, content, "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("keeper"))))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    joined.select("sha256", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; reading one that does not match its address is an error."""
    stored = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1")) & (F.octet_length("payload") == F.col("payload_bytes"))
    return stored.withColumn("sha1", F.when(sound, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Header rows with their parsed fields."""
    text = F.col("header").cast("string")
    field = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return spark.read.schema(_HEADERS).parquet(f"{path}/headers").select(
        "sha256", "header",
        field(r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r\n").cast("long").alias("page_id"),
        field(r"\r\nWARC-Type: (\w+)\r\n").alias("record_type"),
        field(r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n").cast("long").alias("refers_to"),
        field(r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n").alias("header_digest"),
        field(r"\r\nContent-Length: (\d+)\r\n").cast("long").alias("content_length"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with the size and digests of its full payload, from headers joined with the verified payloads.

    The payload table is reduced to its verified measures before the join, so a hot payload is not multiplied.
    """
    measures = payloads(spark, path).select("sha256", "payload_bytes", "sha1")
    joined = headers(spark, path).join(measures, "sha256", "left")
    sound = (F.col("sha1") == F.col("header_digest")) & (F.col("content_length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes")))
    digest = F.when(sound, F.col("sha1")).otherwise(F.raise_error(F.lit("a header does not match its payload")))
    return joined.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "sha256")


def records(spark: SparkSession, path: str, full_revisits: bool = False) -> DataFrame:
    """(page_id, record_type, record): each record's exact bytes; with ``full_revisits`` a payload column is filled for revisits too."""
    h = headers(spark, path)
    p = payloads(spark, path).select("sha256", "payload", "sha1")
    joined = h.join(p, "sha256", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    out = joined.select(
        "page_id", "record_type", F.concat("header", body, F.lit(END).cast("binary")).alias("record"), F.col("payload"), F.col("sha1")
    )
    return out.drop("sha1") if full_revisits else out.drop("payload", "sha1")


def export_warc(spark: SparkSession, path: str, target: str, records_per_file: int = 10_000) -> None:
    """The records as plain WARC files. The end mark of a record is the writer's line separator."""
    text = records(spark, path).select(F.col("record").cast("string").alias("value"))
    text = text.select(F.expr(f"substring(value, 1, length(value) - {len(END)})").alias("value"))
    text.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(target)
