"""A content-addressed WARC archive in two tables: payloads once each by digest, exact record headers by themselves.

``write`` makes a record of every page. Its header block (WARC fields and the HTTP header of the response, to
the byte) goes to ``records``; its payload goes to ``payloads`` under its SHA-256, once. Of records with equal
payloads of at least ``REVISIT_FROM`` bytes, that with the smallest page_id is a response and the others are
revisits that name it; smaller payloads are always responses, though their bytes too are stored once.
``read`` checks every stored payload against its digest and joins it to the headers, of which it parses what it
returns; ``reconstruct`` puts the original records together, of which a revisit has no payload of its own.

Scale: digests are computed where pages are read. Payloads are shuffled once, by digest and page_id, so copies
of one payload are spread, and only the stored copy of each leaves that step. The join of headers with digests
carries no payload; its smaller side is a table of its own, so that Spark can split a digest that very many
records share. No Python runs.

Cases: a null html is an empty payload. Records with a null page_id are responses, named by their digest, and are nobody's smallest.
Rows that repeat the smallest page_id of their payload are all responses. Line breaks in a url are percent-encoded,
a null url has no target field. A payload that does not match its digest makes ``read`` fail. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

REVISIT_FROM = 100
DATE = "1970-01-01T00:00:00Z"


def _header(kind: Column, page_id: Column, url: Column, digest: Column, size: Column, refers: Column) -> Column:
    """WARC fields and HTTP header of a record, as bytes."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    length = F.length(http) + F.when(kind == "revisit", 0).otherwise(size)
    target = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    fields = [
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.coalesce(F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">")), F.concat(F.lit("<urn:sha256:"), digest, F.lit(">")))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", target),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))),
        field("WARC-Profile", F.when(kind == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
    ]
    return F.concat(F.lit("WARC/1.1\r\n"), *fields, F.lit("\r\n"), http).cast("binary")


def write(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM) -> None:
    """The archive of pages (page_id, url, html) in folder/records and folder/payloads."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    page = page.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63))))  # of equal payloads any row's will do
    first = runtime.stored(page.groupBy("digest").agg(F.min("page_id").alias("first"), F.min("key").alias("key")), "warc-first")
    kept = page.select("digest", "key", "payload").join(first.select("digest", "key"), ["digest", "key"]).dropDuplicates(["digest", "key"])
    kept.select("digest", "payload").write.parquet(f"{folder}/payloads")
    record = page.select("page_id", "url", "digest", "size").join(first.select("digest", "first"), "digest", "left")
    again = (F.col("size") >= revisit_from) & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    header = _header(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), F.when(again, F.col("first")))
    record.select(header.alias("header"), "digest").write.parquet(f"{folder}/records")


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads; one whose bytes do not have its digest raises an error."""
    stored = spark.read.parquet(f"{folder}/payloads")
    ok = F.sha2("payload", 256) == F.col("digest")
    return stored.withColumn("checked", F.when(ok, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest"))))


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the headers and the stored payloads."""
    header = F.col("header").cast("string")
    number = r"urn:page:(-?\d+)"
    records = spark.read.parquet(f"{folder}/records").select(
        F.nullif(F.regexp_extract(_field(header, "WARC-Record-ID"), number, 1), F.lit("")).cast("long").alias("page_id"),
        F.regexp_extract(_field(header, "WARC-Payload-Digest"), "sha256:(.*)", 1).alias("digest"),
        _field(header, "WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(_field(header, "WARC-Refers-To"), number, 1), F.lit("")).cast("long").alias("refers_to"),
    )
    payloads = verified_payloads(spark, folder).select("digest", F.col("checked").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    return records.join(payloads, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """header, payload, resolved of every original record: header and payload are its bytes, so a revisit's payload is empty; resolved is that of the record it names, or its own."""
    payloads = verified_payloads(spark, folder).select("checked", F.col("payload").alias("resolved"))
    again = _field(F.col("header").cast("string"), "WARC-Type") == "revisit"
    rows = spark.read.parquet(f"{folder}/records").join(payloads, F.col("digest") == F.col("checked"))
    return rows.select("header", F.when(again, F.lit("").cast("binary")).otherwise(F.col("resolved")).alias("payload"), "resolved")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive, and what is read back from it."""
    folder = runtime.fresh_path(spark, "warc")
    write(runtime.table(spark, sf_dir, "pages"), folder)
    return read(spark, folder)


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p),
r AS (SELECT *, coalesce(payload_bytes >= 100 AND page_id <> first_page, false) AS again FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_page END AS refers_to FROM r
"""
