"""Content-addressed web archive: each distinct payload is stored once under its SHA-256, the exact record headers
are a table of their own, and records are rebuilt by joining the two.

Edge cases: a null html is the empty payload; a null url leaves WARC-Target-URI out, control characters and spaces in a
url are percent-encoded; a null page_id leaves the page headers out and reads back as null, and orders after every
number when the first of equal payloads is chosen; repeated rows are separate records, of which exactly one can be the
response; an empty table gives empty archives; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import new_path, written

# Fixed values of the archive format -------------------------------------------------------------
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_RFC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """Where the two tables lie: ``payloads`` (payload_sha256, payload), ``records`` (payload_sha256, header, stores)."""

    payloads: str
    records: str


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits as eight groups of 20."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), BASE32_PLAIN, BASE32_RFC)


def record_id(page_id: Column, rec: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), rec.cast("string")).cast("binary"))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, s, n) for s, n in at]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)))


def _clean_url(url: Column) -> Column:
    for ch, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        url = F.replace(url, F.lit(ch), F.lit(code))
    return url


def write_archive(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", revisit_from: int = 0) -> Archive:
    """Writes one record per row of ``pages`` (page_id, url, html); payloads under ``revisit_from`` bytes are never revisits.

    One shuffle carries payloads, and only one copy per payload and map task; digests, choice of the response and
    headers move fixed-width rows and headers only. A payload shared by a third of all rows meets its records in a join
    whose hot key Spark splits.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archive")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"))
    keyed = base.withColumn("payload_sha256", F.unhex(F.sha2("payload", 256)))
    where = Archive(f"{folder}/payloads", f"{folder}/records")
    keyed.groupBy("payload_sha256").agg(F.first("payload").alias("payload")) \
        .write.option("compression", "zstd").parquet(where.payloads)
    index = written(keyed.select("page_id", "url", "payload_sha256", F.octet_length("payload").cast("bigint").alias("n"),
                                 base32_sha1(F.col("payload")).alias("digest"), F.monotonically_increasing_id().alias("rec")), "index")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rec"))
    firsts = written(index.groupBy("payload_sha256").agg(first.alias("f"))
                     .select("payload_sha256", F.col("f.page_id").alias("first_page"), F.col("f.rec").alias("first_rec")), "firsts")
    revisit = (F.col("n") >= revisit_from) & (F.col("rec") != F.col("first_rec"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"),
                    F.lit(CRLF * 2))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("rec"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _clean_url(F.col("url"))), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("first_page"), F.col("first_rec")))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))), _line("X-Page-ID", F.col("page_id")),
        _line("X-Refers-To-Page-ID", F.when(F.col("revisit"), F.col("first_page"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))), F.lit(CRLF), http)
    index.join(firsts, "payload_sha256").withColumn("revisit", revisit) \
        .select("payload_sha256", header.alias("header"), (~F.col("revisit")).alias("stores")) \
        .write.option("compression", "zstd").parquet(where.records)
    return where


def open_archive(spark: SparkSession, where: Archive) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema("payload_sha256 binary, payload binary").parquet(where.payloads),
            spark.read.schema("payload_sha256 binary, header string, stores boolean").parquet(where.records))


def rebuild_records(spark: SparkSession, where: Archive) -> DataFrame:
    """Every record's exact bytes, block separator included: header, then the payload if the record stores it."""
    payloads, records = open_archive(spark, where)
    body = F.when(F.col("stores"), F.col("payload")).otherwise(F.lit("").cast("binary"))
    return records.join(payloads, "payload_sha256") \
        .select("payload_sha256", F.concat(F.col("header").cast("binary"), body, F.lit(CRLF * 2).cast("binary")).alias("record"))


def _field(name: str) -> Column:
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, where: Archive) -> DataFrame:
    """One row per record, read from its header and its stored payload; a payload that is missing or whose bytes no
    longer give the digests of its key and header fails the job."""
    payloads, records = open_archive(spark, where)
    facts = payloads.select("payload_sha256", F.unhex(F.sha2("payload", 256)).alias("found_sha256"),
                            F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    facts = written(facts, "facts")
    joined = records.join(facts, "payload_sha256", "left")
    same = F.col("payload_sha256").eqNullSafe(F.col("found_sha256")) & _field("WARC-Payload-Digest").eqNullSafe(
        F.concat(F.lit("sha1:"), "payload_digest"))
    return joined.select(
        _field("X-Page-ID").cast("bigint").alias("page_id"), "payload_bytes",
        F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), _field("X-Refers-To-Page-ID").cast("bigint").alias("refers_to"),
        _field("WARC-Target-URI").alias("target_uri"))
