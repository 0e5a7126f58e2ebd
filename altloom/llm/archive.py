"""A content-addressed WARC archive.

The archive is two written tables. ``payloads`` holds the bytes of each
different payload once, under its SHA-256. ``headers`` holds the exact header
bytes of each record and the digest its payload is kept under. A record is put
together again by joining the two, and nothing else is needed to read the
archive.

Of the records whose payloads are equal, the one with the smallest page_id is
the response; the others revisit it. Payloads below ``least`` bytes are all
responses. Equality is that of SHA-256, SHA-1 and length together; on reading,
each payload's bytes are digested again and a payload that does not have the
digest it is kept under is an error.

Digests are taken where the pages are scanned, and who is first is decided on
digests alone. Payload bytes move once, to the task that writes them.

Fields of a record are read line by line from its header's bytes. Control
characters of an address are percent-encoded, so that no address can add a
line.

Nulls: a null payload is an empty one; null ids come last. A null address is
written as an empty one. Repeated rows with one id and one payload share a
header. An empty table gives an archive without records.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from altloom.llm.base import picked, read, whole
from altloom.session import materialize, shared_folder

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    headers: str
    payloads: str


def base32(digest: Column) -> Column:
    """The 160 bits of a hex digest in 32 characters, by groups of 20 bits."""
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page_id: Column) -> Column:
    h = F.sha2(F.coalesce(page_id.cast("string"), F.lit("null")).cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def address(url: str) -> Column:
    """The address with its control characters percent-encoded."""
    given = F.coalesce(url, F.lit(""))
    out = given
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(given.rlike("[\\x00-\\x1f\\x7f]"), out).otherwise(given)


def field(lines: Column, name: str) -> Column:
    """The value of a header line, null where there is none."""
    found = F.get(F.filter(lines, lambda line: line.startswith(f"{name}: ")), F.lit(0))
    return F.substr(found, F.lit(len(name) + 3))


def header(kind: str, date: str) -> Column:
    """The header lines of a record of one kind, as they stand in the file."""
    lines = [
        F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), address("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
    ]
    if kind == "revisit":
        lines += [
            F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first_id"))),
            F.concat(F.lit("X-Refers-To-Page: "), F.col("first_id").cast("string")), F.lit("Content-Length: 0"),
        ]
    else:
        lines += [F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")


def write(pages: DataFrame, least: int = 0, date: str = DATE) -> Archive:
    """Write the archive of pages (page_id, url, html) to the shared folder."""
    spark = pages.sparkSession
    body = whole("html").cast("binary")
    named = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("sha"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("bytes"))
    rows = materialize(named.drop("html"))
    key = ["sha", "sha1", "bytes"]
    first = rows.groupBy(*key).agg(F.min("page_id").alias("first_id"))
    met = rows.join(first.select(*[F.col(c).alias(f"of_{c}") for c in key], "first_id"), [F.col(c) == F.col(f"of_{c}") for c in key])
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    archive = Archive(*(f"{shared_folder(spark)}/altloom-{part}-{uuid.uuid4().hex}" for part in ("headers", "payloads")))
    met.select(
        "page_id", F.when(revisit, header("revisit", date)).otherwise(header("response", date)).alias("header"),
        F.unhex("sha").alias("payload_sha"),
    ).write.parquet(archive.headers)

    stays = first.select(F.col("first_id").alias("page_id"), "sha")
    picked(named.select("page_id", "sha", "html"), stays, ["page_id", "sha"]).select(
        F.unhex("sha").alias("payload_sha"), body.alias("payload")
    ).write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, header and payload of every record, with what the payload's bytes say of themselves."""
    payloads = spark.read.parquet(archive.payloads).select(
        F.col("payload_sha").alias("of"), "payload", F.octet_length("payload").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"), F.unhex(F.sha2("payload", 256)).alias("found_sha"),
    )
    met = spark.read.parquet(archive.headers).join(payloads, F.col("payload_sha") == F.col("of"))
    told = F.when(F.col("found_sha") == F.col("of"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a payload does not have the digest it is kept under"))
    )
    read = met.withColumn("lines", F.split(F.col("header").cast("string"), "\r\n"))
    return read.select(
        "page_id", "header", "payload", F.col("payload_bytes").cast("long").alias("payload_bytes"), told.alias("payload_digest"),
        field(F.col("lines"), "WARC-Type").alias("record_type"),
        F.substring_index(field(F.col("lines"), "WARC-Payload-Digest"), "sha1:", -1).alias("header_digest"),
        field(F.col("lines"), "X-Refers-To-Page").cast("long").alias("refers_to"), field(F.col("lines"), "WARC-Target-URI").alias("address"),
    )


def record_bytes(rows: DataFrame) -> DataFrame:
    """The records as they stand in a WARC file: header, block, two line ends. A revisit has no block."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def op8_archive(spark, sf_dir: str) -> DataFrame:
    archive = write(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    rows = records(spark, archive)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("header_digest") == F.col("payload_digest")).alias("agrees"))


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('{ALPHABET}', ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS agrees
FROM d
"""
