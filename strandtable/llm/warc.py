"""A content-addressed WARC archive in two tables, native DataFrame work throughout.

``write`` stores the payload bytes of each distinct SHA-256 digest once (``payloads``), and the exact
header of every record (``headers``). ``read`` joins them again: the digests and the length are computed
anew from the stored bytes, the rest is parsed from the headers, and ``record`` is the original record.
The digests of a damaged store no longer match, and the read fails instead of returning other bytes.

Equal payloads of at least ``least_bytes`` bytes are stored as one response (smallest page_id) and revisits
that refer to it; smaller ones are all responses. Records of one page_id and payload are one page seen
twice: they get the same type.

Scale. Payloads cross the network once, after one copy of each digest is left in every map task; which
record is the response is decided on digests and ids alone, and the largest group of copies is combined
before its shuffle. Reading joins narrow rows unless the record bytes are asked for.

Nulls and odd rows: a null html is an empty payload; a null url leaves its header line out; null page_ids
have an empty place in their record id, never become the response of others, and read back as null; line ends
in a url are escaped. Extra columns are ignored. An empty table makes an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

# The profile of revisits with an equal payload; the letters of two bases.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a SHA-1's 40 hexadecimal digits: ten digits make eight."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def write(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, date: str | None = None) -> Archive:
    """Write one record for each row of ``pages`` (page_id, url, html); ``date`` (ISO, UTC) is that of the write if not given.

    A record's id names its page and, so that a page seen twice has two, a digest of payload and row.
    """
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = Archive(f"{folder}/headers", f"{folder}/payloads")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(made.payloads)

    meta = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), base32(F.sha1("payload")).alias("sha1"))
    meta = table(meta.withColumn("row", F.monotonically_increasing_id()), "warc-meta")
    name = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.concat_ws(":", "digest", "row").cast("binary")), F.lit(">"))
    meta = meta.withColumn("name", name)
    least = meta.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "name")).alias("least"))
    least = least.select("digest", F.col("least.page_id").alias("first"), F.col("least.name").alias("first_name"))
    meta = meta.join(least, "digest", "left")
    again = F.coalesce(F.col("n") >= least_bytes, F.lit(False)) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("name")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", F.col("first_name")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("Content-Length", F.when(again, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    meta.select(header.alias("header"), "digest").write.parquet(made.headers)
    return made


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record."""
    store = spark.read.parquet(archive.payloads)
    true = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(true, F.col("digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")))
    store = store.select(checked.cast("string").alias("key"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    heads = spark.read.parquet(archive.headers)
    part = lambda name, pattern: F.regexp_extract("header", rf"(?:^|\n){name}: {pattern}\r\n", 1)
    some = lambda c: F.when(c != "", c)
    heads = heads.select(
        "digest", "header",
        some(part("WARC-Record-ID", "<urn:x-page:(-?\\d*):\\w+>")).cast("long").alias("page_id"),
        F.when(F.col("header").contains("\nWARC-Target-URI: "), part("WARC-Target-URI", "([^\\r\\n]*)")).alias("url"),
        part("WARC-Type", "(\\w+)").alias("record_type"),
        some(part("WARC-Refers-To", "<urn:x-page:(-?\\d*):\\w+>")).cast("long").alias("refers_to"),
        part("WARC-Payload-Digest", "sha1:(\\w+)").alias("said"),
    )
    rows = heads.join(store, heads["digest"] == store["key"])
    same = F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest does not match its payload")))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n"))
    return rows.select("page_id", "url", "record_type", "refers_to", "payload_bytes", same.cast("string").alias("payload_digest"), "payload", record.alias("record"))


def export(spark: SparkSession, archive: Archive, path: str) -> None:
    """Write the records as plain WARC text files, for archives whose payloads are text."""
    lines = read(spark, archive).select(F.decode(F.expr("substring(record, 1, length(record) - 4)"), "UTF-8").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").text(path)
