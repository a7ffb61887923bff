"""Operator 2: a content-addressed WARC archive.

`payloads` holds each payload's bytes once, under their SHA-256; `records` holds every record's exact header bytes and the
digest of its payload.  Reading joins the two, verifies each payload against its digest and gives back the records as they
were written.  Of records with equal payloads of at least REVISIT_BYTES, the one with the largest id is the response and the
others are revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import load, work_path

REVISIT_BYTES = 1000
ID_PREFIX = "urn:page:"


def _bytes(text: Column) -> Column:
    return F.encode(text, "utf-8")


def _lines(*parts: Column) -> Column:
    return F.concat(*[F.concat(p, F.lit("\r\n")) for p in parts], F.lit("\r\n"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Archive `pages` (page_id, url, html) under `path`.

    Null html is an empty payload; a null url is an empty target; repeated rows are records of their own, and a null id never
    wins against one that is there.  Line breaks in a url are percent-encoded, as a header needs.  A payload of any length is one
    value of one row; an empty table gives an archive without records; other columns are not read.
    """
    payload = _bytes(F.coalesce(F.col("html"), F.lit("")))
    rows = pages.select(F.col("page_id"), F.col("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # one row per digest; equal payloads of a partition meet before the shuffle, so a hot payload is sent once a partition
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    owners = light.groupBy("digest").agg(F.max("page_id").alias("owner"))
    owners.write.parquet(f"{path}/owners")
    owners = pages.sparkSession.read.parquet(f"{path}/owners")
    # both sides are shuffled for this join alone, so a digest with very many records can be split
    joined = light.join(owners, "digest")
    revisit = (F.col("n") >= REVISIT_BYTES) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("n").cast("string")))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    refers = F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _record_id(F.col("owner")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise("")
    warc = _lines(
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id")), refers), F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), size.cast("string")),
    )
    joined.select("digest", _bytes(warc).alias("header"), _bytes(http).alias("http")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, http, payload) of every record, the payload verified against its digest."""
    payloads = spark.read.parquet(f"{path}/payloads")
    broken = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))
    checked = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(broken.cast("binary")).alias("payload"))
    return spark.read.parquet(f"{path}/records").join(checked, "digest").select("header", "http", "payload")


def warc_field(name: str) -> Column:
    """A field of the WARC header; null where it has none."""
    found = F.regexp_extract(F.decode("header", "utf-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def record_bytes(archive: DataFrame) -> DataFrame:
    """Adds `record`, the bytes of a WARC file's record; a revisit holds no payload."""
    block = F.when(warc_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.withColumn("record", F.concat("header", "http", block, F.lit(b"\r\n\r\n")))


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a WARC file's records."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        out.append((fields, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each page, all of it read from headers and payloads."""
    page = lambda field: F.try_to_number(F.regexp_extract(warc_field(field), rf"<{ID_PREFIX}(-?\d+)>", 1), F.lit("S9999999999999999999")).cast("long")
    return read_archive(spark, path).select(
        page("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), warc_field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "archive")
    write_archive(load(spark, sf_dir, "pages"), path)
    return archived_pages(spark, path)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t) AS n, t, max(page_id) OVER (PARTITION BY t) AS owner FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> owner THEN owner END AS refers_to
FROM q
"""
